"""Where models and stores of one's own plug in: each seam with a stand-in, the caches, and what a store keeps."""

import uuid

import pytest
from pyspark.sql import functions as F

from sedgeway.config import Scope, WarehouseConfig
from sedgeway.operators import answer, chunking, context
from sedgeway.operators.store import Conflict
from sedgeway.plans import engine as E
from sedgeway.functions import codec
from sedgeway.sources import files, models
from tests.test_engine import sources


def made(spark, path, **seams):
    e = E.Engine(spark, WarehouseConfig(str(path), 32, buckets=3), seams=E.Seams(**seams))
    e.migrate()
    return e


def test_rewriter(spark):
    rows = [(1, "its price?", [("What is Acme?", "A plan.")]), (2, "alone?", []), (3, "mute?", [("a", "b")]), (4, "null?", None)]
    df = spark.createDataFrame(rows, "id long, q string, h array<struct<question:string,answer:string>>")
    model = lambda q, t: q.where(q.eq("mute?"), t.str.replace("\n", "/") + "/" + q).where(~q.eq("mute?"), " ")
    got = {r["id"]: r["x"] for r in df.select("id", answer.rewrite_with(F.col("q"), F.col("h"), model).alias("x")).collect()}
    assert got == {1: "User: What is Acme?/Assistant: A plan./its price?", 2: "alone?", 3: "mute?", 4: "null?"}


def test_contextualizer(spark):
    df = spark.createDataFrame([("a chunk", "the whole"), ("b", "w")], "t string, f string")
    model = lambda f, t: t.map(lambda x: " about it " if x == "a chunk" else "  ")
    assert [r["x"] for r in df.select(context.contextualized(F.col("t"), F.col("f"), model).alias("x")).collect()] == ["about it\n\na chunk", "b"]


def test_chunker_and_classifier(spark, tmp_path):
    lines = lambda text, size, overlap: [(["by line"], x) for x in text.split("\n")]
    e, s = made(spark, tmp_path, chunker=lines, classifier=lambda pages: F.when(F.col("text").contains("scan"), "vision").otherwise(F.col("route"))), Scope("s")
    got = e.ingest(s, sources(spark, a_txt="one\ntwo\nthree", b_txt="scan")).collect()
    assert {(r["source"], r["chunk_count"], r["vision_pages"]) for r in got} >= {("a.txt", 3, 0)} and sum(r["vision_pages"] for r in got) == 1
    assert {r["text"] for r in e.store.read("chunks", s).where("headings[0] = 'by line'").collect()} >= {"one", "two", "three"}


def test_streaming(spark, tmp_path):
    e, s = made(spark, tmp_path), Scope("s")
    e.ingest(s, sources(spark, a_txt="Berlin hosts the archive."))
    said = list(e.stream(s, "Which archive?", lambda prompt: iter(["In ", "", "Berlin [1]", " "] if "Berlin hosts" in prompt else ["?"])))
    assert said == [("token", "In "), ("token", "Berlin [1]"), ("token", " "), ("complete", "In Berlin [1]")]
    assert list(e.stream(s, "zebra?", lambda prompt: iter(["x"]))) == [("complete", answer.NOT_FOUND)]


def test_parse_cache(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def parser(content):
        (marks / uuid.uuid4().hex).write_text("parsed")
        if b"bad" in content:
            raise ValueError("bad")
        return [content.decode().upper()]

    e = made(spark, tmp_path / "wh", parsers={"text": parser})
    e.ingest(Scope("a"), sources(spark, a_txt="alpha", b_txt="bad one"))
    assert len(list(marks.iterdir())) == 2
    # another namespace: what was parsed is known, what failed is tried again
    got = {r["source"]: r for r in e.ingest(Scope("b"), sources(spark, x_txt="alpha", y_txt="bad one", z_txt="gamma")).collect()}
    assert len(list(marks.iterdir())) == 4 and got["y.txt"]["error"] and got["x.txt"]["chunk_count"] == got["z.txt"]["chunk_count"] == 1
    assert {r["text"] for r in e.store.read("chunks", Scope("b")).collect()} == {"ALPHA", "GAMMA"}
    # other parsers under another version
    other = made(spark, tmp_path / "wh", parsers={"text": lambda c: [c.decode()]}, version="2")
    other.ingest(Scope("c"), sources(spark, a_txt="alpha"))
    assert other.store.read("chunks", Scope("c")).first()["text"] == "alpha"


def test_store_keeps_what_it_should(spark, tmp_path):
    e, s, t = made(spark, tmp_path / "wh"), Scope("one/two"), Scope("t")
    e.ingest(s, sources(spark, **{f"f{k}_txt": f"text number {k}" for k in range(7)}))
    ids = sorted(r["document_id"] for r in e.store.read("documents", s).collect())
    assert len(ids) == 7 and e.store.namespaces() == ["one/two"] and e.store.stored_width() == 32
    assert e.store.get(s, ids[0]).first()["document_id"] == ids[0] and e.store.get(s.with_filters(document_ids=[]), ids[0]).count() == 0 and e.store.get(t, ids[0]).count() == 0
    before = e.store._manifest(s.namespace)
    e.delete_document(s, ids[0])
    after = e.store._manifest(s.namespace)
    same = [b for b in before[1]["chunks"] if before[1]["chunks"][b] == after[1]["chunks"].get(b)]
    assert len(same) == len(before[1]["chunks"]) - 1  # just the document's bucket was written anew
    assert sorted(r["document_id"] for r in e.store.read("chunks", s).collect()) == ids[1:]
    e.store.snapshot(s, str(tmp_path / "snap"))
    e.store.restore(t, str(tmp_path / "snap"))
    assert {(r["namespace"], r["text"]) for r in e.store.read("chunks", t).collect()} == {("t", r["text"]) for r in e.store.read("chunks", s).collect()}
    with pytest.raises(Conflict):
        e.store._publish(s.namespace, after[0] - 1, after[1])
    for statement in e.store.ddl():
        spark.sql(statement)
    assert spark.table("sedgeway.t_documents").count() == 6
    spark.sql("DROP DATABASE sedgeway CASCADE")
    e.purge(s)
    assert e.store.namespaces() == ["t"] and e.store.read("chunks", s).count() == 0


def test_trace_details(spark, tmp_path):
    import json

    e, s = made(spark, tmp_path), Scope("s")
    e.ingest(s, sources(spark, a_txt="Alpha beta.", b_txt="Alpha gamma."))
    q = spark.createDataFrame([(1, "alpha beta?"), (2, "thanks")], "query_id long, question string")
    rows = e.context(q, e.store.read("chunks", s))
    found = rows.select("query_id", "chunk_id").unionByName(spark.createDataFrame([(1, "lost:0")], "query_id long, chunk_id string"))
    spans = {(r["query_id"], r["name"]): json.loads(r["detail"]) for r in E.trace(q, rows, e.ask(s, q), "t", found).collect()}
    placed = [r["chunk_id"] for r in rows.where("query_id = 1").orderBy("marker").collect()]
    assert spans[1, "retrieve"]["candidates"] == len(placed) + 1 and spans[1, "rerank"]["dropped"] == ["lost:0"] and spans[1, "prompt"] == {"sources": len(placed), "ids": placed}
    assert spans[1, "generate"]["grounded"] and spans[1, "generate"]["citations"] >= 1 and spans[2, "converse"]["outcome"] == "conversational" and len([k for k in spans if k[0] == 2]) == 1


def test_sentences_end_with_their_line():
    assert context.sentences("One. Two\n- item a\n\n- item b! Three") == ["One.", "Two", "- item a", "- item b!", "Three"]


def test_parts_far_behind(spark):
    far = b"PK\x03\x04" + b"x" * 9000 + b"ppt/slides/slide1.xml"
    df = spark.createDataFrame([(bytearray(far),), (bytearray(b"PK\x03\x04" + b"y" * 9000 + b"word/document.xml"),), (bytearray(b"PK\x03\x04zip"),)], "c binary")
    assert [r["f"] for r in df.select(files.from_content(F.col("c")).alias("f")).collect()] == ["pptx", "docx", None]


def test_new_sources(spark):
    rows = [("n", "h1", 3, b"a"), ("n", "h1", 1, b"a"), ("n", "h2", 5, b"b"), ("n", "h2", 5, b"b"), ("m", "h1", 9, b"a"), ("n", "h3", 2, b"c")]
    every = spark.createDataFrame(rows, "namespace string, content_hash string, ingest_seq long, content binary")
    got = files.new_sources(every, every.where("content_hash = 'h3'")).collect()
    assert sorted((r["namespace"], r["content_hash"], r["ingest_seq"]) for r in got) == [("m", "h1", 9), ("n", "h1", 1), ("n", "h2", 5)]


def test_chunk_page_is_the_default(spark):
    pages = spark.createDataFrame([("d", 1, "# A\n\nbody")], "document_id string, page int, text string")
    assert chunking.markdown_chunks(pages).first()["text"] == "body"


def test_context_cache(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def model(documents, chunks):
        for _ in chunks:
            (marks / uuid.uuid4().hex).write_text("asked")
        return chunks.map(lambda t: f"about {t}")

    e = made(spark, tmp_path / "wh", contextualizer=model)
    for name in ("a", "b"):
        e.ingest(Scope(name), sources(spark, a_txt="alpha", b_txt="beta"))
    assert len(list(marks.iterdir())) == 2
    assert {r["embed_text"] for r in e.store.read("chunks", Scope("b")).collect()} == {"about alpha\n\nalpha", "about beta\n\nbeta"}


def test_changes_seen_together(spark, tmp_path):
    e, s = made(spark, tmp_path), Scope("s")
    e.ingest(s, sources(spark, a_txt="alpha", b_txt="beta", c_txt="gamma"))
    ids = sorted(r["document_id"] for r in e.store.read("documents", s).collect())
    outside = E.Store(spark, e.config)
    with e.store.changing(s) as store:
        for i in ids[:2]:
            store.delete_document(s, i)
        assert store.read("documents", s).count() == 1 and outside.read("documents", s).count() == 3
    assert outside.read("documents", s).count() == 1
    with pytest.raises(KeyError), e.store.changing(s) as store:
        store.delete_document(s, ids[2])
        raise KeyError
    assert outside.read("documents", s).count() == e.store.read("documents", s).count() == 1


def test_models():
    import pandas as pd

    m = models.Model("generate", "any-model", key="k", max_tokens=9)
    assert m.calling(lambda model, p: [{"type": "text", "text": p}, {"type": "image"}, "!"])(pd.Series(["a", "b"])).tolist() == ["a!", "b!"]
    with pytest.raises(models.MissingKey):
        models.Model("embed", "x").calling(lambda m, p: p)(pd.Series(["a"]))
    for bad in ({"role": "x"}, {"name": " "}, {"timeout_seconds": 0}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            models.Model(**({"role": "embed", "name": "m"} | bad))
    assert models.reply_text(None) == "" and models.reply_text("t") == "t" and models.reply_text(type("R", (), {"content": ["a", {"type": "text", "text": 3}]})()) == "a"
    assert models.location("s3://b/x/") == "s3://b/x" and models.location("/tmp/w") == "file:///tmp/w" and models.location("file:/x") == "file:/x"
    for bad in ("", "s3://", "://x"):
        with pytest.raises(ValueError):
            models.location(bad)


def test_codec(spark):
    pages = spark.createDataFrame([([(1, "é\n", "r", bytearray(b"\x00\xff"), 3, 0.5, 7.0), (2, None, None, None, None, None, None)],)], codec.PAGES.replace("image_data:string", "image_data:binary").join(["p ", ""]))
    text = pages.select(codec.encode_pages(F.col("p")).alias("j"), "p")
    assert text.select((codec.decode_pages(F.col("j")) == F.col("p")).alias("same")).first()["same"]
    broken = spark.createDataFrame([("nothing",), ("[{",)], "j string").select(codec.decode_pages(F.col("j")).alias("x"), codec.decode_chunk(F.col("j")).alias("y")).collect()
    assert [r["y"] for r in broken] == [None, None] and not any(r["x"] for r in broken)
    chunk = spark.sql(f"select cast(named_struct('a', 'c:0', 'b', 'c', 'd', 't', 'e', null, 'f', 1, 'g', 0, 'h', array(0.5D), 'i', 'm', 'j', array('h'), 'k', map('x', 'y')) as {codec.CHUNK}) as c")
    assert chunk.select(codec.decode_chunk(codec.encode_chunk(F.col("c"))).alias("d"), "c").first()["d"] == chunk.first()["c"]

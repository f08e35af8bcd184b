"""Retrieval operators on small literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeway.operators import embedding, layout, retrieval as R


def ranked(df):
    return [(r["query_id"], r["chunk_id"], r["rank"]) for r in df.orderBy("query_id", "rank").collect()]


CHUNKS = [("a:0", "a", 1, 0, "Paris is the capital of France"), ("b:0", "b", 1, 0, "Lyon is a French city"), ("c:0", "c", 1, 0, "the capital markets of Paris"), ("d:0", "d", 1, 0, "")]


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, page int, ordinal int, text string")


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")


def test_lexical(spark, chunks):
    q = questions(spark, "the capital of France", "and or", "", "!!!", "zebra")
    assert ranked(R.lexical_topk(q, chunks)) == [(0, "a:0", 0), (0, "c:0", 1)]
    assert ranked(R.lexical_topk(q, chunks, match_all=True)) == [(0, "a:0", 0)]
    assert ranked(R.lexical_topk(q, chunks, 1)) == [(0, "a:0", 0)]


@pytest.mark.parametrize("odd", ["", "   ", '"', "-", "and or", "!!!", "a -"])
def test_odd_queries(spark, chunks, odd):
    assert R.lexical_topk(questions(spark, odd), chunks).count() == 0 and R.bm25_topk(questions(spark, odd), chunks).count() == 0


def test_bm25(spark, chunks):
    got = R.bm25_topk(questions(spark, "capital Paris"), chunks).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c:0", "a:0"] and all(r["score"] > 0 for r in got)


def test_joined_like_travelling(spark, chunks, monkeypatch):
    q = questions(spark, "capital Paris", "the capital of France", "zebra", "French city markets capital", "")
    near = {f.__name__: ranked(f(q, chunks)) for f in (R.lexical_topk, R.bm25_topk)}
    fused = ranked(R.fuse(R.lexical_channels(q, chunks)))
    whole = ranked(R.lexical_topk(q, chunks, match_all=True))
    assert fused == ranked(R.fuse([R.bm25_topk(q, chunks), R.lexical_topk(q, chunks)]))
    monkeypatch.setattr(R, "TRAVEL_ROWS", 1)
    assert near == {f.__name__: ranked(f(q, chunks)) for f in (R.lexical_topk, R.bm25_topk)}
    assert fused == ranked(R.fuse(R.lexical_channels(q, chunks))) and whole == ranked(R.lexical_topk(q, chunks, match_all=True))


def test_many_steps(spark, monkeypatch):
    """A task that scores a few chunks at a time, ties and all, gives what it gives in one step."""
    rows = spark.createDataFrame([(f"c{i % 37}:{i}", f"w{i % 3} w{i % 5} w{i % 7} same") for i in range(150)], "chunk_id string, text string").repartition(3)
    q = questions(spark, "w1 w2 same", "w0", "w6 w4 w2 w1", "none")
    one = [ranked(R.lexical_topk(q, rows, 4)), ranked(R.bm25_topk(q, rows, 4))]
    monkeypatch.setattr(R, "SCORES", 20)
    assert one == [ranked(R.lexical_topk(q, rows, 4)), ranked(R.bm25_topk(q, rows, 4))]
    brute = [(a, c, r) for a, words in ((0, {"w1", "w2", "same"}), (1, {"w0"}), (2, {"w6", "w4", "w2", "w1"}))
             for r, (c, _) in enumerate(sorted(((x["chunk_id"], -len(words & set(x["text"].split()))) for x in rows.collect() if words & set(x["text"].split())), key=lambda t: (t[1], t[0]))[:4])]
    assert one[0] == brute


def test_what_a_task_holds():
    """Common words that many questions ask for are expanded some pairs at a time, however large a batch is."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{i}" for i in range(40)]
    asked = pa.table({"query_id": [q for q in range(100) for _ in words], "token": words * 100, "n_terms": pa.array([40] * 4000, pa.int32())})
    tokens = pa.array([words[i % 7 :] for i in range(6000)])
    batch = pa.record_batch([pa.array([f"c{i:05}" for i in range(6000)]), tokens], names=["chunk_id", "_tokens"])
    run = R._scorer(R._Terms(asked), (R.OVERLAP,), 3, True, ["chunk_id"], ["chunk_id"], None)
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == 300 and set(found["chunk_id"].to_pylist()) == {"c00000", "c00007", "c00014"}
    assert most < 200e6  # 22 million pairs take some 530 MB at once


def test_filter(spark, chunks):
    assert R.narrowed(chunks, ["a", "c"]).count() == 2 and R.narrowed(chunks, []).count() == 0 and R.narrowed(chunks, None).count() == 4


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id long, chunk_id string, rank int")
    lexical = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], "query_id long, chunk_id string, rank int")
    got = R.fuse([dense, lexical]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"]
    assert got[0]["score"] == pytest.approx(1 / 60 + 1 / 61, abs=1e-11) and got[1]["score"] == pytest.approx(1 / 60, abs=1e-11)
    tie = R.fuse([dense.where("chunk_id = 'a'"), lexical.where("chunk_id = 'b'")]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tie] == ["a", "b"]


@pytest.mark.parametrize("n", range(1, 12))
def test_edges(spark, n):
    rows = spark.createDataFrame([(1, str(i), i) for i in range(n)], "query_id long, chunk_id string, rank int")
    got = [r["chunk_id"] for r in R.edges(rows).orderBy("marker").collect()]
    order = [str(i) for i in range(n)]
    assert got == order[::2] + order[1::2][::-1] and got[0] == "0"


def test_rerank_gate(spark):
    rows = [(1, "alpha beta gamma", "x", "alpha", 0), (1, "alpha beta gamma", "y", "alpha beta", 1), (1, "alpha beta gamma", "z", "other", 2), (1, "alpha beta gamma", "w", "beta", 3), (2, "the of", "x", "the of", 0)]
    df = spark.createDataFrame(rows, "query_id long, question string, chunk_id string, text string, rank int")
    top = R.rerank(df)
    assert ranked(top) == [(1, "y", 0), (1, "x", 1), (1, "w", 2)]
    assert ranked(R.gate(top, 0.5, 3)) == [(1, "y", 0)] and ranked(R.gate(top, 0.0, 2)) == [(1, "y", 0), (1, "x", 1)]
    assert ranked(R.rerank_with(df, lambda q, t: t.str.len().astype(float), 2)) == [(1, "y", 0), (1, "x", 1), (2, "x", 0)]


def test_dense(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "chunk_id long, vector array<double>")
    q = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    scores = np.round(x @ x.T, 6)
    want = [(a, int(b), r) for a in (0, 20, 40) for r, b in enumerate([b for b in sorted(range(60), key=lambda b: (-scores[a, b], b)) if scores[a, b] > 0][:5])]
    assert ranked(R.dense_topk(q, rows, 5)) == want
    assert R.dense_topk(q.where("false"), rows, 5).count() == 0
    negative = spark.createDataFrame([(1, [-1.0, 0.0])], "chunk_id long, vector array<double>")
    one = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    assert R.dense_topk(one, negative).count() == 0 and R.dense_topk(one, negative, positive_only=False).first()["score"] == -1.0


def test_dense_grid(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 4)))] + [(99, None)], "chunk_id long, vector array<double>")
    q = rows.where("chunk_id < 23").select(F.col("chunk_id").alias("query_id"), "vector")
    one = ranked(R.dense_topk(q, rows, 3))
    monkeypatch.setattr(R, "BLOCK_NUMBERS", 28)
    assert one == ranked(R.dense_topk(q, rows, 3))
    monkeypatch.setattr(R, "TRAVEL_NUMBERS", 0)
    assert one == ranked(R.dense_topk(q, rows, 3))


def test_postings_hold_no_chunks(spark, tmp_path):
    """Tokens are the only key that is counted by; figures are those of the SQL."""
    import duckdb
    from sedgeway.plans import queries

    rows = [(1, "a b a c", "s"), (2, "a b a c", "s"), (3, " ".join(f"w{i % 90}" for i in range(1500)), "s"), (4, "", "s"), (5, "... !", "s"), (6, None, "s"), (7, "C c A", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["postings"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "chunk_id" in x]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    con.execute("create table benchmark(item_id bigint, text varchar)")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(queries.ORACLES["postings"]).fetchall())


def test_sparse_shuffles_texts_not_tokens(spark):
    """Rows of one key count as one text; a plan has one shuffle, by key."""
    df = spark.createDataFrame([(1, "cat the"), (1, "the"), (2, "dog"), (3, None)], "id long, text string")
    rows = embedding.sparse(df, ["id"], F.col("text"), 16)
    one = {r["bucket"]: r["weight"] for r in embedding.sparse(spark.createDataFrame([(1, "the cat the")], "id long, text string"), ["id"], F.col("text"), 16).collect()}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    got = rows.collect()
    assert {r["bucket"]: r["weight"] for r in got if r["id"] == 1} == pytest.approx(one) and {r["id"] for r in got} == {1, 2}
    assert plan.count("Exchange hashpartitioning") == 1
    alone = embedding.sparse(df.where("id > 1"), ["id"], F.col("text"), 16, distinct=True)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["bucket"], r["weight"]) for r in alone.collect()] == [(2, embedding.bucket("dog", 16), 1.0)]


def test_lsh_recall(spark):
    from tests.conftest import DATA

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["chunk_id"]) for r in R.dense_topk(q, rows, 10).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in R.lsh_topk(q, rows, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_lsh_candidates(spark, monkeypatch):
    """The candidates of a brute reading of the buckets, without a join: also in steps, in blocks and as a grid."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "chunk_id long, vector array<double>").repartition(3)
    q = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    planes = np.random.default_rng(7).standard_normal((2, 6, 6))
    bits = np.einsum("nw,tbw->ntb", x, planes) > 0
    scores = np.round(x @ x.T, 6)
    want = []
    for a in range(0, 300, 20):
        near = [b for b in range(300) if min((bits[a] != bits[b]).sum(axis=1)) <= 1]
        want += [(a, b, r) for r, b in enumerate(sorted(near, key=lambda b: (-scores[a, b], b))[:7])]
    find = lambda: R.lsh_topk(q, rows, 7, tables=2)
    assert ranked(find()) == want
    assert "Join" not in find()._jdf.queryExecution().toString()
    monkeypatch.setattr(R, "SCORES", 40)
    monkeypatch.setattr(R, "PAIRS", 30)
    monkeypatch.setattr(R, "BLOCK_NUMBERS", 28)
    assert ranked(find()) == want
    monkeypatch.setattr(R, "TRAVEL_NUMBERS", 0)
    assert ranked(find()) == want
    assert R.lsh_topk(q, rows.where("false"), 7).count() == 0


def test_hashing(spark):
    assert embedding.bucket("paris", 256) == embedding.bucket("paris", 256) < 256
    df = spark.createDataFrame([(1, "the cat the"), (2, ""), (3, None)], "id long, text string")
    got = {r["id"]: r["v"] for r in df.select("id", embedding.embed(F.col("text"), 16).alias("v")).collect()}
    assert sum(v * v for v in got[1]) == pytest.approx(1) and not any(got[2]) and not any(got[3])
    flat = {r["bucket"]: r["weight"] for r in embedding.sparse(df, ["id"], F.col("text"), 16).collect()}
    assert flat == pytest.approx({i: v for i, v in enumerate(got[1]) if v})
    q = embedding.sparse(spark.createDataFrame([(5, "cat")], "query_id long, text string"), ["query_id"], F.col("text"))
    c = embedding.sparse(df.select(F.col("id").alias("chunk_id"), "text"), ["chunk_id"], F.col("text"))
    assert [r["chunk_id"] for r in R.sparse_dense_topk(q, c).collect()] == [1]


@pytest.mark.parametrize(
    ("chars", "ratio", "bitmap", "text", "image", "want"),
    [
        (23, 0.0, 0.0, "x", True, "vision"), (24, 0.0, 0.0, "x", True, "text"), (100, 0.5, 0.0, "x", True, "vision"), (100, 0.1, 50_000.0, "x", True, "vision"),
        (0, 0.9, 9e5, "", False, "text"), (None, None, None, " ", True, "vision"), (None, None, None, "t", True, "text"),
    ],
)
def test_page_route(spark, chars, ratio, bitmap, text, image, want):
    df = spark.createDataFrame([(chars, ratio, bitmap, text, image)], "c int, r double, b double, t string, i boolean")
    usable = layout.has_usable_text(F.col("t"), F.col("c"), F.col("r"), F.col("b"))
    assert df.select(layout.page_route(usable, F.col("i")).alias("x")).first()["x"] == want

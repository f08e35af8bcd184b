"""The corpus operators against brute force on small fixtures, with the edge cases each docstring names."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedgeway.llm import common, decontaminate, html_text, language_id, line_dedup, lm_scoring, mixing, ngram_jaccard, pii, quality_rules, sharding, textops

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def corpus(n=60, seed=1):
    """Random prose with copies, near copies, a hot source, nulls, empty and long texts, repeated rows and ids."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéüñ") for _ in range(r.randint(1, 6))) for _ in range(120)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [line(9) for _ in range(4)]
    rows = []
    for i in range(n):
        text = "\n".join(r.choice(shared) if r.random() < 0.25 else line(r.randint(1, 14)) for _ in range(r.randint(1, 8)))
        if i % 7 == 3:
            text = rows[r.randrange(len(rows))][1]
        elif i % 7 == 5 and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[r.randrange(len(words))] = "edited"
            text = " ".join(words).upper() if i % 2 else " ".join(words)
        rows.append((i * 3 % n if n % 3 else i, text, r.choice(["en", "fr", None]), "hot" if r.random() < 0.4 else f"s{i % 5}", len(text), "x", 1))
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s1", 0, None, None), (902, " \n\t\n ", "en", "s1", 5, None, None), (903, "one", "en", "s1", 3, None, None), (904, "ONE ", "fr", "s2", 4, None, None)]
    rows += [(905, "\n".join([shared[0]] * 3 + [line(3000)]), "en", "s1", 1, None, None), rows[4], rows[4], (None, shared[1] + "\nlone", "en", "s1", 1, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# == text primitives ==


def test_words_match_python(rows):
    texts = [r[1] for r in rows]
    array = pa.array([t for t in texts], pa.string())
    words = textops.Words(array.slice(0, len(array)), lower=True)
    raw = words.raw.tobytes()
    got = defaultdict(list)
    for row, s, e in zip(words.row, words.starts, words.ends, strict=True):
        got[int(row)].append(raw[s:e].decode())
    hashes = words.hashes()
    by_word = {}
    for k, h in zip([w for i in sorted(got) for w in got[i]], hashes.tolist(), strict=True):
        assert by_word.setdefault(k, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert [got[i] for i in range(len(texts))] == [WHITE.findall(lower(t or "")) for t in texts]
    assert [list(x) for x in textops.steps(array, 200)][0][0] == 0 and sum(b - a for a, b in textops.steps(array, 200)) == len(array)


def test_connected(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(500, k) for k in range(200, 260)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in common.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_join_groups_splits_heavy(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    left = spark.createDataFrame([(None if i % 10 == 9 else i % 4 * (i % 3 == 0), i) for i in range(200)], "k int, v int")
    groups = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = {(x["v"], x["top"]) for x in common.join_groups(left, groups, ["k"], "n", 9, 40_000).collect()}
    top = defaultdict(int)
    for x in left.collect():
        top[x["k"]] = max(top[x["k"]], x["v"])
    assert got == {(x["v"], top[x["k"]]) for x in left.collect()}


# == 1 sharding ==


def test_sharding(docs, rows, empty):
    got = sharding.kd_shards(docs, shards=8).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert all(len(s) == 1 for s in of.values())  # equal texts stay together
    assert sharding.kd_shards(empty, shards=8).count() == 0


def test_sharding_balance(spark):
    """A hot source and a hot size are cut like any other; one group above the share can't be."""
    r = random.Random(4)
    rows = [(i, "x" * (100 if i % 3 else r.randint(1, 400)) + str(i), "en", "hot" if i % 2 else f"s{i % 9}") for i in range(4000)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=8)
    sizes = [x["b"] for x in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * sum(sizes) / 8 and min(sizes) > 0.98 * sum(sizes) / 8
    odd = sharding.kd_shards(spark.createDataFrame(rows[:900], "doc_id long, text string, lang string, source string"), dims=[], target_bytes=20_000)
    sizes = [x["b"] for x in odd.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) < 1.1 * 20_000 and len(sizes) == -(-sum(sizes) // 20_000)
    hot = [(i, "same" * 50 if i % 3 == 0 else f"text {i} " * 9, "en", "s") for i in range(900)]
    got = sharding.kd_shards(spark.createDataFrame(hot, "doc_id long, text string, lang string, source string"), shards=4)
    assert got.where("size = 201").select("shard").distinct().count() == 1


def test_sharding_by_values_of_one_prefix(spark, monkeypatch):
    """Sources that differ only far behind, and fractions, are split by their order; many values are ranked by all tasks."""
    rows = [(i, f"text {i:05d}", "en", f"https://host.example/{i % 50:03d}", (i * 7919 % 1000) / 1000) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    of = {r[0]: r for r in rows}
    one = None
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        for dim, at in (("source", 3), ("score", 4)):
            got = sharding.kd_shards(docs.withColumn("size", F.lit(1)), dims=[dim], shards=4).collect()
            spans = defaultdict(list)
            for x in got:
                spans[x["shard"]].append(of[x["doc_id"]][at])
            ends = sorted((min(v), max(v)) for v in spans.values())
            assert len(ends) == 4 and sum(a[1] > b[0] for a, b in zip(ends, ends[1:], strict=False)) == 0
        if one is None:
            one = sorted(map(tuple, got))
    assert one == sorted(map(tuple, got))


# == 2 line dedup ==


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(line_dedup.NULL_ID if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        me = line_dedup.NULL_ID if doc is None else doc
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and me != max(held[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(docs, rows, empty):
    got = line_dedup.dedup_lines(docs, batches=6, fanout=2).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == brute_lines(rows)
    assert sum(r["n_dropped"] for r in got) > 10
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_distinct_ids(spark, monkeypatch):
    """Hot keys by broadcast, the rest by shuffle, few bits in the bitmaps; and a text of very many lines."""
    r = random.Random(3)
    shared = [f"a line that documents share, number {k}" for k in range(12)]
    rows = [(k * 7 % 83, "\n".join(r.choice(shared[: 1 + k % 12]) if r.random() < 0.7 else f"a line of its own {k} {i} " + "x" * 20 for i in range(r.randint(0, 9)))) for k in range(83)]
    rows.append((1000, "\n".join(shared * 400 + ["short", ""])))
    rows.append((500, "\n".join(x.upper() + "  " for x in shared * 300)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_dedup, "HEAVY", 8)
    monkeypatch.setattr(line_dedup, "BITMAP_WORDS", 1)
    got = line_dedup.dedup_lines(table, batches=5, fanout=2).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == brute_lines(rows)
    assert not spark.sql("show tables like 'sedgeway_line_run*'").collect()


def test_line_runs(spark):
    make = lambda *pairs: spark.createDataFrame([(d, 0, i, h, h, True) for i, (d, h) in enumerate(pairs)], "doc long, mark long, line int, h1 long, h2 long, first boolean")
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=2)
    for n in (9, 8, 7, 6, 5):
        runs.add(make((n, 1), (n, 1), (n, 10 + n)))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    # what is settled in a run isn't written again
    assert 1 not in [r["h1"] for r in runs.levels[0][0].collect()]
    counts = {r["h1"]: (r["docs"], r["last"]) for r in runs.counts().collect()}
    assert counts.pop(1)[0] >= 2 and counts == {10 + n: (1, n) for n in (9, 8, 7, 6, 5)}
    assert [(r["h1"], r["last"]) for r in runs.settled().collect()] == [(1, 9)]
    fresh = runs.fresh(make((4, 1), (4, 12), (4, 16), (4, 99)))
    assert sorted(r["h1"] for r in fresh.collect()) == [12, 99]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    runs.close()


# == 3 decontamination ==


def brute_tiling(doc, item, seed):
    """Greedy string tiling by its definition: mark the longest unmarked match, again and again."""
    md, mi, covered, tiles = [False] * len(doc), [False] * len(item), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not md[i + n] and not mi[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return covered, tiles
        md[i : i + n], mi[j : j + n] = [True] * n, [True] * n
        covered, tiles = covered + n, tiles + 1


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_tiling_is_exact():
    r = random.Random(5)
    for _ in range(60):
        doc, item = ([r.choice("abcd") for _ in range(r.randint(3, 40))] for _ in range(2))
        i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(doc) - 2) for b in range(len(item) - 2) if doc[a : a + 3] == item[b : b + 3]], strict=True)) if any(doc[a : a + 3] == item[b : b + 3] for a in range(len(doc) - 2) for b in range(len(item) - 2)) else (np.zeros(0, int), np.zeros(0, int))
        if len(i):
            assert decontaminate.tile(i, j, 3, len(item)) == brute_tiling(doc, item, 3)


def test_decontamination(spark, empty):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)] + ["Écho", "the"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(r.randint(15, 40)))) for k in range(12)] + [(50, None), (51, "..."), (52, "rare Word pair"), (None, " ".join(say(20)))]
    docs = []
    for k in range(80):
        body, item = say(r.randint(5, 120)), r.choice(items[:12])[1].split()
        half = len(item) // 2
        passage = [[], item, item[half:] + say(3) + item[:half], item[: len(item) // 3], [w.upper() + "," for w in item], [w if i % 8 else "new" for i, w in enumerate(item)]][k % 6]
        docs.append((k, " ".join(body[:4] + passage + body[4:])))
    docs += [(200, None), (201, ""), (202, "a rare, WORD pair."), (203, "rare word"), (None, items[2][1]), docs[1]]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, text in docs:
        for i, item in items:
            a, b = words_of(text), words_of(item)
            seed = min(4, len(b))
            if b:
                covered, tiles = brute_tiling(a, b, seed)
                if covered and covered >= 0.5 * len(b):
                    want[d, i, len(b), covered, tiles] += 1
    got = Counter((r["doc_id"], r["item_id"], r["item_tokens"], r["covered"], r["tiles"]) for r in decontaminate.contaminated(table, bench).collect())
    assert got == want and len(want) > 40
    kept = {r["doc_id"] for r in decontaminate.without_benchmark(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in want}
    assert decontaminate.contaminated(table, bench.where("false")).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0


def test_decontamination_keeps_clean_rows_of_a_shared_id(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, "so " + item), (None, "a clean text"), (None, None), (7, item), (7, "clean as well")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(x["doc_id"], x["text"]) for x in decontaminate.without_benchmark(docs, bench).collect()}
    assert got == {(None, "a clean text"), (None, None), (7, "clean as well")}


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k}") for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so alpha{k} beta{k} gamma{k} delta{k} it") for k in range(9)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()) == [(k, k) for k in range(9)]


# == 4 compression LM ==


def test_lm_scores(spark, empty):
    r = random.Random(7)
    good, bad = ([f"{p}{k}word" for k in range(60)] for p in ("fine", "poor"))
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(80))) for i in range(60)] + [(100, None), (101, ""), (1, "again")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    domain, general = lm_scoring.dictionaries(docs, labels)
    assert b"fine" in domain and b"poor" not in domain and b"poor" in general and len(domain) <= lm_scoring.DICT_BYTES
    got = {(x["doc_id"], x["n_bytes"]): x["score"] for x in lm_scoring.lm_scores(docs, labels, size=600).collect()}
    assert len(got) == len(rows) and got[100, 0] == 0.0 and got[101, 0] == 0.0
    held = [(i, s) for (i, _), s in got.items() if 40 <= i < 60]
    inside, outside = ([s for i, s in held if i % 2 == k] for k in (1, 0))
    assert len(held) == 20 and sum(inside) / 10 > sum(outside) / 10 + 0.01
    assert lm_scoring.lm_scores(empty, labels).count() == 0
    assert lm_scoring.lm_scores(docs, labels.where("false")).count() == len(rows)


def test_lm_sizes_by_zstandard_itself(spark):
    """Dictionaries by the gains of words counted here, sizes by the library's own compressor, scores from these."""
    import zstandard

    r = random.Random(31)
    words = [f"word{k:03d}" + "x" * (k % 6) for k in range(150)]
    rows = [(i, " ".join(r.choice(words[: 40 + 110 * (i % 3 > 0)]) for _ in range(r.randint(1, 120))) + (" straße é\n\t" if i % 4 == 0 else "")) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i in range(30)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    n, inside = Counter(), Counter()
    good = {i for i, q in labels if q}
    for i, text in rows:
        for w in WHITE.findall(text):
            if len(w.encode()) > lm_scoring.REFERENCE:
                n[w] += 1
                inside[w] += i in good
    saved = lambda w: len(w.encode()) + 1 - lm_scoring.REFERENCE
    ratio = lambda w: (inside[w] / sum(inside.values())) / (n[w] / sum(n.values()))
    packed = []
    for gain in ({w: round(inside[w] * saved(w) * min(ratio(w), 2.0), 6) for w in n if inside[w]}, {w: n[w] * saved(w) for w in n}):
        parts, left = [], 700
        for w in sorted(gain, key=lambda w: (-gain[w], w)):
            if len(w.encode()) + 1 <= left:
                parts.append(w.encode() + b" ")
                left -= len(parts[-1])
        packed.append(b"".join(reversed(parts)))
    assert list(lm_scoring.dictionaries(docs, marked, 700)) == packed
    text_of = dict(rows)
    for x in lm_scoring.lm_scores(docs, marked, size=700).collect():
        raw = text_of[x["doc_id"]].encode()
        a, b = (len(zstandard.ZstdCompressor(level=lm_scoring.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(raw)) for d in packed)
        assert (x["n_bytes"], x["domain_bytes"], x["general_bytes"]) == (len(raw), a, b) and x["score"] == pytest.approx((b - a) / (a + b))


def test_lm_counts_every_word(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, "alpha tiny of")], "doc_id long, text string").withColumn("inside", F.col("doc_id") == 2)
    got = {r["word"]: (r["n"], r["inside"]) for r in docs.select("text", "inside").mapInArrow(lm_scoring._word_counts, "word string, n long, inside long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).collect()}
    assert got == {"alpha": (3, 1), "beta": (1, 0), "tiny": (1, 1)}


def test_lm_dictionaries_follow_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "DICT_BYTES", 1000)
    for words in (10_000, 40_000):
        docs = spark.createDataFrame([(i, " ".join(f"w{k:07d}" for k in range(i, words, 50))) for i in range(50)], "doc_id long, text string")
        domain, general = lm_scoring.dictionaries(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"))
        want = lm_scoring.SHARE * 9 * words
        assert want - 9 <= len(general) <= want and want - 9 <= len(domain) <= want


def test_lm_compressor_finds_all_of_a_large_dictionary():
    r = random.Random(3)
    words = [bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(60_000)]
    packer, text = lm_scoring._compressor(b" ".join(words), 3), b" ".join(words[:300])
    assert len(packer.compress(text)) < 0.1 * len(text)


def test_lm_time_of_a_text_is_not_the_dictionary_s(spark):
    """Long texts don't each copy the tables of a large dictionary; sizes are zstandard's own for a stream of unknown size."""
    import time

    r = random.Random(4)
    words = [bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300_000)]
    content = b" ".join(words)
    texts = [b" ".join(r.choice(words) for _ in range(2_000)) for _ in range(60)]
    packer, size, took = lm_scoring._compressor(content, 3), lm_scoring._sizer(content, 3), []
    for of in (lambda raw: len(packer.compress(raw)), size):
        of(texts[0])
        began = time.process_time()
        got = [of(raw) for raw in texts]
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2
    assert all(0 < n < 0.5 * len(raw) for n, raw in zip(got, texts, strict=True))
    docs = spark.createDataFrame([(k, raw.decode()) for k, raw in enumerate(texts[:5])], "doc_id long, text string")
    assert [x["general_bytes"] for x in lm_scoring.score(docs, b"", content).orderBy("doc_id").collect()] == got[:5]


# == 5 language ID ==


def test_language_id(spark, empty):
    r = random.Random(8)
    sound = {"aa": "the and of ing that with", "bb": "der die und ung nicht sch", "cc": "le la que eau oux tion"}
    rows = [(i, " ".join(r.choice(sound[lang].split()) for _ in range(r.randint(4, 60))), lang) for i, lang in enumerate(list(sound) * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 !!", "cc"), (503, "que le eau", None), (None, "the and", "aa"), rows[3], (505, "𝐚 the of that", "aa"), (506, "x" * 40_000 + " the", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502)) and by[503]["lang_pred"] == "cc"
    held = [(by[i]["lang_pred"], lang) for i, _, lang in rows[:180] if by[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert {x["lang_pred"] for x in got} <= {"aa", "bb", "cc", "und"}
    assert language_id.identify(empty).count() == 0
    assert {x["lang_pred"] for x in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    """On the test tables: documents that weren't trained on, against their label."""
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = language_id.identify(docs).where("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_sample_of_repeated_rows(spark):
    """One row over and over doesn't fill the sample of its language."""
    rows = [(7, "uno dos tres cuatro", "es")] * 500 + [(100 + i, f"cinco seis siete ocho nueve diez {i}", "es") for i in range(60)] + [(300 + i, f"one two three four five {i}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.train(docs, sample_rows=80)).collect()}
    assert all(v == ("en" if k >= 300 else "es") for k, v in got.items())


def test_predictions_do_not_see_labels(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "gamma delta", "x" if i % 2 else "y") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    a = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model).collect()}
    b = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs.withColumn("lang", F.lit("x")), model).collect()}
    assert a == b


# == 6 Jaccard join ==


def brute_jaccard(rows, percent=60):
    sets = []
    for _, text, *_ in rows:
        w = WHITE.findall(lower(text or ""))
        sets.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set())
    near, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                near[a], near[b] = near[a] + 1, near[b] + 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    lowest = defaultdict(list)
    for k, (d, *_) in enumerate(rows):
        if d is not None:
            lowest[find(k)].append(d)
    return Counter((rows[k][0], len(sets[k]), near[k], min(lowest[find(k)], default=None)) for k in range(len(rows)))


def near_copies(seed=9, base=60, words=40):
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(base * 3):
        if texts and r.random() < 0.7:
            w = list(r.choice(texts[-6:]))
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"e{r.randrange(900)}"
        else:
            w = [f"v{r.randrange(200)}" for _ in range(r.randint(2, words))]
        texts.append(w)
        rows.append((i, (" ".join(w)).upper() if i % 11 == 0 else "  ".join(w)))
    return rows


def links(df):
    return Counter((r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in df.collect())


def test_jaccard(docs, rows, empty):
    assert links(ngram_jaccard.jaccard_links(docs)) == brute_jaccard(rows)
    assert ngram_jaccard.jaccard_links(empty).count() == 0


@pytest.mark.parametrize("percent", [60, 80])
def test_jaccard_near_copies(spark, percent):
    rows = near_copies()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert links(ngram_jaccard.jaccard_links(table, percent=percent)) == brute_jaccard(rows, percent)


@pytest.mark.parametrize("hot", [2, 48])
def test_jaccard_blocks(spark, monkeypatch, hot):
    """Components cut into pairs of blocks give the same links, whether n-grams bring pairs or stars."""
    rows = near_copies(10)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_jaccard, "BLOCK_DOCS", 4)
    monkeypatch.setattr(ngram_jaccard, "SMALL", 2)
    monkeypatch.setattr(ngram_jaccard, "FRAGMENT", 8)
    monkeypatch.setattr(ngram_jaccard, "HOT", hot)
    monkeypatch.setattr(ngram_jaccard, "OFTEN", hot)
    monkeypatch.setattr(ngram_jaccard, "FLUSH_TOKENS", 40 * hot)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert links(ngram_jaccard.jaccard_links(table)) == brute_jaccard(rows)


def test_jaccard_in_rounds(spark, monkeypatch):
    """A corpus taken in rounds of set sizes has the same links, and no round has more n-grams than it may."""
    sizes = [(n, 100 * n, 100) for n in range(10, 400, 3)]
    monkeypatch.setattr(ngram_jaccard, "ROUND_TOKENS", 1_200_000)
    rounds = ngram_jaccard._rounds(sizes, 60)
    assert len(rounds) > 2 and all(b[0] == a[1] for a, b in zip(rounds, rounds[1:], strict=False)) and rounds[-1][1] is None
    for a in range(10, 400, 3):  # the largest partner is in the round of the smaller set
        low, end, _ = next(r for r in rounds if r[0] <= a and (r[1] is None or a < r[1]))
        assert end is None or a * 100 // 60 * 60 < 100 * end
    for low, end, _ in rounds:  # but for one whose sizes are close together
        assert sum(t for n, t, _ in sizes if n >= low and (end is None or n * 60 < 100 * end)) <= 1_200_000 or end <= 1.3 * low
    monkeypatch.setattr(ngram_jaccard, "ROUND_TOKENS", 500)
    rows = near_copies(11)
    assert links(ngram_jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_jaccard(rows)


def test_representatives(docs, rows):
    got = Counter(r["doc_id"] for r in ngram_jaccard.representatives(docs).collect())
    alone = [r for r in brute_jaccard(rows).elements() if r[2] == 0 or r[0] is None]
    assert got == Counter([r[0] for r in alone]) + Counter({r[3] for r in brute_jaccard(rows) if r[2] and r[0] is not None})


# == 7 HTML extraction ==


P1, P2 = "A first paragraph, long enough to count, with commas.", "The second one, also long, says a little more about it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<script>x</script><style>y</style>", ""), ("just words", "just words"),
        (f"<nav>menu</nav><header>Site</header><article><h1>T</h1><p>{P1}<p>{P2}</article><aside>side</aside><footer>f</footer>", f"T\n\n{P1}\n\n{P2}"),
        (f"<div class='sidebar'><p>{P1}</p></div><div id=content><p>{P1}</p><p>{P2}</p></div>", f"{P1}\n\n{P2}"),
        (f"<main><p>{P1}</p><div class='cookie-notice'>We use cookies, lots.</div><form>f<p>{P2}</form><div id='comments'><p>{P2}</p></div></main>", P1),
        (f"<article><p>a&amp;b &lt;c&gt; caf&eacute;&nbsp;x &#65;&#x42;\n\t y<br>z</p><!-- <p>no</p> --><p>{P1}</article>", f"a&b <c> café x AB y z\n\n{P1}"),
        (f"<article><p><b>{P1}<br><p>{P2}</p></article>", f"{P1}\n\n{P2}"),
        (f"<body class='has-sidebar'><article><ul><li>one<li>two</ul><p>{P1}</article>", f"one\n\ntwo\n\n{P1}"),
        (f"<article><p>{P1}</p><script>var a = '<p>x</p>';</script><div class='ad'>{P2}</div></article>", P1),
        (f"<div class=post><p>{P1}</p></div><div class=post><p>{P2}</p></div><ul class=menu><li><a href=x>{P2}</a></ul>", f"{P1}\n\n{P2}"),
        (f"<article><h1>T</h1><p>{P1}<article class=comment><p>{P2}</article></article>", f"T\n\n{P1}"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = "Long prose of the section, with commas, and with enough of them to be a paragraph of its own. " * 4
ARTICLE = "<article><h1>Title</h1><p>The first paragraph of the article, which is long enough, says something.</p>{}<p>The last paragraph of the article, as long, says some more.</p></article>"


@pytest.mark.parametrize(
    "part",
    [
        '<section id="discussion"><h2>Discussion</h2><p>Short talk.</p></section>', '<section id="related-work"><h2>Related work</h2><p>Others did it.</p></section>',
        '<h2 id="related-work">Related work</h2>', '<h2 id="warning-signs">Warning signs</h2>', '<h2 class="header">Heads</h2>', '<p class="legal">The law of the land.</p>', '<p id="comments">On comments.</p>',
        '<div id="navigation"><h3>Navigation</h3><p>By the stars.</p></div>', f'<div class="warning"><p>{LONG}</p></div>', '<p id="footer-note">A note.</p>', '<section id="legal"><p>Two words.</p></section>',
        '<h3 id="menu">Menu of the day</h3>', '<blockquote id="sharing">Share and share alike.</blockquote>', '<ul id="notices"><li>One</li><li>Two</li></ul>',
    ],
)
def test_article_parts_stay(part):
    words = re.sub(r"<[^>]*>", " ", part).split()
    assert all(w in html_text.main_text(ARTICLE.format(part)).split() for w in words)


@pytest.mark.parametrize(
    "part",
    [
        '<div class="ad"><p>Buy it now.</p></div>', f'<div class="comments"><h3>Comments</h3><p>{LONG}</p></div>', '<p class="advertisement">Buy it now.</p>', '<div class="share-buttons">Share it</div>',
        '<div class="notice">We changed our rules.</div>', '<section class="related"><h3>Read on</h3><ul><li><a href="/a">One more story</a></li><li><a href="/b">And another</a></li></ul></section>',
        '<div class="cookie-banner"><p>We use cookies.</p></div>', '<section id="comments"><p>First!</p></section>', '<div id="nav"><a href="/">Home</a> <a href="/b">Back</a></div>', '<div class="legal">All rights reserved.</div>',
    ],
)
def test_furniture_goes(part):
    assert html_text.main_text(ARTICLE.format(part)) == html_text.main_text(ARTICLE.format(""))


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{P1}</p></article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article><p>{P1}</p></article>"), (3, "w", "<article>" + f"<p>{P1}</p>" * 2000 + "</article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r["page_id"], r["url"], r["n_chars"]) for r in got) == Counter([(1, "u", len(P1)), (1, "u", len(P1)), (2, None, 0), (None, "v", 0), (3, "w", 2000 * (len(P1) + 2) - 2)])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_test_tables(spark):
    import html

    from tests.conftest import DATA

    for r in html_text.extract(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        assert r["text"] == "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in re.split("</?(?:p|h1)>", body)) if t)


# == 8 PII ==


KEY = pii.Permuter(b"test")


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_permutation(n):
    moved = [KEY.move(x, n, b"t") for x in range(n)]
    assert sorted(moved) == list(range(n)) and all(x != y for x, y in enumerate(moved))
    assert [KEY.unmove(y, n, b"t") for y in moved] == list(range(n))
    assert n < 97 or moved != [pii.Permuter(b"other").move(x, n, b"t") for x in range(n)]


VALUES = {
    "email": ["ann.b+1@mail7.example.com", "Ab@x.org"], "ip": ["10.0.0.1", "255.255.255.255"], "date": ["2024-02-29", "1/2/2003", "31/12/1999", "05.06.2010"],
    "ssn": ["123-45-6789", "899-01-0001"], "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "secret": ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "9233A8ECF7C5B09FE5949719B6B82BC4"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "+49 30 1234567"], "card": ["4111 1111 1111 1111", "4845168114407329", "378282246310005"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_round_trip(kind, value):
    new = pii.pseudonym(kind, value, KEY)
    assert new != value and pii._shape(re.sub("[0-9a-fA-F]", "0", new)) if kind in ("secret", "ip") else re.sub(r"\d", "9", new) != "" and len(new) >= len(value)
    assert pii.pseudonym(kind, new, KEY, back=True) == (value if kind != "date" or len(value.split("/")[0]) != 1 else "01/02/2003")
    found = pii._PII.search(f"so {new} it")
    assert found and found[0] == new and found[kind] == new


def test_validity_is_kept():
    for k in range(200):
        body = f"{k * 7919 + 400000000000000:015d}"
        card = body + next(c for c in "0123456789" if pii.luhn(body + c))
        assert pii.luhn(pii.pseudonym("card", card, KEY)) and pii.pseudonym("card", body + next(c for c in "0123456789" if not pii.luhn(body + c)), KEY) is None
        day = datetime.date(1950, 1, 1) + datetime.timedelta(days=97 * k)
        datetime.date.fromisoformat(pii.pseudonym("date", day.isoformat(), KEY))
    iban = pii.pseudonym("iban", "DE89370400440532013000", KEY)
    assert pii._mod97(iban) == 1 and iban[:2] == "DE"
    for bad in (("date", "2023-02-30"), ("ssn", "000-12-1234"), ("ssn", "666-12-1234"), ("iban", "DE00370400440532013000"), ("phone", "+1 2 34")):
        assert pii.pseudonym(*bad, KEY) is None


def test_equal_values_however_written():
    mail = pii.pseudonym("email", "bob.jones@x.org", KEY)
    assert pii.pseudonym("email", "Bob.JONES@x.org", KEY) == "".join(c.upper() if k in (0, 4, 5, 6, 7, 8) else c for k, c in enumerate(mail))
    digits = {re.sub(r"\D", "", pii.pseudonym("phone", p, KEY)) for p in ("+49 30 1234567", "+49301234567", "+49-30-1234-567", "+49 (30) 1234567")}
    assert len(digits) == 1 and digits.pop().startswith("49")
    assert re.sub(r"\D", "", pii.pseudonym("phone", "(212) 555-0100", KEY)) == re.sub(r"\D", "", pii.pseudonym("phone", "212-555-0100", KEY))


@pytest.mark.parametrize("tail", ["EUR", "PAID", "PAID EUR"])
def test_iban_before_upper_case_words(tail):
    iban = "AT61 1904 3002 3457 3201"
    assert pii.replace_pii(f"to {iban} {tail} now", KEY, {}) == (f"to {pii.pseudonym('iban', iban, KEY)} {tail} now", 1)


def test_pseudonymise(spark, empty):
    text = "Ask ann@x.org or ann@x.org, card 4111111111111111, ip 1.2.3.4, on 2024-01-31; not 3.14, 2023-02-30 or v1.2."
    rows = [(1, text), (2, "again ann@x.org"), (3, None), (4, ""), (5, "no data here"), (2, "again ann@x.org"), (6, "x " * 50_000 + "ann@x.org")]
    got = defaultdict(list)
    for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect():
        got[r["doc_id"]].append(r)
    one = got[1][0]
    mail = re.search(r"\S+@x\.org", one["text"])[0]
    assert one["n_pii"] == 5 and one["kinds"] == "card,date,email,ip" and mail != "ann@x.org" and one["text"].count(mail) == 2 and got[2][0]["text"] == f"again {mail}" and got[6][0]["text"].endswith(mail)
    assert "3.14, 2023-02-30 or v1.2." in one["text"] and not any(v in one["text"] for v in ("4111111111111111", "1.2.3.4", "2024-01-31"))
    assert got[3][0]["text"] is None and got[4][0]["text"] == "" and got[5][0]["text"] == "no data here" and len(got[2]) == 2
    assert pii.pseudonymise(empty).count() == 0


def test_pii_against_a_second_reader(spark):
    """Of generated documents just the valid values change, by one to one maps that hold over all documents."""
    r = random.Random(21)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows, made = [], []
    for i in range(120):
        card = digit(15)
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(card)))
        good = card + str(-total % 10)
        pool = [good, card + str((1 - total) % 10), f"user{i % 40}@mail{i % 3}.example.com", f"{r.randint(1, 255)}.{r.randint(0, 255)}.0.{r.randint(0, 255)}", f"20{r.randint(10, 24)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", "2023-02-31", "12.5", f"no {i}"]
        words = [r.choice(pool) if r.random() < 0.4 else "word" for _ in range(30)]
        made.append(words)
        rows.append((i, " ".join(words)))
    got = {x["doc_id"]: x for x in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    maps: dict[str, str] = {}
    for i, words in enumerate(made):
        old, new = " ".join(words).split(" "), got[i]["text"].split(" ")
        changed = 0
        for a, b in zip(old, new, strict=True):
            valid = "@" in a or re.fullmatch(r"\d+(\.\d+){3}", a) or re.fullmatch(r"20\d\d-0[1-9]-1\d", a) or len(a) == 16 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(a))) % 10 == 0
            assert bool(valid) == (a != b) and len(a) == len(b) or "." in a
            assert maps.setdefault(a, b) == b
            changed += bool(valid)
        assert got[i]["n_pii"] == changed
    assert len(set(maps.values())) == len(maps)


# == 9 mixing ==


def test_exponents():
    tokens = {"a": 700, "b": 200, "c": 100}
    alpha = mixing.find_exponent(tokens, max_repeat=2.0)
    w = mixing.weights(tokens, alpha)
    assert sum(w.values()) == pytest.approx(1) and max(mixing.repeats(tokens, w).values()) == pytest.approx(2.0, abs=1e-6) and min(mixing.repeats(tokens, w).values()) == pytest.approx(1)
    beta = mixing.find_exponent(tokens, target_entropy=1.0)
    assert mixing.entropy(mixing.weights(tokens, beta)) == pytest.approx(1.0, abs=1e-9)
    assert mixing.find_exponent(tokens, target_entropy=0.1) == 1.0 and mixing.find_exponent({"a": 5, "b": 5}) == 0.0
    assert mixing.find_exponent(tokens, target_entropy=9.0) == pytest.approx(0, abs=1e-9) and mixing.find_exponent({}) == 0.0


def test_mixture(spark, empty):
    r = random.Random(11)
    rows = [(i, "w" * r.randint(1, 90), "hot" if i % 10 < 7 else f"s{i % 3}") for i in range(900)] + [(2000, None, None), (2001, "", "s1"), (None, "text", "s1"), (5, "twice", "s2"), (5, "twice", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, block_rows=20).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += max(1, math.ceil(len(t or "") / 4))
    # in closed form: the repetition of a source is (largest / own) ** (1 - a), and may be 2 for the smallest
    largest, smallest = max(tokens.values()), min(tokens.values())
    a = 1 - math.log(2) / math.log(largest / smallest)
    rep = {s: (largest / n) ** (1 - a) for s, n in tokens.items()}
    share = {s: n**a for s, n in tokens.items()}
    w = {s: p / sum(share.values()) for s, p in share.items()}
    copies, spent = Counter(), Counter()
    for x in got:
        copies[x["doc_id"], x["source"], x["tokens"]] += 1
        spent[x["source"]] += x["tokens"]
        assert x["weight"] == pytest.approx(w[x["source"]]) and x["exponent"] == pytest.approx(a)
    assert {k[0] for k in copies} == {r[0] for r in rows}  # nothing is lost
    for s in tokens:
        assert rep[s] * tokens[s] - 30 <= spent[s] <= rep[s] * tokens[s] + 1
        per = [n for (d, src, _), n in copies.items() if src == s and d != 5]
        assert max(per) - min(per) <= 1
    orders = {p: [b for _, b in sorted({(x["turn"], x["block"]) for x in got if x["source"] == "hot" and x["pass"] == p})] for p in (0,)}
    assert orders[0] != sorted(orders[0])  # a permutation of the blocks
    assert mixing.mixture(empty).count() == 0
    times = Counter(x["doc_id"] for x in mixing.mixed(docs, block_rows=20).collect())
    assert all(times[d] == n for (d, _, _), n in copies.items() if d != 5) and mixing.mixed(docs).columns == docs.columns


def test_mixture_of_many_sources(spark, monkeypatch):
    """Sources and blocks joined by shuffle, and extra columns with the names used inside."""
    r = random.Random(12)
    rows = [(i, "w" * r.randint(1, 90), r.choice(["hot", "hot", None, f"u{i % 40}"]), i, -i, "x", float(i), {"k": i}) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, mark long, block string, tokens double, copies map<string,int>")
    one = sorted(map(str, mixing.mixed(docs, block_rows=15).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert one == sorted(map(str, mixing.mixed(docs, block_rows=15).collect())) and {(x["doc_id"], x["_id"], x["mark"], x["tokens"]) for x in mixing.mixed(docs).collect()} == {(x[0], x[3], x[4], x[6]) for x in rows}


# == 10 quality ==


def brute_base(text):
    words = WHITE.findall(text or "")
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WHITE.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its formulas, with dictionaries."""
    letters = Counter(ord(c.lower()) for s in texts for c in s if c.isalpha())
    order, table = quality_rules.ORDER, quality_rules._class_table(tuple(sorted(letters, key=lambda c: (-letters[c], c))[: quality_rules.ALPHABET]))
    cls = lambda s: (0,) * (order - 1) + tuple(int(table[min(ord(c), 0xFFFF)]) for c in s) + (0,)
    counts = [Counter() for _ in range(order + 1)]
    for s in texts:
        c = cls(s)
        for k in range(order - 1, len(c)):
            counts[order][c[k - order + 1 : k + 1]] += 1
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    disc = []
    for n in range(order + 1):
        m = Counter(counts[n].values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] and m[2] else 0.5
        disc.append((min(max(1 - 2 * y * m[2] / m[1], 0.1), 1.0) if m[1] else 0.5, min(max(2 - 3 * y * m[3] / m[2], 0.1), 2.0) if m[2] else 1.0, min(max(3 - 4 * y * m[4] / m[3], 0.1), 3.0) if m[3] else 1.5))
    totals, left = [defaultdict(int) for _ in range(order + 1)], [defaultdict(float) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for gram, c in counts[n].items():
            totals[n][gram[:-1]] += c
            left[n][gram[:-1]] += disc[n][min(c, 3) - 1]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 64
        total = totals[n].get(gram[:-1], 0)
        if not total:
            return p(gram[1:])
        c = counts[n].get(gram, 0)
        return max(c - (disc[n][min(c, 3) - 1] if c else 0), 0) / total + left[n][gram[:-1]] / total * p(gram[1:])

    def score(s):
        c = cls(s)
        return -sum(math.log(p(c[k - order + 1 : k + 1])) for k in range(order - 1, len(c))) / (len(c) - order + 1)

    return score


def test_quality_base_and_model(docs, rows, empty):
    got = quality_rules.quality(docs).collect()
    text_of = defaultdict(list)
    for d, t, lang, *_ in rows:
        text_of[d].append((t, lang or "und"))
    by_lang = defaultdict(list)
    for _, t, lang, *_ in rows:
        if t:
            by_lang[lang or "und"].append(t)
    scorers = {lang: brute_model(ts) for lang, ts in by_lang.items()}
    assert len(got) == len(rows)
    for x in got:
        mine = (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"])
        match = [(t, lang) for t, lang in text_of[x["doc_id"]] if brute_base(t) == mine]
        assert match, (x["doc_id"], mine)
        if match[0][0]:
            assert x["log_perplexity"] == pytest.approx(scorers[match[0][1]](match[0][0]), abs=1e-4)
        else:
            assert x["log_perplexity"] is None and not x["kept"]
        assert not (x["base_failed"] and x["kept"])
    assert quality_rules.quality(empty).count() == 0


def test_backoff_for_unseen(spark):
    model = quality_rules.models(spark.createDataFrame([("en", "abcabcabd abc")], "lang string, text string"))["en"]
    score, grams = brute_model(["abcabcabd abc"]), quality_rules._grams(["abx zzé"], quality_rules._class_table(model.alphabet))[0]
    assert -model.log_probability(grams).mean() == pytest.approx(score("abx zzé"), abs=1e-4)


def test_other_scripts_have_models(spark):
    """In any script, prose of a language is told from the same letters in disorder, by the registered settings."""
    r = random.Random(14)
    rows = []
    for lang, letters in (("ru", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф"), ("el", "αοιετσνηυρπκμλωδγχθφβξζψ"), ("xx", "etaoinshrdlu")):
        words = ["".join(r.choice(letters[: 4 + k % 9]) for k in range(r.randint(2, 8))) for _ in range(120)]
        rows += [(len(rows) + i, " ".join(r.choice(words) for _ in range(250)), lang, 1) for i in range(130)]
        rows += [(len(rows) + i, " ".join("".join(r.sample(letters, min(len(letters), 6))) for _ in range(250)), lang, 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    kept = {x["doc_id"] for x in quality_rules.quality(docs, labels=docs.select("doc_id", "quality")).where("kept").collect()}
    good = [x[0] for x in rows if x[3]]
    assert not kept & {x[0] for x in rows if not x[3]} and len(kept) >= 0.97 * len(good)


def test_letters_beyond_the_alphabet_are_told_apart(spark):
    """Texts that differ only in letters that share a class have scores of their own, by these letters' counts over all documents."""
    table = quality_rules._class_table(())
    first = int(table[0x4E00])
    alike = [chr(c) for c in range(0x4E00, 0x5200) if table[c] == first][:60]
    r = random.Random(21)
    common_ = [chr(0x6000 + k) for k in range(quality_rules.ALPHABET)]
    filler = "".join(common_) * 2_000
    texts = ["".join(r.choice(common_) + r.choice(alike[:3]) for _ in range(100)) for _ in range(40)]
    rare = texts[0].translate({ord(a): ord(b) for a, b in zip(alike[:3], alike[50:53], strict=True)})
    rows = [(0, texts[0], "zh"), (1, rare, "zh"), (2, filler, "zh")] + [(3 + k, t, "zh") for k, t in enumerate(texts[1:])]
    got = {x["doc_id"]: x["log_perplexity"] for x in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    n = Counter(c for _, t, _ in rows for c in t if c in alike)
    own = lambda t: sum(math.log(n[c] / sum(n.values())) for c in t if c in alike) / (len(t) + 1)
    assert got[1] - got[0] == pytest.approx(own(texts[0]) - own(rare), abs=1e-4) and got[1] > got[0] + 1


def test_rare_languages_share_a_model(spark, monkeypatch):
    rows = [(i, f"some words of document {i} that are more than ten in all, as the rules want", ["en", "en", "de", "fr"][i % 4], i) for i in range(40)] + [(50, "x y", "fr", 1), (50, "other text", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra long")
    pooled = docs.withColumn("lang", F.when(F.col("lang") == "en", "en"))
    want = Counter(map(tuple, quality_rules.quality(pooled).collect()))
    monkeypatch.setattr(quality_rules, "MAX_LANGS", 1)
    assert Counter(map(tuple, quality_rules.quality(docs).collect())) == want
    assert {(r["doc_id"], r["extra"]) for r in quality_rules.keep_quality(docs).collect()} <= {(r[0], r[3]) for r in rows if r[0] < 50}


def test_long_texts_in_parts(monkeypatch):
    r = random.Random(15)
    texts = ["".join(r.choice("ab é.\n") for _ in range(n)) for n in (0, 1, 6, 7, 8, 13, 14, 15, 40)]
    table = quality_rules._class_table((ord("a"), ord("b"), ord("é")))
    whole = Counter(zip(*(x.tolist() for x in quality_rules._grams(texts, table)), strict=True))
    monkeypatch.setattr(quality_rules, "LONG", 7)
    assert whole == sum((Counter(zip(a.tolist(), b.tolist(), strict=True)) for a, b in quality_rules._gram_parts(texts, table)), Counter())
    long = pa.array(["word " * 50 + "x" * 300 + " word tail", "word"])
    one = textops.Words(long).hashes()
    monkeypatch.setattr(textops, "SPAN", 16)
    assert (one == textops.Words(long).hashes()).all() and one[0] == one[-1] and len(set(one.tolist())) == 3


def test_models_that_travel_in_turns(docs, rows, monkeypatch):
    one = Counter(map(tuple, quality_rules.quality(docs).collect()))
    monkeypatch.setattr(quality_rules, "TRAVEL", 10)
    assert one == Counter(map(tuple, quality_rules.quality(docs).collect()))


def test_quality_bands(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7))) for _ in range(300)]
    good = [(i, " ".join(r.choice(vocabulary) for _ in range(300)), "en") for i in range(120)]
    junk = [(500, " ".join("e" * 9 + str(k % 7) + "tt" * 4 for k in range(r.randint(200, 250))), "en"), (501, "".join(chr(0x4E00 + r.randrange(9000)) + " " for _ in range(600)), "en")]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in quality_rules.quality(docs, high=4.0).where("kept").collect()}
    assert kept == set(range(120))
    assert {x["doc_id"] for x in quality_rules.keep_quality(docs, high=4.0).collect()} == kept and quality_rules.keep_quality(docs).columns == docs.columns


def banded(seed=21):
    """Good prose in two languages, of which one mixes in the other; words between bars; symbols behind words."""
    r = random.Random(seed)
    words = {"en": ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7))) for _ in range(300)], "xx": ["".join(r.choice("aeiouklmnpst") for _ in range(r.randint(2, 9))) for _ in range(300)]}
    prose = lambda lang, n: [r.choice(words[lang]) for _ in range(n)]
    rows = [(i, " ".join(prose("en" if i % 2 else "xx", r.randint(60, 500))), "en" if i % 2 else "xx") for i in range(800)]
    rows += [(1000 + i, " | ".join(prose("en", 300)), "en") for i in range(12)]
    rows += [(2000 + i, " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in prose("en" if i % 2 else "xx", 300)), "en" if i % 2 else "xx") for i in range(24)]
    return rows


def test_quality_defaults_reject_menu_junk(spark):
    rows = banded()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(600)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    kept = {x["doc_id"] for x in quality_rules.quality(docs, labels=labels).where("kept").collect()}
    assert not kept & set(range(1000, 1012))
    for odd in (0, 1):  # a hundredth of the labelled at most on either side
        assert len({i for i in range(600) if i % 2 == odd} - kept) <= 6
    assert len(set(range(600, 800)) - kept) <= 10
    assert {x["doc_id"] for x in quality_rules.keep_quality(docs, labels=labels).collect()} == kept
    assert not {x["doc_id"] for x in quality_rules.quality(docs).where("kept").collect()} & set(range(1000, 1012))


def test_lower_band_follows_each_language(spark):
    """xx, whose good documents hardly scatter downwards, has its own lower band; en's lies deeper."""
    r = random.Random(5)
    row = lambda i, lang, z: (i, lang, 1.4 + z * (1 / 2000**0.5 + quality_rules.FLOOR), 2000, False)
    rows = [row(i, "en", r.uniform(-4, 4)) for i in range(1000)] + [row(1000 + i, "xx", r.uniform(-0.5, 4)) for i in range(1000)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, log_perplexity double, n_scored long, base_failed boolean")
    good = spark.createDataFrame([(i,) for i in range(0, 2000, 2)], "id long")
    got = {x["lang"]: x for x in quality_rules.bands(scored, good=good).collect()}
    for lang, start in (("en", 0), ("xx", 1000)):
        z = sorted((x[2] - got[lang]["centre"]) / (1 / 2000**0.5 + quality_rules.FLOOR) for x in rows[start : start + 1000 : 2])
        assert 3 <= sum(x < got[lang]["least"] for x in z) <= 5 and 3 <= sum(x > got[lang]["most"] for x in z) <= 5

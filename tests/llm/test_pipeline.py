"""The pipeline's stages against brute force, and the registered queries."""

from collections import Counter

import pytest

import corpus_pipeline
from sedgeway.llm import decontaminate, queries
from tests.conftest import DATA
from tests.llm.test_operators import brute_base, brute_jaccard, brute_tiling, words_of


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, over the smallest tables."""
    base, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(base / str(k)))
        docs = spark.read.parquet(str(base / str(k)))
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stage_columns(stages):
    assert [len(corpus_pipeline.STAGES), *{tuple(sorted(s.columns)) for s in stages[:-1]}] == [5, tuple(sorted(stages[0].columns))]


def test_quality_stage(stages):
    kept = {d for d, _ in rows(stages[1])}
    failed = {d for d, t in rows(stages[0]) if brute_base(t)[-1]}
    assert failed and not kept & failed
    assert len(kept) >= 0.97 * (len(rows(stages[0])) - len(failed))


def test_near_duplicate_stage(stages):
    want = {r[3] for r in brute_jaccard(rows(stages[1]))}
    assert Counter(d for d, _ in rows(stages[2])) == Counter(want)


def test_decontamination_stage(spark, stages):
    bench = [words_of(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = set()
    for d, t in rows(stages[2]):
        w = words_of(t)
        grams = {tuple(w[k : k + 4]): k for k in range(len(w) - 3)}
        for b in bench:
            shared = [k for k in range(len(b) - 3) if tuple(b[k : k + 4]) in grams]
            if len({j for k in shared for j in range(k, k + 4)}) >= decontaminate.MIN_COVERAGE * len(b):  # tiles cover no more than this
                seeds = {tuple(b[k : k + 4]) for k in shared}
                near = [k for k in range(len(w) - 3) if tuple(w[k : k + 4]) in seeds]
                n = brute_tiling(w[near[0] : near[-1] + 4], b, 4)[0]
                if n and n >= decontaminate.MIN_COVERAGE * len(b):
                    bad.add(d)
    assert bad and {d for d, _ in rows(stages[2])} - bad == {d for d, _ in rows(stages[3])}


def test_mixing_stage(stages):
    before, after = Counter(rows(stages[3])), Counter(rows(stages[4]))
    assert set(before) == set(after) and max(after.values()) <= 3


def test_sharding_stage(stages):
    got = stages[5].collect()
    assert len(got) == stages[4].count() and {r["shard"] for r in got} == set(range(8))
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.6 * min(size.values())


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["size"], r["text_crc32"], r["shard"])
    assert Counter(map(key, corpus_pipeline.run(spark, DATA).collect())) == Counter(map(key, stages[5].collect()))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_columns_of_any_name(spark, tmp_path):
    """Columns with the names that stages use inside come through all of them, types and values."""
    names = ["_id", "_mark", "_block", "_component", "id", "component", "row", "mark", "_bad", "_d", "_l", "_m", "tokens", "copies", "carried", "h1", "node", "key", "_word", "rank"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", *[f"doc_id * 2 + {k} as `{n}`" for k, n in enumerate(names)], "map('k', doc_id) as `a map`", "array(source) as `dotted.name`")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.columns[5:] == [*names, "a map", "dotted.name"] and docs.count() > 100
    for r in docs.collect():
        assert all(r[n] == r["doc_id"] * 2 + k for k, n in enumerate(names)) and r["a map"] == {"k": r["doc_id"]} and r["dotted.name"] == [r["source"]]
    assert corpus_pipeline.sharding_stage(spark, docs, DATA).count() == docs.count()


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]

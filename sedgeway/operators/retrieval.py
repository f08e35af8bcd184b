"""Retrieval for a whole batch of questions at once.

Every result is keyed by query_id.  Chunks are never shuffled to be scored: the questions, counted
first, travel to them, each partition of chunks keeps its own best k of every question, and only
these are shuffled.  Batches of questions too large to travel are joined by shuffles instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from sedgeway.functions import text as T

RRF_K = 60
#: Distinct (question, token) rows up to which questions travel to the chunks; beyond it they are joined.
TRAVEL_ROWS = 200_000
#: Numbers of query vectors up to which these travel (256 MB in all, BLOCK_NUMBERS of them at a time); beyond it a grid join.
TRAVEL_NUMBERS = 1 << 25
BLOCK_NUMBERS = 1 << 21
#: Scores a task holds at a time.
SCORES = 1 << 21
#: Tokens that a task counts at a time, and (token of a chunk, question that has it) pairs that it expands at a time.
COUNT_TOKENS = 1 << 18
PAIRS = 1 << 20
OVERLAP, BM25 = 0, 1


def top_k(scored: DataFrame, k: int, ties: list[str | Column], score: str = "score", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best k rows of each query with their 0-based ``rank``; the plan cuts before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def together(parts: list[DataFrame]) -> DataFrame:
    """The parts' rows, of which the planner takes nothing for granted, so that what groups them does shuffle.

    A union whose parts are partitioned alike claims that partitioning for itself: no shuffle is planned
    above it, and one asked for by ``repartition`` is left out.  Where adaptive execution then coalesces
    the parts differently, rows of one group meet in two tasks.  ``coalesce`` to more partitions than
    there are moves nothing, but its result claims no partitioning.
    """
    return reduce(DataFrame.unionByName, parts).coalesce(1 << 20)


def narrowed(chunks: DataFrame, document_ids: DataFrame | list | None, key: str = "document_id") -> DataFrame:
    """Chunks of the given documents: None is no filter, an empty one lets nothing through."""
    if document_ids is None:
        return chunks
    if not isinstance(document_ids, DataFrame):
        document_ids = chunks.sparkSession.createDataFrame([(i,) for i in document_ids], f"{key} {dict(chunks.dtypes)[key]}")
    return chunks.join(document_ids.select(key).distinct(), key, "left_semi")


# == lexical channels ==


@dataclass(frozen=True)
class QueryTokens:
    """Content tokens of a question batch: ``frame`` (query_id, token, n_terms), and the same rows here if they may travel."""

    frame: DataFrame
    rows: pa.Table | None


def query_tokens(questions: DataFrame) -> QueryTokens:
    """Gathered once for all lexical channels of a batch."""
    q = questions.select("query_id", T.content_tokens(F.col("question")).alias("t"))
    q = q.select("query_id", F.explode("t").alias("token"), F.size("t").alias("n_terms"))
    rows = q.limit(TRAVEL_ROWS + 1).toArrow()
    return QueryTokens(q, rows if len(rows) <= TRAVEL_ROWS else None)


class _Terms:
    """The batch as arrays: its vocabulary, and for each token the questions that have it."""

    def __init__(self, rows: pa.Table) -> None:
        self.vocabulary = pc.unique(rows["token"].combine_chunks())
        self.ids = pc.unique(rows["query_id"].combine_chunks())
        token = pc.index_in(rows["token"].combine_chunks(), self.vocabulary).to_numpy()
        query = pc.index_in(rows["query_id"].combine_chunks(), self.ids).to_numpy()
        order = np.lexsort((query, token))
        self.queries = query[order].astype(np.int64)
        self.start = np.searchsorted(token[order], np.arange(len(self.vocabulary) + 1))
        self.n_terms = np.zeros(len(self.ids), np.int64)
        self.n_terms[query] = rows["n_terms"].to_numpy()

    def counted(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, token and count of the vocabulary's tokens in each row of a list array."""
        lengths = _lengths(tokens)
        found = pc.index_in(tokens.flatten(), self.vocabulary)
        row = np.repeat(np.arange(len(lengths)), lengths)
        known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        token = pc.fill_null(found, 0).to_numpy()[known]
        size = max(1, len(self.vocabulary))
        key, count = np.unique(row[known] * size + token, return_counts=True)
        return key // size, key % size, count


def _stretches(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows [a, b) of ``most`` in all, as far as a row alone isn't above it, and at most ``rows`` of them."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = min(len(sizes), a + max(1, rows), max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1))
        yield a, b
        a = b


def _lengths(tokens: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Best:
    """The best k of every question seen so far, by score and then by the tie columns."""

    def __init__(self, n_queries: int, k: int, ties: list[str]) -> None:
        self.k, self.ties, self.held = k, ties, None
        self.least = np.full(n_queries, -np.inf)  # scores below it can't come in any more

    def add(self, rows: pa.Table, query: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """``rows`` are the chunks of a step; question ``query[i]`` scores ``score[i]`` on row ``at[i]``."""
        may = score >= self.least[query]
        query, at, score = query[may], at[may], score[may]
        if not len(query):
            return
        new = rows.take(pa.array(at)).append_column("_q", pa.array(query)).append_column("_s", pa.array(score))
        every = new if self.held is None else pa.concat_tables([self.held, new])
        every = every.sort_by([("_q", "ascending"), ("_s", "descending"), *((t, "ascending") for t in self.ties)])
        q = every["_q"].to_numpy()
        first = np.searchsorted(q, q)
        kept = np.flatnonzero(np.arange(len(q)) - first < self.k)
        self.held = every.take(pa.array(kept)).combine_chunks()
        full = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.least[q[full]] = every["_s"].to_numpy()[full]


def _scorer(terms: _Terms, kinds: tuple[int, ...], k: int, match_all: bool, carried: list[str], ties: list[str], weigh: Callable | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {kind: _Best(len(terms.ids), k, ties) for kind in kinds}
        asked = np.diff(terms.start)
        most_rows = SCORES // max(1, len(terms.ids))
        for batch in batches:
            every = batch.column(batch.schema.get_field_index("_tokens"))
            lengths = _lengths(every)
            for lo, hi in _stretches(lengths, COUNT_TOKENS, batch.num_rows):
                rows_, tokens_, tfs = terms.counted(every.slice(lo, hi - lo))
                pairs = np.bincount(rows_, asked[tokens_], hi - lo)
                for a, b in _stretches(pairs, PAIRS, most_rows):
                    x, y = np.searchsorted(rows_, (a, b))
                    row, token, tf, n = rows_[x:y] - a, tokens_[x:y], tfs[x:y], b - a
                    many = asked[token]
                    which = np.repeat(terms.start[token] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
                    cell = terms.queries[which] * n + np.repeat(row, many)
                    part = batch.slice(lo + a, n)
                    rows = pa.table({c: part.column(part.schema.get_field_index(c)) for c in carried})
                    hit = np.flatnonzero(np.bincount(cell, minlength=len(terms.ids) * n))
                    for kind in kinds:
                        worth = np.ones(len(token)) if kind == OVERLAP else weigh(token, tf, lengths[lo + a : lo + b][row])
                        score = np.bincount(cell, np.repeat(worth, many), len(terms.ids) * n)
                        query, at, value = hit // n, hit % n, np.round(score[hit], 6)
                        if match_all:
                            whole = value == terms.n_terms[query]
                            query, at, value = query[whole], at[whole], value[whole]
                        best[kind].add(rows, query, at, value)
        for kind, found in best.items():
            if found.held is not None:
                n = len(found.held)
                yield pa.RecordBatch.from_arrays(
                    [terms.ids.take(found.held["_q"].combine_chunks()), *(found.held[c].combine_chunks() for c in carried), found.held["_s"].combine_chunks(), pa.array([kind] * n, pa.int32())],
                    names=["query_id", *carried, "score", "channel"],
                )

    return run


def _local_best(tokens: QueryTokens, chunks: DataFrame, kinds: tuple[int, ...], k: int, match_all: bool, ties: list[str], field: str, weigh: Callable | None) -> DataFrame:
    carried = list(dict.fromkeys(["chunk_id", *ties]))
    rows = chunks.select(*carried, T.tokens(F.col(field)).alias("_tokens"))
    schema = StructType([tokens.frame.schema["query_id"], *(rows.schema[c] for c in carried), StructField("score", DoubleType()), StructField("channel", IntegerType())])
    return rows.mapInArrow(_scorer(_Terms(tokens.rows), kinds, k, match_all, carried, ties, weigh), schema)


def lexical_topk(questions: DataFrame, chunks: DataFrame, k: int = 20, match_all: bool = False, field: str = "text", ties: list[str] | None = None, tokens: QueryTokens | None = None) -> DataFrame:
    """Chunks by the number of content tokens they share with each question; 0 is no hit.

    match_all keeps only chunks with every token.  A question without content tokens finds nothing.
    """
    ties = ties or ["chunk_id"]
    tokens = tokens or query_tokens(questions)
    if tokens.rows is not None:
        scored = _local_best(tokens, chunks, (OVERLAP,), k, match_all, ties, field, None)
    else:
        rows = chunks.select(*dict.fromkeys(["chunk_id", *ties]), F.explode(T.content_tokens(F.col(field))).alias("token"))
        hits = rows.join(tokens.frame, "token").groupBy("query_id", "n_terms", *dict.fromkeys(["chunk_id", *ties])).agg(F.count("*").alias("shared"))
        scored = (hits.where("shared = n_terms") if match_all else hits).withColumn("score", F.col("shared").cast("double"))
    return top_k(scored, k, ties).select("query_id", "chunk_id", "rank", "score")


def _statistics(tokens: QueryTokens, chunks: DataFrame, field: str) -> tuple[np.ndarray, int, float]:
    """Document frequencies of the batch's vocabulary, number of chunks and mean length: one pass, a row a token."""
    terms = _Terms(tokens.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, chunks_, total = np.zeros(len(terms.vocabulary), np.int64), 0, 0
        for batch in batches:
            lengths = _lengths(batch.column(0))
            for a, b in _stretches(lengths, COUNT_TOKENS, batch.num_rows):
                _, token, _ = terms.counted(batch.column(0).slice(a, b - a))
                df += np.bincount(token, minlength=len(df))
            chunks_ += batch.num_rows
            total += int(lengths.sum())
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[chunks_, total], df[at]]))], names=["token", "n"])

    rows = chunks.select(T.tokens(F.col(field)).alias("t")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    got = {r["token"]: r["n"] for r in rows}
    n, total = got.pop(-2, 0), got.pop(-1, 0)
    df = np.zeros(len(terms.vocabulary), np.int64)
    df[list(got)] = list(got.values())
    return df, n, total / n if n else 0.0


def _bm25_weight(df: np.ndarray, n: int, mean: float, k1: float, b: float) -> Callable:
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return lambda token, tf, length: idf[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1.0)))


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, field: str = "text", tokens: QueryTokens | None = None) -> DataFrame:
    """Okapi BM25 over content tokens of the questions (Robertson & Zaragoza 2009).

    Document frequencies are counted for the questions' tokens only, in a pass of their own.
    """
    tokens = tokens or query_tokens(questions)
    if tokens.rows is not None:
        weigh = _bm25_weight(*_statistics(tokens, chunks, field), k1, b)
        scored = _local_best(tokens, chunks, (BM25,), k, False, ["chunk_id"], field, weigh)
    else:
        rows = chunks.select("chunk_id", T.tokens(F.col(field)).alias("t")).withColumn("len", F.size("t"))
        stats = rows.agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len"))
        tf = rows.select("chunk_id", "len", F.explode("t").alias("token")).join(tokens.frame.select("token").distinct(), "token", "left_semi")
        tf = tf.groupBy("token", "chunk_id", "len").agg(F.count("*").alias("tf"))
        df = tf.groupBy("token").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        scored = tf.join(df, "token").crossJoin(F.broadcast(stats)).join(tokens.frame, "token")  # stats is one row
        scored = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top_k(scored, k, ["chunk_id"]).select("query_id", "chunk_id", "rank", "score")


def lexical_channels(questions: DataFrame, chunks: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, field: str = "text") -> list[DataFrame] | DataFrame:
    """BM25 (channel 0) and shared tokens (channel 1) for :func:`fuse`, scored in one pass over the chunks."""
    tokens = query_tokens(questions)
    if tokens.rows is None:
        return [bm25_topk(questions, chunks, k, k1, b, field, tokens), lexical_topk(questions, chunks, k, field=field, tokens=tokens)]
    weigh = _bm25_weight(*_statistics(tokens, chunks, field), k1, b)
    scored = _local_best(tokens, chunks, (BM25, OVERLAP), k, False, ["chunk_id"], field, weigh).repartition(F.col("query_id"))  # for ranking and for fusion
    ranked = top_k(scored, k, ["chunk_id"], by=("query_id", "channel"))
    return ranked.select("query_id", "chunk_id", "rank", (F.col("channel") == OVERLAP).cast("int").alias("channel"))


def token_frequencies(chunks: DataFrame) -> DataFrame:
    """``token, df, cf``: the chunks that have each token, and its occurrences.

    A row is a chunk, whose own tokens tell both, so nothing is grouped by chunk.
    """
    every = F.array(F.array_distinct("t"), "t")
    both = chunks.select(T.tokens(F.col("text")).alias("t")).select(F.posexplode(every).alias("all", "t")).select("all", F.explode("t").alias("token"))
    return both.groupBy("token").agg(F.count_if(F.col("all") == 0).alias("df"), F.count_if(F.col("all") == 1).alias("cf"))


# == vectors ==


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list array without nulls as doubles, a row a vector; all are of one width."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bucket of each vector in each table."""
    out = np.empty((len(x), len(planes)), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = ((np.einsum("nw,tbw->ntb", x[lo : lo + 4096], planes) > 0) << np.arange(planes.shape[1])).sum(axis=2)
    return out


def _nearest(batches: Iterator[pa.RecordBatch], blocks: list[tuple[pa.Array, np.ndarray]], k: int, positive_only: bool, digits: int, key: str, planes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The best k of all these rows ``key, vector`` for each query of the blocks.

    Rows are scored some at a time and those kept that a query may still want; the first steps are small, so that
    later ones have a bound to go by.  With ``planes`` a row counts for a query only where a table has them in one
    bucket, or in two at one bit's distance.
    """
    best = [_Best(len(ids), k, [key]) for ids, _ in blocks]
    asked = [None if planes is None else _codes(m, planes) for _, m in blocks]
    step = 64
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(batch.schema.get_field_index("vector"))))
        lo = 0
        while lo < batch.num_rows:
            part = batch.slice(lo, step)
            lo, step = lo + part.num_rows, min(2 * step, 4096)
            x = _matrix(part.column(part.schema.get_field_index("vector")))
            codes = None if planes is None else _codes(x, planes)
            keys = pa.table({key: part.column(part.schema.get_field_index(key))})
            for (ids, m), found, wanted in zip(blocks, best, asked, strict=True):
                many, held, n_held = max(1, SCORES // len(ids)), [], 0
                for a in range(0, len(x), many):
                    scores = np.round(x[a : a + many] @ m.T, digits)
                    may = scores >= found.least
                    if positive_only:
                        may &= scores > 0
                    at, query = np.nonzero(may)
                    if planes is not None:
                        near = np.zeros(len(at), bool)
                        for t in range(len(planes)):
                            apart = codes[a + at, t] ^ wanted[query, t]
                            near |= (apart & (apart - 1)) == 0
                        at, query = at[near], query[near]
                    held.append((query, a + at, scores[at, query]))
                    n_held += len(query)
                    if n_held >= PAIRS or a + many >= len(x):
                        found.add(keys, *(np.concatenate(c) for c in zip(*held, strict=True)))
                        held, n_held = [], 0
    for (ids, _), found in zip(blocks, best, strict=True):
        if found.held is not None:
            yield pa.RecordBatch.from_arrays([ids.take(found.held["_q"].combine_chunks()), found.held[key].combine_chunks(), found.held["_s"].combine_chunks()], names=["query_id", key, "score"])


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, positive_only: bool = True, key: str = "chunk_id", digits: int = 6) -> DataFrame:
    """Exact nearest rows by inner product of unit vectors: ``query_id, key, rank, score``.

    ``queries(query_id, vector)`` are counted.  Up to ``TRAVEL_NUMBERS`` numbers go, in blocks, to all
    partitions of ``vectors(key, vector)``, which hand on their own best k; more are joined as a grid of
    blocks of queries and of vectors, both shuffled.  Ties go to the smaller key.
    """
    return _vectors_topk(queries, vectors, k, positive_only, key, digits, None)


def _vectors_topk(queries: DataFrame, vectors: DataFrame, k: int, positive_only: bool, key: str, digits: int, planes: np.ndarray | None) -> DataFrame:
    types = {"query_id": queries.schema["query_id"].dataType, key: vectors.schema[key].dataType}
    schema = StructType([*(StructField(n, t) for n, t in types.items()), StructField("score", DoubleType())])
    wanted = queries.select("query_id", "vector").where("vector is not null")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("numbers")).first()
    if not size["n"]:
        scored = vectors.sparkSession.createDataFrame([], schema)
    elif size["numbers"] > TRAVEL_NUMBERS:
        scored = _grid(wanted, vectors.select(key, "vector"), size["n"], size["numbers"], k, positive_only, key, digits, schema, planes)
    else:
        rows = wanted.orderBy("query_id").toArrow().combine_chunks()
        step = max(1, BLOCK_NUMBERS * len(rows) // size["numbers"])
        ids, matrix = rows["query_id"].combine_chunks(), _matrix(rows["vector"].combine_chunks())
        blocks = [(ids.take(pa.array(np.arange(a, min(len(rows), a + step)))), matrix[a : a + step]) for a in range(0, len(rows), step)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _nearest(batches, blocks, k, positive_only, digits, key, planes)

        scored = vectors.select(key, "vector").mapInArrow(run, schema)
    return top_k(scored, k, [key]).select("query_id", key, "rank", "score")


def _grid(queries: DataFrame, vectors: DataFrame, n: int, numbers: int, k: int, positive_only: bool, key: str, digits: int, schema: StructType, planes: np.ndarray | None) -> DataFrame:
    """Each cell of the grid has a block of queries and a block of vectors; both sides are copied along the other's blocks."""
    per_block = max(1, BLOCK_NUMBERS * n // numbers)
    rows, columns = -(-n // per_block), max(1, -(-vectors.count() // per_block))
    q = queries.withColumn("r", F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    v = vectors.where("vector is not null").withColumn("c", F.pmod(F.xxhash64(key), F.lit(columns)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            blocks = [(left["query_id"].combine_chunks(), _matrix(left["vector"].combine_chunks()))]
            found = list(_nearest(iter(right.select([key, "vector"]).to_batches()), blocks, k, positive_only, digits, key, planes))
        return pa.Table.from_batches(found) if found else pa.table({"query_id": left["query_id"].slice(0, 0), key: right[key].slice(0, 0), "score": pa.array([], pa.float64())})

    return q.groupBy("r", "c").cogroup(v.groupBy("r", "c")).applyInArrow(run, schema)


def sparse_dense_topk(queries: DataFrame, chunks: DataFrame, k: int = 20, ties: list[str] | None = None) -> DataFrame:
    """Cosine of sparse unit vectors ``(query_id | chunk_id, bucket, weight)`` by a join on the bucket."""
    c, q = chunks.withColumnRenamed("weight", "cw"), queries.withColumnRenamed("weight", "qw")
    scored = c.join(q, "bucket").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("cw") * F.col("qw")), 6).alias("score"))
    return top_k(scored.where("score > 0"), k, ties or ["chunk_id"]).select("query_id", "chunk_id", "rank", "score")


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, tables: int = 24, bits: int = 6, seed: int = 7, key: str = "chunk_id") -> DataFrame:
    """Approximate nearest rows: random-hyperplane signatures, candidates by bucket, exact scores.

    Each query looks into its own bucket and those at one bit's distance, in every table.  Every row is indexed;
    candidates aren't capped.  With few bits nearly all pairs are candidates, so none are joined: the queries travel
    as in :func:`dense_topk`, and buckets are compared for the pairs whose score may still count.
    """
    some = vectors.select("vector").where("vector is not null").first()
    planes = np.random.default_rng(seed).standard_normal((tables, bits, len(some[0]))) if some else None
    return _vectors_topk(queries, vectors, k, False, key, 6, planes)


def fuse(channels: list[DataFrame] | DataFrame, k: int = 20, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (0-based ranks), cut to k.

    Ties keep the order of first appearance: the earlier channel, then its rank.  ``channels`` is a
    list, or one table with a column ``channel``.
    """
    if isinstance(channels, DataFrame):
        tagged = channels
    else:
        tagged = together([c.select("query_id", "chunk_id", "rank", F.lit(n).alias("channel")) for n, c in enumerate(channels)])
    merged = tagged.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 12).alias("score"), F.min(F.struct("channel", "rank")).alias("seen"))
    return top_k(merged, k, ["seen"]).select("query_id", "chunk_id", "rank", "score")


def rerank(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Overlap reranker over ``query_id, question, chunk_id, text, rank``: share of the question's content tokens.

    Candidates that share nothing are dropped; ties keep the order they came in.
    """
    q, c = T.content_tokens(F.col("question")), T.content_tokens(F.col("text"))
    shared = T.overlap(q, c)
    scored = candidates.where(shared > 0).withColumn("score", shared / F.size(q)).withColumnRenamed("rank", "came")
    return top_k(scored, k, ["came"]).drop("came")


def rerank_with(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int = 5) -> DataFrame:
    """The seam for a cross-encoder: ``scorer(questions, texts)`` per Arrow batch; null scores are dropped."""
    udf = F.pandas_udf(scorer, "double")
    scored = candidates.withColumn("score", udf("question", "text")).where("score is not null").withColumnRenamed("rank", "came")
    return top_k(scored, k, ["came"]).drop("came")


def gate(ranked: DataFrame, min_score: float, context_k: int) -> DataFrame:
    """Rows of at least ``min_score``, the best ``context_k`` of them, ranks renumbered."""
    return top_k(ranked.where(F.col("score") >= min_score).withColumnRenamed("rank", "came"), context_k, ["came"]).drop("came")


def edge_position(rank: Column, n: Column) -> Column:
    """Where a 0-based rank of n goes so that the best stand at both edges."""
    return F.when(rank % 2 == 0, rank / 2).otherwise(n - 1 - (rank - 1) / 2).cast("int")


def edges(ranked: DataFrame) -> DataFrame:
    """Add ``marker``, the 1-based place in the context."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return ranked.withColumn("marker", edge_position(F.col("rank"), n) + 1)

"""Line dedup over levelled sorted runs of line hashes.

The index is a set of runs: tables bucketed and sorted by the 128-bit hash of the line key, each with
the number of documents that hold the line and the largest of their ids.  Documents come in batches
of descending id, so the document that keeps a line is known from the first batch that has it.  A
batch is reduced to its distinct keys, sorted, and merge-anti-joined with every run: a key that has
reached ``min_docs`` there is settled and no longer counted, and only what is left is written, as a
run of level 0.  When a level has ``fanout`` runs they are merged into one of the next level, so a
key is rewritten a logarithmic number of times.  All runs have the same buckets; none of these joins
and merges shuffles a run.

A line is dropped where its key is settled at last and a larger id holds it.  That takes one join of
the lines with the settled keys: lines pass a bitmap of these keys first, keys that may be hot are
broadcast, and only the texts of documents that may lose a line (by a bitmap again) are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeway.llm import common

_WHITE = common.WHITE_CHARS.encode()
#: Where a null doc_id sorts: below all others.
NULL_ID = -(1 << 63)
#: Batches of the one-shot query, by ranges of doc_id.
BATCHES = 4
FANOUT = 4
#: A key in one of so many parts of a batch's lines is joined by broadcast: there can be no more of them than that.
HEAVY = 1000
#: Words of 64 bits that a bitmap has at most; it is broadcast.
BITMAP_WORDS = 1 << 18


def _line_keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, texts, numbers, keys, first = [], [], [], [], []
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer()
                if raw is None or len(raw) < least:
                    continue
                seen = set()
                for number, line in enumerate(raw.to_pybytes().split(b"\n")):
                    if len(line) < least:
                        continue
                    key = line.strip(_WHITE)
                    if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                        key = digest(key.lower())  # bytes.lower() changes A-Z only
                        ids.append(doc)
                        texts.append(mark)
                        numbers.append(number)
                        keys.append(key)
                        first.append(key not in seen)
                        seen.add(key)
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(numbers, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(first, pa.bool_())],
                names=["doc", "mark", "line", "h1", "h2", "first"],
            )

    return run


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points: ``doc, mark, line, h1, h2, first``.

    mark is a hash of the whole text, which tells rows apart that share a doc_id; first tells the
    first line of its key in a text.
    """
    text = F.col("text").cast("string")
    return docs.select(_doc().alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(
        common.frugal(_line_keys(min_chars)), "doc long, mark long, line int, h1 long, h2 long, first boolean"
    )


class LineRuns:
    """The levelled runs.  ``levels[i]`` are the runs of level i, oldest first."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout, self.levels = spark, min_docs, fanout, [[]]
        self.buckets = common.partitions(spark)
        self.heavy: set[tuple[int, int]] = set()
        self._tables: dict[int, tuple[str, str]] = {}

    def add(self, keys: DataFrame, distinct_docs: bool = False, lines: int | None = None) -> None:
        """Add a batch of line keys, all of whose documents have smaller ids than those of earlier batches.

        distinct_docs: no two rows of the documents share an id, so a text's first lines count its keys.
        lines: how many lines the batch has, about; keys in one of HEAVY of them are noted as heavy.
        """
        if distinct_docs:
            batch = keys.where("first").groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        else:
            batch = keys.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        batch = self._sorted(batch)
        if lines is not None:
            cut = max(2, lines // HEAVY)
            self.heavy |= {(r["h1"], r["h2"]) for r in batch.where(F.col("docs") >= cut).select("h1", "h2").collect()}  # some HEAVY at most
        if self._runs():
            self.levels[0].append(self._sorted(self._unsettled(batch)))
            self._drop(batch)
        else:
            self.levels[0].append(batch)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._sorted(self._merged(full)))
                self._drop(*full)

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _unsettled(self, batch: DataFrame) -> DataFrame:
        """Merge anti-join with each run's settled keys."""
        for run in self._runs():
            batch = batch.join(run.where(F.col("docs") >= self.min_docs).hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def _sorted(self, rows: DataFrame) -> DataFrame:
        """A table of ``buckets`` buckets by key, each sorted by it."""
        name = f"sedgeway_line_run_{uuid.uuid4().hex}"
        path = f"{common.shared_dir(self.spark)}/{name}"
        common.owned(self.spark, path)
        rows.select("h1", "h2", "docs", "last").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        self._tables[id(table)] = (name, path)
        table._sedgeway_path = path  # type: ignore[attr-defined]
        return table

    def _drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(id(table))[0]}")
            common.discard(table)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs merged as they are sorted, two at a time."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h1", "h2", F.col("docs").alias("docs2"), F.col("last").alias("last2"))
            both = a.join(b.hint("merge"), ["h1", "h2"], "full_outer")
            return both.select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs"), F.greatest("last", "last2").alias("last"))

        return reduce(two, runs)

    def counts(self) -> DataFrame:
        """``h1, h2, docs, last`` over all runs; docs is at least ``min_docs`` for a settled key, and no count of all it has."""
        return self._merged(self._runs())

    def settled(self) -> DataFrame:
        """Keys in at least ``min_docs`` documents, with the largest of their ids."""
        return self.counts().where(F.col("docs") >= self.min_docs).select("h1", "h2", "last")

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Merge anti-join: the lines of a new batch that no run holds."""
        for run in self._runs():
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def close(self) -> None:
        self._drop(*self._runs())
        self.levels = [[]]


def _bitmap(keys: DataFrame, key: Column, rows: int) -> tuple[DataFrame, int]:
    """``_word, _bits`` of a bitmap of 64-bit hashes, 16 bits for each of ``rows`` until it has BITMAP_WORDS words, and their number."""
    words = min(BITMAP_WORDS, max(1, rows // 4))
    bits = keys.select(key.alias("k")).select(F.pmod("k", F.lit(words)).alias("_word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(k, 58) as int))").alias("b"))
    return bits.groupBy("_word").agg(F.bit_or("b").alias("_bits")), words


def _passed(rows: DataFrame, key: str, bitmap: tuple[DataFrame, int], how: str) -> DataFrame:
    """``rows`` joined to the bitmap (broadcast, BITMAP_WORDS rows at most), with ``_hit``."""
    words, many = bitmap
    joined = rows.join(F.broadcast(words), F.pmod(key, F.lit(many)) == F.col("_word"), how)
    hit = F.expr(f"coalesce((shiftrightunsigned(_bits, cast(shiftrightunsigned({key}, 58) as int)) & 1L) = 1L, false)")
    return joined.withColumn("_hit", hit).drop("_word", "_bits")


def _dropped(lines: DataFrame, settled: DataFrame, n_settled: int, heavy: set[tuple[int, int]]) -> DataFrame:
    """``doc, mark, line`` of the lines whose settled key a larger id holds."""
    spark = lines.sparkSession
    lines = _passed(lines.select("doc", "mark", "line", "h1", "h2"), "h1", _bitmap(settled, F.col("h1"), n_settled), "inner").where("_hit").drop("_hit")
    if n_settled <= common.BROADCAST_ROWS:
        found = lines.join(F.broadcast(settled), ["h1", "h2"])
    else:
        hot = F.broadcast(spark.createDataFrame(sorted(heavy), "h1 long, h2 long"))  # HEAVY a batch at most
        few = F.broadcast(settled.join(hot, ["h1", "h2"]).withColumnsRenamed({"h1": "k1", "h2": "k2", "last": "hot"}))
        marked = lines.join(few, F.expr("h1 = k1 and h2 = k2"), "left").drop("k1", "k2")
        columns = ["doc", "mark", "line", "last"]
        found = marked.where("hot is not null").withColumnRenamed("hot", "last").select(columns).unionByName(
            marked.where("hot is null").drop("hot").join(settled.join(hot, ["h1", "h2"], "left_anti"), ["h1", "h2"]).select(columns)
        )
    return found.where("doc < last").select("doc", "mark", "line")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, counts, texts = [], [], []
        for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, gone = text.split("\n"), set(lines or ())
            totals.append(len(parts))
            counts.append(len(gone))
            texts.append("\n".join(p for k, p in enumerate(parts) if k not in gone) if gone else text)
        yield pa.record_batch([batch.column(0), pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop repeated lines: a key in at least ``min_docs`` documents stays only in the largest doc_id.

    Returns per row ``doc_id, n_lines, n_dropped, kept_sha256`` and the ``kept_text``.

    Nulls: a null text is one empty line; rows with a null doc_id count as one document that sorts
    below all others.  Rows that share a doc_id are one document for
    the counts; each loses the lines of its own text whose keys say so.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct(_doc()).alias("ids")).first()
    at = docs.select(_doc().cast("double").alias("doc")).approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if ids["n"] else []
    cuts = sorted({int(c) for c in at}, reverse=True)
    batch = sum(((F.col("doc") <= c).cast("int") for c in cuts), F.lit(0))
    keyed = common.written(line_keys(docs, min_chars).withColumn("batch", batch), "line-keys", ["batch"])
    runs = LineRuns(spark, min_docs, fanout)
    total = keyed.count()
    for b in range(len(cuts) + 1):
        runs.add(keyed.where(F.col("batch") == b).drop("batch"), ids["n"] == ids["ids"], total // (len(cuts) + 1))
    settled = common.written(runs.settled(), "line-settled")
    runs.close()
    drops = _dropped(keyed, settled, settled.count(), runs.heavy)
    by_doc = common.written(drops.groupBy("doc", "mark").agg(F.collect_set("line").alias("lines")), "line-drops")
    common.discard(keyed, settled)
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc().alias("doc"), F.xxhash64(text).alias("mark"), F.coalesce(text, F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc", "mark"))
    source = _passed(source, "row", _bitmap(by_doc, F.xxhash64("doc", "mark"), by_doc.count()), "left").drop("row")
    whole = source.where("not _hit").select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text")
    )
    cut = source.where("_hit").join(by_doc, ["doc", "mark"], "left").select("doc_id", "text", "lines").mapInArrow(common.frugal(_kept), "doc_id long, n_lines long, n_dropped long, kept_text string")
    return whole.unionByName(cut).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")

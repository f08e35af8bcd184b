"""Language identification by nearest centroid.

A text is a vector of hashed character 2- and 3-grams over letters (case folded, every other
character a boundary), weighed by TF-IDF and normalised.  Document frequencies are counted over all
training rows; each language's centroids come from spherical k-means over a bounded, documented
sample of its rows (the smallest hashes of doc_id).  A text gets the language of the centroid of
largest cosine, and is marked as rejected when that cosine is below what the centroid's own
training rows show.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.llm import common
from sedgeway.llm.textops import steps

DIM_BITS = 12
DIM = 1 << DIM_BITS
#: Rows of the centroid sample over all languages; each gets an equal part, 20 at least.
SAMPLE_ROWS = 4000
CLUSTERS = 3
ROUNDS = 8
#: Rejected when the cosine is below this part of the lowest percentile seen in training.
REJECT = 0.8
_ROWS = 256
_fold: dict[str, np.ndarray] = {}


def _folded(points: np.ndarray) -> np.ndarray:
    """Lower-case code point of letters, 0 for everything else."""
    if "bmp" not in _fold:
        _fold["bmp"] = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(1 << 16)], np.uint32)
    out = _fold["bmp"][np.minimum(points, 0xFFFF)]
    far = points > 0xFFFF
    if far.any():
        kinds, back = np.unique(points[far], return_inverse=True)
        out[far] = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in kinds], np.uint32)[back]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (rows x DIM, float32) and whether each row has a letter."""
    rows = len(texts)
    strings = [x or "" for x in texts.to_pylist()]
    lengths = np.array([len(s) for s in strings], np.int64) + 2
    points = np.frombuffer(("\n\n".join(strings) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    f = _folded(points)
    owner = np.repeat(np.arange(rows, dtype=np.int64), lengths)
    has = np.bincount(owner[f > 0], minlength=rows) > 0
    a, b, c = f[:-2], f[1:-1], f[2:]
    own = owner[1:-1] << DIM_BITS
    mid = b > 0  # n-grams around a letter; a boundary on either side is part of them
    a, b, c, own = a[mid], b[mid], c[mid], own[mid]
    with np.errstate(over="ignore"):
        two = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
        three = (two * np.uint32(0xC2B2AE3D)) ^ (c * np.uint32(0x27D4EB2F))
        two = two * np.uint32(0x165667B1)
        three = (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    shift = np.uint32(32 - DIM_BITS)
    counts = np.bincount(own | (two >> shift), minlength=rows << DIM_BITS)
    counts += np.bincount(own | (three >> shift), minlength=rows << DIM_BITS)
    return counts.reshape(rows, DIM).astype(np.float32), has


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in steps(texts):
        for lo in range(a, b, _ROWS):
            yield lo, min(b, lo + _ROWS)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for a, b in _pieces(batch.column(0)):
            counts, _ = features(batch.column(0).slice(a, b - a))
            df += (counts > 0).sum(axis=0)
            n += b - a
    yield pa.record_batch([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], df]))], names=["bucket", "df"])


def _clusters(idf: np.ndarray, k: int, rounds: int) -> Callable:
    """Spherical k-means of one language's sample; farthest-first start from its mean, so deterministic."""

    def run(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        table = table.sort_by([("h", "ascending"), ("text", "ascending")])
        text = table["text"].combine_chunks()
        x = np.concatenate([features(text.slice(a, b - a))[0] for a, b in _pieces(text)])
        x = x[x.any(axis=1)]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "low": pa.array([], pa.float64()), "centre": pa.array([], pa.binary())})
        x = _unit(x * idf)
        centres = _unit(x.mean(axis=0, keepdims=True))
        near = x @ centres[0]
        while len(centres) < min(k, len(x)):
            far = int(np.argmin(near))
            centres = np.concatenate([centres, x[far : far + 1]])
            near = np.maximum(near, x @ centres[-1])
        for _ in range(rounds):
            which = np.argmax(x @ centres.T, axis=1)
            centres = _unit(np.stack([x[which == i].mean(axis=0) if (which == i).any() else centres[i] for i in range(len(centres))]))
        cosine = x @ centres.T
        which = np.argmax(cosine, axis=1)
        # a cluster of a few odd rows would draw odd rows of every language
        keep = [i for i in range(len(centres)) if (which == i).sum() >= max(1, len(x) // 100)]
        low = [float(np.percentile(cosine[which == i, i], 1)) for i in keep]
        return pa.table(
            {"lang": [lang] * len(keep), "k": pa.array(keep, pa.int32()), "low": low, "centre": [centres[i].astype(np.float32).tobytes() for i in keep]}
        )

    return run


class Model:
    """Inverse document frequencies, and centroids with their language and lowest usual cosine."""

    def __init__(self, idf: np.ndarray, langs: list[str], low: np.ndarray, centres: np.ndarray) -> None:
        self.idf, self.langs, self.low, self.centres = idf, langs, low, centres


def train(rows: DataFrame, clusters: int = CLUSTERS, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on ``rows`` (doc_id, text, lang), of which those with a null text or lang are left out; equal ones count once in the sample."""
    rows = rows.where("text is not null and lang is not null")
    df = np.ones(DIM, np.int64)
    n = 0
    counted = rows.select("text").mapInArrow(common.frugal(_frequencies), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    for r in counted.collect():  # DIM + 1 rows
        if r["bucket"] < 0:
            n = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    n_langs = max(1, rows.select("lang").distinct().count())
    each = max(20, sample_rows // n_langs)
    # equal rows are one, so an id or a text that is repeated ever so often fills no sample
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "mark")
    keyed = rows.withColumns({"h": F.xxhash64("doc_id"), "mark": F.xxhash64("text")})
    picked = keyed.groupBy("doc_id", "lang", "h", "mark").agg(F.lit(1).alias("one")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("doc_id", "lang", "h", "mark")
    sample = keyed.join(common.small(picked, each * n_langs), ["doc_id", "lang", "h", "mark"]).groupBy("lang", "h", "doc_id", "mark").agg(F.first("text").alias("text")).select("lang", "h", "text")
    found = sample.groupBy("lang").applyInArrow(common.frugal(_clusters(idf, clusters, rounds)), "lang string, k int, low double, centre binary").orderBy("lang", "k").collect()
    centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in found]) if found else np.zeros((0, DIM), np.float32)
    return Model(idf, [r["lang"] for r in found], np.array([r["low"] for r in found]), centres)


def predict(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` from the text alone.

    A null text, one without letters, or an empty model gives ``und`` with score 0 and rejected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], dtype=object)
        # the vectors' norm divides the cosine, so idf goes into the centroids once
        weighed = (model.centres * model.idf).T.copy()
        square = model.idf**2
        for batch in batches:
            text = batch.column(1)
            which, score, bad = [], [], []
            for a, b in _pieces(text):
                x, has = features(text.slice(a, b - a))
                norm = np.sqrt(np.einsum("ij,ij,j->i", x, x, square, optimize=False)) if len(model.langs) else np.ones(b - a)
                if len(model.langs):
                    cosine = (x @ weighed) / np.maximum(norm, 1e-12)[:, None]
                    best = np.argmax(cosine, axis=1)
                    top = np.clip(cosine[np.arange(b - a), best], 0.0, 1.0).astype(np.float64)
                    low = top < reject * model.low[best]
                    none = ~has
                else:
                    best, top, low, none = np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool), np.ones(b - a, bool)
                best = np.where(none, len(model.langs), best)
                which.append(best)
                score.append(np.where(none, 0.0, top))
                bad.append(low | none)
            if which:
                yield pa.record_batch(
                    [batch.column(0), pa.array(names[np.concatenate(which)], pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(bad))],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        common.frugal(run), "doc_id long, lang_pred string, score double, rejected boolean"
    )


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text leaves 2 on division by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, clusters: int = CLUSTERS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the rows that aren't held out and predict all: ``doc_id, held_out, lang_pred, score, rejected``.

    Nulls: a null lang or text, or a null doc_id, keeps a row out of training; a null text or one
    without letters is ``und``.  Ties of cosine go to the first language by name.  Repeated rows are
    predicted alike.  An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")



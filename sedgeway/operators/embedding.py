"""The hashing embedder, as vectors per row; hosted embedders take its place as an iterator UDF."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from sedgeway.functions import text as T

WIDTH = 256
#: Texts that a task counts at a time, and tokens whose bucket it remembers.
STEP = 1024
KNOWN = 1 << 20


def bucket(token: str, width: int = WIDTH) -> int:
    """Stable bucket of a token: 8 bytes of BLAKE2b, big-endian, modulo the width."""
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest(), "big") % width


def _bucketed(tokens: pa.Array, width: int, known: dict[str, int]) -> np.ndarray:
    """Tokens of each bucket, a row a text."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    if len(known) > KNOWN:
        known.clear()
    buckets = []
    for token in coded.dictionary.to_pylist():
        at = known.get(token)
        if at is None:
            at = known[token] = bucket(token, width)
        buckets.append(at)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.array(buckets, np.int64)[coded.indices.to_numpy()] if len(row) else row
    return np.bincount(row * width + at, minlength=len(lengths) * width).reshape(-1, width)


def _weights(keys: list[pa.Array], names: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that a text has."""
    norm = np.sqrt((counts * counts).sum(axis=1))
    row, at = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([*(k.take(pa.array(row)) for k in keys), pa.array(at.astype(np.int32)), pa.array(counts[row, at] / norm[row])], names=[*names, "bucket", "weight"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    """Some rows at a time: the columns before the last, and the last."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            yield part.columns[:-1], part.column(part.num_columns - 1)


def sparse(rows: DataFrame, key: list[str], text: Column, width: int = WIDTH, distinct: bool = False) -> DataFrame:
    """Unit vectors as rows ``key, bucket, weight``; a text without tokens has none, and rows of one key count as one text.

    Tokens become counts of buckets where they are.  Of ``distinct`` keys nothing is shuffled; else these counts
    are, a row a text.
    """
    tokens = rows.select(*key, T.tokens(text).alias("_tokens"))
    keys = [tokens.schema[k] for k in key]
    schema = StructType([*keys, StructField("bucket", IntegerType()), StructField("weight", DoubleType())])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for of, texts in _steps(batches):
            yield _weights(of, key, _bucketed(texts, width, known))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for of, texts in _steps(batches):
            counts = _bucketed(texts, width, known)
            ends = pa.array(np.arange(len(counts) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([*of, pa.ListArray.from_arrays(ends, pa.array(counts.ravel().astype(np.int32)))], names=[*key, "_counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, lists in _steps(batches):
            start = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False) // width)[:-1]]).astype(np.int64)
            each = lists.flatten().to_numpy().astype(np.int64).reshape(-1, width)
            yield _weights(of, key, np.add.reduceat(each, start, axis=0))

    if distinct:
        return tokens.mapInArrow(single, schema)
    counts = tokens.mapInArrow(counted, StructType([*keys, StructField("_counts", ArrayType(IntegerType()))]))
    return counts.groupBy(*key).agg(F.flatten(F.collect_list("_counts")).alias("_counts")).mapInArrow(summed, schema)


def hashed(texts: pd.Series, width: int = WIDTH) -> np.ndarray:
    """Unit vectors of a batch; tokens are hashed once per batch."""
    import re

    known: dict[str, int] = {}
    out = np.zeros((len(texts), width))
    for row, text in enumerate(texts):
        for token in re.findall("[a-z0-9]+", (text or "").lower()):
            at = known.get(token)
            if at is None:
                at = known[token] = bucket(token, width)
            out[row, at] += 1
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None]


def embed(text: Column, width: int = WIDTH, embedder: Callable[[list[str]], list] | None = None) -> Column:
    """``array<double>`` of each text, by the hashing embedder or by any batch function."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if embedder is None:
                yield pd.Series(list(hashed(batch, width)))
            else:
                yield pd.Series([[float(x) for x in v] for v in embedder(batch.fillna("").tolist())])

    return run(text)

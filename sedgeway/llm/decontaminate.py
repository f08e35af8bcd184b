"""Benchmark decontamination by greedy string tiling.

The shared-token seeds are windows of ``seed`` tokens.  Those of a block of benchmark items, whose
bytes are bounded, travel to every task; a rolling (Karp-Rabin) hash over each whole document finds
the positions that meet one, and the positions of one document and item are tiled: the longest
match none of whose tokens are marked is marked, again and again, down to matches of ``seed``
tokens.  As tiles may come in any order, reordered passages count in full.  An item is found in a
document when tiles cover enough of the *item's* tokens.  No row is shuffled.

Tokens are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeway.llm import common
from sedgeway.llm.textops import Words, steps

SEED = 4
MIN_COVERAGE = 0.5
#: Bytes of benchmark text that travel to the tasks at a time.
BLOCK_BYTES = 8 << 20

_TOKEN_BYTES = np.full(256, 0x20, dtype=np.uint8)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _TOKEN_BYTES[_lo:_hi] = np.arange(_lo, _hi)


def _tokens(texts: pa.Array) -> Words:
    """Tokens as words of the lower-cased text with every other ASCII byte blanked."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = pc.utf8_lower(texts)
    n = len(texts)
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    clean = pa.py_buffer(_TOKEN_BYTES[raw])
    return Words(pa.Array.from_buffers(texts.type, n, [None, offsets, clean], offset=texts.offset))


def tile(i: np.ndarray, j: np.ndarray, seed: int, n_item: int) -> tuple[int, int]:
    """Greedy tiling of seed hits (document position i, item position j): covered item tokens and tiles.

    Ties of length go to the earliest document position, then to the earliest item position.
    """
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.concatenate([[True], (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)])
    at = np.flatnonzero(new)
    length = np.diff(np.concatenate([at, [len(i)]])) + seed - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(length, i[at], j[at], strict=True)]
    heapq.heapify(heap)
    base = int(i.min())
    in_doc = np.zeros(int(i.max()) - base + seed, dtype=bool)
    in_item = np.zeros(n_item, dtype=bool)
    covered = tiles = 0
    while heap and covered <= n_item - seed:
        n, a, b = heapq.heappop(heap)
        free = ~(in_doc[a - base : a - base - n] | in_item[b : b - n])
        if free.all():
            in_doc[a - base : a - base - n] = True
            in_item[b : b - n] = True
            covered, tiles = covered - n, tiles + 1
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo >= seed:
                heapq.heappush(heap, (lo - hi, a + lo, b + lo))
    return covered, tiles


class _Seeds:
    """Sorted window hashes of a block of items, each with its items and positions."""

    def __init__(self, ids: list, texts: list[str], seed: int) -> None:
        words = _tokens(pa.array(texts, pa.string()))
        hashes = words.hashes()
        self.lengths = words.counts
        self.ids = ids
        self.by_size = {}
        for size in range(1, seed + 1):
            # an item shorter than a seed is matched whole
            wanted = words.counts >= seed if size == seed else words.counts == size
            start, value = words.windows(size, hashes)
            keep = wanted[words.row[start]] if len(start) else np.zeros(0, bool)
            start, value = start[keep], value[keep]
            if len(value):
                order = np.argsort(value, kind="stable")
                start, value = start[order], value[order]
                table = np.zeros(1 << 20, dtype=bool)
                table[(value >> np.uint64(44)).astype(np.int64)] = True
                row = words.row[start]
                self.by_size[size] = (value, row, start - words.first[row], table)


def _matcher(seeds: _Seeds, min_coverage: float, seed: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_tokens", pa.int64()), ("covered", pa.int64()), ("tiles", pa.int64())])

    def step(docs: pa.Array, texts: pa.Array, out: list) -> None:
        words = _tokens(texts)
        hashes = words.hashes()
        for size, (value, item, position, table) in seeds.by_size.items():
            start, mine = words.windows(size, hashes)
            hit = np.flatnonzero(table[(mine >> np.uint64(44)).astype(np.int64)])
            start, mine = start[hit], mine[hit]
            lo = np.searchsorted(value, mine, "left")
            many = np.searchsorted(value, mine, "right") - lo
            hit = np.flatnonzero(many)
            if not len(hit):
                continue
            start, lo, many = start[hit], lo[hit], many[hit]
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            start = np.repeat(start, many)
            row, it, j = words.row[start], item[which], position[which]
            i = start - words.first[row]
            order = np.lexsort((j, it, row))
            row, it, i, j = row[order], it[order], i[order], j[order]
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (it[1:] != it[:-1]), [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                n = int(seeds.lengths[it[a]])
                places = np.unique(j[a:b])
                reach = size + int(np.minimum(np.diff(places), size).sum())  # item tokens under any seed
                if reach < min_coverage * n:
                    continue
                covered, tiles = tile(i[a:b], j[a:b], size, n)
                if covered >= min_coverage * n:
                    out.append((docs[int(row[a])].as_py(), seeds.ids[it[a]], n, covered, tiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            text = batch.column(1)
            for a, b in steps(text):
                step(batch.column(0).slice(a, b - a), text.slice(a, b - a), out)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: ``doc_id, item_id, item_tokens, covered, tiles, coverage``.

    An item counts as held when non-overlapping matches of ``seed`` tokens or more cover at least
    ``min_coverage`` of its tokens; an item with fewer tokens must occur whole.  Nulls: a null or
    empty text on either side matches nothing; null ids are returned as such.  Repeated rows give
    repeated pairs.  Empty tables give no rows.  Other columns are not looked at.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = -(-size // BLOCK_BYTES)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for k in range(blocks):  # the stated query set, in blocks of bounded bytes
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        seeds = _Seeds([r["item_id"] for r in block], [r["text"] for r in block], seed)
        found = source.mapInArrow(common.frugal(_matcher(seeds, min_coverage, seed)), "doc_id long, item_id long, item_tokens long, covered long, tiles long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_tokens long, covered long, tiles long")
    return out.withColumn("coverage", F.col("covered") / F.col("item_tokens"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents (all their columns) that hold no benchmark item.

    Each text is judged by itself: rows that share an id, or have none, don't take clean ones with them.
    """
    mark = F.xxhash64(docs["text"].cast("string"))
    bad = common.written(contaminated(docs.select(mark.alias("doc_id"), "text"), benchmark, seed, min_coverage).select(F.col("doc_id").alias("_bad")).distinct(), "decontaminate-marks")
    bad = common.small(bad, bad.count())
    return docs.join(bad, mark == bad["_bad"], "left_anti")

"""Search as the web does it: all terms, "phrases", or, and -exclusions, by stems.

Questions are parsed where the plan is built and travel in blocks; a chunk that has all stems of an
alternative is looked at for its phrases and exclusions.  Odd input finds nothing and raises nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sedgeway.functions import text as T
from sedgeway.functions.stem import stem
from sedgeway.operators.retrieval import _Best, top_k

#: Questions of a block.
BLOCK = 2_000
_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')
_TOKEN = re.compile("[a-z0-9]+")
_STOP = frozenset(T.STOP_WORDS)

#: A term or a phrase: stems with their distance from the first; stop words count as distance only.
Item = tuple[tuple[str, int], ...]


def _item(text: str) -> Item:
    found = [(stem(t), k) for k, t in enumerate(_TOKEN.findall(text.lower())) if t not in _STOP]
    return tuple((t, k - found[0][1]) for t, k in found)


def parse(question: str) -> list[tuple[list[Item], list[Item]]]:
    """Alternatives, each with what it needs and what it excludes; those that need nothing are left out."""
    out: list[tuple[list[Item], list[Item]]] = [([], [])]
    for minus, phrase, word in _PART.findall(question or ""):
        if word.lower() == "or":
            out.append(([], []))
            continue
        item = _item(phrase or word)
        if item:
            excluded = bool(minus) or not phrase and word.startswith("-")
            out[-1][excluded].append(item)
    return [a for a in out if a[0]]


def _holds(item: Item, places: dict[str, list[int]]) -> bool:
    first, *rest = item
    return any(all(at + gap in places.get(t, ()) for t, gap in rest) for at in places.get(first[0], ()))


def websearch_topk(questions: DataFrame, chunks: DataFrame, k: int = 20, field: str = "text") -> DataFrame:
    """``query_id, chunk_id, rank, score`` of chunks that match; the score grows with the frequency of the stems asked for.

    Ties go to the smaller chunk_id.  A question without a term to look for finds nothing.
    """
    schema = StructType([questions.schema["query_id"], chunks.schema["chunk_id"], StructField("score", DoubleType())])
    rows = chunks.select("chunk_id", T.tokens(F.col(field)).alias("tokens"))
    parts, block = [], []
    for r in questions.select("query_id", "question").toLocalIterator():
        block.append((r["query_id"], parse(r["question"])))
        if len(block) == BLOCK:
            parts.append(rows.mapInArrow(_matcher(block, k, schema), schema))
            block = []
    parts.append(rows.mapInArrow(_matcher(block, k, schema), schema))
    return top_k(reduce(DataFrame.unionByName, parts), k, ["chunk_id"]).select("query_id", "chunk_id", "rank", "score")


def _matcher(block: list, k: int, schema: StructType):
    alternatives = [(q, need, out) for q, (_, found) in enumerate(block) for need, out in found]
    of: dict[str, list[int]] = {}  # the alternatives that need a stem
    stems = [{t for item in need for t, _ in item} for _, need, _ in alternatives]
    for n, wanted in enumerate(stems):
        for t in wanted:
            of.setdefault(t, []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known = _Best(len(block), k, ["chunk_id"]), {}
        for batch in batches:
            hits: dict[tuple[int, int], float] = {}
            for row, tokens in enumerate(batch.column(1).to_pylist()):
                places: dict[str, list[int]] = {}
                for at, token in enumerate(tokens or ()):
                    s = known.get(token)
                    if s is None:
                        s = known[token] = stem(token)
                    places.setdefault(s, []).append(at)
                met: dict[int, int] = {}
                for s in places.keys() & of.keys():
                    for n in of[s]:
                        met[n] = met.get(n, 0) + 1
                for n, count in met.items():
                    query, need, out = alternatives[n]
                    if count == len(stems[n]) and all(len(i) == 1 or _holds(i, places) for i in need) and not any(_holds(i, places) for i in out):
                        score = round(sum(len(places[s]) / (len(places[s]) + 1.2) for s in stems[n]), 6)
                        hits[query, row] = max(score, hits.get((query, row), 0.0))
                if len(known) > 1_000_000:
                    known.clear()
            if hits:
                query, at = (np.array(x, np.int64) for x in zip(*hits, strict=True))
                best.add(pa.table({"chunk_id": batch.column(0)}), query, at, np.array(list(hits.values())))
        if best.held is not None:
            ids = pa.array([q for q, _ in block]).take(best.held["_q"].combine_chunks())
            yield pa.RecordBatch.from_arrays([ids, best.held["chunk_id"].combine_chunks(), best.held["_s"].combine_chunks()], names=["query_id", "chunk_id", "score"])

    return run

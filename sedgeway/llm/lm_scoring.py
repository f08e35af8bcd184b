"""Compression cross-entropy: zstandard sizes under an in-domain and a general dictionary.

Both dictionaries are built from the corpus.  Spark counts every word of every document, over all
documents and over those labelled as in-domain; the gain of a word is the bytes that a back
reference saves times its count, and each dictionary holds the words of greatest gain, the best at
its end where offsets are shortest.  In-domain gain is weighed by how much likelier the word is
there than in general.  Their size follows the vocabulary that was counted (``SHARE`` of its bytes).
A document's score is the difference of the two compressed sizes over
their sum: positive where the in-domain dictionary serves it better.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeway.llm import common
from sedgeway.llm.textops import Words, steps

#: Bytes of a dictionary: a share of the counted words' bytes, but never less than DICT_BYTES, nor more than the
#: window of 2**27 that zstandard's decoders accept; this bounds what travels to the tasks.
SHARE, DICT_BYTES, WINDOW = 0.025, 112_640, 1 << 27
LEVEL = 3
#: A back reference costs about so many bytes; shorter words gain nothing.
REFERENCE = 3
#: Distinct words a task gathers before it hands on their counts.
HOLD = 400_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def out() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([v[0] for v in held.values()], pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[2] for v in held.values()], pa.int64())],
            names=["word", "n", "inside"],
        )

    for batch in batches:
        text, flag = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in steps(text):
            words = Words(text.slice(a, b - a))
            long = np.flatnonzero(words.ends - words.starts > REFERENCE)
            if not len(long):
                continue
            hashes = words.hashes()[long]
            inside = flag[a:b][words.row[long]]
            order = np.argsort(hashes)
            sorted_ = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            n = np.diff(np.concatenate([first, [len(order)]]))
            run = np.concatenate([[0], np.cumsum(inside[order])])
            k = run[np.concatenate([first[1:], [len(order)]])] - run[first]
            at = long[order[first]]
            raw = words.raw.tobytes()
            for h, s, e, c, m in zip(sorted_[first].tolist(), words.starts[at].tolist(), words.ends[at].tolist(), n.tolist(), k.tolist(), strict=True):
                got = held.get(h)
                if got is None:
                    held[h] = [raw[s:e].decode("utf-8", "replace"), c, m]
                else:
                    got[1] += c
                    got[2] += m
            if len(held) >= HOLD:
                yield out()
                held.clear()
    if held:
        yield out()


def _packed(rows: list, most: int) -> bytes:
    """Words joined by spaces, the best last, at most ``most`` bytes."""
    parts, left = [], most
    for r in rows:
        w = r["word"].encode() + b" "
        if len(w) <= left:
            parts.append(w)
            left -= len(w)
    return b"".join(reversed(parts))


def _best(words: DataFrame, size: int) -> bytes:
    """The words of greatest gain (``word, gain``), as many as ``size`` holds; only these reach the driver."""
    words = words.withColumn("bin", F.floor(64 * F.log(F.greatest("gain", F.lit(1e-6)))))
    least, held = None, 0
    for r in words.groupBy("bin").agg(F.sum(F.octet_length("word") + 1).alias("b")).orderBy(F.desc("bin")).collect():  # some thousand bins at most
        least, held = r["bin"], held + r["b"]
        if held >= size:
            break
    kept = common.written(words.where(F.col("bin") >= F.lit(least)), "lm-best")
    out = _packed(kept.orderBy(F.desc("gain"), "word").collect(), size)
    common.discard(kept)
    return out


def dictionaries(docs: DataFrame, labels: DataFrame, size: int | None = None) -> tuple[bytes, bytes]:
    """The in-domain and the general dictionary, from counts over all documents and all labels.

    Each has ``size`` bytes at most, by default what follows from the counted vocabulary.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("quality = 1 and id is not null").select("id").distinct()
    text = F.col("text").cast("string")
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text is not null")
    flagged = flagged.join(common.small(good, good.count()), F.col("doc_id") == F.col("id"), "left").select("text", F.col("id").isNotNull().alias("inside"))
    counts = common.written(
        flagged.mapInArrow(common.frugal(_word_counts), "word string, n long, inside long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")),
        "lm-words",
    )
    total = counts.agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"), F.sum(F.octet_length("word") + 1).alias("bytes")).first()
    size = size or min(WINDOW, max(DICT_BYTES, int(SHARE * (total["bytes"] or 0))))
    saved = F.octet_length("word") + 1 - REFERENCE
    ratio = (F.col("inside") / max(1, total["inside"] or 0)) / (F.col("n") / max(1, total["n"] or 0))
    fits = F.octet_length("word") < size
    general = counts.where(fits).select("word", (F.col("n") * saved).alias("gain"))
    domain = counts.where(fits & (F.col("inside") > 0)).select("word", F.round(F.col("inside") * saved * F.least(ratio, F.lit(2.0)), 6).alias("gain"))
    out = _best(domain, size), _best(general, size)
    common.discard(counts)
    return out


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """With match tables that index all of ``content``: a level's own hold some 2**17 positions."""
    if not content:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    if len(content) <= DICT_BYTES:
        d.precompute_compress(level=level)
    else:
        bits = min(len(content).bit_length(), 28)
        d.precompute_compress(compression_params=zstandard.ZstdCompressionParameters.from_level(level, window_log=bits + 1, hash_log=bits, chain_log=bits))
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)


def _sizer(content: bytes, level: int) -> Callable[[bytes], int]:
    """Compressed size of a text under a dictionary.

    Told a text's size, zstandard copies the match tables of the dictionary for every text above some
    16 KB, which takes the longer the larger the dictionary is.  Not told, it looks them up in place.
    """
    packer = _compressor(content, level)
    if len(content) <= DICT_BYTES:
        return lambda raw: len(packer.compress(raw))

    def size(raw: bytes) -> int:
        frame = packer.compressobj()
        return len(frame.compress(raw)) + len(frame.flush())

    return size


def score(docs: DataFrame, domain: bytes, general: bytes, level: int = LEVEL) -> DataFrame:
    """``doc_id, n_bytes, domain_bytes, general_bytes, score`` of every whole text.

    score = (general - domain) / (general + domain), in (-1, 1).  A null or empty text scores 0.0
    with sizes 0; repeated rows score alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizers = [_sizer(content, level) for content in (domain, general)]
        for batch in batches:
            sizes: list[list[int]] = [[], [], []]
            for text in batch.column(1):
                raw = text.as_buffer()
                if raw is None or not len(raw):
                    for s in sizes:
                        s.append(0)
                    continue
                sizes[0].append(len(raw))
                for s, size in zip(sizes[1:], sizers, strict=True):
                    s.append(size(raw))
            n, a, b = (np.array(s, np.int64) for s in sizes)
            with np.errstate(invalid="ignore"):
                value = np.where(a + b > 0, (b - a) / np.maximum(a + b, 1), 0.0)
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(a), pa.array(b), pa.array(value)], names=["doc_id", "n_bytes", "domain_bytes", "general_bytes", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        common.frugal(run), "doc_id long, n_bytes long, domain_bytes long, general_bytes long, score double"
    )


def lm_scores(docs: DataFrame, labels: DataFrame, size: int | None = None, level: int = LEVEL) -> DataFrame:
    """Build both dictionaries from ``docs`` and ``labels`` (doc_id, quality) and score every document."""
    domain, general = dictionaries(docs, labels, size)
    return score(docs, domain, general, level)

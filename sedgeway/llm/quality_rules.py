"""Quality rules: base counts, and n-gram perplexity with language-specific bands.

The language model is an interpolated modified Kneser-Ney model (Chen & Goodman 1999) of order 4
over characters, one per value of ``lang``, counted by Spark over all documents of the language.
Characters are mapped to 64 classes - in each language its commonest letters, of whatever script,
have classes of their own, and each of
the others counts by its probability within the class that it shares - so an n-gram is a number below 2**24 and a language's tables
have a proven bound.  They are kept as arrays sorted by a bijective hash of the n-gram and searched
by bisection; where all languages' tables are too many to travel at once, so many travel as may.  A document's deviation is its log-perplexity less the median of its language, over
``1 / sqrt(n) + FLOOR`` for n characters, as the mean over few of them scatters more.  It must lie
between the bands of its language: the quantiles beyond which a share ``RATE`` of the documents
labelled good lies on either side or, where too few are labelled, the quartiles of all deviations
widened by multiples of the interquartile range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.llm import common
from sedgeway.llm.textops import WHITE, Words, mix, steps

ORDER = 4
BITS = 6
#: Characters of a text that are scored at a time.
LONG = 1 << 18
#: Letters of a language that have a class of their own.
ALPHABET = 46
#: Languages that have a model of their own; there are some 7,000 living ones.
MAX_LANGS = 8_192
#: N-grams whose models travel to the tasks at a time, some 100 MB.
TRAVEL = 8_000_000
#: Share of the documents labelled good that each band of a language may reject.
RATE = 0.01
#: A language with fewer documents labelled good has bands from its quartiles.
MIN_GOOD = 100
#: Those bands: below q25 - LOW * iqr or above q75 + HIGH * iqr of all its deviations.  The multiples are
#: the largest that RATE took in any of the four languages of sf0.1 (1.31 in en; 4.27 in fr).
LOW, HIGH = 1.35, 4.3
#: The interquartile range of deviations counts as this much at least.
MIN_SPREAD = 0.2
#: A document of n characters may scatter by 1 / sqrt(n) + FLOOR nats.
FLOOR = 0.01
#: Log perplexities are counted in steps of this many nats, deviations in steps of STEP.
GRAIN, STEP = 0.001, 0.01
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_classes: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Lower-case code point of each letter below 2**16, 0 for everything else."""
    if "letters" not in _classes:
        t = np.zeros(1 << 16, np.uint16)
        for k in range(1 << 16):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                t[k] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else k
        _classes["letters"] = t
    return _classes["letters"]


def _class_table(alphabet: tuple[int, ...]) -> np.ndarray:
    """Class of each code point below 2**16: 1-11 marks, 12 other ASCII, 13 digit, 14 white, 15-17 other characters by hash, 18-63 the alphabet."""
    t = ((np.arange(1 << 16, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(3) + np.uint32(15)).astype(np.uint8)
    t[:128] = 12
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 14
    t[48:58] = 13
    for k, marks in enumerate((".", ",", ";:", "!", "?", "'\"", "()[]{}", "-_", "#*", "$%&", "|<>")):
        t[[ord(c) for c in marks]] = 1 + k
    own = np.zeros(1 << 16, np.uint8)
    own[list(alphabet)] = np.arange(64 - len(alphabet), 64)
    own = own[_letters()]
    return np.where(own > 0, own, t)


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each language has each letter, over the whole task."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for a, b in steps(batch.column(1)):
            strings = batch.column(1).slice(a, b - a).to_pylist()
            for lang in set(langs[a:b]):
                joined = "".join(s for s, x in zip(strings, langs[a:b], strict=True) if x == lang and s)
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                found = np.bincount(_letters()[points[points < 1 << 16]], minlength=1 << 16)
                held[lang] = held[lang] + found if lang in held else found
    for lang, counts in held.items():
        at = np.flatnonzero(counts[1:]) + 1
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "letter", "n"])


def _grams(strings: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed classes of the ORDER characters that end at each character, and its row.

    Before a text's first character stand ORDER - 1 boundaries of class 0; one ends it as well.
    """
    joined = ("\x00" * (ORDER - 1)).join(["", *strings, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = table[np.minimum(points, 0xFFFF)].astype(np.uint32)
    gap = ORDER - 1
    ends = np.cumsum([len(s) + gap for s in strings], dtype=np.int64)
    for k in range(gap):  # by position, as a text may hold the separator itself
        c[k] = 0
        c[ends + k] = 0
    packed = c[: -gap or None].copy()
    for k in range(1, ORDER):
        packed = (packed << np.uint32(BITS)) | c[k : len(c) - gap + k]
    row = np.repeat(np.arange(len(strings)), [len(s) + gap for s in strings])
    at = np.arange(len(row)) - np.repeat(ends - [len(s) + gap for s in strings], [len(s) + gap for s in strings])
    keep = at <= np.repeat([len(s) for s in strings], [len(s) + gap for s in strings])  # to the first boundary after the text
    return packed[: len(row)][keep], row[keep]


def _gram_parts(strings: list[str], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`_grams` of all strings, those of a string beyond LONG characters a part at a time."""
    short = [k for k, s in enumerate(strings) if len(s) <= LONG]
    if short:
        packed, row = _grams([strings[k] for k in short], table)
        yield packed, np.array(short)[row]
    for k in set(range(len(strings))) - set(short):
        s = strings[k]
        for at in range(0, len(s), LONG):
            part = s[at : at + LONG]
            before = s[max(0, at - ORDER + 1) : at]
            points = np.frombuffer((before + part).encode("utf-32-le", "surrogatepass"), np.uint32)
            edge = np.zeros(ORDER - 1 - len(before), np.uint32)
            c = np.concatenate([edge, table[np.minimum(points, 0xFFFF)].astype(np.uint32), np.zeros(int(at + LONG >= len(s)), np.uint32)])
            packed = c[: len(c) - ORDER + 1].copy()
            for j in range(1, ORDER):
                packed = (packed << np.uint32(BITS)) | c[j : len(c) - ORDER + 1 + j]
            yield packed, np.full(len(packed), k)


def _counter(alphabets: dict[str, tuple[int, ...]]) -> Callable:
    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([n for _, n in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of full n-grams per language, over the whole task."""
        held: dict[str, list] = {}
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            text = batch.column(1)
            for a, b in steps(text):
                strings = text.slice(a, b - a).to_pylist()
                for lang in set(langs[a:b]):
                    mine = [s for s, x in zip(strings, langs[a:b], strict=True) if x == lang and s]
                    if mine:
                        if lang not in tables:
                            tables[lang] = _class_table(alphabets.get(lang, ()))
                        for keys, _ in _gram_parts(mine, tables[lang]):
                            keys.sort()
                            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                            held.setdefault(lang, []).append((keys[first], np.diff(np.concatenate([first, [len(keys)]]))))
                            if len(held[lang]) >= 32:
                                held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    return run


def _hash(gram: np.ndarray) -> np.ndarray:
    """A bijection of 24-bit numbers, the order of the arrays."""
    x = gram.astype(np.uint32)
    for k in (0x9E3779, 0x85EBCB):
        x = (x * np.uint32(k)) & np.uint32(0xFFFFFF)
        x ^= x >> np.uint32(11)
    return x


def _rest_table(rest: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By code point, the log probability of a letter beyond the alphabet given its class; 0 for all others."""
    own = np.zeros(1 << 16, np.float32)
    own[rest[0]] = rest[1]
    return own[_letters()]


def _rest_log(strings: list[str], own: np.ndarray) -> np.ndarray:
    """The sum of ``own`` over each string's characters, of a long string a part at a time."""
    out = np.zeros(len(strings))
    short = [k for k, s in enumerate(strings) if len(s) <= LONG]
    parts = [(short, [strings[k] for k in short])] if short else []
    for k in set(range(len(strings))) - set(short):
        parts += [([k], [strings[k][at : at + LONG]]) for at in range(0, len(strings[k]), LONG)]
    for rows, some in parts:
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        run = np.concatenate([[0.0], np.cumsum(np.where(points < 1 << 16, own[np.minimum(points, 0xFFFF)], 0), dtype=np.float64)])
        ends = np.cumsum([len(s) for s in some])
        out[rows] += run[ends] - run[ends - [len(s) for s in some]]
    return out


class NgramModel:
    """A language's log probabilities: full n-grams in sorted hash arrays, backoff below them.

    A letter beyond the alphabet shares its class; ``rest`` has each such letter and its log probability
    given its class, from its own count over all documents.

    Tables for each order n: hashes of seen n-grams (of ``n`` classes), their log probability, and
    for contexts the log of what they leave to the next lower order.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: tuple[int, ...] = (), rest: list[tuple[int, int]] | None = None) -> None:
        self.alphabet = alphabet
        letters, many = np.array(rest or [], np.int64).reshape(-1, 2).T
        classes = _class_table(alphabet)[letters]
        self.rest = letters, np.log(many / np.maximum(np.bincount(classes, many, 64), 1)[classes]).astype(np.float32)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # per order 1..ORDER: hash, log p
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []  # per context length 0..ORDER-1: hash, log weight
        below_keys, below_p = None, None
        levels = [(grams.astype(np.uint32), counts.astype(np.int64))]
        for n in range(ORDER - 1, 0, -1):
            # the continuation count of an n-gram: the different classes before it
            keys = levels[0][0] & np.uint32((1 << BITS * n) - 1)
            uniq, cont = np.unique(keys, return_counts=True)
            levels.insert(0, (uniq, cont.astype(np.int64)))
        for n, (keys, c) in enumerate(levels, 1):
            ones, twos, threes, fours = (int((c == k).sum()) for k in (1, 2, 3, 4))
            y = ones / (ones + 2 * twos) if ones and twos else 0.5
            d = [
                min(max(1 - 2 * y * twos / ones, 0.1), 1.0) if ones else 0.5,
                min(max(2 - 3 * y * threes / twos, 0.1), 2.0) if twos else 1.0,
                min(max(3 - 4 * y * fours / threes, 0.1), 3.0) if threes else 1.5,
            ]
            cut = np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))
            context = keys >> np.uint32(BITS)
            ctx, back = np.unique(context, return_inverse=True)
            total = np.bincount(back, c)
            left = np.bincount(back, cut) / total
            if n == 1:
                lower = np.full(len(keys), 1.0 / (1 << BITS))
            else:
                tail = keys & np.uint32((1 << BITS * (n - 1)) - 1)
                lower = below_p[np.searchsorted(below_keys, tail)]
            p = (c - cut) / total[back] + left[back] * lower
            below_keys, below_p = keys, p
            h = _hash(keys)
            order = np.argsort(h)
            self.tables.append((h[order], np.log(p[order]).astype(np.float32)))
            h = _hash(ctx)
            order = np.argsort(h)
            self.backoff.append((h[order], np.log(left[order]).astype(np.float32)))

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last class given the ones before, with backoff for unseen n-grams."""
        out = np.zeros(len(grams), np.float64)
        todo = np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            keys = grams[todo] & np.uint32((1 << BITS * n) - 1)
            hashes, values = self.tables[n - 1]
            h = _hash(keys)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            out[todo[hit]] += values[at[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return out
            hashes, values = self.backoff[n - 1]
            h = _hash(keys >> np.uint32(BITS))
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            out[todo[hit]] += values[at[hit]]
        out[todo] += -np.log(1 << BITS)
        return out


def _base(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    words = Words(texts)
    raw, offsets, n = words.raw, words.offsets, len(words.counts)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    white = np.concatenate([[0], np.cumsum(WHITE[raw])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[raw])])
    per = lambda run: run[offsets[1:]] - run[offsets[:-1]]
    # words in 5-word windows that the text has twice
    repeated = np.zeros(n, np.int64)
    start, value = words.windows(5)
    if len(start):
        row = words.row[start]
        order = np.lexsort((value, row))
        r, v = row[order], value[order]
        same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = start[order[twice]]
        cover = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 5, -1)
        np.add.at(repeated, words.row, (np.cumsum(cover[:-1]) > 0).astype(np.int64))
    dup = np.zeros(n, np.int64)
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    for k in np.flatnonzero(per(newline)):
        seen = set()
        for line in raw[offsets[k] : offsets[k + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\r\x0b\x0c"):
                dup[k] += line in seen
                seen.add(line)
    return {"n_words": words.counts.astype(np.int64), "word_chars": per(lead) - per(white), "n_symbols": per(symbols), "n_dup_lines": dup, "n_repeat_words": repeated}


def _scorer(models: dict[str, NgramModel]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        rests: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, text = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2)
            base: list[dict] = []
            value, length = np.full(len(text), np.nan), np.zeros(len(text), np.int64)
            for a, b in steps(text):
                piece = text.slice(a, b - a)
                base.append(_base(piece))
                strings = piece.to_pylist()
                for lang in set(langs[a:b]):
                    mine = [k for k in range(b - a) if langs[a + k] == lang and strings[k]]
                    if not mine or lang not in models:
                        continue
                    if lang not in tables:
                        tables[lang] = _class_table(models[lang].alphabet)
                        if len(models[lang].rest[0]):
                            rests[lang] = _rest_table(models[lang].rest)
                    total, many = np.zeros(len(mine)), np.zeros(len(mine), np.int64)
                    for grams, row in _gram_parts([strings[k] for k in mine], tables[lang]):
                        total += np.bincount(row, models[lang].log_probability(grams), len(mine))
                        many += np.bincount(row, minlength=len(mine))
                    if lang in rests:
                        total += _rest_log([strings[k] for k in mine], rests[lang])
                    length[a + np.array(mine)] = many
                    value[a + np.array(mine)] = -total / many
            if base:
                columns = {k: pa.array(np.concatenate([x[k] for x in base])) for k in base[0]}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *columns.values(), pa.array(value, mask=np.isnan(value)), pa.array(length), batch.column(3)],
                    names=["doc_id", "lang", *columns, "log_perplexity", "n_scored", "mark"],
                )

    return run


_SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, n_scored long, mark long"


def _counted(docs: DataFrame) -> tuple[DataFrame, dict[str, tuple[int, ...]], dict[str, list[tuple[int, int]]], dict[str, int]]:
    """``lang, gram, n`` of all documents; each language's alphabet, its other letters with their counts, and its number of n-grams."""
    rows = docs.select("lang", "text").where("text <> ''")
    letters = rows.mapInArrow(common.frugal(_count_letters), "lang string, letter int, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "letter")
    alphabets: dict[str, list[int]] = {}
    rest: dict[str, list[tuple[int, int]]] = {}
    for r in letters.withColumn("r", F.row_number().over(order)).orderBy("lang", "r").toLocalIterator():  # the letters that a language has
        if r["r"] <= ALPHABET:
            alphabets.setdefault(r["lang"], []).append(r["letter"])
        else:
            rest.setdefault(r["lang"], []).append((r["letter"], r["n"]))
    known = {k: tuple(v) for k, v in alphabets.items()}
    counted = rows.mapInArrow(common.frugal(_counter(known)), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = common.written(counted, "quality-grams")
    return counted, known, rest, {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language


def _built(counted: DataFrame, alphabets: dict[str, tuple[int, ...]], rest: dict[str, list[tuple[int, int]]], langs: list[str]) -> dict[str, NgramModel]:
    """Models of these languages, which ``counted`` has."""
    table = counted.toArrow()
    names = table["lang"].to_numpy(zero_copy_only=False)
    out = {}
    for lang in langs:
        mine = table.filter(pa.array(names == lang)).sort_by("gram")
        out[lang] = NgramModel(mine["gram"].to_numpy(), mine["n"].to_numpy(), alphabets.get(lang, ()), rest.get(lang))
    return out


def models(docs: DataFrame) -> dict[str, NgramModel]:
    """One model per language from the counts over all its documents; at most 2**24 n-grams each."""
    counted, alphabets, rest, sizes = _counted(docs)
    out = _built(counted, alphabets, rest, sorted(sizes))
    common.discard(counted)
    return out


def _batches(sizes: dict[str, int]) -> list[list[str]]:
    """Languages in groups of at most TRAVEL n-grams (one language at least)."""
    out: list[list[str]] = [[]]
    room = TRAVEL
    for lang in sorted(sizes):
        if out[-1] and sizes[lang] > room:
            out.append([])
            room = TRAVEL
        out[-1].append(lang)
        room -= sizes[lang]
    return out


def _scored(rows: DataFrame) -> DataFrame:
    """All rows with their base counts and the log perplexity under their language's model, as tables."""
    counted, alphabets, rest, sizes = _counted(rows)
    groups = _batches(sizes)
    of = rows.sparkSession.createDataFrame([(lang, n) for n, langs in enumerate(groups) for lang in langs], "lang string, part int")
    only = lambda df, n: df if len(groups) == 1 else df.join(common.small(of, len(sizes)), "lang", "left").where(F.coalesce("part", F.lit(0)) == n).select(*df.columns)
    parts = []
    for n, langs in enumerate(groups):
        scored = only(rows, n).mapInArrow(common.frugal(_scorer(_built(only(counted, n), alphabets, rest, langs))), _SCORED)
        failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        parts.append(common.written(scored.withColumn("base_failed", failed), "quality-scored"))
    common.discard(counted)
    return reduce(DataFrame.unionByName, parts)


def _scale() -> Column:
    """The scatter that a document's length allows; deviations are measured in it."""
    return F.lit(1.0) / F.sqrt(F.greatest("n_scored", F.lit(1))) + FLOOR


def _marks(bins: DataFrame, key: str, **at: tuple[str, float]) -> DataFrame:
    """Per key of ``key, bin, n``: its rows, and bins by name: the least with a share ``q`` of the rows at or
    below it (``("below", q)``), or the greatest with that share at or above it (``("above", q)``)."""
    w = Window.partitionBy(key)
    run = bins.withColumn("run", F.sum("n").over(w.orderBy("bin"))).withColumn("every", F.sum("n").over(w))
    below = lambda q: F.min(F.when(F.col("run") >= q * F.col("every"), F.col("bin")))
    above = lambda q: F.max(F.when(F.col("every") - F.col("run") + F.col("n") >= q * F.col("every"), F.col("bin")))
    return run.groupBy(key).agg(F.first("every").alias("every"), *[{"below": below, "above": above}[side](q).alias(name) for name, (side, q) in at.items()])


def bands(scored: DataFrame, low: float = LOW, high: float = HIGH, good: DataFrame | None = None, rate: float = RATE) -> DataFrame:
    """``lang, centre, least, most``: the median log perplexity, and the bounds of deviations from it.

    ``good`` has the ids of documents labelled good.  All counts are exact on a grid.
    """
    passed = scored.where("log_perplexity is not null and not base_failed")
    bins = passed.groupBy("lang", F.floor(F.col("log_perplexity") / GRAIN).alias("bin")).agg(F.count("*").alias("n"))
    centres = _marks(bins, "lang", half=("below", 0.5)).select("lang", ((F.col("half") + 0.5) * GRAIN).alias("centre"))
    deviations = passed.join(F.broadcast(centres), "lang").select(  # one row a language
        "doc_id", "lang", F.floor((F.col("log_perplexity") - F.col("centre")) / _scale() / STEP).alias("bin")
    )
    counted = lambda rows: rows.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    edges = _marks(counted(deviations), "lang", q1=("below", 0.25), q3=("below", 0.75)).drop("every")
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_SPREAD / STEP))
    least, most = F.col("q1") - low * spread, F.col("q3") + high * spread
    if good is not None:
        mine = counted(deviations.join(common.small(good, good.count()), F.col("doc_id") == F.col("id"), "left_semi"))
        own = _marks(mine, "lang", lo=("above", 1 - rate), hi=("below", 1 - rate)).where(F.col("every") >= MIN_GOOD).drop("every")
        edges = edges.join(F.broadcast(own), "lang", "left")
        least, most = F.coalesce("lo", least), F.coalesce("hi", most)
    return edges.select("lang", (least * STEP).alias("least"), ((most + 1) * STEP).alias("most")).join(F.broadcast(centres), "lang")


def good_ids(labels: DataFrame) -> DataFrame:
    """``id`` of the documents labelled good."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()


def _mark(docs: DataFrame) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(docs["text"].cast("string"), docs["lang"].cast("string"))


def _pooled(rows: DataFrame) -> DataFrame:
    """Languages beyond the MAX_LANGS commonest as one, ``und``."""
    langs = common.written(rows.groupBy("lang").agg(F.count("*").alias("n")), "quality-langs")
    if langs.count() <= MAX_LANGS:
        common.discard(langs)
    else:
        most = langs.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select(F.col("lang").alias("own"))
        columns = [F.coalesce("own", F.lit("und")).alias(c) if c == "lang" else F.col(c) for c in rows.columns]
        rows = rows.join(F.broadcast(most), F.col("lang") == F.col("own"), "left").select(*columns)
    return rows


def _judged(docs: DataFrame, low: float, high: float, labels: DataFrame | None) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), _mark(docs).alias("mark")
    )
    rows = _pooled(rows)
    scored = _scored(rows)
    limits = bands(scored, low, high, None if labels is None else good_ids(labels))
    inside = ((F.col("log_perplexity") - F.col("centre")) / _scale()).between(F.col("least"), F.col("most"))
    return scored.join(F.broadcast(limits), "lang", "left").withColumn(  # one row a language
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    )


def quality(docs: DataFrame, low: float = LOW, high: float = HIGH, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity``.

    A null or empty text has no words, fails the base rules and is not kept; a null lang is the
    language ``und``, as are all languages but the MAX_LANGS commonest; null ids are kept; repeated rows are judged alike; an empty table gives no rows.
    ``labels`` (doc_id, quality) calibrates the bands; a null id there is no label.
    """
    return _judged(docs, low, high, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"
    )


def keep_quality(docs: DataFrame, low: float = LOW, high: float = HIGH, labels: DataFrame | None = None) -> DataFrame:
    """The documents (all their columns) that the rules keep."""
    out = common.written(_judged(docs, low, high, labels).where("not kept").select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).distinct(), "quality-out")
    out = common.small(out, out.count())
    return docs.join(out, docs["doc_id"].cast("long").eqNullSafe(out["_d"]) & (_mark(docs) == out["_m"]), "left_anti")

"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and renormalised.  The exponent is found
by bisection: the smallest that keeps the repetition of every source within a limit, or the one
whose weights have a target entropy.  The mix is as large as it must be for the source of least
repetition to be seen whole once, so no document is lost.  A source's budget is spent in passes
over blocks of its documents, each pass in its own keyed permutation of the blocks; the last,
partial pass takes whole blocks and cuts the one that crosses the budget at a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.llm import common

MAX_REPEAT = 2.0
SEED = 17
#: Documents of a block, about, and blocks there are at most, besides one a source; a block's ids are ordered in one task.
BLOCK_ROWS = 20_000
BLOCKS = 50_000


def weights(tokens: dict, exponent: float, times: dict | None = None) -> dict:
    """Normalised powers of the token shares; a source without tokens has weight 0.

    With ``times`` a key stands for so many sources of equal tokens, and the weight is that of each.
    """
    times = times or dict.fromkeys(tokens, 1)
    total = sum(n * times[s] for s, n in tokens.items())
    powers = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = math.fsum(p * times[s] for s, p in powers.items())
    return {s: p / norm if norm else 0.0 for s, p in powers.items()}


def entropy(w: dict, times: dict | None = None) -> float:
    return -math.fsum((times[s] if times else 1) * p * math.log(p) for s, p in w.items() if p > 0)


def repeats(tokens: dict, w: dict) -> dict:
    """Passes over each source in the smallest mix of these weights that holds every document."""
    per = {s: w[s] / n for s, n in tokens.items() if n and w[s] > 0}
    least = min(per.values(), default=1.0)
    return {s: per[s] / least if s in per else 1.0 for s in tokens}


def find_exponent(tokens: dict, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, rounds: int = 60, times: dict | None = None) -> float:
    """Bisect the exponent in [0, 1]: entropy falls and repetition falls as it grows.

    With ``target_entropy`` the largest exponent that reaches it (0 if none does); otherwise the
    smallest one whose largest repetition is within ``max_repeat``.
    """
    if target_entropy is not None:
        good = lambda a: entropy(weights(tokens, a, times), times) >= target_entropy
        if good(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo
    ends = {n: n for n in (min(tokens.values(), default=0), max(tokens.values(), default=0))}  # no other source repeats more or less
    good = lambda a: max(repeats(ends, weights(ends, a)).values(), default=1.0) <= max_repeat
    if good(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def _sources(slim: DataFrame, max_repeat: float | None, target_entropy: float | None, block_rows: int) -> DataFrame:
    """One row a source: its weight, full passes, the budget of the partial one, number of blocks, and rows.

    The driver sees one row for each *size* that sources have; of these there are fewer than the root of twice the tokens.
    """
    sums = common.written(slim.groupBy("source").agg(F.sum("tokens").alias("size"), F.sum("rows").alias("in_source")), "mix-sources")
    times = {r["size"]: r["n"] for r in sums.groupBy("size").agg(F.count("*").alias("n")).collect()}
    sizes = {n: n for n in times}
    exponent = find_exponent(sizes, max_repeat, target_entropy, times=times)
    w = weights(sizes, exponent, times)
    rep = repeats(sizes, w)
    whole = {n: int(r + 1e-9) for n, r in rep.items()}
    table = [(n, w[n], whole[n], round(max(0.0, rep[n] - whole[n]) * n), exponent) for n in sorted(sizes)]
    planned = slim.sparkSession.createDataFrame(table, "size long, weight double, passes int, rest long, exponent double")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("in_source") / block_rows)).cast("long")
    return common.written(sums.join(common.small(planned, len(table)), "size").drop("size").withColumn("blocks", blocks), "mix-planned")


def _planned(docs: DataFrame, carried: Column, max_repeat: float | None, target_entropy: float | None, seed: int, block_rows: int) -> DataFrame:
    """Each row's ``carried`` with ``id, source, tokens, passes, block, weight, exponent`` and ``copies``.

    A row's block and its place in it follow from its id and text, so what is joined is one row a
    source and one a block; where these were counted to be few they are broadcast, and no document
    is shuffled, else only rows of large sources and blocks stay where they are.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    # tokens are estimated at four characters each, one at least, so that every document has weight
    rows = docs.select(
        carried.alias("carried"), F.greatest(F.lit(1), F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("long").alias("tokens"), source.alias("source"),
        F.xxhash64(F.lit(seed), text, F.col("doc_id").cast("long")).alias("mark"), F.col("doc_id").cast("long").alias("id"),
    )
    # equal rows are one, with all their tokens
    slim = common.written(rows.groupBy("source", "mark", "id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "mix-rows")
    total = slim.agg(F.sum("rows").alias("n")).first()["n"] or 0
    sources = _sources(slim, max_repeat, target_entropy, max(block_rows, total // BLOCKS))
    n_sources = sources.count()
    with_source = lambda df: common.join_groups(df, sources, ["source"], "in_source", n_sources, total).withColumn("block", F.pmod("mark", "blocks").cast("int"))
    # the partial pass: blocks in their permuted order up to the budget
    keyed = with_source(slim)
    turn = F.xxhash64(F.lit(seed), F.col("passes"), F.coalesce("source", F.lit("")), "block")
    blocks = keyed.groupBy("source", "block", "rest", "passes").agg(F.sum("tokens").alias("size"), F.sum("rows").alias("in_block")).withColumn("turn", turn)
    order = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).select("source", "block", "before", "size", "rest", "in_block")
    blocks = common.written(blocks, "mix-blocks")  # BLOCKS of them at most, and one a source
    n_blocks = blocks.count()
    # in the block that crosses the budget, the last row that fits
    crossed = blocks.where("before < rest and before + size > rest").select("source", "block", F.col("before").alias("until"), F.col("in_block"))  # one block a source
    at = common.join_groups(keyed.select("source", "block", "mark", "id", "tokens", "rest"), crossed, ["source", "block"], "in_block", n_sources, total).where("until is not null")
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("mark", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = at.withColumn("upto", upto).where("until + upto <= rest")
    cuts = fits.groupBy("source").agg(F.max(F.struct("mark", "id")).alias("cut"))
    places = common.written(blocks.drop("rest").join(cuts, blocks["source"].eqNullSafe(cuts["source"]), "left").select(blocks["source"], "block", "before", "size", "in_block", "cut"), "mix-places")
    extra = (
        F.when(F.col("before") + F.col("size") <= F.col("rest"), 1)
        .when(F.col("before") >= F.col("rest"), 0)
        .otherwise(F.coalesce((F.struct("mark", "id") <= F.col("cut")).cast("int"), F.lit(0)))
    )
    out = common.join_groups(with_source(rows), places, ["source", "block"], "in_block", n_blocks, total)
    common.discard(slim)
    return out.withColumn("copies", F.greatest(F.lit(1), F.col("passes") + extra))


def mixture(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mix, one row per copy of a document: ``doc_id, source, tokens, pass, block, turn, weight, exponent``.

    ``turn`` orders the mix: passes one after the other, each with its own permutation of a
    source's blocks.  Every document is in every full pass of its source.  Nulls: rows with a null
    source are a source of their own, null and empty texts count as one token, null ids are kept.
    Repeated rows are documents of their own.  An empty table gives no rows.
    """
    plan = _planned(docs, F.lit(None), max_repeat, target_entropy, seed, block_rows)
    copies = plan.withColumn("pass", F.explode(F.expr("sequence(0, copies - 1)")))
    turn = F.xxhash64(F.lit(seed), F.col("pass"), F.coalesce("source", F.lit("")), "block")
    return copies.select(F.col("id").alias("doc_id"), "source", "tokens", "pass", "block", turn.alias("turn"), "weight", "exponent")


def mixed(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents with all their columns, whatever their names, each as often as the mix has it."""
    plan = _planned(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), max_repeat, target_entropy, seed, block_rows)
    plan = plan.withColumn("pass", F.explode(F.expr("sequence(1, copies)")))
    return plan.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])

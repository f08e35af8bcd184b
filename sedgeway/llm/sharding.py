"""K-d tree sharding by distributed weighted medians.

Equal texts are one point whose weight is the bytes of all copies.  A node is split along its
widest metadata dimension (extent against the whole corpus' extent) at the weighted median, found
by narrowing a histogram: each round aggregates the node's bytes over ``BUCKETS`` ranges of the
key and keeps the range that holds the median.  The key is the value of the dimension followed by
bits of the text's hash, so a value that holds a third of all bytes - one source, one language -
is cut like any other.  Splitting ends when the leaves have reached the target bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.llm import common

#: Buckets of a node's histogram, and of all nodes' histograms together, in one round.
BUCKETS, HISTOGRAM = 1 << 14, 1 << 22
#: Rows that get their slot numbers in one task.
SLOT_ROWS = 100_000


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _ranks(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``value, many, rank`` of a dimension's values in their order, null first, and how many there are."""
    column = F.col(f"`{name}`")
    kind = dict(docs.dtypes)[name]
    ordered = column if kind in ("string", "float", "double", "boolean", "date", "timestamp") or kind.startswith("decimal") else column.cast("string")
    values = common.written(docs.groupBy(ordered.alias("value")).agg(F.count("*").alias("many")), "kd-values")
    n = values.count()
    if n <= common.BROADCAST_ROWS:
        ranked = values.withColumn("rank", (F.row_number().over(Window.orderBy("value")) - 1).cast("long"))
    else:  # sorted by all tasks, each value numbered within its partition, and the partitions' sizes added up
        placed = common.written(values.orderBy("value").withColumn("at", F.monotonically_increasing_id()), "kd-sorted").withColumn("p", F.shiftright("at", 33))
        sizes = placed.groupBy("p").agg(F.count("*").alias("c"))  # a row a partition
        before = sizes.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        ranked = placed.join(F.broadcast(before), "p").select("value", "many", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))
    return common.written(ranked, "kd-ranks"), n


def _split_level(points: DataFrame, nodes: dict[int, tuple[int, int]], dims: list[str], root: dict[str, int], tolerance: float, shard_bytes: float):
    """One level of the tree: for each node of several leaves the dimension, its range and the split key."""
    spark = points.sparkSession
    live = {n: k for n, (_, k) in nodes.items() if k > 1}
    stats = points.groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(f"{name}_{d}") for d in dims for f, name in ((F.min, "lo"), (F.max, "hi"))]).collect()  # one row a node
    splits = {}
    for r in stats:
        if r["node"] not in live:
            continue
        dim = max(dims, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, root[d]), -dims.index(d)))
        lo, span = r[f"lo_{dim}"], r[f"hi_{dim}"] - r[f"lo_{dim}"] + 1
        splits[r["node"]] = {"dim": dims.index(dim), "lo": lo, "span": float(span), "goal": r["w"] * (live[r["node"]] // 2) / live[r["node"]]}
    if not splits:
        return None
    buckets = min(BUCKETS, max(64, HISTOGRAM // len(splits)))
    plan = spark.createDataFrame([(n, s["dim"], s["lo"], s["span"]) for n, s in splits.items()], "node int, dim int, lo long, span double")
    value = F.element_at(F.array(*dims), F.col("dim") + 1)
    scaled = F.least(F.floor((value - F.col("lo")).cast("double") / F.col("span") * (1 << 30)), F.lit((1 << 30) - 1))
    key = F.shiftleft(scaled.cast("long"), 33).bitwiseOR(F.shiftrightunsigned(F.col("gh"), 31))
    keyed = common.written(
        points.join(common.small(plan, len(splits)), "node", "left").withColumn("key", F.when(F.col("dim").isNotNull(), key)).drop("dim", "lo", "span"),
        "kd-level",
    )
    search = {n: (0, (1 << 63) - 1, 0.0) for n in splits}  # range of keys, weight below it
    cuts: dict[int, int] = {}
    while search:
        ranges = spark.createDataFrame(
            [(n, lo, max(1, -(-(hi - lo + 1) // buckets)), hi, below, float(splits[n]["goal"])) for n, (lo, hi, below) in search.items()],
            "node int, lo long, width long, hi long, below double, goal double",
        )
        hist = (
            keyed.where("key is not null").join(common.small(ranges, len(search)), "node").where("key between lo and hi")
            .groupBy("node", F.expr("(key - lo) div width").alias("bucket"))
            .agg(F.sum("w").alias("w"), F.min("key").alias("first"), F.max("key").alias("last"), F.first("below").alias("below"), F.first("goal").alias("goal"))
        )
        run = F.sum("w").over(Window.partitionBy("node").orderBy("bucket"))  # at most ``buckets`` rows a node
        rank = F.row_number().over(Window.partitionBy("node").orderBy("bucket"))
        found = (
            hist.withColumn("upto", F.col("below") + run).where("upto >= goal").withColumn("r", rank).where("r = 1").collect()  # one row a node
        )
        search = {}
        for r in found:
            before = r["upto"] - r["w"]
            if r["first"] == r["last"] or r["w"] <= tolerance * shard_bytes:
                near_left = r["goal"] - before < r["upto"] - r["goal"]  # keep the nearer side of the bucket
                cuts[r["node"]] = r["first"] - 1 if near_left else r["last"]
            else:
                search[r["node"]] = (r["first"], r["last"], float(before))
    return keyed, cuts


def kd_shards(docs: DataFrame, dims: list[str] | None = None, shards: int | None = None, target_bytes: int = 256 << 20, tolerance: float = 0.001) -> DataFrame:
    """Shards of near-equal bytes (law ``bytes``), copies of a text always together.

    shards: number of leaves; by default as many as leave ``target_bytes`` to each.  dims: metadata
    columns (default: those of lang, source that exist, and the size).  Returns ``doc_id, size,
    text_crc32, law, shard, slot, grown_shard``.

    Nulls: a null text has size 1 and is one group with the checksum of no bytes, apart from the
    empty text only in name (both weigh 1 a row); a null dimension sorts first.  Repeated rows stay
    rows of their own.  An empty table gives no rows.  A group of copies above a shard's share
    can't be cut; its shard is as large as it.
    """
    dims = [d for d in ("lang", "source") if d in docs.columns] if dims is None else dims
    names = [f"d{i}" for i in range(len(dims) + 1)]
    kinds = dict(docs.dtypes)
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("gh"),
        *[(F.coalesce(F.col(f"`{d}`").cast("long"), F.lit(-1)) if kinds[d] in _WHOLE else F.col(f"`{d}`").cast(kinds[d] if kinds[d] != "binary" else "string")).alias(n) for d, n in zip(dims, names, strict=False)],
    ).withColumn(names[-1], F.col("size")).withColumn("rid", F.monotonically_increasing_id())
    base = read = common.written(given, "kd-rows")
    n_rows = base.count()
    for d, n in zip(dims, names, strict=False):
        if kinds[d] not in _WHOLE:  # a value counts by its rank among the values
            ranked, many = _ranks(base, n)
            base = common.join_groups(base, ranked.withColumnRenamed("value", n), [n], "many", many, n_rows).drop(n).withColumnRenamed("rank", n)
    if base is not read:
        base = common.written(base, "kd-rows")
        common.discard(read)
    total = base.agg(F.count("*").alias("n"), F.sum("size").alias("w")).first()
    if not shards:
        shards = max(1, -(-(total["w"] or 0) // target_bytes))
    points = common.written(
        base.groupBy("gh", "size")
        .agg(F.sum("size").alias("w"), F.count("*").alias("rows"), *[F.min(n).alias(n) for n in names])
        .withColumn("node", F.lit(0)),
        "kd-points",
    )
    ends = points.agg(F.count("*").alias("n"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).first()
    root = {n: ends[n] or 0 for n in names}
    nodes = {0: (0, shards)}  # node: first shard, leaves
    fresh = 1
    while total["n"] and any(k > 1 for _, k in nodes.values()):
        got = _split_level(points, nodes, names, root, tolerance, total["w"] / shards)
        if got is None:  # every node that is left is empty
            break
        keyed, cuts = got
        rows, after = [], {}
        for n, (first, k) in nodes.items():
            if n in cuts:
                left, right = fresh, fresh + 1
                fresh += 2
                after[left], after[right] = (first, k // 2), (first + k // 2, k - k // 2)
                rows.append((n, cuts[n], left, right))
            else:
                after[n] = (first, 1)
        moves = docs.sparkSession.createDataFrame(rows, "node int, cut long, l int, r int")
        to = F.when(F.col("cut").isNull(), F.col("node")).when(F.col("key") <= F.col("cut"), F.col("l")).otherwise(F.col("r"))
        new = common.written(keyed.join(common.small(moves, len(rows)), "node", "left").withColumn("node", to).drop("key", "cut", "l", "r"), "kd-points")
        common.discard(points, keyed)
        points, nodes = new, after
    leaf = docs.sparkSession.createDataFrame([(n, first) for n, (first, _) in nodes.items()], "node int, shard int")
    placed = points.join(common.small(leaf, len(nodes)), "node").select("gh", "size", "rows", "shard")
    rows = common.join_groups(base.select("doc_id", "size", "text_crc32", "gh", "rid"), placed, ["gh", "size"], "rows", ends["n"], total["n"])
    buckets = max(1, total["n"] // (SLOT_ROWS * shards))  # of a shard's rows, for their slots
    rows = common.written(rows.withColumn("b", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int")).drop("gh"), "kd-placed")
    counts = rows.groupBy("shard", "b").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "b", before.alias("off"))  # rows / SLOT_ROWS of them
    rank = F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "rid"))
    common.discard(base, points)
    return (
        rows.withColumn("r", rank).join(common.small(offsets, buckets * shards), ["shard", "b"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("off") + F.col("r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )

"""What the operators of this subpackage share: the shared folder, written tables, skew."""

from __future__ import annotations

import ctypes
import gc
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeway.sources.shared import discard, owned, shared_dir, written  # noqa: F401

#: Rows up to which a side whose count was taken may be broadcast; rows here are
#: narrow (ids, hashes and counts), so this is some megabytes.
BROADCAST_ROWS = 100_000

#: ``[\x20\x09-\x0D]`` as the trim set of Spark SQL.
WHITE_CHARS = " \t\n\x0b\x0c\r"


def frugal(run: Callable) -> Callable:
    """An Arrow function (of batches, or of a group's table) that hands memory back before and after its task's work.

    Python workers are reused, and what the allocators keep would add up over stages.
    """

    def trim(collect: bool = True) -> None:
        if collect:
            gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    if inspect.isgeneratorfunction(run):

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trim()
            try:
                yield from run(source)
            finally:
                trim()

        return batches

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        trim(False)  # a task may have many groups
        return out

    return group


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows is not None and rows <= limit else df


def null_safe(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(right[k])
        cond = one if cond is None else cond & one
    return cond


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an edge table ``(u long, v long)`` as ``(node, root)``, root the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (SoCC 2014),
    each as one minimum per node and one join, until the edge set stands still.
    Every step is linear in the edges and no neighbour list is ever collected.
    """
    now = written(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        star = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        new = written(star.where("u <> v").distinct(), name)
        state = new.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        discard(now)
        now = new
        if before == state:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def join_groups(left: DataFrame, groups: DataFrame, keys: list[str], count: str, n_groups: int, total: int) -> DataFrame:
    """Left join rows to their groups although one group may hold a large part of all rows.

    ``groups`` has one row per key (null keys included) and each group's row count.  Few groups
    are broadcast whole.  Otherwise those with a thousandth of all rows or more - a thousand at
    most - are broadcast, and only rows of the others are shuffled.
    """
    values = [c for c in groups.columns if c not in keys and c != count]
    named = groups.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *values, F.col(count).alias("_count"))

    def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        return rows.join(side, cond, "left").drop(*[f"_key_{k}" for k in keys])

    if n_groups <= BROADCAST_ROWS:
        return joined(left, F.broadcast(named.drop("_count")))
    cut = max(1, total // 1000)
    heavy = named.where(F.col("_count") >= cut).drop("_count").withColumn("_heavy", F.lit(True))
    light = named.where(F.col("_count") < cut).drop("_count")
    marked = joined(left, F.broadcast(heavy))
    rest = joined(marked.where("_heavy is null").drop("_heavy", *values), light)
    return marked.where("_heavy").drop("_heavy").unionByName(rest)

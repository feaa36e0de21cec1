"""Ordered scans that survive a hot key.

A running window over one key runs in one task.  Here rows are cut into ranges of (key, position) of
about equal numbers of rows, whatever gaps the positions have: the window runs inside (key, range),
one summary row per key and range carries the state across, and the two are combined.  The ranges
come from Spark's sampled range partitioning and are checkpointed with their numbers, so a lost
executor cannot deal rows anew.  Several scans over one order share its ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

PART = "_part"


def range_parts(df: DataFrame, keys: Sequence[str], pos: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned by keys and position, with the number of each row's range as ``_part``."""
    order = [*keys, *([pos] if isinstance(pos, str) else pos)]
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settle(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))


def stitched(parts: DataFrame, keys: Sequence[str], pos: str | Sequence[str], inside: Column, of_part: Column,
             over_parts: Column, combine, out: str, falling: bool = False) -> DataFrame:
    """A two-level scan of :func:`range_parts` rows.

    inside: aggregate run over the rows of a range up to the current one; of_part: the same of a whole
    range; over_parts: aggregate of the earlier ranges' ``_whole``; combine(local, carried): the result.
    ``falling`` scans from the last row to the first.
    """
    keys = list(keys)
    order = [F.col(c).desc() if falling else F.col(c) for c in ([pos] if isinstance(pos, str) else pos)]
    rows = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(F.col(PART).desc() if falling else F.col(PART)).rowsBetween(
        Window.unboundedPreceding, -1)
    names = [f"_key{i}" for i in range(len(keys))]
    carried = parts.groupBy(PART, *keys).agg(of_part.alias("_whole"))
    carried = carried.withColumn("_carried", over_parts.over(earlier)).select(
        F.col(PART).alias("_of"), *[F.col(k).alias(n) for k, n in zip(keys, names)], "_carried")
    same = F.col(PART) == F.col("_of")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return parts.withColumn("_local", inside.over(rows)).join(carried, same).withColumn(
        out, combine(F.col("_local"), F.col("_carried"))).drop("_local", "_carried", "_of", *names)


def sum_over(parts: DataFrame, keys: Sequence[str], pos: str | Sequence[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` from the start of the key up to and including this row."""
    marked = parts.withColumn("_v", value)
    return stitched(marked, keys, pos, F.sum("_v"), F.sum("_v"), F.sum("_whole"),
                    lambda local, carried: local + F.coalesce(carried, F.lit(0)), out).drop("_v")


def latest_over(parts: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str) -> DataFrame:
    """Latest non-NULL ``value`` at or before this row."""
    marked = parts.withColumn("_v", value)
    at = F.when(F.col("_v").isNotNull(), F.col(pos))
    return stitched(marked, keys, pos, F.last("_v", ignorenulls=True), F.max_by("_v", at), F.last("_whole", ignorenulls=True),
                    lambda local, carried: F.coalesce(local, carried), out).drop("_v")


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, parts: int | None = None) -> DataFrame:
    """:func:`sum_over` of rows that are not in ranges yet."""
    return sum_over(range_parts(df, keys, pos, parts), keys, pos, value, out).drop(PART)


def carry_forward(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, parts: int | None = None) -> DataFrame:
    """:func:`latest_over` of rows that are not in ranges yet."""
    return latest_over(range_parts(df, keys, pos, parts), keys, pos, value, out).drop(PART)


def hashed_index(df: DataFrame, keys: list[str], member: str, out: str) -> DataFrame:
    """0-based position of a distinct ``member`` in its key, in the order of md5(member).

    The first two hex digits split every key into 256 even buckets, so a key with very many
    members is numbered in 256 tasks and stitched by bucket counts (at most 256 rows a key).
    """
    digest = F.md5(F.col(member).cast("string"))
    parts = (df.withColumn("_digest", digest)
             .withColumn("_bucket", F.substring("_digest", 1, 2)).repartition(*keys, "_bucket"))
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    sizes = (parts.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, "_bucket",
                     F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_digest", member)
    return (parts.withColumn("_local", F.row_number().over(inside) - F.lit(1))
            .join(sizes, [*keys, "_bucket"])
            .withColumn(out, F.col("_local") + F.col("_base"))
            .drop("_digest", "_bucket", "_local", "_base"))

"""Exact grouped percentiles without holding or ordering a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here every wanted
rank has a bracket of values, at first from the least to the largest. A pass over the rows counts, map-side
combined, how many values of the bracket fall into each of BINS bins, with the least and largest value
met there; the bin that holds the rank is the next bracket. A bracket that holds one distinct value is the
answer. The pass is the same for groups of any size; the answer is linear interpolation between two
order statistics, as in numpy and in SQL's ``percentile_cont``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

BINS = 1_024


#: The largest finite double.
LARGEST = 1.7976931348623157e308


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a value inside [low, high]; never falls as the value rises.

    Infinities and NaN (the largest, as Spark orders it) have bins of their own, and halves keep differences finite.
    """
    bottom, top = F.greatest(low, F.lit(-LARGEST)), F.least(high, F.lit(LARGEST))
    width = top / 2 - bottom / 2
    place = F.floor((value / 2 - bottom / 2) / F.nullif(width, F.lit(0.0)) * bins)
    return (F.when(F.isnan(value), F.lit(bins + 1)).when(value > LARGEST, F.lit(bins)).when(value < -LARGEST, F.lit(-1))
            .otherwise(F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")))


def order_statistics(data: DataFrame, keys: list[str], value: str, ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """``ranks`` (keys, rank: from 0) with the value of that rank in its group as ``_at``.

    The brackets are a small table, at most one row per key and rank; every round joins it with the rows,
    which the caller has settled.
    """
    keys = list(keys)
    data = data.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"))
    own = [f"_k{i}" for i in range(len(keys))]
    same = F.lit(True)
    for k in own:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}"))
    ends = data.groupBy(*own).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = ranks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "rank").distinct()
    met = F.lit(True)
    for k in own:
        met = met & F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}"))
    # _below: values of the group under the bracket.
    brackets = settle(wanted.alias("d").join(ends.alias("b"), met).select(
        *[f"d.{k}" for k in own], F.array("d.rank").alias("_ranks"), F.lit(0).cast("long").alias("_below"), "b._low", "b._high")
        .groupBy(*own, "_below", "_low", "_high").agg(F.flatten(F.collect_list("_ranks")).alias("_ranks")))
    found = None
    while True:
        done = brackets.where("_low = _high").select(*own, F.explode("_ranks").alias("rank"), F.col("_low").alias("_at"))
        found = done if found is None else found.union(done)
        brackets = brackets.where("_low < _high")
        if brackets.isEmpty():
            break
        inside = data.alias("d").join(brackets.alias("b"), same & (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        counts = inside.select(*[f"b.{k}" for k in own], "_below", "_ranks", "_v", _bin(F.col("_v"), F.col("_low"), F.col("_high"), bins).alias(
            "_bin")).groupBy(*own, "_below", "_ranks", "_bin").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        # At most ``bins`` rows per bracket.
        before = Window.partitionBy(*own, "_below", "_ranks").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
        held = F.filter("_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_n")))
        brackets = settle(placed.select(*own, "_below", "_low", "_high", held.alias("_ranks")).where(F.size("_ranks") > 0))
    names = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    return found.select(*names, "rank", "_at")


def group_percentiles(df: DataFrame, keys: list[str], value: str, wanted: Mapping[str, float], bins: int = BINS) -> DataFrame:
    """One row per key with a column per entry of ``wanted`` (name -> fraction); null values do not count."""
    names = list(wanted)
    data = settle(df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    sizes = settle(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    rank = {n: (F.col("_n") - 1) * F.lit(float(p)) for n, p in wanted.items()}
    ranks = sizes.select(*keys, F.explode(F.array(*[f(rank[n]).cast("long") for n in names for f in (F.floor, F.ceil)])).alias("rank"))
    at = order_statistics(data, keys, "_v", ranks, bins)
    # A map of at most two entries per fraction.
    values = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_at"))).alias("_values"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"v.{k}"))
    joined = sizes.alias("s").join(values.alias("v"), same).select(*[F.col(f"s.{k}").alias(k) for k in keys], "_n", "_values")

    def interpolated(n: str) -> Column:
        low, high = (F.element_at("_values", f(rank[n]).cast("long")) for f in (F.floor, F.ceil))
        return low + (rank[n] - F.floor(rank[n])) * (high - low)

    return joined.select(*keys, *[interpolated(n).alias(n) for n in names])

"""Helpers the operators share: lineage cuts, row keys, broadcasts, filters, range-sorted parts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numbers (values of rows, or elements of their arrays) that may be broadcast, 64 MB or less; larger sides are shuffled.
BROADCAST_NUMBERS = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "llm-checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark's cleaner removes it when it is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, weight: Column | None = None, limit: int = BROADCAST_NUMBERS) -> DataFrame:
    """Hint a broadcast of a checkpointed ``df`` only if its rows times columns, or the sum of ``weight``, are in ``limit``."""
    numbers = F.lit(len(df.columns)) if weight is None else weight
    size = df.agg(F.coalesce(F.sum(numbers), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def row_keys(*columns: str | Column) -> tuple[Column, Column]:
    """128 bits that identify a row by the values (nulls included) of ``columns``."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    nulls = [c.isNull() for c in parts]
    return F.xxhash64(F.lit(1), *parts, *nulls), F.xxhash64(F.lit(2), *nulls, *reversed(parts))


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """(_row, _k1, _k2): rows packed away with their keys over ``columns``, so that no column name can clash in a join."""
    k1, k2 = row_keys(*columns)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), k1.alias("_k1"), k2.alias("_k2"))


def same_key(k1: str = "k1", k2: str = "k2") -> Column:
    """Join condition of :func:`keyed` rows with columns ``k1`` and ``k2``."""
    return (F.col("_k1") == F.col(k1)) & (F.col("_k2") == F.col(k2))


def unpacked(df: DataFrame, *more: Column) -> DataFrame:
    """The packed rows' columns again, and ``more``."""
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.schema["_row"].dataType.names], *more)


def lower_ascii(text: str | Column) -> Column:
    """Lower-case A-Z and leave all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


#: Least and most bits of a hash filter (128 kB to 2 MB), whatever it is built from: a fuller one only passes more.
FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 24


def filter_bits(n: int, least: int = FILTER_BITS) -> int:
    """Bits for ``n`` hashes, 16 for each."""
    return max(least, min(MOST_FILTER_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))


def _bits(h: Column, bits: int) -> list[Column]:
    """Two positions in the filter, from different bits of a hash."""
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits))]


def hash_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> Column:
    """A filter of the column ``h`` as an array constant of bits / 64 numbers."""
    set_bits = hashes.select(F.explode(F.array(*_bits(F.col("h"), bits))).alias("bit"))
    packed = set_bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    filled = {at: word for at, word in packed.collect()}  # of a bounded size
    text = ",".join(str(filled.get(i, 0)) for i in range(bits // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def filter_row(hashes: DataFrame, bits: int) -> DataFrame:
    """The filter of the column ``h`` as one checkpointed row: ``flags``, an array of bits / 64 numbers, put together by the executors.

    Its ``scalar()`` stands for a filter that grows: a constant is printed, a number at a time, into every plan the driver keeps.
    """
    set_bits = hashes.select(F.explode(F.array(*_bits(F.col("h"), bits))).alias("bit"))
    masks = set_bits.select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    unset = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bits"))

    def listed(key: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(key, "bits"))), lambda x: x["bits"])

    numbers = masks.union(unset).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    blocks = numbers.groupBy(F.shiftright("at", 10).alias("block")).agg(listed("at").alias("bits"))
    return cut(blocks.agg(F.flatten(listed("block")).alias("flags")))


def passes(flags: Column, h: Column, bits: int = FILTER_BITS) -> Column:
    """Whether the filter may hold ``h``; never false for a hash it was built from."""
    tests = [F.getbit(F.get(flags, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1 for b in _bits(h, bits)]
    return tests[0] & tests[1]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where a filter is pushed down or inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def part_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_parts(df: DataFrame, *order: str) -> DataFrame:
    """``df`` range-sorted by ``order``; ``_part`` numbers the ranges in ascending order.

    The result is checkpointed, so a lost executor cannot deal the rows anew.
    """
    spread = df.repartitionByRange(part_count(df.sparkSession), *order)
    return cut(spread.withColumn("_part", F.spark_partition_id()))


def running_sum(parts: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of ``group`` before and up to a row, over the output of :func:`range_parts`.

    Each range is summed by its own task; only one total per (range, group) is gathered, so a
    group that holds most rows is still spread. ``group`` must be the first column of the range order.
    """
    totals = parts.groupBy("_part", group).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.col(group).alias("_group"),
                           F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.withColumn(out, F.sum(value).over(inside)).alias("r").join(
        totals.alias("t"), (F.col("r._part") == F.col("t._part")) & F.col(f"r.{group}").eqNullSafe(F.col("t._group")))
    return joined.select(*[F.col(f"r.{c}") for c in parts.columns if c != "_part"],
                         (F.col(f"r.{out}") + F.col("t._before")).alias(out))

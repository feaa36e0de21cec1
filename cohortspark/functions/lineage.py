"""Intermediate results: written once for several readers, computed once per row.

A settled table is a reliable checkpoint in the folder named by ``spark.checkpoint.dir``: it
survives the loss of executors, branches do not recompute the scan behind it, and Spark's
cleaner removes it when nothing refers to it any more.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
#: Times its share of the rows that the fullest of evenly dealt partitions may hold.
EVEN = 2


def settle(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's shared folder.

    The folder is read from the session.  A local session without one gets a temporary folder; on a
    cluster its absence is an error, since no other folder is shared.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(_KEY, None) or context.getConf().get(_KEY)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError(f"set {_KEY} to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "settled")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add expensive columns so that each is evaluated exactly once per row.

    A filter on a projected column is pushed below the projection by copying its expression,
    so higher-order functions would run once in the filter and again in the projection.  A
    one-row generator is not copied: everything above it refers to its output.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition rows that are about to be expanded, at least one partition per core.

    The number is explicit, so adaptive execution does not coalesce the small input of a
    large expansion back into one task.
    """
    return df.repartition(_parts(df), *columns)


def spread_if_even(df: DataFrame, source: DataFrame, *columns: str) -> DataFrame:
    """``spread``, unless one partition would get more than EVEN times its share of the rows of ``source``; then as is.

    ``source`` holds the same keys and is cheaper to read: a pass over these columns alone counts the
    rows of each partition, by the hash that deals them.
    """
    n = _parts(df)
    counts = source.groupBy(F.pmod(F.hash(*columns), F.lit(n)).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    most, all_rows = counts.agg(F.max("_n"), F.sum("_n")).first()
    return spread(df, *columns) if (most or 0) * n <= EVEN * (all_rows or 0) else df


def spread_scan(df: DataFrame, *columns: str) -> DataFrame:
    """Deal out a scan that has fewer splits than cores (a few small files); otherwise as is.

    With ``columns`` the rows are hash-partitioned on them, so a following aggregation on the
    same key needs no further shuffle.  A scan of many files is left alone.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *columns) if df.rdd.getNumPartitions() < n else df

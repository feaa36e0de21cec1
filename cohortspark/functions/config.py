"""Small tables that come from configuration, and size-checked broadcasts.

A broadcast hint is given only to data with a proven bound: configuration rows (counted
on the driver) or a DataFrame whose row count was checked; larger ones are joined without a hint.  All
other joins carry no hint; Spark's own size estimate and AQE choose the strategy.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_CONFIG_ROWS = 20_000


def config_table(spark: SparkSession, rows: Sequence[Mapping], schema: pa.Schema) -> DataFrame:
    """Literal rows as a local relation, with a broadcast hint if they are few."""
    rows = list(rows)
    table = spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
    return F.broadcast(table) if len(rows) <= BROADCAST_CONFIG_ROWS else table


def strings(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.string()) for n in names])


def feature_set_table(spark: SparkSession, sets: Mapping[str, Sequence[str]],
                      set_name: str = "module_id", member: str = "gene") -> DataFrame:
    """(set, member) rows of a locked feature-set configuration."""
    check_feature_sets(sets)
    rows = [{set_name: s, member: g.strip().upper()} for s, genes in sets.items() for g in genes]
    return config_table(spark, rows, strings(set_name, member))


def check_feature_sets(sets: Mapping[str, Sequence[str]]) -> None:
    """Empty sets, empty members and repeated members are configuration errors."""
    for name, genes in sets.items():
        normal = [g.strip().upper() for g in genes]
        if not normal or any(not g for g in normal):
            raise ValueError(f"feature set {name!r} is empty or has an empty member")
        if len(set(normal)) != len(normal):
            raise ValueError(f"feature set {name!r} repeats a member")


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Hint ``df`` when it has at most ``max_rows`` rows (one bounded count), else leave it.

    At most ``max_rows + 1`` rows are looked at, so the check does not grow with the data.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small

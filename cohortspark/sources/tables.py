"""Delimited ledgers, specifications, feature sets and manifests.

Every file is read as text columns with a declared schema and coerced on purpose; nothing
is inferred.  Readers return the data; their checks are gate DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import gates as G

# Column contracts of the published tables.
CONTRAST_COLUMNS = (
    "cohort_id", "cohort_role", "inference_key_type", "score_files", "dataset_values", "compartment",
    "group_column", "comparison_value", "target_value", "comparison_label", "target_label",
    "contrast_label", "severity_orientation", "analysis_role", "confirmatory_eligible", "notes")
MANIFEST_COLUMNS = (
    "release_groups", "local_path", "accession", "resource_role", "asset_kind", "source", "url", "bytes",
    "sha256", "notes")
LISTING_COLUMNS = ("entry_type", "name", "time", "bytes", "type")


class ColumnError(ValueError):
    """A required column is absent."""


def read_text_table(spark: SparkSession, path: str | Sequence[str], required: Sequence[str] = (),
                    sep: str = ",", trim: bool = True, multi_line: bool = False) -> DataFrame:
    """All-string table with a header; a byte-order mark on the first name is dropped.

    ``multi_line`` allows line breaks inside quoted fields, at the price of one task a file.
    """
    # inferSchema stays off: every column is text.
    df = (spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line)
          .option("quote", '"').option("escape", '"').csv(path))
    names = [c.replace("\ufeff", "").strip() for c in df.columns]
    df = df.toDF(*names)
    missing = [c for c in required if c not in names]
    if missing:
        raise ColumnError(f"{path}: missing columns {missing}")
    return df.select(*[F.trim(c).alias(c) for c in names]) if trim else df


def read_ledger(spark: SparkSession, path: str, required: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Sample ledger and its gates: non-blank key, unique key, not empty."""
    df = read_text_table(spark, path, [*required, key])
    gates = G.gate_rows(df, F.lit("ledger"), {f"blank_{key}": X.is_blank(key)})
    gates = gates.unionByName(G.duplicate_gate(df, [key], f"duplicate_{key}", "ledger"))
    empty = G.with_status(df.agg((F.count(F.lit(1)) == 0).cast("long").alias("violations")).select(
        F.lit("empty_file").alias("gate"), F.lit("ledger").alias("scope"), "violations"))
    return df, gates.unionByName(empty)


def read_contrast_spec(spark: SparkSession, path: str) -> DataFrame:
    """Contrast specification with its list columns as arrays."""
    df = read_text_table(spark, path, CONTRAST_COLUMNS[:-1])
    return df.withColumns({c: X.split_list(c) for c in ("score_files", "dataset_values")})


def read_cell_ledger(spark: SparkSession, path: str, required: Sequence[str], sep: str = "\t",
                     partitions: int | None = None, keys: Sequence[str] = ("library_id", "barcode")
                     ) -> tuple[DataFrame, DataFrame]:
    """Per-cell rows and the uniqueness gate.

    A gzip file is one split, so the rows are spread by their key right after the read.
    """
    df = (spark.read.option("header", True).option("sep", sep).csv(path))
    missing = [c for c in (*required, *keys) if c not in df.columns]
    if missing:
        raise ColumnError(f"{path}: missing columns {missing}")
    df = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return df, G.duplicate_gate(df, keys, "duplicate_cell", "cell_ledger")


def read_feature_sets(spark: SparkSession, path: str, field: str = "modules", member: str = "genes"
                      ) -> tuple[DataFrame, DataFrame]:
    """JSON configuration -> (set_name, label, gene) rows and gates.

    Accepts ``{field: {name: {label, genes: [...]}}}`` and ``{field: {name: [...]}}``.
    """
    raw = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    nested = F.from_json("value", f"struct<{field}:map<string,struct<label:string,{member}:array<string>>>>")
    flat = F.from_json("value", f"struct<{field}:map<string,array<string>>>")
    a = raw.select(F.explode(nested[field]).alias("set_name", "_v")).select(
        "set_name", F.col("_v.label").alias("label"), F.col(f"_v.{member}").alias("_genes"))
    b = raw.select(F.explode(flat[field]).alias("set_name", "_genes")).select(
        "set_name", F.lit(None).cast("string").alias("label"), "_genes")
    sets = a.where(F.col("_genes").isNotNull()).unionByName(b.where(F.col("_genes").isNotNull()))
    rows = sets.select("set_name", "label", F.explode_outer("_genes").alias("gene")).withColumn(
        "gene", X.normalize_symbol("gene"))
    gates = G.gate_rows(rows, F.col("set_name"), {"empty_set_or_member": X.is_blank("gene")})
    return rows, gates.unionByName(G.duplicate_gate(rows, ["set_name", "gene"], "duplicate_member", "feature_sets"))


def read_file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Published archive listing; its header starts with ``#``."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = [c.lstrip("#").strip() for c in df.columns]
    if len(names) != len(LISTING_COLUMNS):
        raise ColumnError(f"{path}: expected {len(LISTING_COLUMNS)} columns, found {names}")
    return df.toDF(*LISTING_COLUMNS).withColumn("bytes", F.col("bytes").try_cast("long"))


def read_asset_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Asset manifest with arrays of release groups, and its row gates."""
    raw = read_text_table(spark, path, MANIFEST_COLUMNS, sep="\t")
    local = F.col("local_path")
    gates = G.gate_rows(raw, F.lit("asset_manifest"), {
        "invalid_sha256": ~F.coalesce(F.lower("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "invalid_bytes": ~F.coalesce(F.col("bytes").try_cast("long") >= 0, F.lit(False)),
        "unsafe_path": X.is_blank(local) | local.startswith("/") | local.contains("..") | local.rlike("^[A-Za-z]:")})
    rows = raw.select(local.alias("path"), F.col("bytes").try_cast("long").alias("bytes"),
                      F.lower("sha256").alias("sha256"), X.split_list("release_groups").alias("groups"))
    return rows, gates.unionByName(G.duplicate_gate(raw, ["local_path"], "duplicate_path", "asset_manifest"))


def read_attribute_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Nine-column interval file -> gene spans (chrom, start, end, gene_id, gene_name)."""
    names = "chrom string, source string, feature string, start string, `end` string, score string, " \
            "strand string, frame string, attributes string"
    # Quotes belong to the attribute text, so quoting is off.
    df = (spark.read.schema(names).option("sep", "\t").option("comment", "#").option("quote", "\u0000")
          .csv(path))
    return df.where(F.col("feature") == "gene").select(
        "chrom", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"),
        X.without_version(attribute("attributes", "gene_id")).alias("gene_id"),
        attribute("attributes", "gene_name").alias("gene_name"))


def attribute(c: str | Column, name: str) -> Column:
    """Value of one quoted attribute, empty when absent."""
    return F.regexp_extract(X.col(c), rf'(?:^|;)\s*{name} "([^"]*)"', 1)

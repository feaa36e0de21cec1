"""Integrity audits: matrices, identifiers, ledgers, designs, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.quantiles import group_percentiles


# ---------------------------------------------------------------- numeric text tables

# Checks of one number parsed from text (NULL when it is not finite).
FIELD_PROBLEMS = {
    "non_finite_values": lambda number: number.isNull(),
    "negative_values": lambda number: F.coalesce(number < 0, F.lit(False)),
    "non_integer_values": lambda number: F.coalesce((number >= 0) & (number != F.floor(number)), F.lit(False)),
}


def tabular_integrity(lines: DataFrame, keys: Sequence[str], line: str = "line", width: int = 0,
                      numeric_from: int = 1, separator: str = "\t") -> DataFrame:
    """Rows, unique and duplicate ids, malformed widths and value problems of delimited lines.

    ``width`` is the expected field count.  One explicitly empty trailing field is dropped
    and counted; any other width is malformed.  Ids are pre-counted per (keys, id).
    """
    keys = list(keys)
    raw = F.split(F.col(line), separator)
    trailing = (F.size(raw) == width + 1) & (F.element_at(raw, -1) == "")
    parsed = lines.select(*keys, trailing.alias("_trail"), F.when(trailing, F.slice(raw, 1, width)).otherwise(raw).alias("_f"))
    parsed = parsed.withColumn("_ok", F.size("_f") == width)
    numbers = F.transform(F.slice("_f", numeric_from + 1, max(width - numeric_from, 1)), X.to_number)
    counts = {name: F.size(F.filter(numbers, check)) for name, check in FIELD_PROBLEMS.items()}
    per_id = (parsed.select(*keys, "_ok", "_trail", F.when(F.col("_ok"), F.col("_f")[0]).alias("_id"),
                            *[F.when(F.col("_ok"), c).otherwise(F.lit(0)).alias(n) for n, c in counts.items()],
                            F.when(F.col("_ok"), F.array_min(numbers)).alias("_min"),
                            F.when(F.col("_ok"), F.array_max(numbers)).alias("_max"))
              .groupBy(*keys, "_id").agg(
                  F.count_if("_ok").alias("_rows"), F.count_if(~F.col("_ok")).alias("_bad"),
                  F.count_if("_trail").alias("_trails"),
                  *[F.sum(n).alias(n) for n in counts], F.min("_min").alias("_min"), F.max("_max").alias("_max")))
    return per_id.groupBy(*keys).agg(
        F.sum("_rows").alias("feature_rows"),
        F.count_if((F.col("_rows") > 0)).alias("unique_feature_ids"),
        F.sum(F.greatest(F.col("_rows") - 1, F.lit(0))).alias("duplicate_feature_ids"),
        F.sum("_bad").alias("malformed_rows"), F.sum("_trails").alias("trailing_empty_fields"),
        *[F.sum(n).alias(n) for n in counts], F.min("_min").alias("min_value"), F.max("_max").alias("max_value"))


def sampled_value_check(rows: DataFrame, position: str, fields: Column, every_row: int = 500,
                        columns_sampled: int = 256) -> DataFrame:
    """Integer and sign check of a fixed sample: row 1 and each ``every_row``-th, and evenly
    spaced columns.  The sample is the feature: it bounds the cost on very wide matrices."""
    spacing = F.greatest(F.floor(F.size(fields) / F.lit(columns_sampled)), F.lit(1))
    picked = rows.where((F.col(position) == 1) | (F.col(position) % every_row == 0))
    values = F.filter(fields, lambda v, i: i % spacing == 0)
    cells = picked.select(F.explode(values).alias("_v")).withColumn("_n", X.to_number("_v"))
    return cells.agg(
        F.count(F.lit(1)).alias("sampled_values"),
        F.count_if(F.col("_n").isNull() | (F.col("_n") != F.floor("_n"))).alias("non_integer_values"),
        F.count_if(F.col("_n") < 0).alias("negative_values"))


# ---------------------------------------------------------------- coordinate matrices

def parse_coordinates(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add feature, cell, value (NULL where malformed) and the NUL count of raw lines."""
    nul = "\u0000"
    text = F.col(line)
    pattern = r"^\s*([+-]?[0-9]+)\s+([+-]?[0-9]+)\s+([+-]?[0-9]+)\s*$"
    nul_bytes = (F.length(text) - F.length(F.translate(text, nul, ""))).cast("long")
    ok = text.rlike(pattern) & (nul_bytes == 0)
    part = lambda i: F.when(ok, F.regexp_extract(text, pattern, i).try_cast("long"))
    return lines.withColumns({"nul_bytes": nul_bytes, "feature": part(1), "cell": part(2), "value": part(3)})


def coordinate_integrity(lines: DataFrame, headers: DataFrame, key: str = "library_id",
                         line: str = "line", pos: str = "pos") -> DataFrame:
    """Integrity counters and the pass flag of each library's coordinate lines.

    ``headers``: key, matrix_rows, matrix_columns, declared_nnz, n_features, n_barcodes.
    Zero values are counted but do not fail the text integrity flag.
    """
    shown = parse_coordinates(lines, line).where(
        ~(F.trim(F.col(line)) == "") & ~F.col(line).startswith("%"))
    valid = F.col("feature").isNotNull() & F.col("cell").isNotNull() & F.col("value").isNotNull()
    joined = shown.join(headers.select(key, "n_features", "n_barcodes"), key)
    inside = F.col("feature").between(1, F.col("n_features")) & F.col("cell").between(1, F.col("n_barcodes"))
    counted = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("coordinate_lines"), F.count_if(valid).alias("valid_lines"),
        F.count_if(~valid).alias("malformed_lines"), F.count_if(valid & ~inside).alias("out_of_range"),
        F.count_if(valid & (F.col("value") < 0)).alias("negative_values"),
        F.count_if(valid & (F.col("value") == 0)).alias("zero_values"),
        F.sum("nul_bytes").alias("nul_bytes"),
        F.min(F.when(~valid, F.col(pos))).alias("first_malformed_pos"),
        F.max(F.when(~valid, F.col(pos))).alias("last_malformed_pos"))
    names = ["coordinate_lines", "valid_lines", "malformed_lines", "out_of_range", "negative_values",
             "zero_values", "nul_bytes"]
    out = headers.join(counted, key, "left").fillna(0, subset=names).withColumns({
        "dimension_match": (F.col("matrix_rows") == F.col("n_features"))
        & (F.col("matrix_columns") == F.col("n_barcodes")),
        "line_count_matches": F.col("coordinate_lines") == F.col("declared_nnz"),
        "valid_count_matches": F.col("valid_lines") == F.col("declared_nnz")})
    return out.withColumn("text_integrity_pass",
                          F.col("dimension_match") & F.col("line_count_matches") & F.col("valid_count_matches")
                          & (F.col("malformed_lines") == 0) & (F.col("out_of_range") == 0)
                          & (F.col("negative_values") == 0) & (F.col("nul_bytes") == 0))


def integrity_failures(audit: DataFrame) -> DataFrame:
    """Failing gates, payload legality, inclusion and role; zero values are illegal here."""
    illegal = ((F.col("malformed_lines") > 0) | (F.col("out_of_range") > 0)
               | (F.col("negative_values") > 0) | (F.col("zero_values") > 0))
    out = audit.withColumns({
        "failures": X.reason_list(
            (~F.col("dimension_match"), "dimension mismatch"),
            (~F.col("line_count_matches"), "Matrix Market line count mismatch"),
            (~F.col("valid_count_matches"), "valid coordinate count mismatch"),
            (illegal, "illegal Matrix Market payload"),
            (~F.col("text_integrity_pass"), "text integrity failure"), none=""),
        "payload_legal": ~illegal & F.col("valid_count_matches")})
    included = F.col("failures") == ""
    return out.withColumns({
        "inclusion": F.when(included, F.lit("included after stream-integrity audit"))
        .otherwise(F.lit("excluded by stream-integrity audit")),
        "analysis_role": F.when(included, F.lit("exploratory")).otherwise(F.lit("not analysed"))})


def raw_eligibility(audits: DataFrame, key: str = "library_id", prefix: str = "raw 10x") -> DataFrame:
    """Eligible if the matrix status has the prefix and the dimension check passed; a key with
    several audit rows is flagged."""
    counts = audits.groupBy(key).agg(F.count(F.lit(1)).alias("audit_rows"))
    eligible = F.col("matrix_status").startswith(prefix) & F.col("dimension_check_pass")
    return audits.join(counts, key).withColumn("raw_count_eligible", eligible).withColumn(
        "analysis_status", F.when(F.col("audit_rows") != 1, F.lit("repeated audit row"))
        .when(F.col("raw_count_eligible"), F.lit("eligible for pre-QC raw-count ingestion"))
        .otherwise(F.lit("blocked")))


# ---------------------------------------------------------------- identifiers

def _id_counts(rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    per_value = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"unique_{name}"), (F.sum("_n") - F.count(F.lit(1))).alias(f"duplicate_{name}"))


def identifier_audit(features: DataFrame, barcodes: DataFrame, key: str) -> DataFrame:
    """Unique and duplicate ids, symbols and barcodes with the recommended key.

    Two-level counts replace several distinct counts in one aggregate, which would expand
    every row once per counted column.
    """
    out = (_id_counts(features, [key], "feature_id", "feature_ids")
           .join(_id_counts(features, [key], "symbol", "symbols"), key)
           .join(_id_counts(barcodes, [key], "barcode", "barcodes"), key, "left"))
    ok = (F.col("duplicate_feature_ids") == 0) & (F.coalesce("duplicate_barcodes", F.lit(0)) == 0)
    return out.fillna(0, subset=["unique_barcodes", "duplicate_barcodes"]).withColumns({
        "identifier_check_pass": ok, "recommended_key": F.lit("feature_id")})


def id_overlap(rows: DataFrame, platform: DataFrame, key: str, id_column: str) -> DataFrame:
    """Per file: rows, unique ids, ids shared with the platform and both differences."""
    known = platform.select(id_column).distinct().withColumn("_known", F.lit(True))
    per_id = rows.groupBy(key, id_column).agg(F.count(F.lit(1)).alias("_n"))
    out = per_id.join(known, id_column, "left").groupBy(key).agg(
        F.sum("_n").alias("feature_rows"), F.count(F.lit(1)).alias("unique_ids"),
        F.count_if("_known").alias("platform_intersection"),
        F.count_if(F.col("_known").isNull()).alias("unmapped_ids"))
    return out.withColumn("platform_ids_missing",
                          known.agg(F.count(F.lit(1))).scalar() - F.col("platform_intersection")).withColumn(
        "status", F.when(F.col("unmapped_ids") == 0, F.lit("pass")).otherwise(F.lit("fail")))


def id_overlap_lists(rows: DataFrame, platform: DataFrame, key: str, id_column: str) -> DataFrame:
    """The ids behind the counts: ids of a file that the platform lacks, and platform ids that no file has (key NULL)."""
    known = platform.select(id_column).distinct()
    unmapped = rows.select(key, id_column).distinct().join(known, id_column, "left_anti").select(
        key, id_column, F.lit("unmapped_id").alias("problem"))
    absent = known.join(rows.select(id_column).distinct(), id_column, "left_anti")
    return unmapped.unionByName(absent.select(
        F.lit(None).cast(rows.schema[key].dataType).alias(key), id_column, F.lit("platform_id_in_no_file").alias("problem")))


def examples(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Distinct count and the first ``k`` distinct values per key.

    The ranking keeps k values per key before it shuffles, so no group is collected whole.
    """
    keys = list(keys)
    distinct = rows.select(*keys, value).distinct()
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_values"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    first = (distinct.withColumn("_r", rank).where(F.col("_r") <= k)
             .groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), ";").alias("examples")))
    return counts.join(first, keys)


# ---------------------------------------------------------------- designs

def pair_status(ledger: DataFrame, donor: str = "donor_id", compartment: str = "compartment",
                pair: Sequence[str] = ("AF", "NP")) -> DataFrame:
    """Per donor × compartment: library count, pairing and the one-library rule."""
    libraries = ledger.groupBy(donor, compartment).agg(
        F.count_distinct("library_id").alias("libraries"), F.min("library_id").alias("first_library"))
    sides = libraries.groupBy(donor).agg(
        *[F.max(F.when(F.col(compartment) == p, 1).otherwise(0)).alias(f"_{p}") for p in pair],
        F.max(F.when(~F.col(compartment).isin(list(pair)), 1).otherwise(0)).alias("_other"))
    paired = (F.col(f"_{pair[0]}") == 1) & (F.col(f"_{pair[1]}") == 1) & (F.col("_other") == 0)
    return libraries.join(sides, donor).select(
        donor, compartment, "libraries", "first_library",
        F.when(paired, F.lit("_".join(pair) + "_paired")).otherwise(
            F.concat(F.col(compartment), F.lit("_only"))).alias("pair_status"),
        (F.col("libraries") == 1).alias("one_library"))


def earlier_library(ledger: DataFrame) -> DataFrame:
    """Libraries that repeat a donor × compartment, with the library met before."""
    distinct = ledger.select("donor_id", "compartment", "library_id").distinct()
    w = Window.partitionBy("donor_id", "compartment").orderBy("library_id")
    return (distinct.withColumn("earlier_library", F.lag("library_id").over(w))
            .where(F.col("earlier_library").isNotNull()))


def design_summary(ledger: DataFrame, group: str, controls: Sequence[str], cases: Sequence[str],
                   pair: Sequence[str] = ("AF", "NP")) -> DataFrame:
    """metric / value rows of a sample ledger.

    Reduced to one row per donor before counting, so no distinct count sees the raw rows.
    """
    c = F.col("compartment")
    donors = ledger.groupBy("donor_id").agg(
        F.count(F.lit(1)).alias("_samples"),
        *[F.count_if(c == p).alias(f"_{p}") for p in pair],
        F.max(F.when(F.col(group).isin(list(controls)), 1).otherwise(0)).alias("_control"),
        F.max(F.when(F.col(group).isin(list(cases)), 1).otherwise(0)).alias("_case"))
    paired = (F.col(f"_{pair[0]}") > 0) & (F.col(f"_{pair[1]}") > 0)
    totals = donors.agg(
        F.sum("_samples").alias("samples"), F.count(F.lit(1)).alias("donors"),
        F.sum("_control").alias("control_donors"), F.sum("_case").alias("case_donors"),
        F.count_if(paired).alias("paired_donors"),
        F.count_if(paired & (F.col("_control") == 1)).alias("control_paired_donors"),
        F.count_if(paired & (F.col("_case") == 1)).alias("case_paired_donors"),
        *[F.sum(f"_{p}").alias(f"{p}_libraries") for p in pair])
    return totals.unpivot([], totals.columns, "metric", "value")


# ---------------------------------------------------------------- distributions

def matrix_distribution(cells: DataFrame, key: str, min_detected: int, min_total: float,
                        max_mt_fraction: float, features: int | Column) -> DataFrame:
    """Per sample: cells, density, quartiles of totals, detected features and mt fraction.

    Unlike the cell QC rule, the mt fraction of an empty cell is missing and the limit is
    inclusive (``<=``).
    """
    fraction = F.when(F.col("total_umi") > 0, F.col("mt_umi") / F.col("total_umi"))
    rows = cells.withColumn("mt_fraction", fraction)
    meets = ((F.col("detected_genes") >= min_detected) & (F.col("total_umi") >= min_total)
             & F.coalesce(F.col("mt_fraction") <= max_mt_fraction, F.lit(False)))
    width = F.lit(features) if isinstance(features, int) else features
    summary = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("detected_genes").alias("nonzero_entries"),
        F.avg(meets.cast("double")).alias("fraction_meeting_thresholds")).withColumn(
        "nonzero_fraction", F.col("nonzero_entries") / (width * F.col("cells")))
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("_value"))
                        for m, c in (("total", "total_umi"), ("detected", "detected_genes"),
                                     ("mt_fraction", "mt_fraction"))])
    quartiles = group_percentiles(rows.select(key, F.inline(metrics)), [key, "metric"], "_value",
                                  {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return summary.join(quartiles, key)


def range_report(summary: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Smallest and largest per-sample summary value as (metric, minimum, maximum)."""
    names = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("_v"))
                      for n, c in metrics.items()])
    return summary.select(F.inline(names)).groupBy("metric").agg(
        F.min("_v").alias("minimum"), F.max("_v").alias("maximum"), F.count("_v").alias("samples"))

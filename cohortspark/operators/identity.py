"""Identity and coverage: crosswalks, alignments, listings, assets, key differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def side_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Matched / left-only / right-only key counts, overall or per ``by`` (a subset of keys).

    Union and count instead of a full join: each key becomes one row with a left and a right
    count, combined map-side, so a key repeated very often on one side costs one row per task.
    """
    keys = list(keys)
    sides = (left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
             .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    per_key = sides.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    l, r = F.col("_l") > 0, F.col("_r") > 0
    return per_key.groupBy(*by).agg(
        F.count_if(l).alias("left_keys"), F.count_if(r).alias("right_keys"),
        F.count_if(l & r).alias("matched_keys"), F.count_if(l & ~r).alias("left_only_keys"),
        F.count_if(r & ~l).alias("right_only_keys"),
        F.count_if((F.col("_l") > 1) | (F.col("_r") > 1)).alias("repeated_keys"))


def identity_crosswalk(scores: DataFrame, ledger: DataFrame, identity: Sequence[str],
                       by: str = "cohort_id") -> DataFrame:
    """Exact agreement of distinct identity tuples between a score table and a ledger."""
    counts = side_counts(scores.select(*identity).distinct(), ledger.select(*identity).distinct(), identity, [by])
    exact = (F.col("left_only_keys") == 0) & (F.col("right_only_keys") == 0)
    return counts.select(
        by, F.col("left_keys").alias("score_keys"), F.col("right_keys").alias("ledger_keys"), "matched_keys",
        F.col("left_only_keys").alias("score_table_only_keys"),
        F.col("right_only_keys").alias("ledger_only_keys"),
        F.when(exact, F.lit("pass_exact_identity_crosswalk")).otherwise(F.lit("fail_identity_crosswalk"))
        .alias("crosswalk_status"))


def coverage_check(required: DataFrame, observed: DataFrame, keys: Sequence[str], scope: str) -> DataFrame:
    """Exact one-to-one coverage: each required key observed once, no other key observed."""
    counts = side_counts(required, observed, keys)
    exact = ((F.col("left_only_keys") == 0) & (F.col("right_only_keys") == 0) & (F.col("repeated_keys") == 0))
    return counts.select(
        F.lit(scope).alias("scope"), F.col("left_keys").alias("required_keys"),
        F.col("right_keys").alias("observed_keys"), F.col("left_only_keys").alias("missing_keys"),
        F.col("right_only_keys").alias("unexpected_keys"), "repeated_keys",
        F.when(exact, F.lit("pass")).otherwise(F.lit("fail")).alias("status"))


def library_presence(archive: DataFrame, ledger: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Archive libraries missing from the ledger; with ``strict`` also the reverse."""
    missing = archive.select(key).distinct().join(ledger, key, "left_anti").withColumn(
        "problem", F.lit("archive_library_absent_from_ledger"))
    if strict:
        extra = ledger.select(key).distinct().join(archive, key, "left_anti").withColumn(
            "problem", F.lit("ledger_library_absent_from_archive"))
        missing = missing.unionByName(extra)
    return missing


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A−B and B−A as rows with the side they come from."""
    keys = list(keys)
    a, b = left.select(*keys), right.select(*keys)
    return (a.join(b, keys, "left_anti").distinct().withColumn("side", F.lit("left_only"))
            .unionByName(b.join(a, keys, "left_anti").distinct().withColumn("side", F.lit("right_only"))))


def set_intersection_size(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return side_counts(left, right, keys).select("matched_keys")


def sets_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Whether both sides hold the same keys, overall or per ``by`` (a subset of keys)."""
    return side_counts(left, right, keys, by).select(
        *by, ((F.col("left_only_keys") == 0) & (F.col("right_only_keys") == 0)).alias("sets_equal"))


def audit_alignment(audits: Mapping[str, DataFrame], key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Several audit tables on one key: key presence and field rules as (key, failures, selected).

    Tables are full-outer joined; a rule that cannot be evaluated (a side is missing) fails.
    """
    joined = None
    for name, df in audits.items():
        tagged = df.withColumn(f"in_{name}", F.lit(True))
        joined = tagged if joined is None else joined.join(tagged, key, "full")
    presence = [(F.col(f"in_{name}").isNull(), f"missing_in_{name}") for name in audits]
    failed = [(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules]
    return (joined.select(key, X.reason_list(*presence, *failed, none="").alias("failures"))
            .withColumn("selected", F.col("failures") == ""))


def listing_compare(listing: DataFrame, observed: DataFrame, name: str = "name", size: str = "bytes") -> DataFrame:
    """Published listing against observed members: missing, unexpected, size mismatch, match."""
    a = listing.select(name, F.col(size).alias("published_bytes"))
    b = observed.select(name, F.col(size).alias("observed_bytes"))
    status = (F.when(F.col("observed_bytes").isNull(), F.lit("missing_in_archive"))
              .when(F.col("published_bytes").isNull(), F.lit("unexpected_in_archive"))
              .when(F.col("published_bytes") != F.col("observed_bytes"), F.lit("size_mismatch"))
              .otherwise(F.lit("match")))
    return a.join(b, name, "full").withColumn("listing_status", status)


def verify_assets(manifest: DataFrame, observed: DataFrame, path: str = "path") -> DataFrame:
    """Manifest ⟕ observed files: missing, size differs, hash differs, verified."""
    seen = observed.select(path, F.col("bytes").alias("observed_bytes"), F.col("sha256").alias("observed_sha256"))
    status = (F.when(F.col("observed_bytes").isNull(), F.lit("missing"))
              .when(F.col("observed_bytes") != F.col("bytes"), F.lit("size_mismatch"))
              .when(~F.col("observed_sha256").eqNullSafe(F.col("sha256")), F.lit("hash_mismatch"))
              .otherwise(F.lit("verified")))
    return manifest.join(seen, path, "left").withColumn("asset_status", status)


def grid_completeness(rows: DataFrame, left: DataFrame, left_keys: Sequence[str], right_values: Sequence[str],
                      right_key: str) -> DataFrame:
    """Expected (left keys × configured value) grid against observed keys: missing and extra cells."""
    grid = left.select(*left_keys).distinct().withColumn(
        right_key, F.explode(F.array(*[F.lit(v) for v in right_values])))
    seen = rows.groupBy(*left_keys, right_key).agg(F.count(F.lit(1)).alias("observed_rows"))
    joined = grid.withColumn("_expected", F.lit(True)).join(seen, [*left_keys, right_key], "full")
    status = (F.when(F.col("_expected").isNull(), F.lit("extra"))
              .when(F.col("observed_rows").isNull(), F.lit("missing"))
              .when(F.col("observed_rows") > 1, F.lit("repeated")).otherwise(F.lit("present")))
    return joined.withColumns({"grid_status": status,
                               "observed_rows": F.coalesce("observed_rows", F.lit(0))}).drop("_expected")


def map_columns_to_samples(columns: DataFrame, ledger: DataFrame, key: str, dataset: str) -> DataFrame:
    """Matrix columns -> ledger rows; absent and mismatching datasets are named."""
    a = columns.select(key, F.col(dataset).alias("column_dataset"))
    b = ledger.select(key, F.col(dataset).alias("ledger_dataset"), F.lit(True).alias("_in_ledger"))
    status = (F.when(F.col("_in_ledger").isNull(), F.lit("absent_from_ledger"))
              .when(~F.col("column_dataset").eqNullSafe(F.col("ledger_dataset")), F.lit("dataset_mismatch"))
              .otherwise(F.lit("mapped")))
    return a.join(b, key, "left").withColumn("mapping_status", status).drop("_in_ledger")


def disposition_table(availability: DataFrame, crosswalk: DataFrame, key: str = "cohort_id") -> DataFrame:
    """Availability ⟕ crosswalk counts with a fallback for cohorts without a crosswalk."""
    joined = availability.join(crosswalk, key, "left")
    checked = F.format_string("%s; %d/%d matched", F.col("crosswalk_status"), F.col("matched_keys"),
                              F.col("score_keys"))
    return joined.withColumns({
        "keys_after_score": F.coalesce(F.col("score_keys"), F.col("ledger_rows")),
        "identity_check": F.when(F.col("crosswalk_status").isNotNull(), checked)
        .otherwise(F.lit("separate audit-gated ledger"))})


def identity_conflicts(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One library id with several metadata tuples."""
    return (rows.select(key, *fields).distinct().groupBy(key)
            .agg(F.count(F.lit(1)).alias("metadata_tuples")).where(F.col("metadata_tuples") > 1))


def missing_members(members: DataFrame, features: DataFrame, set_name: str = "module_id",
                    member: str = "gene", symbol: str = "symbol") -> DataFrame:
    """Set members without a matching feature."""
    return members.join(features.select(F.col(symbol).alias(member)).distinct(), member, "left_anti").select(
        set_name, member)

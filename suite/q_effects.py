"""Queries: contrasts, intervals, bootstrap, leave-one-out, alignment, ledgers and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import expr as X
from cohortspark.functions.lineage import settle
from cohortspark.operators import effects as E
from cohortspark.operators import gates as G
from cohortspark.operators import identity as I
from cohortspark.operators import scores as S

from . import views as V
from .q_cells import r6
from .registry import query, view
from .tables import COHORTS, LIBRARY, MODULES, REFERENCE_THRESHOLD, REPLICATES, SYMBOLS, THRESHOLDS, Tables

KEYS = E.CONTRAST


def donor_effects_frame(t: Tables):
    return E.mean_difference(E.contrast_moments(t.arms))


@query("donor_effects", """
SELECT cohort_id, compartment, module_id, comparison_n, target_n, round(comparison_mean, 6) AS comparison_mean,
  round(target_mean, 6) AS target_mean, round(effect, 6) AS effect, effect_direction, effect_status FROM v_effects""")
def donor_effects(t: Tables):
    return donor_effects_frame(t).select(
        *KEYS, "comparison_n", "target_n", F.round("comparison_mean", 6).alias("comparison_mean"),
        F.round("target_mean", 6).alias("target_mean"), F.round("effect", 6).alias("effect"),
        "effect_direction", "effect_status")


@query("welch_intervals", """
SELECT cohort_id, compartment, module_id, round(effect, 6) AS effect, round(analytic_se, 6) AS analytic_se,
  round(analytic_df, 6) AS analytic_df, round(effect - q * analytic_se, 6) AS analytic_ci_lower,
  round(effect + q * analytic_se, 6) AS analytic_ci_upper, analytic_ci_status
FROM v_welch LEFT JOIN v_tq_welch ON df = analytic_df""")
def welch_intervals(t: Tables):
    return E.welch_interval(donor_effects_frame(t)).select(
        *KEYS, *[F.round(c, 6).alias(c) for c in ("effect", "analytic_se", "analytic_df", "analytic_ci_lower",
                                                 "analytic_ci_upper")], "analytic_ci_status")


view("v_arm_moments", """
    SELECT cohort_id, compartment, module_id, contrast_arm, count(*) AS n, avg(module_score) AS mean,
      stddev_samp(module_score) AS sd, median(module_score) AS median, min(module_score) AS min, max(module_score) AS max,
      min(included_cells) AS min_included_cells, max(included_cells) AS max_included_cells,
      1e0 * median(included_cells) AS median_included_cells, 1e0 * median(total_umi_included_cells) AS median_total_umi
    FROM v_arms GROUP BY ALL""")
V.t_quantiles("v_tq_mean", "n - 1", "v_arm_moments")


@query("group_descriptives", """
SELECT cohort_id, compartment, module_id, contrast_arm, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median,
  round(min, 6) AS min, round(max, 6) AS max, min_included_cells, max_included_cells,
  round(median_included_cells, 6) AS median_included_cells, round(median_total_umi, 6) AS median_total_umi,
  CASE WHEN n < 2 THEN 'not_estimable_group_n_lt_2' WHEN NOT sd > 0 THEN 'not_estimable_zero_or_nonpositive_standard_error'
       ELSE 'available_t' END AS mean_ci_status,
  round(mean - q * sd / sqrt(n), 6) AS mean_ci_lower, round(mean + q * sd / sqrt(n), 6) AS mean_ci_upper
FROM v_arm_moments LEFT JOIN v_tq_mean ON df = n - 1 AND sd > 0""")
def group_descriptives(t: Tables):
    out = E.group_descriptives(t.arms)
    return out.withColumns(r6("mean", "sd", "median", "min", "max", "median_included_cells", "median_total_umi",
                              "mean_ci_lower", "mean_ci_upper"))


def seed_sql(*parts: str) -> str:
    digest = "sha256(concat_ws('|', '20260814', " + ", ".join(parts) + "))"
    return "CAST(('0x' || " + " || ".join(f"substr({digest}, {2 * i + 1}, 2)" for i in range(7, -1, -1)) + ")::UBIGINT AS VARCHAR)"


def mixed(source: str, value: str, out: str) -> str:
    """``source`` with the 32-bit mix of ``value`` as ``out``."""
    return (f"(SELECT * EXCLUDE (_a, _b), xor(_b, _b >> 16) AS {out} FROM (SELECT *, (xor(_a, _a >> 13) * 3266489909) % 4294967296 AS _b "
            f"FROM (SELECT *, (xor({value}, ({value}) >> 16) * 2246822507) % 4294967296 AS _a FROM {source})))")


def bootstrap_views(prefix: str, rows: str, *template: str) -> None:
    """{prefix}: percentile limits of the bootstrap of all contrasts of ``rows`` (arms of up to one block)."""
    view(f"{prefix}_donors", f"""
        SELECT *, dense_rank() OVER (ORDER BY cohort_id, compartment, module_id, contrast_arm) AS arm_no FROM (
          SELECT cohort_id, compartment, module_id, contrast_arm, module_score,
            row_number() OVER (PARTITION BY cohort_id, compartment, module_id, contrast_arm ORDER BY md5(donor_id), donor_id) - 1 AS idx,
            count(*) OVER (PARTITION BY cohort_id, compartment, module_id, contrast_arm) AS n
          FROM {rows})""")
    quoted = [f"'{t}'" for t in template]
    arms = (f"(SELECT DISTINCT cohort_id, compartment, module_id, contrast_arm, arm_no, n::UBIGINT AS n, (CASE contrast_arm WHEN 'target' THEN 1 "
            f"ELSE 2 END)::UBIGINT AS code, {seed_sql(*quoted, 'cohort_id', 'compartment', 'module_id')}::UBIGINT AS seed FROM {prefix}_donors)")
    arms = mixed(mixed(mixed(arms, "code", "m1"), "xor(seed >> 32, m1)", "m2"), "xor(seed & 4294967295, m2)", "base")
    reps = mixed(f"(SELECT r::UBIGINT AS rep FROM range(1, {REPLICATES + 1}) t(r))", "rep", "m3")
    slots = mixed(f"(SELECT j::UBIGINT AS slot FROM range(0, (SELECT max(n) FROM {prefix}_donors)) t(j))", "slot", "m4")
    keyed = mixed(f"(SELECT arm_no, n, rep, base, m3 FROM {arms}, {reps})", "xor(base, m3)", "rep_key")
    drawn = mixed(f"(SELECT arm_no, n, rep, rep_key, m4 FROM {keyed} JOIN {slots} ON slot < n)", "xor(rep_key, m4)", "draw")
    view(f"{prefix}_means", f"""
        SELECT d.arm_no, rep, avg(s.module_score) AS mean
        FROM (SELECT arm_no, rep, (draw * n) >> 32 AS pick FROM {drawn}) d
        JOIN {prefix}_donors s ON s.arm_no = d.arm_no AND s.idx = d.pick GROUP BY ALL""")
    view(prefix, f"""
        SELECT cohort_id, compartment, module_id, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high
        FROM (SELECT cohort_id, compartment, module_id, rep,
                sum(mean) FILTER (WHERE contrast_arm = 'target') - sum(mean) FILTER (WHERE contrast_arm = 'comparison') AS diff
              FROM {prefix}_means JOIN (SELECT DISTINCT cohort_id, compartment, module_id, contrast_arm, arm_no FROM {prefix}_donors) USING (arm_no)
              GROUP BY ALL) GROUP BY ALL""")


bootstrap_views("v_boot", "v_arms")
bootstrap_views("v_isolated_boot", "(SELECT * FROM v_arms WHERE cohort_id = 'EUROPE')", "isolated")


@query("donor_bootstrap", f"""
SELECT m.cohort_id, m.compartment, m.module_id, comparison_n, target_n,
  CASE WHEN target_n < 2 OR comparison_n < 2 THEN 'not_estimable_group_n_lt_2' ELSE 'available_percentile_donor_bootstrap' END AS bootstrap_status,
  CASE WHEN target_n >= 2 AND comparison_n >= 2 THEN round(low, 6) END AS bootstrap_ci_lower,
  CASE WHEN target_n >= 2 AND comparison_n >= 2 THEN round(high, 6) END AS bootstrap_ci_upper,
  {seed_sql('m.cohort_id', 'm.compartment', 'm.module_id')} AS bootstrap_seed
FROM v_moments m LEFT JOIN v_boot b ON b.cohort_id = m.cohort_id AND b.compartment = m.compartment AND b.module_id = m.module_id""")
def donor_bootstrap(t: Tables):
    return E.donor_bootstrap(t.arms, KEYS, REPLICATES).withColumns(r6("bootstrap_ci_lower", "bootstrap_ci_upper"))


view("v_loo", f"""
    SELECT a.cohort_id, a.compartment, a.module_id, a.donor_id AS excluded_donor_id, a.contrast_arm AS excluded_arm,
      count(b.module_score) FILTER (WHERE b.contrast_arm = 'comparison') AS remaining_comparison_n,
      count(b.module_score) FILTER (WHERE b.contrast_arm = 'target') AS remaining_target_n,
      avg(b.module_score) FILTER (WHERE b.contrast_arm = 'target') - avg(b.module_score) FILTER (WHERE b.contrast_arm = 'comparison') AS e
    FROM v_arms a LEFT JOIN v_arms b ON a.cohort_id = b.cohort_id AND a.compartment = b.compartment
      AND a.module_id = b.module_id AND a.donor_id <> b.donor_id
    GROUP BY ALL""")
view("v_loo_rows", f"""
    SELECT l.*, {V.direction('l.e')} AS leave_one_out_direction, f.effect_direction AS full_effect_direction,
      CASE WHEN l.e IS NULL THEN 'not_estimable_one_or_both_remaining_groups_empty'
           ELSE 'available_unweighted_target_minus_comparison_mean_difference' END AS leave_one_out_status
    FROM v_loo l JOIN v_effects f USING (cohort_id, compartment, module_id)""")
view("v_loo_full", """
    SELECT *, CASE WHEN full_effect_direction NOT IN ('not_estimable', 'zero') AND leave_one_out_direction NOT IN ('not_estimable', 'zero')
                   THEN leave_one_out_direction = full_effect_direction END AS direction_agrees FROM v_loo_rows""")


@query("leave_one_out", """
SELECT cohort_id, compartment, module_id, excluded_donor_id, excluded_arm, remaining_comparison_n, remaining_target_n,
  round(e, 6) AS leave_one_out_effect, leave_one_out_direction, full_effect_direction, direction_agrees, leave_one_out_status
FROM v_loo_full""")
def leave_one_out(t: Tables):
    return E.leave_one_out(t.arms).withColumns(r6("leave_one_out_effect"))


@query("direction_retention", """
SELECT cohort_id, compartment, module_id, full_effect_direction, available AS leave_one_out_available,
  directional AS leave_one_out_directional, agreeing AS leave_one_out_agreeing, round(low, 6) AS leave_one_out_min,
  round(high, 6) AS leave_one_out_max,
  CASE WHEN full_effect_direction NOT IN ('not_estimable', 'zero') THEN round(1e0 * agreeing / nullif(directional, 0), 6) END AS direction_retention_fraction,
  CASE WHEN full_effect_direction IN ('not_estimable', 'zero') THEN 'not_assessable_full_effect_zero_or_nonfinite'
       WHEN directional = 0 THEN 'not_assessable_no_nonzero_leave_one_out_effect'
       WHEN 1e0 * agreeing / directional >= 0.8e0 THEN 'direction_retained_at_or_above_0.80'
       ELSE 'direction_retention_below_0.80' END AS stability_status
FROM (SELECT cohort_id, compartment, module_id, full_effect_direction, count(e) AS available, count(direction_agrees) AS directional,
        count(*) FILTER (WHERE direction_agrees) AS agreeing, min(e) AS low, max(e) AS high FROM v_loo_full GROUP BY ALL)""")
def direction_retention(t: Tables):
    out = E.direction_retention(E.leave_one_out(t.arms))
    return out.withColumns(r6("leave_one_out_min", "leave_one_out_max", "direction_retention_fraction"))


view("v_oriented", """
    SELECT *, CASE WHEN cohort_id IN ('ASIA', 'EUROPE') THEN 'lower_grade' ELSE 'higher_grade' END AS severity_orientation,
      'role_' || lower(cohort_id) AS cohort_role, CASE WHEN cohort_id IN ('AFRICA', 'ASIA', 'EUROPE') THEN 'True' ELSE 'False' END AS confirmatory_eligible
    FROM v_effects""")


@query("direction_consistency", """
SELECT module_id, compartment, severity_orientation, n_available, n_positive, n_negative, n_zero,
  round(1e0 * greatest(n_positive, n_negative) / nullif(n_positive + n_negative, 0), 6) AS majority_fraction,
  CASE WHEN n_positive + n_negative < 2 THEN 'not_assessable_fewer_than_two_nonzero_cohort_effects'
       WHEN n_negative = 0 THEN 'positive_higher_target_severity' WHEN n_positive = 0 THEN 'negative_lower_target_severity'
       ELSE 'discordant' END AS consensus_direction,
  CASE WHEN n_positive + n_negative < 2 THEN 'insufficient_cohort_effects_for_direction_alignment'
       WHEN n_negative = 0 OR n_positive = 0 THEN 'available_effects_directionally_aligned'
       ELSE 'available_effects_directionally_discordant' END AS consistency_status, cohort_ids, cohort_effects, cohort_roles, n_eligible,
  CASE WHEN n_eligible < 2 THEN 'not_assessed_fewer_than_two_confirmatory_eligible_independent_validation_contrasts; no_meta_analysis_run'
       ELSE 'not_adjudicated_by_this_script_no_meta_analysis_run' END AS replication_assessment
FROM (SELECT module_id, compartment, severity_orientation, count(*) FILTER (WHERE a) AS n_available,
        count(*) FILTER (WHERE a AND effect_direction LIKE 'positive%') AS n_positive,
        count(*) FILTER (WHERE a AND effect_direction LIKE 'negative%') AS n_negative,
        count(*) FILTER (WHERE a AND effect_direction = 'zero') AS n_zero,
        count(*) FILTER (WHERE a AND confirmatory_eligible = 'True') AS n_eligible,
        coalesce(string_agg(cohort_id, ';' ORDER BY cohort_id) FILTER (WHERE a), '') AS cohort_ids,
        coalesce(string_agg(cohort_role, ';' ORDER BY cohort_id) FILTER (WHERE a), '') AS cohort_roles,
        coalesce(string_agg(cohort_id || '=' || printf('%.6f', effect), ';' ORDER BY cohort_id) FILTER (WHERE a), '') AS cohort_effects
      FROM (SELECT *, effect_status LIKE 'available%' AS a FROM v_oriented) GROUP BY ALL)""")
def direction_consistency(t: Tables):
    cohort = F.col("cohort_id")
    effects = donor_effects_frame(t).withColumns({
        "severity_orientation": F.when(cohort.isin("ASIA", "EUROPE"), F.lit("lower_grade")).otherwise(F.lit("higher_grade")),
        "cohort_role": F.concat(F.lit("role_"), F.lower(cohort)),
        "confirmatory_eligible": F.when(cohort.isin("AFRICA", "ASIA", "EUROPE"), F.lit("True")).otherwise(F.lit("False"))})
    return E.direction_consistency(effects, digits=6).withColumns(r6("majority_fraction"))


@query("ingestion_audit", """
WITH f AS (SELECT *, CASE WHEN score_status <> 'score_available' THEN 'score_status_not_available'
      WHEN mapped_fraction < 0.8e0 THEN 'mapped_fraction_below_threshold' WHEN module_score IS NULL THEN 'nonfinite_score'
      ELSE 'score_available_and_mapping_pass' END AS reason FROM v_scores),
s AS (SELECT DISTINCT cohort_id, c.compartment FROM v_donors CROSS JOIN (VALUES ('AF'), ('NP')) c(compartment))
SELECT s.cohort_id, s.compartment, f.reason, count(*) AS row_count, (SELECT count(*) FROM f) AS raw_rows_loaded,
  (SELECT count(*) FROM f g WHERE g.cohort_id = s.cohort_id) AS rows_matching_dataset,
  (SELECT count(*) FROM f g WHERE g.cohort_id = s.cohort_id AND g.compartment = s.compartment) AS rows_matching_compartment,
  (SELECT count(*) FROM f g WHERE g.cohort_id = s.cohort_id AND g.compartment = s.compartment AND g.severity_group IN ('BUILDING', 'MACHINERY')) AS rows_matching_contrast_groups,
  CASE WHEN f.reason = 'score_available_and_mapping_pass' THEN 'retained' ELSE 'excluded' END AS row_disposition
FROM s JOIN f ON f.cohort_id = s.cohort_id AND f.compartment = s.compartment AND f.severity_group IN ('BUILDING', 'MACHINERY')
GROUP BY s.cohort_id, s.compartment, f.reason""")
def ingestion_audit(t: Tables):
    return E.ingestion_audit(t.module_scores.withColumnRenamed("cohort_id", "dataset"), t.spec)


@query("conflicting_arms", """
SELECT l_linestatus AS cohort_id, l_shipmode AS compartment, donor_id, arms FROM (
  SELECT l_linestatus, 'line' AS l_shipmode, CAST(l_orderkey AS VARCHAR) AS donor_id, count(DISTINCT l_returnflag = 'R') AS arms
  FROM lineitem GROUP BY ALL) WHERE arms > 1""")
def conflicting_arms(t: Tables):
    arms = t.lineitem.select(F.col("l_linestatus").alias("cohort_id"), F.lit("line").alias("compartment"),
                             F.col("l_orderkey").cast("string").alias("donor_id"),
                             X.arm_label(F.col("l_returnflag") == "R", F.lit(False), F.lit(True)).alias("contrast_arm"))
    return E.conflicting_arms(arms)


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS rows_for_key FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""")
def duplicate_keys(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = ["l_orderkey", "l_linenumber"]
    return rows.join(E.duplicate_keys(rows, keys), keys)


@query("ordered_effects", """
SELECT cohort_id, compartment, module_id, round(effect, 6) AS effect,
  CAST(CASE cohort_id WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AFRICA' THEN 3 ELSE 4 END AS BIGINT) AS cohort_id_rank,
  CAST(CASE module_id WHEN 'm3' THEN 1 WHEN 'm1' THEN 2 ELSE 3 END AS BIGINT) AS module_id_rank,
  CAST(target_n AS VARCHAR) || ' vs ' || CAST(comparison_n AS VARCHAR) AS group_sizes
FROM v_effects""")
def ordered_effects(t: Tables):
    ranked = E.order_by_catalog(donor_effects_frame(t), {"cohort_id": ["EUROPE", "ASIA", "AFRICA"],
                                                         "module_id": ["m3", "m1"]})
    return ranked.orderBy("module_id_rank", "cohort_id_rank").select(
        *KEYS, F.round("effect", 6).alias("effect"), "cohort_id_rank", "module_id_rank",
        X.versus_label("target_n", "comparison_n").alias("group_sizes"))


@query("isolated_effects", f"""
SELECT w.cohort_id, w.compartment, w.module_id, round(effect, 6) AS effect, effect_direction,
  round(effect - q * analytic_se, 6) AS analytic_ci_lower, round(effect + q * analytic_se, 6) AS analytic_ci_upper,
  analytic_ci_status, agreeing AS leave_one_out_agreeing, directional AS leave_one_out_directional,
  {seed_sql("'isolated'", 'w.cohort_id', 'w.compartment', 'w.module_id')} AS bootstrap_seed,
  CASE WHEN m.target_n < 2 OR m.comparison_n < 2 THEN 'not_estimable_group_n_lt_2' ELSE 'available_percentile_donor_bootstrap' END AS bootstrap_status,
  CASE WHEN m.target_n >= 2 AND m.comparison_n >= 2 THEN round(low, 6) END AS bootstrap_ci_lower,
  CASE WHEN m.target_n >= 2 AND m.comparison_n >= 2 THEN round(high, 6) END AS bootstrap_ci_upper
FROM v_welch w LEFT JOIN v_tq_welch ON df = analytic_df
JOIN v_moments m ON m.cohort_id = w.cohort_id AND m.compartment = w.compartment AND m.module_id = w.module_id
LEFT JOIN v_isolated_boot b ON b.cohort_id = w.cohort_id AND b.compartment = w.compartment AND b.module_id = w.module_id
JOIN (SELECT cohort_id, compartment, module_id, count(direction_agrees) AS directional,
        count(*) FILTER (WHERE direction_agrees) AS agreeing FROM v_loo_full GROUP BY ALL) r
  ON r.cohort_id = w.cohort_id AND r.compartment = w.compartment AND r.module_id = w.module_id
WHERE w.cohort_id = 'EUROPE'""")
def isolated_effects(t: Tables):
    # Every interval of this cohort, its bootstrap too, comes from a seed of its own.
    arms = settle(t.arms_from(t.module_scores.where(F.col("cohort_id") == "EUROPE")))
    resampled = E.donor_bootstrap(arms, KEYS, REPLICATES, template=("isolated",)).withColumns(
        r6("bootstrap_ci_lower", "bootstrap_ci_upper")).drop("target_n", "comparison_n")
    welch = E.welch_interval(E.mean_difference(E.contrast_moments(arms)))
    kept = E.direction_retention(E.leave_one_out(arms)).select(
        *KEYS, "leave_one_out_agreeing", "leave_one_out_directional")
    return welch.join(kept, KEYS).join(resampled, KEYS).select(
        *KEYS, F.round("effect", 6).alias("effect"), "effect_direction",
        F.round("analytic_ci_lower", 6).alias("analytic_ci_lower"),
        F.round("analytic_ci_upper", 6).alias("analytic_ci_upper"), "analytic_ci_status",
        "leave_one_out_agreeing", "leave_one_out_directional", "bootstrap_seed", "bootstrap_status",
        "bootstrap_ci_lower", "bootstrap_ci_upper")


# ---------------------------------------------------------------- ledgers and sources

@query("union_scores", """
SELECT library_id, module_id, round(module_score, 6) AS module_score,
  CASE WHEN compartment = 'AF' THEN 'score_available' ELSE score_status END AS score_status,
  CASE WHEN compartment = 'AF' THEN 1e0 ELSE round(mapped_fraction, 6) END AS mapped_fraction,
  CASE WHEN compartment <> 'AF' THEN included_cells END AS included_cells FROM v_scores""")
def union_scores(t: Tables):
    scores = t.module_scores
    af = scores.where(F.col("compartment") == "AF").select("library_id", "module_id", "module_score")
    np_ = scores.where(F.col("compartment") != "AF").select(
        "library_id", "module_id", "module_score", "score_status", "mapped_fraction", "included_cells")
    return S.union_sources([af, np_]).withColumns(r6("module_score", "mapped_fraction"))


view("v_ledger", """
    SELECT DISTINCT c.cohort_id, library_id, c.donor_id, compartment,
      CASE WHEN d.c_acctbal < 0 THEN 'UNRESOLVED' ELSE c.severity_group END AS severity_group
    FROM v_cells c JOIN v_donors d USING (donor_id)""")
view("v_crosswalk", """
    SELECT coalesce(s.cohort_id, l.cohort_id) AS cohort_id, count(s.library_id) AS score_keys, count(l.library_id) AS ledger_keys,
      count(*) FILTER (WHERE s.library_id IS NOT NULL AND l.library_id IS NOT NULL) AS matched_keys,
      count(*) FILTER (WHERE l.library_id IS NULL) AS score_table_only_keys,
      count(*) FILTER (WHERE s.library_id IS NULL) AS ledger_only_keys
    FROM (SELECT DISTINCT cohort_id, library_id, donor_id, compartment, severity_group FROM v_scores) s
    FULL JOIN v_ledger l ON s.cohort_id = l.cohort_id AND s.library_id = l.library_id AND s.donor_id = l.donor_id
      AND s.compartment = l.compartment AND s.severity_group = l.severity_group
    GROUP BY 1""")


def ledger(t: Tables):
    """Sample ledger whose group column has another name and an unresolved value."""
    group = F.when(F.col("c_acctbal") < 0, F.lit("UNRESOLVED")).otherwise(F.col("severity_group"))
    donors = t.donors.select("donor_id", group.alias("published_group"))
    return (t.cells.select("cohort_id", "library_id", "donor_id", "compartment")
            .distinct().join(donors, "donor_id"))


def crosswalk(t: Tables):
    renamed = ledger(t).withColumnRenamed("published_group", "severity_group")
    return I.identity_crosswalk(t.library_profiles, renamed, LIBRARY)


@query("identity_crosswalk", """
SELECT *, CASE WHEN score_table_only_keys = 0 AND ledger_only_keys = 0 THEN 'pass_exact_identity_crosswalk'
               ELSE 'fail_identity_crosswalk' END AS crosswalk_status FROM v_crosswalk""")
def identity_crosswalk(t: Tables):
    return crosswalk(t)


@query("cohort_disposition", """
SELECT a.cohort_id, a.ledger_rows, coalesce(c.score_keys, a.ledger_rows) AS keys_after_score,
  CASE WHEN c.cohort_id IS NULL THEN 'separate audit-gated ledger'
       ELSE CASE WHEN score_table_only_keys = 0 AND ledger_only_keys = 0 THEN 'pass_exact_identity_crosswalk' ELSE 'fail_identity_crosswalk' END
            || '; ' || matched_keys || '/' || score_keys || ' matched' END AS identity_check,
  CAST(CASE a.cohort_id WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 3 WHEN 'EUROPE' THEN 4 WHEN 'MIDDLE EAST' THEN 5 ELSE 6 END AS BIGINT) AS cohort_id_rank
FROM (SELECT cohort_id, count(*) AS ledger_rows FROM v_ledger GROUP BY 1) a
LEFT JOIN (SELECT * FROM v_crosswalk WHERE cohort_id <> 'EUROPE') c ON c.cohort_id = a.cohort_id""")
def cohort_disposition(t: Tables):
    availability = ledger(t).groupBy("cohort_id").agg(F.count(F.lit(1)).alias("ledger_rows"))
    table = I.disposition_table(availability, crosswalk(t).where(F.col("cohort_id") != "EUROPE"))
    return E.order_by_catalog(table, {"cohort_id": COHORTS}).select(
        "cohort_id", "ledger_rows", "keys_after_score", "identity_check", "cohort_id_rank")


@query("spec_gate", """
WITH s AS (SELECT cohort_id, compartment, min(severity_group) AS a, max(severity_group) AS b FROM v_cells GROUP BY ALL)
SELECT gate, 'contrast_specification' AS scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'blank_cohort_id' AS gate, count(*) FILTER (WHERE cohort_id IS NULL OR trim(cohort_id) = '') AS violations FROM s
  UNION ALL SELECT 'blank_compartment', count(*) FILTER (WHERE compartment IS NULL OR trim(compartment) = '') FROM s
  UNION ALL SELECT 'blank_comparison_value', count(*) FILTER (WHERE a IS NULL) FROM s
  UNION ALL SELECT 'blank_target_value', count(*) FILTER (WHERE b IS NULL) FROM s
  UNION ALL SELECT 'same_contrast_values', count(*) FILTER (WHERE a = b) FROM s
  UNION ALL SELECT 'invalid_boolean', count(*) FILTER (WHERE lower(cohort_id) NOT IN ('true', 'false') AND compartment = '') FROM s
  UNION ALL SELECT 'duplicate_contrast', (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY cohort_id, compartment HAVING count(*) > 1)))""")
def spec_gate(t: Tables):
    eligible = F.when(F.col("compartment") == "", F.lit("unknown")).otherwise(F.lit("False"))
    spec = t.cells.groupBy("cohort_id", "compartment").agg(
        F.min("severity_group").alias("comparison_value"), F.max("severity_group").alias("target_value")
    ).withColumn("confirmatory_eligible", eligible)
    return G.spec_gate(spec, ["cohort_id", "compartment", "comparison_value", "target_value"], "comparison_value",
                       "target_value", "confirmatory_eligible", ["cohort_id", "compartment"])


@query("ledger_gate", """
WITH l AS (SELECT DISTINCT cohort_id, library_id, compartment, severity_group, donor_id FROM v_cells)
SELECT gate, scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'blank_compartment' AS gate, cohort_id AS scope, count(*) FILTER (WHERE trim(compartment) = '') AS violations FROM l GROUP BY cohort_id
  UNION ALL SELECT 'blank_library_id', cohort_id, count(*) FILTER (WHERE library_id IS NULL OR trim(library_id) = '') FROM l GROUP BY cohort_id
  UNION ALL SELECT 'no_donor_key', cohort_id, count(*) FILTER (WHERE donor_id IS NULL AND library_id IS NULL) FROM l GROUP BY cohort_id)""")
def ledger_gate(t: Tables):
    rows = t.cells.select("cohort_id", "library_id", "compartment", "severity_group", "donor_id").distinct()
    return G.ledger_gate(rows, ["compartment", "library_id"], ["donor_id", "library_id"], F.col("cohort_id"))


@query("ledger_score_agreement", """
WITH s AS (SELECT DISTINCT library_id, included_cells AS a FROM v_scores),
l AS (SELECT library_id, count(*) AS b FROM v_labels GROUP BY 1),
j AS (SELECT s.a, l.b FROM s FULL JOIN l ON s.library_id = l.library_id)
SELECT gate, 'score_ledger' AS scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'library_missing_on_one_side' AS gate, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS violations FROM j
  UNION ALL SELECT 'retained_cell_counts_differ', count(*) FILTER (WHERE a <> b) FROM j
  UNION ALL SELECT 'below_minimum_retained_cells', count(*) FILTER (WHERE b < 2) FROM j)""")
def ledger_score_agreement(t: Tables):
    # Both sides from one pass over the cells: libraries split by the include flag.
    profiles = settle(S.library_profiles(t.annotated, [*LIBRARY, "include"], SYMBOLS))
    scores = S.module_scores(profiles.where("include"), t.platforms, MODULES, LIBRARY, feature_keys=["cohort_id"])
    counts = profiles.groupBy("library_id").agg(F.sum("included_cells").alias("included_cells"))
    return G.ledger_score_agreement(scores, counts, ["library_id"], 2)


# ---------------------------------------------------------------- thresholds

view("v_threshold_scores", """
    SELECT t.threshold, s.* FROM v_scores s JOIN v_thresholds t ON s.included_cells >= t.threshold""")
view("v_threshold_arms", """
    SELECT t.threshold, a.* FROM v_arms a JOIN v_thresholds t ON a.included_cells >= t.threshold""")
view("v_threshold_moments", V.moments("v_threshold_arms", "threshold, cohort_id, compartment, module_id"))
view("v_threshold_effects", V.effects("v_threshold_moments"))
view("v_identity", """
    SELECT t.threshold, count(b.library_id) AS score_rows_reference, count(c.library_id) AS score_rows_current,
      count(*) FILTER (WHERE b.library_id IS NOT NULL AND c.library_id IS NOT NULL) AS matched_score_rows,
      count(*) FILTER (WHERE c.library_id IS NULL) AS reference_only_score_rows,
      count(*) FILTER (WHERE b.library_id IS NULL) AS current_only_score_rows,
      max(abs(b.module_score - c.module_score)) AS delta,
      count(*) FILTER (WHERE b.included_cells <> c.included_cells) AS cells_differ
    FROM v_thresholds t JOIN (
      (SELECT h.threshold AS at, s.* FROM v_threshold_scores s CROSS JOIN v_thresholds h WHERE s.threshold = 2) b
      FULL JOIN v_threshold_scores c ON b.at = c.threshold AND b.library_id = c.library_id AND b.module_id = c.module_id
    ) ON t.threshold = coalesce(b.at, c.threshold)
    GROUP BY t.threshold""")


def threshold_scores(t: Tables):
    scores = t.module_scores
    return S.threshold_table(scores, scores.columns, THRESHOLDS).where("threshold_pass").drop("threshold_pass")


def threshold_identity_frame(t: Tables):
    compared = S.compare_to_reference(threshold_scores(t), ["library_id", "module_id"], "threshold",
                                      REFERENCE_THRESHOLD, ["module_score", "included_cells"], THRESHOLDS)
    return S.score_identity(compared, "threshold")


@query("threshold_eligibility", """
SELECT library_id, compartment, CAST(threshold AS BIGINT) AS threshold, included_cells, included_cells >= threshold AS threshold_pass
FROM v_libraries CROSS JOIN v_thresholds""")
def threshold_eligibility(t: Tables):
    return S.threshold_table(t.library_profiles, ["library_id", "compartment", "included_cells"], THRESHOLDS)


@query("threshold_run_summary", """
SELECT CAST(threshold AS BIGINT) AS threshold, count(*) AS libraries_scored, count(*) FILTER (WHERE included_cells >= threshold) AS libraries_passing,
  count(*) FILTER (WHERE included_cells < threshold) AS libraries_failing, min(included_cells) AS minimum_included_cells,
  CASE WHEN count(*) FILTER (WHERE included_cells < threshold) = 0 THEN 'all_libraries_scored'
       ELSE 'unexpected_below_threshold_library_in_output' END AS threshold_run_status
FROM v_libraries CROSS JOIN v_thresholds GROUP BY threshold""")
def threshold_run_summary(t: Tables):
    return S.threshold_run_summary(S.threshold_table(t.library_profiles, ["library_id", "included_cells"], THRESHOLDS))


@query("threshold_identity", """
SELECT CAST(threshold AS BIGINT) AS threshold, score_rows_reference, score_rows_current, matched_score_rows, reference_only_score_rows,
  current_only_score_rows, round(delta, 6) AS maximum_absolute_score_delta, matched_score_rows > 0 AND cells_differ = 0 AS included_cell_counts_identical,
  CASE WHEN matched_score_rows = score_rows_reference AND matched_score_rows = score_rows_current AND delta = 0 AND cells_differ = 0
       THEN 'identical_score_keys_and_values' ELSE 'different_score_keys_or_values' END AS score_identity_status
FROM v_identity""")
def threshold_identity(t: Tables):
    return threshold_identity_frame(t).withColumns(r6("maximum_absolute_score_delta"))


@query("threshold_effect_stability", """
SELECT CAST(coalesce(b.at, c.threshold) AS BIGINT) AS threshold, coalesce(b.cohort_id, c.cohort_id) AS cohort_id,
  coalesce(b.compartment, c.compartment) AS compartment, coalesce(b.module_id, c.module_id) AS module_id,
  CASE WHEN b.at IS NULL THEN 'right_only' WHEN c.threshold IS NULL THEN 'left_only' ELSE 'both' END AS row_match_status,
  b.comparison_n AS comparison_n_reference, c.comparison_n AS comparison_n_current, b.target_n AS target_n_reference, c.target_n AS target_n_current,
  round(b.effect, 6) AS effect_reference, round(c.effect, 6) AS effect_current, round(c.effect - b.effect, 6) AS effect_delta,
  b.effect_direction AS effect_direction_reference, c.effect_direction AS effect_direction_current,
  b.effect_direction = c.effect_direction AS effect_directions_agree
FROM (SELECT h.threshold AS at, e.* FROM v_threshold_effects e CROSS JOIN v_thresholds h WHERE e.threshold = 2) b
FULL JOIN v_threshold_effects c ON b.at = c.threshold AND b.cohort_id = c.cohort_id AND b.compartment = c.compartment AND b.module_id = c.module_id""")
def threshold_effect_stability(t: Tables):
    arms = t.arms
    by = E.contrast_moments(S.threshold_table(arms, arms.columns, THRESHOLDS).where("threshold_pass"),
                            ["threshold", *KEYS])
    compared = S.compare_to_reference(
        E.mean_difference(by), KEYS, "threshold", REFERENCE_THRESHOLD,
        ["comparison_n", "target_n", "effect", "effect_direction"], THRESHOLDS)
    return S.effect_stability(compared).withColumns(r6("effect_reference", "effect_current", "effect_delta"))


@query("sensitivity_gate", """
SELECT gate, scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'scores_differ_from_reference' AS gate, 'threshold=' || threshold AS scope,
    CAST(CASE WHEN matched_score_rows = score_rows_reference AND matched_score_rows = score_rows_current AND delta = 0 AND cells_differ = 0 THEN 0 ELSE 1 END AS BIGINT) AS violations FROM v_identity
  UNION ALL SELECT 'keys_differ_from_reference', 'threshold=' || threshold, CAST(CASE WHEN reference_only_score_rows > 0 OR current_only_score_rows > 0 THEN 1 ELSE 0 END AS BIGINT) FROM v_identity
  UNION ALL SELECT 'cell_counts_differ_from_reference', 'threshold=' || threshold, CAST(CASE WHEN matched_score_rows > 0 AND cells_differ = 0 THEN 0 ELSE 1 END AS BIGINT) FROM v_identity)""")
def sensitivity_gate(t: Tables):
    return G.sensitivity_gate(threshold_identity_frame(t), "threshold")


@query("grid_completeness", "SELECT c.cohort_id, c.compartment, m.module_id, coalesce(s.n, 0) AS observed_rows, "
       "CASE WHEN s.n IS NULL THEN 'missing' WHEN s.n > 1 THEN 'repeated' ELSE 'present' END AS grid_status "
       "FROM (SELECT DISTINCT cohort_id, compartment FROM v_cells) c CROSS JOIN (SELECT DISTINCT module_id FROM v_modules) m "
       "LEFT JOIN (SELECT cohort_id, compartment, module_id, count(*) AS n FROM v_effects GROUP BY ALL) s "
       "ON s.cohort_id = c.cohort_id AND s.compartment = c.compartment AND s.module_id = m.module_id")
def grid_completeness(t: Tables):
    return I.grid_completeness(donor_effects_frame(t), t.cells, ["cohort_id", "compartment"], list(MODULES), "module_id")

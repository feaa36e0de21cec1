"""Queries: arms, standardised effects, pooled models and their gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.functions import dist
from cohortspark.operators import effects as E
from cohortspark.operators import gates as G
from cohortspark.operators import synthesis as M
from cohortspark.functions.lineage import settle

from . import views as V
from .q_cells import r6
from .q_effects import donor_effects_frame
from .registry import query, view
from .tables import COHORTS, Tables

GROUP = ["module_id", "compartment"]
SCENARIOS = {
    "default_four": COHORTS[:4],
    "expanded_five": COHORTS,
    "replacement": COHORTS[:3] + [COHORTS[4]],
}
MODELS = {
    "smdh_reml": ("smdh", "smdh_variance", "REML"),
    "hedges_reml": ("hedges_g", "hedges_g_variance", "REML"),
    "smdh_pm": ("smdh", "smdh_variance", "PM"),
}
RESULT = ["k", "pooled_effect", "ci_lower", "ci_upper", "test_statistic", "p_value", "tau_squared", "I_squared",
          "Q", "Q_p_value", "prediction_lower", "prediction_upper", "fit_status"]


def wide_frame(t: Tables):
    return M.wide_arms(E.arm_moments(t.arms), E.CONTRAST)


def studies(t: Tables):
    wide = wide_frame(t)
    return settle(M.standardized_effects(wide.where(M.poolable(wide))))


def shown(df, *keys):
    rounded = ("pooled_effect", "ci_lower", "ci_upper", "test_statistic", "p_value", "tau_squared", "I_squared", "Q",
               "Q_p_value", "prediction_lower", "prediction_upper")
    return df.withColumns({n: F.round(n, 5) for n in rounded}).select(*keys, *RESULT)


view("v_wide", """
    SELECT cohort_id, compartment, module_id, CAST(target_n > 0 AS BIGINT) AS target_rows, CAST(comparison_n > 0 AS BIGINT) AS comparison_rows,
      nullif(target_n, 0) AS target_n, target_mean, target_sd, nullif(comparison_n, 0) AS comparison_n, comparison_mean, comparison_sd,
      target_mean - comparison_mean AS raw_difference,
      CASE WHEN target_n > 0 AND comparison_n > 0 THEN 'complete' ELSE 'incomplete_or_repeated_arm' END AS arms_status
    FROM v_moments""")
view("v_studies", """
    SELECT *, 1e0 / n1 + 1e0 / n2 + g * g / (2 * (n1 + n2)) AS g_variance,
      d * d * (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) / (2 * (v1 + v2) * (v1 + v2)) + (v1 / (n1 - 1) + v2 / (n2 - 1)) / ((v1 + v2) / 2) AS d_variance
    FROM (SELECT *, j * raw_difference / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / m) AS g, j * raw_difference / sqrt((v1 + v2) / 2) AS d
          FROM (SELECT *, exp(lgamma(m / 2e0) - lgamma((m - 1) / 2e0)) / sqrt(m / 2e0) AS j
                FROM (SELECT *, target_sd * target_sd AS v1, comparison_sd * comparison_sd AS v2, target_n * 1e0 AS n1, comparison_n * 1e0 AS n2,
                        target_n + comparison_n - 2e0 AS m FROM v_wide
                      WHERE arms_status = 'complete' AND target_n >= 2 AND comparison_n >= 2 AND target_sd > 0 AND comparison_sd > 0)))""")


def pooled_views(name: str, source: str) -> None:
    """Views fitting every group of ``source`` (gkey, method, y, v): REML or Paule-Mandel τ² by
    bisection, Knapp-Hartung interval, Q, I² and prediction interval."""
    def total(expr):
        return f"list_sum(list_transform(s, lambda x: {expr}))"

    def sums(tau):
        w = f"(1e0 / (x.v + {tau}))"
        return (f"{total(w)} AS w, {total(w + ' * x.y')} AS wy, {total(w + ' * ' + w)} AS w2")

    def score(tau):
        w = f"(1e0 / (x.v + {tau}))"
        return (f"CASE WHEN method = 'PM' THEN {total(f'{w} * (x.y - wy / w) * (x.y - wy / w)')} - (k - 1) "
                f"ELSE {total(f'{w} * {w} * (x.y - wy / w) * (x.y - wy / w)')} - (w - w2 / w) END")

    view(f"{name}_groups", f"""
        SELECT *, (SELECT 1e0) AS one, greatest(list_max(list_transform(s, lambda x: x.v)),
                 2e0 * list_sum(list_transform(s, lambda x: (x.y - center) * (x.y - center))) / (k - 1)) AS top
        FROM (SELECT gkey, method, list(struct_pack(y := y, v := v)) AS s, count(*) AS k, avg(y) AS center
              FROM ({source}) GROUP BY gkey, method HAVING count(*) >= 2)""")
    view(f"{name}_seek", f"""(gkey, method, s, k, lo, hi, step)
        SELECT gkey, method, s, k, 0e0, top, 0 FROM {name}_groups
        UNION ALL
        SELECT gkey, method, s, k, CASE WHEN f > 0 THEN mid ELSE lo END, CASE WHEN f > 0 THEN hi ELSE mid END, step + 1
        FROM (SELECT *, {score('mid')} AS f
              FROM (SELECT *, {sums('mid')} FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_seek WHERE step < 90)))""")
    view(f"{name}_tau", f"""
        SELECT z.gkey, z.method, CASE WHEN z.f <= 0 THEN 0e0 ELSE (r.lo + r.hi) / 2 END AS tau2
        FROM (SELECT *, {score('0e0')} AS f FROM (SELECT *, {sums('0e0')} FROM {name}_groups)) z
        JOIN {name}_seek r ON r.gkey = z.gkey AND r.method = z.method AND r.step = 90""")
    w = "(1e0 / (x.v + tau2))"
    view(f"{name}_fit", f"""
        SELECT *, {total('(x.y - wfy / wf) * (x.y - wfy / wf) / x.v')} AS Q, wy / w AS mu, (k - 1) / (wf - wf2 / wf) AS typical,
          sqrt({total(f'{w} * (x.y - wy / w) * (x.y - wy / w)')} / (k - 1) / w) AS se
        FROM (SELECT g.*, tau2, {total(w)} AS w, {total(w + ' * x.y')} AS wy, {total('1e0 / x.v')} AS wf, {total('x.y / x.v')} AS wfy,
                {total('1e0 / (x.v * x.v)')} AS wf2
              FROM {name}_groups g JOIN {name}_tau t ON g.gkey = t.gkey AND g.method = t.method)""")
    V.t_quantiles(f"{name}_tq", "k - 1", f"{name}_fit")
    # Tails by Simpson's rule: t through the angle, chi-square through u = sqrt(x).
    view(name, f"""
        SELECT gkey, method, k, round(mu, 5) AS pooled_effect, round(mu - crit * se, 5) AS ci_lower, round(mu + crit * se, 5) AS ci_upper,
          round(mu / se, 5) AS test_statistic,
          round(1e0 - 2e0 * tc * atan(abs(mu / se) / sqrt(df)) / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
            CASE WHEN i = 0 OR i = 2000 THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END
            * pow(cos(atan(abs(mu / se) / sqrt(df)) * i / 2000), df - 1))), 5) AS p_value,
          round(tau2, 5) AS tau_squared, round(1e2 * tau2 / (tau2 + typical), 5) AS I_squared, round(Q, 5) AS Q,
          round(1e0 - cc * sqrt(Q) / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
            CASE WHEN i = 0 OR i = 2000 THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END
            * 2e0 * pow(sqrt(Q) * i / 2000, df - 1) * exp(-(Q * i * i / 4e6) / 2))), 5) AS Q_p_value,
          round(mu - crit * sqrt(se * se + tau2), 5) AS prediction_lower, round(mu + crit * sqrt(se * se + tau2), 5) AS prediction_upper,
          'available_random_effects' AS fit_status
        FROM (SELECT f.*, t.q AS crit, t.df, exp(lgamma((t.df + 1) / 2e0) - lgamma(t.df / 2e0)) / sqrt(pi()) AS tc,
                1e0 / (pow(2e0, t.df / 2e0) * exp(lgamma(t.df / 2e0))) AS cc
              FROM {name}_fit f JOIN {name}_tq t ON t.df = f.k - 1)""")


SHOWN = ("k, pooled_effect, ci_lower, ci_upper, test_statistic, p_value, tau_squared, I_squared, Q, Q_p_value, "
         "prediction_lower, prediction_upper, fit_status")
BASE_KEY = "module_id || '|' || compartment"
SPLIT = "split_part(gkey, '|', 1) AS module_id, split_part(gkey, '|', 2) AS compartment"
pooled_views("v_pool", f"SELECT {BASE_KEY} AS gkey, 'REML' AS method, d AS y, d_variance AS v FROM v_studies")
pooled_views("v_loso", f"""SELECT a.module_id || '|' || a.compartment || '|' || o.cohort_id AS gkey, 'REML' AS method, a.d AS y, a.d_variance AS v
    FROM v_studies a JOIN v_studies o ON a.module_id = o.module_id AND a.compartment = o.compartment AND a.cohort_id <> o.cohort_id""")
pooled_views("v_models", f"""
    SELECT {BASE_KEY} || '|smdh_reml' AS gkey, 'REML' AS method, d AS y, d_variance AS v FROM v_studies
    UNION ALL SELECT {BASE_KEY} || '|hedges_reml', 'REML', g, g_variance FROM v_studies
    UNION ALL SELECT {BASE_KEY} || '|smdh_pm', 'PM', d, d_variance FROM v_studies""")
pooled_views("v_scenarios", f"""
    SELECT {BASE_KEY} || '|' || n.scenario || '|' || n.size AS gkey, 'REML' AS method, d AS y, d_variance AS v
    FROM v_studies JOIN (SELECT *, count(*) OVER (PARTITION BY scenario) AS size FROM (
      {V.values([(n, c) for n, ids in SCENARIOS.items() for c in ids], 'scenario, member')})) n ON n.member = cohort_id""")


@query("wide_arms", """
SELECT cohort_id, compartment, module_id, target_rows, comparison_rows, target_n, comparison_n, round(target_mean, 6) AS target_mean,
  round(target_sd, 6) AS target_sd, round(comparison_mean, 6) AS comparison_mean, round(comparison_sd, 6) AS comparison_sd,
  round(raw_difference, 6) AS raw_difference, arms_status FROM v_wide""")
def wide_arms(t: Tables):
    return wide_frame(t).withColumns(r6("target_mean", "target_sd", "comparison_mean", "comparison_sd", "raw_difference"))


_ANY = "target_n IS NULL OR comparison_n IS NULL"


@query("arm_gate", f"""
SELECT gate, scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'arm_not_exactly_once' AS gate, cohort_id AS scope, count(*) FILTER (WHERE target_rows <> 1 OR comparison_rows <> 1) AS violations FROM v_wide GROUP BY cohort_id
  UNION ALL SELECT 'arm_n_below_two', cohort_id, count(*) FILTER (WHERE {_ANY} OR target_n < 2 OR comparison_n < 2) FROM v_wide GROUP BY cohort_id
  UNION ALL SELECT 'arm_sd_not_positive', cohort_id, count(*) FILTER (WHERE NOT coalesce(target_sd > 0, FALSE) OR NOT coalesce(comparison_sd > 0, FALSE)) FROM v_wide GROUP BY cohort_id)""")
def arm_gate(t: Tables):
    return G.arm_gate(wide_frame(t), F.col("cohort_id"))


@query("role_gate", """
WITH r AS (SELECT * FROM v_arms)
SELECT gate, scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'confirmatory_eligible_row' AS gate, cohort_id AS scope, CAST(0 AS BIGINT) AS violations FROM r GROUP BY cohort_id
  UNION ALL SELECT 'unexpected_role', cohort_id, CAST(0 AS BIGINT) FROM r GROUP BY cohort_id
  UNION ALL SELECT 'isolated_cohort_in_default', cohort_id, count(*) FILTER (WHERE cohort_id = 'EUROPE') FROM r GROUP BY cohort_id)""")
def role_gate(t: Tables):
    return G.role_gate(t.arms, F.col("cohort_id"), "confirmatory_eligible", "analysis_role", "exploratory",
                       F.col("cohort_id") == "EUROPE")


@query("standardized_effects", """
SELECT cohort_id, compartment, module_id, round(g, 6) AS hedges_g, round(g_variance, 6) AS hedges_g_variance, round(d, 6) AS smdh,
  round(d_variance, 6) AS smdh_variance FROM v_studies""")
def standardized_effects(t: Tables):
    names = ("hedges_g", "hedges_g_variance", "smdh", "smdh_variance")
    return studies(t).select(*E.CONTRAST, *[F.round(n, 6).alias(n) for n in names])


@query("study_intervals", """
SELECT cohort_id, compartment, module_id, round(d, 6) AS smdh, round(sqrt(d_variance), 6) AS standard_error,
  round(d - 1.959963984540054e0 * sqrt(d_variance), 6) AS study_ci_lower, round(d + 1.959963984540054e0 * sqrt(d_variance), 6) AS study_ci_upper
FROM v_studies""")
def study_intervals(t: Tables):
    out = M.study_intervals(studies(t), "smdh", "smdh_variance")
    return out.select(*E.CONTRAST, *[F.round(n, 6).alias(n) for n in (
        "smdh", "standard_error", "study_ci_lower", "study_ci_upper")])


@query("random_effects", f"SELECT {SPLIT}, {SHOWN} FROM v_pool")
def random_effects(t: Tables):
    return shown(M.random_effects(studies(t), GROUP), *GROUP)


@query("leave_one_study_out", f"SELECT {SPLIT}, split_part(gkey, '|', 3) AS omitted, {SHOWN} FROM v_loso")
def leave_one_study_out(t: Tables):
    return shown(M.leave_one_study_out(studies(t), GROUP), *GROUP, "omitted").where(F.col("k") >= 2)


@query("model_sensitivity", f"SELECT {SPLIT}, split_part(gkey, '|', 3) AS model, method AS tau_method, {SHOWN} FROM v_models")
def model_sensitivity(t: Tables):
    return shown(M.model_sensitivity(studies(t), GROUP, MODELS), *GROUP, "model", "tau_method")


@query("scenario_synthesis", f"""
SELECT {SPLIT}, split_part(gkey, '|', 3) AS scenario, CAST(split_part(gkey, '|', 4) AS BIGINT) AS expected_k,
  k = CAST(split_part(gkey, '|', 4) AS BIGINT) AS complete, {SHOWN} FROM v_scenarios""")
def scenario_synthesis(t: Tables):
    return shown(M.scenario_synthesis(studies(t), GROUP, SCENARIOS), *GROUP, "scenario", "expected_k", "complete")


@query("synthesis_package_gate", """
SELECT gate, scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'unexpected_study_count' AS gate, split_part(gkey, '|', 3) AS scope, count(*) FILTER (WHERE k <> 4) AS violations FROM v_scenarios GROUP BY 2
  UNION ALL SELECT 'missing_or_nonfinite_result', split_part(gkey, '|', 3), count(*) FILTER (WHERE pooled_effect IS NULL OR ci_lower IS NULL OR ci_upper IS NULL) FROM v_scenarios GROUP BY 2
  UNION ALL SELECT 'interval_excludes_estimate', split_part(gkey, '|', 3), count(*) FILTER (WHERE NOT pooled_effect BETWEEN ci_lower AND ci_upper) FROM v_scenarios GROUP BY 2)""")
def synthesis_package_gate(t: Tables):
    results = M.scenario_synthesis(studies(t), GROUP, SCENARIOS)
    return G.synthesis_package_gate(results, F.col("scenario"), 4, ["pooled_effect", "ci_lower", "ci_upper"])


view("v_listed", """
    SELECT scenario, cohort_id, row_number() OVER (PARTITION BY scenario ORDER BY cohort_id) AS place,
      CASE WHEN cohort_id = 'EUROPE' THEN 'True' ELSE 'False' END AS confirmatory_eligible
    FROM (SELECT DISTINCT n.scenario, s.cohort_id FROM v_studies s JOIN ({listed}) n ON true)""".format(listed=V.values([(n,) for n in SCENARIOS], "scenario")))


def listed(rows):
    """Every cohort with a study in ``rows``, listed for each scenario by name: more than most scenarios want."""
    cohorts = rows.select("cohort_id").distinct().select("cohort_id", F.explode(F.array(*[F.lit(n) for n in SCENARIOS])).alias("scenario"))
    order = Window.partitionBy("scenario").orderBy("cohort_id")  # a list of cohorts
    return cohorts.select("scenario", "cohort_id", F.row_number().over(order).alias("place"), F.when(
        F.col("cohort_id") == "EUROPE", F.lit("True")).otherwise(F.lit("False")).alias("confirmatory_eligible"))


_WANTED = V.values([(n, c, i) for n, ids in SCENARIOS.items() for i, c in enumerate(ids, 1)], "scenario, member, nth")


@query("scenario_gate", f"""
WITH w AS ({_WANTED}),
c AS (SELECT l.scenario, count(*) FILTER (WHERE w.member IS DISTINCT FROM l.cohort_id) AS off, count(*) FILTER (WHERE w.member = l.cohort_id) AS hits,
        count(*) FILTER (WHERE confirmatory_eligible = 'True') AS eligible
      FROM v_listed l LEFT JOIN w ON w.scenario = l.scenario AND w.nth = l.place GROUP BY 1),
g AS (SELECT c.*, greatest((SELECT count(*) FROM w WHERE w.scenario = c.scenario) - hits, 0) AS missing FROM c)
SELECT gate, scope, violations::BIGINT AS violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'unexpected_study_order' AS gate, scenario AS scope, off AS violations FROM g
  UNION ALL SELECT 'missing_studies', scenario, missing FROM g UNION ALL SELECT 'confirmatory_eligible_study', scenario, eligible FROM g)""")
def scenario_gate(t: Tables):
    return G.scenario_gate(listed(studies(t)), F.col("scenario"), "scenario", SCENARIOS, "place")


@query("synthesis_contract_gate", f"""
WITH w AS ({_WANTED}),
r AS (SELECT DISTINCT split_part(gkey, '|', 1) AS module_id, split_part(gkey, '|', 3) AS scenario FROM v_scenarios),
m AS (SELECT scenario, count(*) FILTER (WHERE module_id NOT IN ('m1', 'm2', 'm3')) + 3 - count(DISTINCT module_id) FILTER (WHERE module_id IN ('m1', 'm2', 'm3')) AS bad,
        count(*) FILTER (WHERE module_id = 'm2') AS model FROM r GROUP BY 1),
s AS (SELECT l.scenario, count(*) FILTER (WHERE w.member IS NULL) + (SELECT count(*) FROM w x WHERE x.scenario = l.scenario) - count(DISTINCT w.member) AS bad,
        count(*) FILTER (WHERE confirmatory_eligible = 'True') AS eligible
      FROM v_listed l LEFT JOIN w ON w.scenario = l.scenario AND w.member = l.cohort_id GROUP BY 1)
SELECT gate, scope, violations::BIGINT AS violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'unexpected_module_set' AS gate, scenario AS scope, bad AS violations FROM m
  UNION ALL SELECT 'unexpected_measure', scenario, 0 FROM m UNION ALL SELECT 'unexpected_model', scenario, model FROM m
  UNION ALL SELECT 'unexpected_cohort_set', scenario, bad FROM s UNION ALL SELECT 'confirmatory_eligible_study', scenario, eligible FROM s)""")
def synthesis_contract_gate(t: Tables):
    rows = studies(t)  # settled once for both readers
    pooled = M.scenario_synthesis(rows, GROUP, SCENARIOS).select("module_id", "scenario").distinct()
    claims = pooled.withColumns({"effect_measure": F.lit("SMDH"), "tau_squared_method": F.when(
        F.col("module_id") == "m2", F.lit("PM")).otherwise(F.lit("REML")), "confidence_interval_method": F.lit("Knapp-Hartung")})
    return G.synthesis_contract_gate(claims, listed(rows), "scenario", ["m1", "m2", "m3"], SCENARIOS, "SMDH",
                                     {"tau_squared_method": "REML", "confidence_interval_method": "Knapp-Hartung"})


view("v_welch_p", """
    SELECT cohort_id, compartment, module_id, round(1e0 - 2e0 * exp(lgamma((analytic_df + 1) / 2) - lgamma(analytic_df / 2)) / sqrt(pi())
        * th / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
          CASE WHEN i = 0 OR i = 2000 THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END * pow(cos(th * i / 2000), analytic_df - 1))), 8) AS p
    FROM (SELECT *, atan(abs(effect / analytic_se) / sqrt(analytic_df)) AS th FROM v_welch WHERE analytic_se IS NOT NULL)""")


@query("bh_adjust", """
SELECT cohort_id, compartment, module_id, round(p, 5) AS p_value, round(least(1e0, min(p * m / rk) OVER (
  PARTITION BY compartment ORDER BY p DESC, rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 5) AS p_adjusted
FROM (SELECT *, row_number() OVER (PARTITION BY compartment ORDER BY p) AS rk, count(*) OVER (PARTITION BY compartment) AS m FROM v_welch_p)""")
def bh_adjust(t: Tables):
    effects = E.welch_interval(donor_effects_frame(t)).where(F.col("analytic_se").isNotNull())
    tested = settle(effects.select(*E.CONTRAST, F.round(dist.t_two_sided_p(
        F.col("effect") / F.col("analytic_se"), F.col("analytic_df")), 8).alias("p_value")))
    out = M.adjust_bh(tested, ["compartment"], "p_value")
    return out.select(*E.CONTRAST, F.round("p_value", 5).alias("p_value"), F.round("p_adjusted", 5).alias("p_adjusted"))

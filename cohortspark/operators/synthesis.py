"""Standardised effects and random-effects synthesis over many groups at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist, tabulated
from ..functions import expr as X
from ..functions.config import literal_array
from ..functions.lineage import settle
from ..functions.scans import PART, range_parts, stitched, sum_over

# Fixed values.
NORMAL_975 = 1.959963984540054
CONFIDENCE = 0.95


def wide_arms(descriptives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per contrast from one row per arm; a conditional aggregate, not a self join."""
    def pick(arm, column):
        return F.max(F.when(F.col("contrast_arm") == arm, F.col(column)))

    aggs = [F.count_if(F.col("contrast_arm") == arm).alias(f"{arm}_rows") for arm in ("target", "comparison")]
    for arm in ("target", "comparison"):
        aggs += [pick(arm, c).alias(f"{arm}_{c}") for c in ("n", "mean", "sd")]
    out = descriptives.groupBy(*keys).agg(*aggs)
    return out.withColumns({
        "raw_difference": F.col("target_mean") - F.col("comparison_mean"),
        "arms_status": F.when((F.col("target_rows") == 1) & (F.col("comparison_rows") == 1),
                              F.lit("complete")).otherwise(F.lit("incomplete_or_repeated_arm"))})


def poolable(wide: DataFrame) -> Column:
    """Both arms present once, n >= 2 and sd > 0."""
    ok = F.col("arms_status") == "complete"
    for arm in ("target", "comparison"):
        ok = ok & (F.col(f"{arm}_n") >= 2) & F.coalesce(X.finite(f"{arm}_sd") > 0, F.lit(False))
    return ok


def standardized_effects(wide: DataFrame) -> DataFrame:
    """Hedges g and the heteroscedastic standardised mean difference, with variances."""
    n1, n2 = F.col("target_n").cast("double"), F.col("comparison_n").cast("double")
    v1, v2 = F.col("target_sd") ** 2, F.col("comparison_sd") ** 2
    m = n1 + n2 - 2
    diff = F.col("target_mean") - F.col("comparison_mean")
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / m)
    average = (v1 + v2) / 2
    out = wide.withColumn("_j", X.small_sample_factor(m))
    out = out.withColumns({"hedges_g": F.col("_j") * diff / pooled,
                           "smdh": F.col("_j") * diff / F.sqrt(average)})
    g, d = F.col("hedges_g"), F.col("smdh")
    return out.withColumns({
        "hedges_g_variance": 1 / n1 + 1 / n2 + g * g / (2 * (n1 + n2)),
        "smdh_variance": d * d * (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) / (2 * (v1 + v2) ** 2)
        + (v1 / (n1 - 1) + v2 / (n2 - 1)) / average,
    }).drop("_j")


def study_intervals(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """Normal interval of each study, for display beside the pooled one."""
    se = F.sqrt(F.col(variance))
    return studies.withColumns({
        "standard_error": se,
        "study_ci_lower": F.col(effect) - F.lit(NORMAL_975) * se,
        "study_ci_upper": F.col(effect) + F.lit(NORMAL_975) * se})


# ---------------------------------------------------------------- pooled model

def _results(rows: DataFrame) -> DataFrame:
    """Pooled results from k, centre, τ² and the weighted sums at τ² (_s) and at zero (_f)."""
    enough = F.col("k") >= 2
    s, f = F.col("_s"), F.col("_f")
    mu, mu_f = s["wy"] / s["w"], f["wy"] / f["w"]
    df = F.when(enough, F.col("k").cast("double") - 1)
    rows = rows.withColumns({
        "pooled_effect": mu + F.col("_center"),
        "_se": F.sqrt(F.greatest((s["wyy"] - mu * s["wy"]) / df, F.lit(0.0)) / s["w"]),
        "degrees_freedom": df,
        "Q": F.greatest(f["wyy"] - mu_f * f["wy"], F.lit(0.0)),
        "_typical": df / (f["w"] - f["w2"] / f["w"]),
    })
    rows = rows.withColumns({
        "test_statistic": F.when(F.col("_se") > 0, F.col("pooled_effect") / F.nullif(F.col("_se"), F.lit(0.0))),
        "_critical": dist.t_quantile(CONFIDENCE, F.col("degrees_freedom")),
        "I_squared": F.lit(100.0) * F.col("tau_squared") / (F.col("tau_squared") + F.col("_typical")),
    })
    half = F.col("_critical") * F.col("_se")
    wide = F.col("_critical") * F.sqrt(F.col("_se") ** 2 + F.col("tau_squared"))
    return rows.withColumns({
        "ci_lower": F.col("pooled_effect") - half, "ci_upper": F.col("pooled_effect") + half,
        "p_value": dist.t_two_sided_p(F.col("test_statistic"), F.col("degrees_freedom")),
        "Q_p_value": dist.chi2_sf(F.col("Q"), F.col("degrees_freedom")),
        "prediction_lower": F.col("pooled_effect") - wide,
        "prediction_upper": F.col("pooled_effect") + wide,
        "fit_status": F.when(enough, F.lit("available_random_effects"))
        .otherwise(F.lit("not_estimable_fewer_than_two_studies")),
    }).drop("_center", "_s", "_f", "_se", "_typical", "_critical")


#: Least ratio of the smallest variance to the largest τ² that is tabulated from its own size.
FLOOR = 2.0 ** -60


def _tabulate(studies: DataFrame, keys: Sequence[str], effect: str, variance: str, more: Sequence[str] = ()) -> tuple[DataFrame, ...]:
    """(raw, facts, table): the rows, one row of facts per group with k >= 2, and the sums per segment of τ².

    One pass with map-side combined sums: every study meets the nodes of its group's segments, some
    hundred however large the group. ``table`` has per group and segment (low, high] the sums at its
    nodes as one array; ``facts`` has those at all segment bounds, at most 61.
    """
    keys = list(keys)
    raw = studies.select(*keys, *more, F.col(effect).cast("double").alias("y"), F.col(variance).cast("double").alias("v"))
    facts = settle(raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.avg("y").alias("_center"), F.var_samp("y").alias("_var"),
        F.max("v").alias("_vmax"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("_vmin")))
    k = F.col("k").cast("double")
    # Certain also when one study is left out, which leaves no larger sum of squares to fewer studies.
    top = F.greatest(F.col("_vmax"), 2 * F.col("_var") * (k - 1) / F.greatest(k - 2, F.lit(1.0)))
    open_ = facts.where("k >= 2").withColumn("_top", top).withColumn("_unit", F.greatest("_vmin", F.col("_top") * FLOOR))
    count = F.greatest(F.lit(1), F.ceil(F.log2(F.col("_top") / F.col("_unit") + 1)).cast("int"))
    segments = open_.select(*keys, "_center", "_unit", F.explode(F.sequence(F.lit(0), count - 1)).alias("_seg"))
    segments = segments.withColumns({"_low": F.col("_unit") * (F.pow(F.lit(2.0), F.col("_seg")) - 1),
                                     "_high": F.col("_unit") * (F.pow(F.lit(2.0), F.col("_seg") + 1) - 1)})
    nodes = segments.select(*keys, "_center", "_seg", "_low", "_high", F.posexplode(F.array(*[F.lit(p) for p in tabulated.points()])).alias(
        "_node", "_place")).withColumn("_t", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_place"))
    rows = raw.select(*keys, "y", "v").join(nodes, keys)
    term = tabulated.terms(F.col("y") - F.col("_center"), F.col("v"), F.col("_t"))
    sums = rows.select(*keys, "_seg", "_low", "_high", "_node", term.alias("_s")).groupBy(*keys, "_seg", "_low", "_high", "_node").agg(
        *[F.sum(f"_s.{n}").alias(n) for n in tabulated.SUMS])
    node = F.struct("_node", F.array(*tabulated.SUMS).alias("s"))
    table = settle(sums.groupBy(*keys, "_seg", "_low", "_high").agg(F.array_sort(F.collect_list(node)).alias("_n")).select(
        *keys, "_seg", "_low", "_high", F.flatten(F.transform("_n", lambda n: n["s"])).alias("_table")))

    def node_sums(at: int) -> Column:
        return F.struct(*[F.get("_table", F.lit(at * len(tabulated.SUMS) + i)).alias(n) for i, n in enumerate(tabulated.SUMS)])

    bounds = table.select(*keys, F.struct("_seg", F.col("_high").alias("t"), node_sums(tabulated.NODES).alias("s")).alias("_b"),
                          F.when(F.col("_seg") == 0, node_sums(0)).alias("_zero")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_b")).alias("_bounds"), F.max("_zero").alias("_zero"))
    return raw, facts.join(bounds, keys, "left"), table


def _solved(rows: DataFrame, table: DataFrame, keys: Sequence[str], method: Column) -> DataFrame:
    """Root and sums of rows (keys, k, _bounds, _zero, _ys, _vs: what the row leaves out), and the pooled results."""
    keys = list(keys)
    kd, pm = F.col("k").cast("double"), F.col("_pm")

    def without(s: Column, t: Column) -> Column:
        """The sums less the row's own terms."""
        pairs = F.arrays_zip(F.col("_ys").alias("y"), F.col("_vs").alias("v"))
        return F.aggregate(pairs, s, lambda acc, p: F.struct(*[
            (acc[n] - tabulated.terms(p["y"], p["v"], t)[n]).alias(n) for n in tabulated.SUMS]))

    rows = rows.withColumn("_pm", method == "PM").withColumn("_f", without(F.col("_zero"), F.lit(0.0)))
    falls = F.filter("_bounds", lambda b: tabulated.column_score(without(b["s"], b["t"]), kd, pm) <= 0)
    first = F.coalesce(F.get(falls, F.lit(0))["_seg"], F.element_at("_bounds", -1)["_seg"])
    fit = F.col("k") >= 2
    rows = rows.withColumns({"_in": F.when(fit, F.coalesce(first, F.lit(0))),
                             "_at_zero": tabulated.column_score(F.col("_f"), kd, pm) <= 0}).drop("_bounds", "_zero")
    rows = rows.withColumn("_in", F.when(F.col("_at_zero") & fit, F.lit(0)).otherwise(F.col("_in")))
    segment = table.select(*keys, F.col("_seg").alias("_in"), "_low", "_high", "_table")
    rows = rows.join(segment, [*keys, "_in"], "left")
    high = F.when(F.col("_at_zero"), F.col("_low")).otherwise(F.col("_high"))
    rows = rows.withColumn("_r", tabulated.root("_table", "_low", high, kd, "_pm", "_ys", "_vs"))
    rows = rows.withColumn("tau_squared", F.when(fit, F.col("_r.t"))).withColumn(
        "_s", F.when(fit, F.struct(*[F.col(f"_r.{n}").alias(n) for n in tabulated.SUMS]))).withColumn("_f", F.when(fit, F.col("_f")))
    return _results(rows.drop("_in", "_at_zero", "_low", "_high", "_table", "_r", "_pm", "_ys", "_vs", "_var", "_vmax", "_vmin"))


def _nothing() -> dict[str, Column]:
    return {c: F.array().cast("array<double>") for c in ("_ys", "_vs")}


def random_effects(studies: DataFrame, keys: Sequence[str], effect: str = "smdh",
                   variance: str = "smdh_variance", method: Column | str = "REML") -> DataFrame:
    """The pooled model per group, of any size; study rows are never collected.

    ``method`` may be a Column of the keys. The sums that the estimating function needs are tabulated as
    functions of τ² in one pass over the rows; the root is then found on the table, one row per group.
    """
    _, facts, table = _tabulate(studies, keys, effect, variance)
    return _solved(facts.withColumns(_nothing()), table, keys, F.lit(method) if isinstance(method, str) else method)


def leave_one_study_out(studies: DataFrame, keys: Sequence[str], effect: str = "smdh",
                        variance: str = "smdh_variance", method: str = "REML",
                        study: str = "cohort_id") -> DataFrame:
    """The pooled model with each study omitted: one row per (group, omitted study).

    All fits of a group share one table of its sums; a fit subtracts its own study's terms, so the work is
    linear in the studies and no row holds more than its own. A study on several rows is omitted whole.
    """
    keys = list(keys)
    raw, facts, table = _tabulate(studies, keys, effect, variance, [study])
    own = raw.join(facts.select(*keys, "_center"), keys).groupBy(*keys, F.col(study).alias("omitted")).agg(
        F.collect_list(F.col("y") - F.col("_center")).alias("_ys"), F.collect_list("v").alias("_vs"))
    rows = own.join(facts, keys).withColumn("k", F.col("k") - F.size("_ys"))
    return _solved(rows, table, keys, F.lit(method))


def model_sensitivity(studies: DataFrame, keys: Sequence[str],
                      models: Mapping[str, tuple[str, str, str]], study: str = "cohort_id") -> DataFrame:
    """Several models (name -> effect, variance, τ² method) over the same studies, fitted once."""
    variants = F.array(*[F.struct(F.lit(name).alias("model"), F.lit(method).alias("tau_method"),
                                  F.col(e).alias("_y"), F.col(v).alias("_v"))
                         for name, (e, v, method) in models.items()])
    rows = studies.select(*keys, study, F.inline(variants))
    return random_effects(rows, [*keys, "model", "tau_method"], "_y", "_v", F.col("tau_method"))


def scenario_synthesis(studies: DataFrame, keys: Sequence[str], scenarios: Mapping[str, Sequence[str]],
                       effect: str = "smdh", variance: str = "smdh_variance", method: str = "REML",
                       study: str = "cohort_id") -> DataFrame:
    """The pooled model for each named study list; ``complete`` tells if its studies are exactly those of the list."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), literal_array(ids).alias("_ids"),
                               F.lit(len(ids)).cast("long").alias("expected_k")) for n, ids in scenarios.items()])
    rows = (studies.select(*keys, study, effect, variance, F.inline(table))
            .where(F.array_contains("_ids", F.col(study))))
    group = [*keys, "scenario", "expected_k"]
    present = rows.groupBy(*group).agg(F.count_distinct(study).alias("_present"))
    return (random_effects(rows, group, effect, variance, method).join(present, group)
            .withColumn("complete", (F.col("_present") == F.col("expected_k")) & (F.col("k") == F.col("expected_k"))).drop("_present"))


def adjust_bh(rows: DataFrame, family: Sequence[str], p_value: str, out: str = "p_adjusted", parts: int | None = None) -> DataFrame:
    """Benjamini-Hochberg adjustment inside each family.

    Equal p-values share the largest rank of their tie, so the test works on distinct values. These
    are cut into ranges of about equal size by sampled quantiles of (family, p), so a family whose
    p-values all lie close together is spread like any other. Ranks are counted inside a range and
    stitched from below, the running minimum from above.
    """
    family = list(family)
    distinct = rows.where(F.col(p_value).isNotNull()).groupBy(*family, F.col(p_value).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    ranges = range_parts(distinct, family, "_p", parts)
    sizes = ranges.groupBy(*family).agg(F.sum("_c").alias("_m"))
    ranked = sum_over(ranges, family, "_p", F.col("_c"), "_rank")
    same = F.lit(True)
    for f in family:
        same = same & F.col(f).eqNullSafe(F.col(f"_size_{f}"))
    sizes = sizes.select(*[F.col(f).alias(f"_size_{f}") for f in family], "_m")
    raw = ranked.join(sizes, same).select(PART, *family, "_p", (F.col("_p") * F.col("_m") / F.col("_rank")).alias("_raw"))
    adjusted = stitched(raw, family, "_p", F.min("_raw"), F.min("_raw"), F.min("_whole"),
                        lambda local, carried: F.least(local, F.coalesce(carried, F.lit(1.0)), F.lit(1.0)), out, falling=True)
    back = F.col("_p") == F.col(p_value)
    for f in family:
        back = back & F.col(f).eqNullSafe(F.col(f"_of_{f}"))
    adjusted = adjusted.select(*[F.col(f).alias(f"_of_{f}") for f in family], "_p", out)
    return rows.join(adjusted, back, "left").drop("_p", *[f"_of_{f}" for f in family])

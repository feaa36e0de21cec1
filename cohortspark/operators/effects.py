"""Donor-level contrasts: arms, descriptives, intervals, bootstrap, leave-one-out, alignment.

The unit is the donor or library.  Group totals are aggregates joined back to the rows, not
windows over the group, so a contrast with very many donors is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions import expr as X
from ..functions.lineage import evaluate_once, settle, spread
from ..functions.quantiles import group_percentiles
from ..functions.scans import hashed_index

# Statuses and settings of the result contract.
EFFECT_AVAILABLE = "available_unweighted_target_minus_comparison_mean_difference"
EFFECT_EMPTY = "not_estimable_one_or_both_contrast_groups_empty"
LOO_EMPTY = "not_estimable_one_or_both_remaining_groups_empty"
SMALL_GROUP = "not_estimable_group_n_lt_2"
NONFINITE_VARIANCE = "not_estimable_nonfinite_variance"
NONFINITE_SD = "not_estimable_nonfinite_sd"
ZERO_SE = "not_estimable_zero_or_nonpositive_standard_error"
NO_DF = "not_estimable_welch_df"
NO_CRITICAL = "not_estimable_welch_critical_value"
NOT_ASSESSED = "not_assessed_fewer_than_two_confirmatory_eligible_independent_validation_contrasts; no_meta_analysis_run"
NOT_ADJUDICATED = "not_adjudicated_by_this_script_no_meta_analysis_run"
CONFIDENCE = 0.95
SEED = 20260814
REPLICATES = 10_000
STABLE_RETENTION = 0.80

CONTRAST = ["cohort_id", "compartment", "module_id"]


def assign_arms(scores: DataFrame, spec: DataFrame, dataset: str = "dataset",
                group: str = "severity_group",
                minimum_mapped: float = 0.80) -> DataFrame:
    """Score rows ⋈ contrast specification, each with its arm, disposition and reason.

    ``spec`` rows carry ``cohort_id, dataset, compartment, comparison_value, target_value``
    (one row per dataset value) and are configuration, hence broadcast.  Rows outside the
    two groups are kept with a NULL arm for the funnel counts.
    """
    score = X.finite(F.col("module_score").cast("double"))
    rows = scores.join(F.broadcast(spec), [dataset, "compartment"])
    reason = X.first_reason(
        (~F.col("score_status").eqNullSafe("score_available"), "score_status_not_available"),
        (~F.coalesce(F.col("mapped_fraction") >= minimum_mapped, F.lit(False)),
         "mapped_fraction_below_threshold"),
        (score.isNull(), "nonfinite_score"), none="score_available_and_mapping_pass")
    return rows.withColumns({
        "contrast_arm": X.arm_label(group, "comparison_value", "target_value"),
        "reason": reason,
        "module_score": score,
    }).withColumn("row_disposition", F.when(
        F.col("reason") == "score_available_and_mapping_pass", F.lit("retained")).otherwise(F.lit("excluded")))


def retained_arms(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("contrast_arm").isNotNull() & (F.col("row_disposition") == "retained"))


def ingestion_audit(scores: DataFrame, spec: DataFrame, dataset: str = "dataset",
                    group: str = "severity_group", minimum_mapped: float = 0.80) -> DataFrame:
    """Filter funnel and row counts per disposition, one row per contrast and reason.

    One pass: rows are counted per (dataset, compartment, group, reason) before the join, so
    the specification only meets the small count table, which is settled for its three readers.
    """
    reason = X.first_reason(
        (~F.col("score_status").eqNullSafe("score_available"), "score_status_not_available"),
        (~F.coalesce(F.col("mapped_fraction") >= minimum_mapped, F.lit(False)),
         "mapped_fraction_below_threshold"),
        (X.finite(F.col("module_score").cast("double")).isNull(), "nonfinite_score"),
        none="score_available_and_mapping_pass")
    counted = settle(scores.groupBy(F.col(dataset).alias("_d"), F.col("compartment").alias("_c"),
                                    F.col(group).alias("_g"), reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("_n")))
    per_contrast = (counted.join(F.broadcast(spec), counted["_d"] == spec[dataset])
                    .withColumn("_in_c", F.col("_c") == F.col("compartment"))
                    .withColumn("_in_g", F.col("_in_c") & F.col("_g").isin(F.col("comparison_value"),
                                                                          F.col("target_value"))))
    keys = ["cohort_id", "compartment"]
    funnel = per_contrast.groupBy(*keys).agg(
        F.sum("_n").alias("rows_matching_dataset"),
        F.sum(F.when(F.col("_in_c"), F.col("_n")).otherwise(0)).alias("rows_matching_compartment"),
        F.sum(F.when(F.col("_in_g"), F.col("_n")).otherwise(0)).alias("rows_matching_contrast_groups"))
    reasons = (per_contrast.where("_in_g").groupBy(*keys, "reason")
               .agg(F.sum("_n").alias("row_count")))
    return reasons.join(funnel, keys).withColumns({
        "raw_rows_loaded": counted.agg(F.sum("_n")).scalar(),
        "row_disposition": F.when(F.col("reason") == "score_available_and_mapping_pass", F.lit("retained"))
        .otherwise(F.lit("excluded"))})


def conflicting_arms(arms: DataFrame) -> DataFrame:
    """Donors that appear in both arms of one cohort and compartment."""
    keys = ["cohort_id", "compartment", "donor_id"]
    return (arms.groupBy(*keys).agg(F.count_distinct("contrast_arm").alias("arms"))
            .where(F.col("arms") > 1))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys met more than once with their row counts (map-side combined, no window)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_for_key")).where(F.col("rows_for_key") > 1)


# ---------------------------------------------------------------- moments and intervals

def group_descriptives(arms: DataFrame, keys: Sequence[str] = tuple(CONTRAST + ["contrast_arm"]),
                       confidence: float = CONFIDENCE) -> DataFrame:
    """n, mean, sd, median, range and t interval per arm, with cell and total medians."""
    keys = list(keys)
    arms = settle(arms.select(*keys, "module_score", "included_cells", "total_umi_included_cells"))
    moments = arms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("module_score").alias("mean"),
        F.stddev_samp("module_score").alias("sd"),
        F.min("module_score").alias("min"), F.max("module_score").alias("max"),
        F.min("included_cells").alias("min_included_cells"),
        F.max("included_cells").alias("max_included_cells"))
    metric = F.array(*[F.struct(F.lit(m).alias("_metric"), F.col(c).cast("double").alias("_value"))
                       for m, c in (("score", "module_score"), ("cells", "included_cells"),
                                    ("total", "total_umi_included_cells"))])
    medians = group_percentiles(arms.select(*keys, F.inline(metric)), keys + ["_metric"], "_value",
                                {"_median": 0.5})
    wide = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("_metric") == "score", F.col("_median"))).alias("median"),
        F.max(F.when(F.col("_metric") == "cells", F.col("_median"))).alias("median_included_cells"),
        F.max(F.when(F.col("_metric") == "total", F.col("_median"))).alias("median_total_umi"))
    return mean_interval(moments.join(wide, keys, "left"), confidence)


def arm_moments(arms: DataFrame, keys: Sequence[str] = tuple(CONTRAST)) -> DataFrame:
    """n, mean and sd per contrast arm, the input of the synthesis."""
    return arms.groupBy(*keys, "contrast_arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("module_score").alias("mean"),
        F.stddev_samp("module_score").alias("sd"))


def mean_interval(moments: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """mean ± t(n-1)·sd/√n with a status for every way it can be missing."""
    se = F.col("sd") / F.sqrt("n")
    status = (F.when(F.col("n") < 2, F.lit(SMALL_GROUP))
              .when(X.finite("sd").isNull(), F.lit(NONFINITE_SD))
              .when(~(se > 0), F.lit(ZERO_SE)).otherwise(F.lit("available_t")))
    out = moments.withColumn("mean_ci_status", status)
    ok = F.col("mean_ci_status") == "available_t"
    out = out.withColumn("_half", dist.t_quantile(
        confidence, F.when(ok, F.col("n") - 1).cast("double")) * se)
    return out.withColumns({
        "mean_ci_lower": F.when(ok, F.col("mean") - F.col("_half")),
        "mean_ci_upper": F.when(ok, F.col("mean") + F.col("_half"))}).drop("_half")


def contrast_moments(arms: DataFrame, keys: Sequence[str] = tuple(CONTRAST)) -> DataFrame:
    """Both arms of each contrast in one row: n, sum, mean, variance, sd."""
    aggs = []
    for arm in ("comparison", "target"):
        value = F.when(F.col("contrast_arm") == arm, F.col("module_score"))
        aggs += [F.count(value).alias(f"{arm}_n"), F.sum(value).alias(f"{arm}_sum"),
                 F.avg(value).alias(f"{arm}_mean"), F.var_samp(value).alias(f"{arm}_var")]
    return arms.groupBy(*keys).agg(*aggs).withColumns(
        {f"{arm}_sd": F.sqrt(f"{arm}_var") for arm in ("comparison", "target")})


def mean_difference(moments: DataFrame) -> DataFrame:
    """Unweighted mean(target) - mean(comparison), direction and status."""
    effect = F.col("target_mean") - F.col("comparison_mean")
    empty = (F.col("target_n") == 0) | (F.col("comparison_n") == 0)
    return moments.withColumns({
        "effect": F.when(~empty, effect),
        "effect_status": F.when(empty, F.lit(EFFECT_EMPTY)).otherwise(F.lit(EFFECT_AVAILABLE)),
    }).withColumn("effect_direction", X.effect_direction("effect"))


def welch_interval(effects: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Welch standard error, Satterthwaite df and interval with the failure statuses."""
    nt, nc = F.col("target_n"), F.col("comparison_n")
    vt, vc = F.col("target_var"), F.col("comparison_var")
    out = evaluate_once(effects, {
        "_se_sq": vt / F.nullif(nt, F.lit(0)) + vc / F.nullif(nc, F.lit(0)),
        "_denominator": F.try_divide(vt * vt, nt * nt * (nt - 1)) + F.try_divide(vc * vc, nc * nc * (nc - 1))})
    se_sq = F.col("_se_sq")
    out = evaluate_once(out, {"_df": X.finite(F.try_divide(se_sq * se_sq, F.col("_denominator")))})
    status = (F.when((nt < 2) | (nc < 2), F.lit(SMALL_GROUP))
              .when(X.finite(vt).isNull() | X.finite(vc).isNull(), F.lit(NONFINITE_VARIANCE))
              .when(~F.coalesce(X.finite(se_sq) > 0, F.lit(False)), F.lit(ZERO_SE))
              .when(~F.coalesce(F.col("_df") > 0, F.lit(False)), F.lit(NO_DF))
              .otherwise(F.lit("available_welch_t")))
    out = evaluate_once(out, {"_status": status})
    ok = F.col("_status") == "available_welch_t"
    out = out.withColumns({"analytic_se": F.when(ok, F.sqrt(se_sq)), "analytic_df": F.when(ok, F.col("_df"))})
    out = out.withColumn("_critical", dist.t_quantile(confidence, F.col("analytic_df")))
    found = F.col("_critical").isNotNull()
    half = F.col("_critical") * F.col("analytic_se")
    return out.withColumns({
        "analytic_ci_lower": F.col("effect") - half,
        "analytic_ci_upper": F.col("effect") + half,
        "analytic_ci_status": F.when(ok & ~found, F.lit(NO_CRITICAL)).otherwise(F.col("_status")),
        "analytic_se": F.when(found, F.col("analytic_se")),
        "analytic_df": F.when(found, F.col("analytic_df")),
    }).drop("_status", "_critical", "_se_sq", "_denominator", "_df")


# ---------------------------------------------------------------- bootstrap

def _bootstrap_status(effects: DataFrame, replicates: int) -> Column:
    small = (F.col("target_n") < 2) | (F.col("comparison_n") < 2)
    return (F.when(small, F.lit(SMALL_GROUP))
            .when(F.lit(replicates < 1), F.lit("not_run_n_bootstrap_lt_1"))
            .otherwise(F.lit("available_percentile_donor_bootstrap")))


#: Donors of a block; an arm of more is resampled block by block.
BLOCK = 4_096
#: Draws held at a time: few enough for a processor's cache.
DRAWS = 1 << 16


def _mix32(x):
    """A permutation of 32-bit numbers that scatters neighbours."""
    import numpy as np

    x = np.array(x, dtype=np.uint32)
    part = np.empty_like(x)
    with np.errstate(over="ignore"):
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(x, np.uint32(shift), out=part)
            np.bitwise_xor(x, part, out=x)
            if factor:
                np.multiply(x, np.uint32(factor), out=x)
    return x


def block_slots(seed: int, arm: int, n: int, block: int, replicates: int, size: int):
    """How many of the n draws of each replicate fall on donors of ``block``.

    The multinomial over blocks is taken apart into binomials along a binary tree. Every block draws
    the same numbers at the nodes it passes, so the blocks of an arm agree without meeting.
    """
    import numpy as np

    counts = np.full(replicates, n, dtype=np.int64)
    low, high = 0, -(-n // size)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * size / (min(high * size, n) - low * size)
        left = np.random.default_rng([seed, arm, low, high]).binomial(counts, share)
        counts, low, high = (left, low, middle) if block < middle else (counts - left, middle, high)
    return counts


def block_sums(scores, seed: int, arm: int, n: int, block: int, replicates: int, size: int = BLOCK):
    """Sum of the scores drawn from one block, for each replicate.

    Slot j of replicate r draws donor ``hash(seed, arm, block, r, j) * donors >> 32``: a counter-based
    generator, so a retried task draws the same donors.
    """
    import numpy as np

    scores = np.asarray(scores, dtype=float)
    counts = block_slots(seed, arm, n, block, replicates, size)
    base = _mix32((seed & 0xFFFFFFFF) ^ int(_mix32((seed >> 32) ^ int(_mix32(2 * block + arm)))))
    keys = base ^ _mix32(np.arange(1, replicates + 1))
    keys, slots = _mix32(keys), _mix32(np.arange(int(counts.max(initial=0))))
    sums = np.zeros(replicates)
    # A row per replicate, as wide as the largest count; only the columns that some replicates lack are masked.
    step = max(1, DRAWS // max(len(slots), 1))
    for at in range(0, replicates, step):
        taken = counts[at:at + step]
        least, most = int(taken.min()), int(taken.max())
        picks = _mix32(keys[at:at + step, None] ^ slots[:most]).astype(np.uint64)
        picks *= np.uint64(len(scores))
        picks >>= np.uint64(32)
        drawn = scores[picks.view(np.int64)]
        if least < most:
            drawn[:, least:][np.arange(least, most) >= taken[:, None]] = 0.0
        sums[at:at + step] = drawn.sum(axis=1)
    return sums


def donor_bootstrap(arms: DataFrame, keys: Sequence[str] = tuple(CONTRAST),
                    replicates: int = REPLICATES, seed: int = SEED, confidence: float = CONFIDENCE,
                    template: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Percentile interval of the donor bootstrap; ``bootstrap_seed`` drives all draws.

    The donors of an arm are dealt to blocks of at most ``block``. A block draws its own share of each
    replicate and returns one sum per replicate; those are added over blocks, so the shuffle carries
    ``replicates`` numbers a block, however many donors and draws there are. Results depend neither on
    partitioning nor on retries.
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keys = list(keys)
    arm_keys = keys + ["contrast_arm"]
    arms = settle(arms.select(*arm_keys, "donor_id", "module_score"))
    donors = settle(hashed_index(arms, arm_keys, "donor_id", "_index"))
    sizes = donors.groupBy(*arm_keys).agg(F.count(F.lit(1)).alias("_n"))
    moments = contrast_moments(arms, keys).withColumn("bootstrap_status", _bootstrap_status(arms, replicates)).withColumn(
        "bootstrap_seed", X.stable_seed(seed, *keys, template=template))
    ready = moments.where(F.col("bootstrap_status").startswith("available")).select(*keys, "bootstrap_seed")
    # At most ``block`` scores in a row.
    packed = (donors.withColumn("_block", F.floor(F.col("_index") / block)).groupBy(*arm_keys, "_block")
              .agg(F.array_sort(F.collect_list(F.struct("_index", F.col("module_score").cast("double").alias("s")))).alias("_d"))
              .join(sizes, arm_keys).join(ready, keys)
              .select(*arm_keys, "_n", "_block", "bootstrap_seed", F.transform("_d", lambda d: d["s"]).alias("_scores")))
    packed = spread(packed, *arm_keys, "_block")

    def resample(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, at, text, scores, arm = (row.column(c)[0].as_py() for c in ("_n", "_block", "bootstrap_seed", "_scores", "contrast_arm"))
                sums = block_sums(scores, int(text), 1 if arm == "target" else 2, n, at, replicates, block)
                yield pa.RecordBatch.from_arrays([*row.select([*arm_keys, "_n"]).columns, pa.array([sums.tolist()])],
                                                 names=[*arm_keys, "_n", "_sums"])

    types = dict(packed.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in [*arm_keys, "_n"])
    drawn = packed.mapInArrow(resample, f"{fields}, _sums array<double>").select(*arm_keys, "_n", F.posexplode("_sums").alias("_rep", "_sum"))
    part = F.col("_sum") / F.col("_n")
    means = drawn.groupBy(*keys, "_rep").agg(
        F.sum(F.when(F.col("contrast_arm") == "target", part).otherwise(-part)).alias("_diff"))
    tail = (1.0 - confidence) / 2.0
    # Bounded by the number of replicates, so the built-in percentile is safe here.
    limits = means.groupBy(*keys).agg(F.percentile("_diff", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("_q"))
    return (moments.select(*keys, "comparison_n", "target_n", "bootstrap_status", "bootstrap_seed").join(limits, keys, "left")
            .withColumns({"bootstrap_ci_lower": F.col("_q")[0], "bootstrap_ci_upper": F.col("_q")[1]})
            .select(*keys, "comparison_n", "target_n", "bootstrap_status", "bootstrap_ci_lower", "bootstrap_ci_upper",
                    "bootstrap_seed"))


def donor_bootstrap_parity(arms: DataFrame, order: str, keys: Sequence[str] = tuple(CONTRAST),
                           replicates: int = REPLICATES, seed_column: str = "bootstrap_seed",
                           confidence: float = CONFIDENCE, max_donors: int = 100_000) -> DataFrame:
    """Bit-for-bit interval of numpy's PCG64 generator, for comparing with published tables.

    Donors must be in file order (``order``); the target arm is drawn first.  A contrast is
    one group here, so this mode refuses contrasts above ``max_donors``; use
    ``donor_bootstrap`` for those.
    """
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keys = list(keys)
    tail = (1.0 - confidence) / 2.0
    guarded = arms.join(
        arms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), keys).withColumn(
        "_size", F.when(F.col("_size") > max_donors,
                        F.raise_error(F.lit("contrast too large for the parity bootstrap")).cast("long"))
        .otherwise(F.col("_size")))
    schema = ", ".join([f"{k} string" for k in keys]
                       + ["bootstrap_ci_lower double", "bootstrap_ci_upper double", "bootstrap_status string"])

    def resample(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(order)
        target = pdf.loc[pdf.contrast_arm == "target", "module_score"].to_numpy(float)
        comparison = pdf.loc[pdf.contrast_arm == "comparison", "module_score"].to_numpy(float)
        lower = upper = None
        status = SMALL_GROUP
        if min(len(target), len(comparison)) >= 2:
            rng = np.random.default_rng(int(pdf[seed_column].iloc[0]))
            means = [rng.choice(v, size=(replicates, len(v)), replace=True).mean(axis=1)
                     for v in (target, comparison)]
            lower, upper = map(float, np.quantile(means[0] - means[1], [tail, 1.0 - tail]))
            status = "available_percentile_donor_bootstrap"
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), lower, upper, status]],
                            columns=[*keys, "bootstrap_ci_lower", "bootstrap_ci_upper", "bootstrap_status"])

    return (guarded.select(*keys, "contrast_arm", "module_score", order, seed_column, "_size")
            .groupBy(*keys).applyInPandas(resample, schema))


# ---------------------------------------------------------------- leave one out

def leave_one_out(arms: DataFrame, keys: Sequence[str] = tuple(CONTRAST)) -> DataFrame:
    """Effect without each donor, by subtracting its rows from its arm's sum: linear in the rows.

    A donor on several rows of an arm is one exclusion that removes them all.
    """
    keys = list(keys)
    arms = settle(arms.select(*keys, "donor_id", "contrast_arm", "module_score"))
    full = mean_difference(contrast_moments(arms, keys)).select(
        *keys, "comparison_n", "target_n", "comparison_sum", "target_sum",
        F.col("effect_direction").alias("full_effect_direction"))
    rows = arms.groupBy(*keys, F.col("donor_id").alias("excluded_donor_id"),
                        F.col("contrast_arm").alias("excluded_arm")).agg(
        F.sum("module_score").alias("_sum"), F.count("module_score").alias("_rows")).join(full, keys)
    remaining = {}
    for arm in ("comparison", "target"):
        mine = F.when(F.col("excluded_arm") == arm, F.col("_rows")).otherwise(F.lit(0))
        remaining[f"remaining_{arm}_n"] = F.col(f"{arm}_n") - mine
        remaining[f"_{arm}_sum"] = F.col(f"{arm}_sum") - F.when(
            F.col("excluded_arm") == arm, F.col("_sum")).otherwise(F.lit(0.0))
    rows = rows.withColumns(remaining)
    nt, nc = F.col("remaining_target_n"), F.col("remaining_comparison_n")
    empty = (nt == 0) | (nc == 0)
    effect = F.col("_target_sum") / F.nullif(nt, F.lit(0)) - F.col("_comparison_sum") / F.nullif(nc, F.lit(0))
    rows = rows.withColumns({
        "leave_one_out_effect": F.when(~empty, effect),
        "leave_one_out_status": F.when(empty, F.lit(LOO_EMPTY)).otherwise(F.lit(EFFECT_AVAILABLE)),
    }).withColumn("leave_one_out_direction", X.effect_direction("leave_one_out_effect"))
    defined = X.is_directional("full_effect_direction") & X.is_directional("leave_one_out_direction")
    return rows.withColumn("direction_agrees", F.when(
        defined, F.col("leave_one_out_direction") == F.col("full_effect_direction"))).select(
        *keys, "excluded_donor_id", "excluded_arm", "remaining_comparison_n", "remaining_target_n",
        "leave_one_out_effect", "leave_one_out_direction", "full_effect_direction",
        "direction_agrees", "leave_one_out_status")


def direction_retention(loo: DataFrame, keys: Sequence[str] = tuple(CONTRAST),
                        stable: float = STABLE_RETENTION) -> DataFrame:
    """Share of directional leave-one-out effects that keep the full direction."""
    out = loo.groupBy(*keys, "full_effect_direction").agg(
        F.count_if(F.col("leave_one_out_status") == EFFECT_AVAILABLE).alias("leave_one_out_available"),
        F.count_if(F.col("direction_agrees").isNotNull()).alias("leave_one_out_directional"),
        F.count_if("direction_agrees").alias("leave_one_out_agreeing"),
        F.min("leave_one_out_effect").alias("leave_one_out_min"),
        F.max("leave_one_out_effect").alias("leave_one_out_max"))
    assessable = X.is_directional("full_effect_direction") & (F.col("leave_one_out_directional") > 0)
    fraction = F.when(assessable, F.col("leave_one_out_agreeing")
                      / F.nullif(F.col("leave_one_out_directional"), F.lit(0)))
    status = (F.when(~X.is_directional("full_effect_direction"),
                     F.lit("not_assessable_full_effect_zero_or_nonfinite"))
              .when(F.col("leave_one_out_directional") == 0,
                    F.lit("not_assessable_no_nonzero_leave_one_out_effect"))
              .when(fraction >= stable, F.lit("direction_retained_at_or_above_0.80"))
              .otherwise(F.lit("direction_retention_below_0.80")))
    return out.withColumns({"direction_retention_fraction": fraction, "stability_status": status})


def direction_consistency(effects: DataFrame, keys: Sequence[str] = ("module_id", "compartment", "severity_orientation"),
                          digits: int = 8) -> DataFrame:
    """Sign counts, majority share, consensus and ordered cohort lists over available effects.

    Cohorts whose severity scales run in different directions are never compared: the orientation is
    part of the key.  A key without an available effect keeps its row.  ``n_eligible`` counts available
    effects of confirmatory cohorts; alignment itself never establishes replication.
    """
    available = F.col("effect_status").startswith("available")
    shown = effects.withColumn("_pair", F.concat_ws("=", "cohort_id", X.format_fixed("effect", digits)))

    def counted(direction: str) -> Column:
        return F.count_if(available & (F.col("effect_direction") == direction))

    out = shown.groupBy(*keys).agg(
        F.count_if(available).alias("n_available"), counted(X.DIRECTION_POSITIVE).alias("n_positive"),
        counted(X.DIRECTION_NEGATIVE).alias("n_negative"), counted(X.DIRECTION_ZERO).alias("n_zero"),
        F.count_if(available & X.parse_bool_strict("confirmatory_eligible")).alias("n_eligible"),
        # The list is the result itself: one entry per cohort of the module.
        F.array_sort(F.collect_list(F.when(available, F.struct("cohort_id", "_pair", "cohort_role")))).alias("_list"))
    p, n = F.col("n_positive"), F.col("n_negative")
    nonzero = p + n
    return out.withColumns({
        "majority_fraction": F.greatest(p, n) / F.nullif(nonzero, F.lit(0)),
        "consensus_direction": F.when(nonzero < 2, F.lit("not_assessable_fewer_than_two_nonzero_cohort_effects"))
        .when(n == 0, F.lit(X.DIRECTION_POSITIVE)).when(p == 0, F.lit(X.DIRECTION_NEGATIVE))
        .otherwise(F.lit("discordant")),
        "consistency_status": F.when(nonzero < 2, F.lit("insufficient_cohort_effects_for_direction_alignment"))
        .when((p == 0) | (n == 0), F.lit("available_effects_directionally_aligned"))
        .otherwise(F.lit("available_effects_directionally_discordant")),
        "cohort_ids": F.array_join(F.transform("_list", lambda s: s["cohort_id"]), ";"),
        "cohort_effects": F.array_join(F.transform("_list", lambda s: s["_pair"]), ";"),
        "cohort_roles": F.array_join(F.transform("_list", lambda s: s["cohort_role"]), ";"),
        "replication_assessment": F.when(F.col("n_eligible") < 2, F.lit(NOT_ASSESSED)).otherwise(F.lit(NOT_ADJUDICATED)),
    }).drop("_list")


def order_by_catalog(rows: DataFrame, orders: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``<column>_rank`` from each declared order (unknown values last); sort at the sink."""
    ranks = {}
    for column, values in orders.items():
        catalog = F.array(*[F.lit(v) for v in values])
        found = F.array_position(catalog, F.col(column)).cast("long")
        ranks[f"{column}_rank"] = F.when(found == 0, F.lit(len(values) + 1).cast("long")).otherwise(found)
    return rows.withColumns(ranks)



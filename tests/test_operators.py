"""Edge rows of every status, search and interval brute force, partition invariance."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import expr as X
from cohortspark.operators import audits as A
from cohortspark.operators import cells as C
from cohortspark.operators import effects as E
from cohortspark.operators import gates as G
from cohortspark.operators import identity as I
from cohortspark.operators import scores as S
from cohortspark.operators import sequences as Q
from cohortspark.operators import synthesis as M
from cohortspark.operators import text as TX

KEYS = E.CONTRAST


def arms(spark, groups):
    rows = [("c", "NP", m, f"{a}{i}", "target" if a == "t" else "comparison", float(v), 5, 50)
            for m, sides in groups.items() for a, values in sides.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cohort_id string, compartment string, module_id string, donor_id string, "
                                       "contrast_arm string, module_score double, included_cells long, "
                                       "total_umi_included_cells long")


@pytest.fixture(scope="module")
def edge_arms(spark):
    return arms(spark, {
        "empty": {"t": [1, 2]},
        "single": {"t": [1], "c": [2, 3]},
        "flat": {"t": [2, 2], "c": [1, 1]},
        "zero": {"t": [1, 3], "c": [2, 2]},
        "flip": {"t": [10, -9.5, 0], "c": [0, 0.1, 0.2]},
        "good": {"t": [4, 5, 6], "c": [1, 2, 3]},
    }).cache()


def test_effect_and_welch_statuses(edge_arms):
    rows = {r["module_id"]: r for r in E.welch_interval(E.mean_difference(E.contrast_moments(edge_arms))).collect()}
    assert rows["empty"]["effect_status"] == E.EFFECT_EMPTY and rows["empty"]["effect"] is None
    assert rows["empty"]["effect_direction"] == "not_estimable"
    assert rows["empty"]["analytic_ci_status"] == E.SMALL_GROUP
    assert rows["single"]["analytic_ci_status"] == E.SMALL_GROUP and rows["single"]["effect"] == -1.5
    assert rows["flat"]["analytic_ci_status"] == E.ZERO_SE
    assert rows["zero"]["effect_direction"] == "zero"
    assert rows["good"]["analytic_ci_status"] == "available_welch_t"
    assert rows["good"]["effect_direction"] == "positive_higher_target_severity"


def test_mean_interval_statuses(edge_arms):
    rows = {(r["module_id"], r["contrast_arm"]): r for r in E.group_descriptives(edge_arms).collect()}
    assert rows[("single", "target")]["mean_ci_status"] == E.SMALL_GROUP
    assert rows[("flat", "target")]["mean_ci_status"] == E.ZERO_SE
    assert rows[("good", "target")]["mean_ci_status"] == "available_t"
    assert rows[("good", "target")]["median"] == 5.0


def test_leave_one_out_and_retention(edge_arms):
    loo = E.leave_one_out(edge_arms).cache()
    single = loo.where("module_id = 'single' and excluded_arm = 'target'").first()
    assert single["leave_one_out_status"] == E.LOO_EMPTY and single["remaining_target_n"] == 0
    status = {r["module_id"]: r for r in E.direction_retention(loo).collect()}
    assert status["zero"]["stability_status"] == "not_assessable_full_effect_zero_or_nonfinite"
    assert status["good"]["stability_status"] == "direction_retained_at_or_above_0.80"
    assert status["good"]["direction_retention_fraction"] == 1.0
    assert status["flip"]["leave_one_out_agreeing"] < status["flip"]["leave_one_out_directional"]


def test_bootstrap_is_partition_invariant(spark, edge_arms):
    def run(n):
        out = E.donor_bootstrap(edge_arms.repartition(n), KEYS, replicates=50)
        return sorted((r["module_id"], r["bootstrap_ci_lower"], r["bootstrap_ci_upper"], r["bootstrap_status"])
                      for r in out.collect())

    one, eight = run(1), run(8)
    assert [r[3] for r in one] == [r[3] for r in eight]
    for a, b in zip(one, eight):
        assert a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])
    status = {r[0]: r[3] for r in one}
    assert status["single"] == E.SMALL_GROUP and status["good"].startswith("available")


def test_blocks_of_a_large_arm_share_its_draws():
    """Blocks agree on their shares, each replicate draws n donors, and every donor is as likely."""
    n, size, reps = 23, 4, 2000
    blocks = range(-(-n // size))
    shares = [E.block_slots(77, 1, n, b, reps, size) for b in blocks]
    assert (sum(shares) == n).all()
    ones = [E.block_sums([1.0] * min(size, n - b * size), 77, 1, n, b, reps, size) for b in blocks]
    assert all((a == b).all() for a, b in zip(ones, shares))
    hits = [E.block_sums([float(i == k) for i in range(min(size, n - b * size))], 77, 1, n, b, reps, size).sum()
            for b in blocks for k in range(min(size, n - b * size))]
    assert len(hits) == n and sum(hits) == n * reps
    assert max(abs(h - reps) for h in hits) < 6 * reps ** 0.5
    assert (E.block_sums([1.0] * n, 78, 1, n, 0, reps) == n).all()


def test_bootstrap_equals_plain_draws(spark):
    """Every draw made one by one, as the docstring states it; seeds and templates change them."""
    import numpy as np

    scores = {"target": [1.0, 4.0, 9.0, 16.0, 30.0], "comparison": [2.0, 2.5, 7.0]}
    rows = [("c", "NP", "m", arm, f"d{arm}{i}", x) for arm, xs in scores.items() for i, x in enumerate(xs)]
    arms = spark.createDataFrame(rows, "cohort_id string, compartment string, module_id string, contrast_arm string, donor_id string, module_score double")

    def mix(x):
        x = ((x ^ x >> 16) * 0x85EBCA6B) % 2 ** 32
        x = ((x ^ x >> 13) * 0xC2B2AE35) % 2 ** 32
        return x ^ x >> 16

    found = {}
    for template in ((), ("own",)):
        got = E.donor_bootstrap(arms, KEYS, 300, template=template).first()
        seed, means = int(got["bootstrap_seed"]), {}
        for code, (arm, xs) in enumerate(scores.items(), 1):
            order = sorted(range(len(xs)), key=lambda i: hashlib.md5(f"d{arm}{i}".encode()).hexdigest())
            base = mix((seed % 2 ** 32) ^ mix((seed >> 32) ^ mix(code)))
            means[arm] = [np.mean([xs[order[mix(mix(base ^ mix(r)) ^ mix(j)) * len(xs) >> 32]] for j in range(len(xs))]) for r in range(1, 301)]
        want = np.quantile(np.array(means["target"]) - np.array(means["comparison"]), [0.025, 0.975])
        found[template] = (got["bootstrap_ci_lower"], got["bootstrap_ci_upper"])
        assert found[template] == pytest.approx(tuple(want), abs=1e-9)
    assert len(set(found.values())) == 2


def test_consistency_statuses(spark):
    def effect(c, m, e):
        return (c, "NP", m, e, E.EFFECT_AVAILABLE)

    df = spark.createDataFrame(
        [effect("a", "same", 1.0), effect("b", "same", 2.0), effect("a", "mixed", 1.0), effect("b", "mixed", -2.0),
         effect("a", "few", 1.0), effect("b", "few", 0.0), effect("a", "neg", -1.0), effect("b", "neg", -1.5)],
        "cohort_id string, compartment string, module_id string, effect double, effect_status string")
    df = df.withColumns({"effect_direction": X.effect_direction("effect"), "severity_orientation": F.lit("up"),
                         "cohort_role": F.concat(F.lit("r"), "cohort_id"), "confirmatory_eligible": F.lit("True")})
    rows = {r["module_id"]: r for r in E.direction_consistency(df, digits=2).collect()}
    assert rows["same"]["cohort_roles"] == "ra;rb" and rows["same"]["replication_assessment"] == E.NOT_ADJUDICATED
    # Cohorts of opposite orientation are not compared.
    apart = E.direction_consistency(df.withColumn("severity_orientation", F.col("cohort_id")), digits=2)
    assert {r["n_available"] for r in apart.collect()} == {1} and apart.where("consensus_direction = 'discordant'").count() == 0
    none = E.direction_consistency(df.withColumn("effect_status", F.lit("not_estimable")), digits=2).first()
    assert none["n_available"] == 0 and none["cohort_ids"] == "" and none["replication_assessment"] == E.NOT_ASSESSED
    assert rows["same"]["consensus_direction"] == "positive_higher_target_severity"
    assert rows["neg"]["consensus_direction"] == "negative_lower_target_severity"
    assert rows["mixed"]["consensus_direction"] == "discordant" and rows["mixed"]["majority_fraction"] == 0.5
    assert rows["few"]["consistency_status"] == "insufficient_cohort_effects_for_direction_alignment"
    assert rows["mixed"]["cohort_effects"] == "a=1.00;b=-2.00"


def test_ingestion_reasons(spark):
    scores = spark.createDataFrame(
        [("d", "NP", "A", "score_available", 1.0, 1.0), ("d", "NP", "B", "blocked", 1.0, 1.0),
         ("d", "NP", "B", "score_available", 0.79, 1.0), ("d", "NP", "A", "score_available", 0.80, float("nan")),
         ("d", "NP", "A", "score_available", 0.80, 2.0), ("d", "AF", "A", "score_available", 1.0, 1.0),
         ("d", "NP", "C", "score_available", 1.0, 1.0), ("x", "NP", "A", "score_available", 1.0, 1.0)],
        "dataset string, compartment string, severity_group string, score_status string, mapped_fraction double, module_score double")
    spec = spark.createDataFrame([("c", "d", "NP", "A", "B")],
                                 "cohort_id string, dataset string, compartment string, comparison_value string, target_value string")
    rows = {r["reason"]: r for r in E.ingestion_audit(scores, spec).collect()}
    assert {k: v["row_count"] for k, v in rows.items()} == {
        "score_available_and_mapping_pass": 2, "score_status_not_available": 1,
        "mapped_fraction_below_threshold": 1, "nonfinite_score": 1}
    one = rows["nonfinite_score"]
    assert (one["raw_rows_loaded"], one["rows_matching_dataset"], one["rows_matching_compartment"],
            one["rows_matching_contrast_groups"]) == (8, 7, 6, 5)


def test_bh_with_ties_and_many_values(spark):
    rng = random.Random(1)
    values = [rng.random() ** 3 for _ in range(400)] + [0.01] * 5 + [1.0, 0.0]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(values)], ["f", "i", "p"])
    got = {r["i"]: r["p_adjusted"] for r in M.adjust_bh(df, ["f"], "p").collect()}
    order = sorted(range(len(values)), key=lambda i: values[i], reverse=True)
    best, want = 1.0, {}
    for rank, i in zip(range(len(values), 0, -1), order):
        best = min(best, values[i] * len(values) / rank)
        want[i] = best
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-12)


def test_pooled_edge_groups(spark):
    rows = [("one", "a", 1.0, 0.1), ("two", "a", 1.0, 0.1), ("two", "b", 3.0, 0.2),
            ("same", "a", 1.0, 0.1), ("same", "b", 1.0, 0.3)]
    df = spark.createDataFrame(rows, ["g", "cohort_id", "smdh", "smdh_variance"])
    out = {r["g"]: r for r in M.random_effects(df, ["g"]).collect()}
    assert out["one"]["fit_status"] == "not_estimable_fewer_than_two_studies" and out["one"]["pooled_effect"] is None
    # Two studies: the restricted likelihood root is (difference² - v1 - v2) / 2.
    assert out["two"]["tau_squared"] == pytest.approx((4 - 0.3) / 2, abs=1e-9)
    assert out["same"]["tau_squared"] == 0.0


def test_one_fit_for_all_group_sizes(spark):
    """Against a plain solution of the estimating equation, for two studies up to more than ten thousand."""
    rng = random.Random(5)
    groups = {str(n): [(rng.gauss(0.3, 0.7), 0.05 + rng.random() / 3) for _ in range(n)] for n in (2, 200, 12_000)}
    rows = [(g, f"s{i}", y, v) for g, studies in groups.items() for i, (y, v) in enumerate(studies)]
    df = spark.createDataFrame(rows, ["g", "cohort_id", "smdh", "smdh_variance"])
    got = {r["g"]: r for r in M.random_effects(df, ["g"], method="PM").collect()}

    def q(studies, t):
        w = [1 / (v + t) for _, v in studies]
        mu = sum(a * y for a, (y, _) in zip(w, studies)) / sum(w)
        return sum(a * (y - mu) ** 2 for a, (y, _) in zip(w, studies)) - (len(studies) - 1)

    for g, studies in groups.items():
        low, high = 0.0, 10.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if q(studies, middle) > 0 else (low, middle)
        assert got[g]["k"] == len(studies)
        assert got[g]["tau_squared"] == pytest.approx(0.0 if q(studies, 0.0) <= 0 else low, abs=1e-8)


def direct_fit(studies, method="REML"):
    """(τ², pooled effect) by bisection over all studies, as the estimating equations are written."""
    import numpy as np

    y, v = (np.array(x) for x in zip(*studies))

    def value(t):
        w = 1 / (v + t)
        mu = (w * y).sum() / w.sum()
        if method == "PM":
            return (w * (y - mu) ** 2).sum() - (len(y) - 1)
        return (w * w * (y - mu) ** 2).sum() - (w.sum() - (w * w).sum() / w.sum())

    low, high = 0.0, max(v.max(), 2 * y.var(ddof=1)) + 1e-12
    if value(0.0) <= 0:
        high = 0.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) > 0 else (low, middle)
    w = 1 / (v + high)
    return high, (w * y).sum() / w.sum()


@pytest.mark.parametrize("method", ["REML", "PM"])
def test_each_study_left_out_equals_a_direct_fit(spark, method):
    """200 studies of variances that differ by five orders, two large outliers, a group of three and one without variation."""
    rng = random.Random(11)
    groups = {"wide": [(rng.gauss(0.2, 0.5), 10 ** rng.uniform(-4, 1)) for _ in range(198)] + [(9.0, 0.01), (-7.0, 0.3)],
              "three": [(0.1, 0.2), (0.9, 0.1), (-1.2, 0.05)], "same": [(1.0, 0.1 + i / 50) for i in range(6)],
              "twice": [(0.5, 0.1), (2.5, 0.2), (0.1, 0.3), (4.0, 0.4)]}
    rows = [(g, "s0" if (g, i) == ("twice", 1) else f"s{i}", y, v) for g, st in groups.items() for i, (y, v) in enumerate(st)]
    df = spark.createDataFrame(rows, ["g", "cohort_id", "smdh", "smdh_variance"])
    got = {(r["g"], r["omitted"]): r for r in M.leave_one_study_out(df, ["g"], method=method).collect()}
    assert len(got) == 200 + 3 + 6 + 3
    for (g, omitted), r in got.items():
        rest = [(y, v) for group, name, y, v in rows if group == g and name != omitted]
        tau, mu = direct_fit(rest, method)
        assert r["k"] == len(rest)
        assert r["tau_squared"] == pytest.approx(tau, abs=1e-8) and r["pooled_effect"] == pytest.approx(mu, abs=1e-8)


def test_leaving_out_is_linear_in_the_studies(spark):
    rng = random.Random(2)
    studies = [(rng.gauss(0.0, 1.0), 0.02 + rng.random()) for _ in range(20_000)]
    df = spark.createDataFrame([("x", f"s{i}", y, v) for i, (y, v) in enumerate(studies)], ["g", "cohort_id", "smdh", "smdh_variance"])
    out = M.leave_one_study_out(df, ["g"])
    assert out.count() == 20_000
    for r in out.where("omitted in ('s0', 's777', 's19999')").collect():
        tau, mu = direct_fit([s for i, s in enumerate(studies) if f"s{i}" != r["omitted"]])
        assert r["tau_squared"] == pytest.approx(tau, abs=1e-8) and r["pooled_effect"] == pytest.approx(mu, abs=1e-8)
    assert M.leave_one_study_out(df.where("cohort_id = 's1'"), ["g"]).first()["fit_status"].startswith("not_estimable")


def test_leave_one_out_removes_the_whole_donor(spark):
    rows = [("target", "d1", 4.0), ("target", "d1", 2.0), ("target", "d2", 1.5), ("comparison", "e1", 1.0), ("comparison", "e2", 1.0)]
    arms = spark.createDataFrame([("c", "NP", "m", d, a, s) for a, d, s in rows],
                                 ["cohort_id", "compartment", "module_id", "donor_id", "contrast_arm", "module_score"])
    got = {r["excluded_donor_id"]: r for r in E.leave_one_out(arms).collect()}
    assert len(got) == 4
    assert got["d1"]["leave_one_out_effect"] == pytest.approx(0.5) and got["d1"]["remaining_target_n"] == 1


def test_each_library_is_scored_by_its_own_platform(spark):
    wide = [("a", f"f{i}", s) for i, s in enumerate("ABCDE")]
    features = spark.createDataFrame(wide + [("b", "g0", "A"), ("c", "h0", "Z")], ["platform", "feature_id", "symbol"])
    counts = "struct<" + ",".join(f"{g}:bigint" for g in "ABCDE") + ">"
    libraries = spark.createDataFrame([(p, p.upper(), 2, 100, (10, None, None, None, None)) for p in "abc"],
                                      f"platform string, library_id string, included_cells long, total_umi_included_cells long, counts {counts}")
    modules = {"m": list("ABCDE")}
    rows = {r["library_id"]: r for r in S.module_scores(libraries, features, modules, ["library_id"], feature_keys=["platform"]).collect()}
    assert rows["A"]["score_status"] == "score_available" and rows["A"]["mapped_fraction"] == 1.0
    assert rows["B"]["mapped_fraction"] == pytest.approx(0.2) and rows["B"]["module_score"] is None
    assert rows["C"]["mapped_fraction"] == 0.0
    audit = {r["platform"]: r["mapped_genes"] for r in S.mapping_audit(features, modules, ["platform"]).collect()}
    assert audit == {"a": 5, "b": 1, "c": 0}
    coverage = {r["platform"]: r["measured_genes"] for r in C.panel_coverage(features, modules, ["platform"]).collect()}
    assert coverage == {"a": 5, "b": 1, "c": 0}
    cells = spark.createDataFrame([("a", 10, (1, 0, 0, 0, 0)), ("b", 10, (1, 0, 0, 0, 0))], f"platform string, total_umi long, counts {counts}")
    scores = {r["platform"]: r["m_score"] for r in C.panel_columns(cells, features, modules, feature_keys=["platform"]).collect()}
    assert scores["b"] == pytest.approx(5 * scores["a"])


def test_release_patterns_on_planted_texts(spark):
    back = "\\"
    texts = {"double": f"c:{back * 2}users{back * 2}x", "escaped": f"C:{back * 4}HOME{back * 4}x", "slash": "d:/users/x",
             "unix": "see /Users/me", "unix_other_case": "see /USERS/me", "url": "file:///x", "clean": "nothing here"}
    df = spark.createDataFrame(list(texts.items()), ["doc_id", "text"])
    got = {}
    for r in TX.text_pattern_scan(df, ["doc_id"], "text", TX.RELEASE_PATTERNS).collect():
        got.setdefault(r["doc_id"], set()).add(r["pattern"])
    assert got == {"double": {"windows_path"}, "escaped": {"windows_path_escaped"}, "slash": {"windows_path_slash"},
                   "unix": {"unix_home"}, "url": {"file_url"}}


# ---------------------------------------------------------------- cells and scores

def test_cell_rules(spark):
    triples = spark.createDataFrame([("L", 1, "f1", "MT-A", 1), ("L", 1, "f2", "B", 4), ("L", 1, "f3", "B", 0),
                                     ("L", 1, "f2", "B", 5), ("L", 3, "f1", "MT-A", 2)],
                                    ["library_id", "cell_id", "feature_id", "symbol", "value"])
    cells = spark.createDataFrame([("L", 1), ("L", 2), ("L", 3)], ["library_id", "cell_id"])
    profiles = C.cell_profiles(triples, ["B"])
    rows = {r["cell_id"]: r for r in C.cell_metrics(cells, profiles, C.QcRule(3, 5, 10.0)).collect()}
    one = rows[1]  # a repeated coordinate counts as an entry, a zero does not; 1/10 is at the limit
    assert (one["total_umi"], one["detected_genes"], one["mt_umi"], one["pct_mt"]) == (10, 3, 1, 10.0)
    assert one["qc_reason"] == "mt_pct_at_or_above_max"
    assert (rows[2]["total_umi"], rows[2]["pct_mt"]) == (0, 0.0)
    assert rows[2]["qc_reason"] == "detected_genes_below_min;umi_below_min"
    assert rows[3]["qc_reason"] == "detected_genes_below_min;umi_below_min;mt_pct_at_or_above_max"


def test_label_priority(spark):
    panels = ["AF_support", "NP_support", "immune_exclusion", "endothelial_exclusion", "mural_exclusion", "erythroid_exclusion"]

    def row(i, compartment, **scores):
        out = {"cell_id": i, "compartment": compartment}
        for p in panels:
            s, d = scores.get(p.split("_")[0], (0.0, 0))
            out[f"{p}_score"], out[f"{p}_detected_genes"] = s, d
        return out

    rows = [row(1, "AF", AF=(0.2, 1)), row(2, "AF", AF=(0.19, 1)), row(3, "AF", AF=(3.0, 4), mural=(2.0, 3)),
            row(4, "np", immune=(2.0, 3), mural=(9.0, 9)), row(5, "NP", immune=(2.0, 2), NP=(1.0, 1), AF=(1.3, 2)),
            row(6, ""), row(7, "", erythroid=(2.5, 3))]
    got = {r["cell_id"]: r for r in C.label_cells(spark.createDataFrame(rows)).collect()}
    assert got[1]["annotation_label"] == "source_AF_nonexcluded" and got[1]["source_support_status"] == "supporting"
    assert got[2]["source_support_status"] == "support_insufficient" and got[2]["include"]
    assert got[3]["annotation_label"] == "mixed_or_nonresident"
    assert got[4]["annotation_label"] == "nonresident_immune"
    assert got[5]["annotation_label"] == "source_NP_nonexcluded" and got[5]["source_marker_discordant"]
    assert got[6]["annotation_label"] == "ambiguous" and not got[6]["include"]
    assert got[7]["annotation_label"] == "nonresident_erythroid"


def test_mapped_fraction_gate_and_zero_total(spark):
    features = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate("ABCDA")], ["feature_id", "symbol"])
    counts = "struct<" + ",".join(f"{g}:bigint" for g in "ABCDEF") + ">"
    libraries = spark.createDataFrame([("ok", 2, 100, (10, 5, 0, None, None, None)), ("none", 1, 0, (0,) * 6)],
                                      f"library_id string, included_cells long, total_umi_included_cells long, counts {counts}")
    modules = {"at": ["A", "B", "C", "D", "E"], "below": ["A", "E", "F"]}
    rows = {(r["library_id"], r["module_id"]): r for r in S.module_scores(libraries, features, modules, ["library_id"]).collect()}
    assert rows[("ok", "at")]["score_status"] == "score_available"  # exactly 0.80 passes
    assert rows[("ok", "below")]["module_score"] is None
    assert rows[("none", "at")]["score_status"] == "mapping_below_minimum_or_zero_library_umi"
    audit = {r["module_id"]: r for r in S.mapping_audit(features, modules).collect()}
    assert (audit["at"]["mapped_genes"], audit["at"]["duplicate_feature_rows"]) == (4, 1)


def test_duplicate_symbols(spark):
    rows = spark.createDataFrame([("A", "x1", 1), ("A", "x2", 2), ("B", "y1", 3), ("B", "y2", 4), ("C", "z1", 5), ("C", "z2", 6)],
                                 ["symbol", "feature_id", "line_no"])
    kept, decisions = S.resolve_duplicate_symbols(rows, ["A", "B"], {"A": "x2"})
    assert {r["symbol"]: r["feature_id"] for r in kept.collect()} == {"A": "x2", "C": "z1"}
    assert {r["symbol"]: r["decision"] for r in decisions.collect()} == {"A": "canonical_id_kept", "B": "undeclared_duplicate"}


# ---------------------------------------------------------------- search and intervals

def brute_hits(texts, patterns):
    out = []
    for (d, text), (i, p) in itertools.product(texts, patterns):
        start = text.find(p)
        while start >= 0:
            out.append((d, i, start + 1, start + len(p)))
            start = text.find(p, start + 1)
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_pattern_search_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "MAX_BROADCAST_SEEDS", limit)
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("ABé") for _ in range(n))) for i, n in enumerate([0, 1, 5, 63, 64, 65, 400, 1000])]
    texts.append((99, "AB" * 300))
    long = texts[7][1]
    patterns = [(1, "A"), (2, "ABA"), (3, long[100:240]), (4, long[-130:]), (5, long[:127]), (6, "ABABABA"),
                (7, "é" * 4), (8, long[100:240]), (9, "zzz"), (10, long[55:75])]
    got = Q.multi_pattern_search(spark.createDataFrame(texts, "d long, text string"),
                                 spark.createDataFrame(patterns, "i long, pattern string"), "d", "text", chunk=64)
    assert sorted((r["d"], r["i"], r["start"], r["end"]) for r in got.collect()) == brute_hits(texts, patterns)


def test_interval_overlap_matches_brute_force(spark):
    rng = random.Random(11)

    def make(n, spread):
        out = []
        for i in range(n):
            start = rng.randint(0, 2000)
            out.append((rng.choice("xxy"), i, start, start + int(rng.random() ** 4 * spread)))
        return out

    a, b = make(150, 1500), make(150, 300)
    names = "chrom string, id long, start long, end long"
    got = Q.interval_overlap(spark.createDataFrame(a, names), spark.createDataFrame(b, names), "chrom", "id", "id")
    want = sorted((x[0], x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2])
    assert sorted((r["chrom"], r["left_id"], r["right_id"]) for r in got.collect()) == want


def test_table_between_markers_ignores_stray_ends(spark):
    lines = spark.createDataFrame([("d", i + 1, s) for i, s in enumerate(["END", "a", "BEGIN", "b", "c", "END", "d", "BEGIN", "e"])],
                                  ["k", "pos", "line"])
    out = TX.table_between_markers(lines, ["k"], F.col("line") == "BEGIN", F.col("line") == "END").collect()
    assert sorted((r["table_no"], r["line"]) for r in out) == [(1, "b"), (1, "c"), (2, "e")]


def test_release_patterns(spark):
    texts = [("path", "open /home/someone/x"), ("win", "C:/Users/me"), ("url", "file:" + "///tmp"),
             ("key", "AKIA" + "A" * 16), ("clean", "nothing here")]
    got = TX.text_pattern_scan(spark.createDataFrame(texts, ["id", "t"]), ["id"], "t", TX.RELEASE_PATTERNS).collect()
    assert {(r["id"], r["pattern"]) for r in got} == {
        ("path", "unix_home"), ("win", "windows_path_slash"), ("win", "unix_home"), ("url", "file_url"),
        ("key", "aws_key")}


# ---------------------------------------------------------------- audits, identity, gates

def test_coordinate_defects(spark):
    lines = [("L", 1, "1 1 5"), ("L", 2, "2 1 0"), ("L", 3, "x 1 2"), ("L", 4, "9 1 2"), ("L", 5, "1 1 -3"),
             ("L", 6, "1 2\u0000 3"), ("L", 7, "  "), ("L", 8, "%c"), ("Z", 1, "1 1 0")]
    headers = [("L", 3, 2, 6, 3, 2), ("Z", 3, 2, 1, 3, 2), ("empty", 3, 2, 0, 3, 3)]
    audit = A.coordinate_integrity(
        spark.createDataFrame(lines, ["library_id", "pos", "line"]),
        spark.createDataFrame(headers, ["library_id", "matrix_rows", "matrix_columns", "declared_nnz", "n_features", "n_barcodes"]))
    rows = {r["library_id"]: r for r in A.integrity_failures(audit).collect()}
    r = rows["L"]
    assert (r["coordinate_lines"], r["valid_lines"], r["malformed_lines"], r["out_of_range"], r["negative_values"],
            r["zero_values"], r["nul_bytes"], r["first_malformed_pos"], r["last_malformed_pos"]) == (6, 4, 2, 1, 1, 1, 1, 3, 6)
    # A zero value passes the text audit but is an illegal payload.
    assert rows["Z"]["text_integrity_pass"] and rows["Z"]["failures"] == "illegal Matrix Market payload"
    assert rows["empty"]["failures"].startswith("dimension mismatch")


def test_identity_helpers(spark):
    a = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "2")], ["cohort_id", "k"])
    b = spark.createDataFrame([("c", "2"), ("c", "3")], ["cohort_id", "k"])
    counts = I.side_counts(a, b, ["cohort_id", "k"]).first()
    assert (counts["matched_keys"], counts["left_only_keys"], counts["right_only_keys"], counts["repeated_keys"]) == (1, 1, 1, 1)
    assert I.identity_crosswalk(a, b, ["cohort_id", "k"]).first()["crosswalk_status"] == "fail_identity_crosswalk"
    assert I.sets_equal(a, a, ["k"]).first()[0] is True
    assert {(r["k"], r["problem"]) for r in I.library_presence(a, b, "k", strict=True).collect()} == {
        ("1", "archive_library_absent_from_ledger"), ("3", "ledger_library_absent_from_archive")}
    assert I.identity_conflicts(a.withColumn("g", F.monotonically_increasing_id()), "k", ["g"]).count() == 1


def test_gates_can_raise(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.5,), (float("nan"),)], ["v"])
    gates = G.value_gate(df, "v", F.lit("t"), True)
    assert {r["gate"]: r["violations"] for r in gates.collect()} == {"not_finite": 1, "negative": 1, "not_integer": 1}
    with pytest.raises(G.GateError):
        G.require(gates)
    G.require(gates.where("gate = 'none'"))


def test_one_library_per_donor(spark):
    df = spark.createDataFrame([("d", "AF", "l1"), ("d", "AF", "l2"), ("d", "NP", "l3")], ["donor_id", "compartment", "library_id"])
    assert [(r["library_id"], r["earlier_library"]) for r in A.earlier_library(df).collect()] == [("l2", "l1")]
    assert {(r["compartment"], r["one_library"]) for r in A.pair_status(df).collect()} == {("AF", False), ("NP", True)}

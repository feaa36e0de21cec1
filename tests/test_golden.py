"""Published results reproduced from their published inputs (rows embedded as literals)."""

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import expr as X
from cohortspark.operators import effects as E
from cohortspark.operators import synthesis as M

# Fixed values: (module, cohort, target n, mean, sd, comparison n, mean, sd, g, var g, smdh, var smdh).
STUDIES = [
    ("ecm", "c1", 8, 5.07878688, 0.19796665, 3, 4.73335078, 0.04603474, 1.7943430053893, 0.604681825196493, 2.19655413317109, 0.635711350498066),
    ("ecm", "c2", 3, 5.72949047, 0.40977653, 4, 4.75914058, 0.40832457, 1.99512955555925, 0.867657757866624, 1.99442124371499, 1.24886387643546),
    ("ecm", "c3", 8, 5.82736372, 0.90418391, 8, 6.23076674, 0.72129989, -0.466250150017952, 0.256793412574743, -0.466250150017952, 0.293861539829133),
    ("ecm", "c4", 4, 6.39348001, 0.50645444, 4, 4.71507373, 1.89357151, 1.05186598740621, 0.569151378466377, 1.05186598740621, 0.828092758871584),
    ("inf", "c1", 8, 2.22115378, 0.09136621, 3, 2.33207744, 0.14106774, -0.970285896725551, 0.501126729759902, -0.852968347378693, 0.883723806487767),
    ("inf", "c2", 3, 2.88844681, 0.28488012, 4, 2.83915533, 0.55393436, 0.0890513014307944, 0.583899771496656, 0.0940886445767989, 0.737408507071888),
    ("inf", "c3", 8, 4.22052703, 0.31121035, 8, 3.54043393, 0.66258506, 1.24198778013215, 0.298204176437425, 1.24198778013215, 0.363265965313568),
    ("inf", "c4", 4, 4.52640076, 0.41180618, 4, 4.54341931, 0.58513705, -0.0292178727384937, 0.50005335525546, -0.0292178727384937, 0.666745911393291),
    ("hyp", "c1", 8, 5.01783585, 0.15417755, 3, 4.8402014, 0.10396602, 1.12315938129592, 0.515673651323926, 1.23457830479469, 0.597663123868633),
    ("hyp", "c2", 3, 4.94632123, 0.18219043, 4, 4.70822363, 0.11459687, 1.37624626804736, 0.718622889784355, 1.31529984413, 1.15072512406218),
    ("hyp", "c3", 8, 5.01730299, 0.27763385, 8, 4.9291249, 0.2904383, 0.293387029132686, 0.252689873401978, 0.293387029132686, 0.288794667792164),
    ("hyp", "c4", 4, 5.07041681, 0.16455361, 4, 4.6358242, 0.33172674, 1.44171453457446, 0.629908799950203, 1.44171453457446, 0.903288656165272),
    ("hom", "c1", 8, 1.98518521, 0.33027479, 3, 1.93192953, 0.67048991, 0.113231990406438, 0.458916128044761, 0.0920878598269981, 0.861922371336284),
    ("hom", "c2", 3, 5.30071394, 0.28071087, 4, 5.26423271, 0.07572205, 0.164040697092892, 0.585255429783528, 0.149189758567414, 0.982242220315217),
    ("hom", "c3", 8, 4.56840922, 0.53816084, 8, 4.61562426, 1.09180826, -0.0518542975150951, 0.250084027130337, -0.0518542975150951, 0.285845940359486),
    ("hom", "c4", 4, 4.75190189, 0.40411625, 4, 3.98945127, 1.28810274, 0.69378339655452, 0.53008346258342, 0.69378339655452, 0.733800541741047),
]
# Pooled, low, high, t, p, tau², I², Q, Q p, prediction low, prediction high.
PRIMARY = {
    "ecm": (1.04808052417951, -0.996452326668016, 3.09261337502703, 1.63140445037713, 0.20130385299707, 1.19869656878688, 65.1147356744747, 9.63939675684997, 0.0218937314056168, -2.99177972790533, 5.08794077626434),
    "inf": (0.280917195947411, -1.14317738374313, 1.70501177563795, 0.627770026712528, 0.574689630736441, 0.289037757811529, 31.7097525503868, 4.12755951082304, 0.248015366573607, -1.94515771701851, 2.50699210891333),
    "hyp": (0.818436820706115, -0.12848701255272, 1.76536065396495, 2.75062380381798, 0.0707052684033081, 0.0, 0.0, 1.88893456646136, 0.595775548584517, -0.12848701255272, 1.76536065396495),
    "hom": (0.145293888031312, -0.367941258869862, 0.658529034932486, 0.900932058019382, 0.434026418979805, 0.0, 0.0, 0.54924927984931, 0.907945731773641, -0.367941258869862, 0.658529034932486),
}
ADJUSTED = {"ecm": 0.402607705994139, "inf": 0.574689630736441, "hyp": 0.282821073613232, "hom": 0.574689630736441}
# Fixed values: (pooled, tau²) of the two model variants.
VARIANTS = {
    ("hedges_reml", "ecm"): (0.955216042533574, 0.958952401193215),
    ("hedges_reml", "inf"): (0.152369025422887, 0.510692204890745),
    ("hedges_reml", "hyp"): (0.859191355199708, 0.0167949722887416),
    ("hedges_reml", "hom"): (0.166634898409045, 0.0),
    ("smdh_pm", "ecm"): (1.027692100057, 0.988321811523649),
    ("smdh_pm", "inf"): (0.303611701982832, 0.193323283568248),
    ("smdh_pm", "hyp"): (0.818436820706115, 0.0),
    ("smdh_pm", "hom"): (0.145293888031312, 0.0),
}
FIELDS = ("pooled_effect", "ci_lower", "ci_upper", "test_statistic", "p_value", "tau_squared", "I_squared", "Q",
          "Q_p_value", "prediction_lower", "prediction_upper")


@pytest.fixture(scope="module")
def studies(spark):
    names = ("module_id cohort_id target_n target_mean target_sd comparison_n comparison_mean comparison_sd "
             "g_expected vg_expected d_expected vd_expected").split()
    return M.standardized_effects(spark.createDataFrame(STUDIES, names)).cache()


def test_standardized_effects(studies):
    for r in studies.collect():
        for got, want in (("hedges_g", "g_expected"), ("hedges_g_variance", "vg_expected"),
                          ("smdh", "d_expected"), ("smdh_variance", "vd_expected")):
            assert r[got] == pytest.approx(r[want], abs=1e-12)


def test_pooled_model(studies):
    rows = {r["module_id"]: r for r in M.random_effects(studies, ["module_id"]).collect()}
    for module, want in PRIMARY.items():
        for field, value in zip(FIELDS, want):
            tolerance = 1e-3 if field == "I_squared" else 2e-5
            assert rows[module][field] == pytest.approx(value, abs=tolerance), (module, field)
    assert rows["hyp"]["tau_squared"] == 0.0 and rows["hom"]["tau_squared"] == 0.0


def test_model_variants(studies):
    models = {"hedges_reml": ("hedges_g", "hedges_g_variance", "REML"), "smdh_pm": ("smdh", "smdh_variance", "PM")}
    got = {(r["model"], r["module_id"]): r for r in M.model_sensitivity(studies, ["module_id"], models).collect()}
    for key, (pooled, tau2) in VARIANTS.items():
        assert got[key]["pooled_effect"] == pytest.approx(pooled, abs=2e-5)
        assert got[key]["tau_squared"] == pytest.approx(tau2, abs=2e-5)


def test_leave_one_study_out_equals_refit(studies):
    out = {(r["module_id"], r["omitted"]): r for r in M.leave_one_study_out(studies, ["module_id"]).collect()}
    assert len(out) == 16
    refit = M.random_effects(studies.where(F.col("cohort_id") != "c2"), ["module_id"]).collect()
    for r in refit:
        assert out[(r["module_id"], "c2")]["pooled_effect"] == pytest.approx(r["pooled_effect"], abs=1e-12)


def test_bh_on_pooled_p_values(spark):
    p = spark.createDataFrame([(m, v[4]) for m, v in PRIMARY.items()], ["module_id", "p"]).withColumn("family", F.lit(1))
    for r in M.adjust_bh(p, ["family"], "p").collect():
        assert r["p_adjusted"] == pytest.approx(ADJUSTED[r["module_id"]], abs=1e-12)


# ---------------------------------------------------------------- isolated five-library cohort

LIBRARIES = [("k1", "comparison"), ("k3", "comparison"), ("k4", "target"), ("k5", "target"), ("k6", "target")]
SCORES = {
    "ecm": (5.44421571, 5.17709309, 6.87991042, 6.08777246, 6.87576862),
    "inf": (2.72491637, 3.11634281, 2.90640950, 2.77830964, 2.99289940),
}
SEEDS = {"ecm": "5837321243297817187", "inf": "17662654979126664986"}
ISOLATED = {
    "ecm": dict(effect=1.30382943, lower=0.32315334, upper=2.28450552, se=0.29529015, df=2.79174099,
                boot=(0.77711806, 1.70143673), agreeing=5),
    "inf": dict(effect=-0.02809008, lower=-1.78549116, upper=1.72931100, se=0.20539999, df=1.20695846,
                boot=(-0.29533322, 0.23915306), agreeing=3),
}


@pytest.fixture(scope="module")
def isolated(spark):
    rows = [("iso", "NP", m, key, arm, score, i, SEEDS[m], 10, 100)
            for m, scores in SCORES.items() for i, ((key, arm), score) in enumerate(zip(LIBRARIES, scores))]
    return spark.createDataFrame(rows, ["cohort_id", "compartment", "module_id", "donor_id", "contrast_arm",
                                        "module_score", "line_no", "bootstrap_seed", "included_cells",
                                        "total_umi_included_cells"]).cache()


def test_isolated_effects_and_intervals(isolated):
    for r in E.welch_interval(E.mean_difference(E.contrast_moments(isolated))).collect():
        want = ISOLATED[r["module_id"]]
        assert r["effect"] == pytest.approx(want["effect"], abs=1e-7)
        assert r["analytic_ci_lower"] == pytest.approx(want["lower"], abs=1e-7)
        assert r["analytic_ci_upper"] == pytest.approx(want["upper"], abs=1e-7)
        assert r["analytic_se"] == pytest.approx(want["se"], abs=1e-7)
        assert r["analytic_df"] == pytest.approx(want["df"], abs=1e-6)


def test_isolated_bootstrap_parity(isolated):
    for r in E.donor_bootstrap_parity(isolated, "line_no").collect():
        low, high = ISOLATED[r["module_id"]]["boot"]
        assert r["bootstrap_ci_lower"] == pytest.approx(low, abs=1e-7)
        assert r["bootstrap_ci_upper"] == pytest.approx(high, abs=1e-7)


def test_isolated_leave_one_out(isolated):
    loo = E.leave_one_out(isolated)
    effects = {r["excluded_donor_id"]: r["leave_one_out_effect"] for r in loo.where("module_id = 'ecm'").collect()}
    assert effects["k1"] == pytest.approx(1.43739074, abs=1e-7)
    assert effects["k3"] == pytest.approx(1.17026812, abs=1e-7)
    assert effects["k4"] == pytest.approx(1.17111614, abs=1e-7)
    for r in E.direction_retention(loo).collect():
        assert r["leave_one_out_agreeing"] == ISOLATED[r["module_id"]]["agreeing"]


def test_isolated_descriptives(isolated):
    rows = {(r["module_id"], r["contrast_arm"]): r for r in E.group_descriptives(isolated).collect()}
    r = rows[("ecm", "target")]
    assert r["sd"] == pytest.approx(0.45615013, abs=1e-7)
    assert r["mean_ci_lower"] == pytest.approx(5.48134409, abs=1e-7)
    assert r["mean_ci_upper"] == pytest.approx(7.74762358, abs=1e-7)
    assert rows[("ecm", "comparison")]["mean_ci_lower"] == pytest.approx(3.61359705, abs=1e-7)


def test_set_fingerprint(spark):
    # A published locked gene set and its SHA-256.
    genes = ["ACAN", "B3GAT1", "BGN", "CILP", "COL2A1", "COL9A1", "COL9A2", "COL9A3", "COMP", "FMOD", "HAPLN1",
             "HAS2", "KRT19", "MATN3", "SOX9"]
    row = spark.createDataFrame([(list(reversed(genes)) + ["ACAN"],)], "g array<string>").select(
        X.set_fingerprint("g").alias("h")).first()
    assert row["h"] == "e6b7f020a8a3cf9f187282dae56964a9b3b25fe809a8badff19764a070f0f01c"

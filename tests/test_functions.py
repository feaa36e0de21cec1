"""Distribution tails, segmented scans and exact percentiles against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import dist, scans
from cohortspark.functions import expr as X
from cohortspark.functions.config import broadcast_if_small, feature_set_table
from cohortspark.functions.quantiles import group_percentiles


def test_distribution_tails(spark):
    # Standard table entries.
    rows = spark.createDataFrame([(1.0, 12.706204736), (2.0, 4.302652730), (5.0, 2.570581836), (30.0, 2.042272456),
                                  (1000.0, 1.962339081)], ["df", "q"])
    for r in rows.select("q", dist.t_quantile(0.95, F.col("df")).alias("got"),
                         dist.t_two_sided_p(F.col("q"), F.col("df")).alias("p")).collect():
        assert r["got"] == pytest.approx(r["q"], abs=1e-8)
        assert r["p"] == pytest.approx(0.05, abs=1e-9)
    chi = spark.createDataFrame([(3.841458821, 1.0), (9.487729037, 4.0), (0.0, 3.0), (124.342113, 100.0)], ["x", "df"])
    got = [r[0] for r in chi.select(dist.chi2_sf(F.col("x"), F.col("df"))).collect()]
    assert got == pytest.approx([0.05, 0.05, 1.0, 0.05], abs=1e-8)


def test_tails_of_missing_values_are_null(spark):
    df = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0)], "t double, df double")
    assert [r[0] for r in df.select(dist.t_two_sided_p(F.col("t"), F.col("df"))).collect()] == [None] * 3


def test_log_gamma_and_correction(spark):
    values = [1.0, 2.0, 5.5, 9.0, 150.0, 5000.0]
    df = spark.createDataFrame([(v,) for v in values], ["x"])
    for r in df.select("x", X.log_gamma("x").alias("g"), X.small_sample_factor("x").alias("j")).collect():
        x = r["x"]
        assert r["g"] == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-12)
        if x > 1:
            want = math.exp(math.lgamma(x / 2) - math.lgamma((x - 1) / 2)) / math.sqrt(x / 2)
            assert r["j"] == pytest.approx(want, rel=1e-10)
        else:
            assert r["j"] is None


@pytest.fixture(scope="module")
def sequence_rows(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 4 else f"k{i % 7}", i, rng.choice([None, None, "a", "b", "c"]), rng.randint(0, 3))
            for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, pos long, mark string, v int").repartition(5)


def test_carry_forward_across_blocks(sequence_rows):
    rows, df = sequence_rows
    want, last = {}, {}
    for k, pos, mark, _ in rows:
        last[k] = mark or last.get(k)
        want[pos] = last[k]
    got = {r["pos"]: r["out"] for r in scans.carry_forward(df, ["k"], "pos", F.col("mark"), "out", parts=9).collect()}
    assert got == want


def test_running_sum_across_blocks(sequence_rows):
    rows, df = sequence_rows
    want, total = {}, {}
    for k, pos, _, v in rows:
        total[k] = total.get(k, 0) + v
        want[pos] = total[k]
    got = {r["pos"]: r["out"] for r in scans.running_sum(df, ["k"], "pos", F.col("v"), "out", parts=9).collect()}
    assert got == want


def test_scan_of_one_hot_key_with_gaps_is_spread(spark):
    """Positions that leap by millions, and one key for all rows: ranges of about equal size, no single task."""
    rows = [("all", i * 1_000_003 ** (i % 2) + i * 7_000_000_000, "m" if i % 97 == 0 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, pos long, mark string").withColumn("k", F.lit("all"))
    parts = scans.range_parts(df, ["k"], "pos", 8)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    out = scans.latest_over(parts, ["k"], "pos", F.when(F.col("mark") == "m", F.col("pos")), "out")
    want, last = {}, None
    for _, pos, mark in sorted(rows, key=lambda r: r[1]):
        last = pos if mark else last
        want[pos] = last
    assert {r["pos"]: r["out"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_part" in plan


def test_hashed_index_is_a_permutation_in_digest_order(spark):
    members = [f"d{i}" for i in range(700)]
    df = spark.createDataFrame([("g", m) for m in members], ["g", "m"]).repartition(6)
    got = {r["m"]: r["i"] for r in scans.hashed_index(df, ["g"], "m", "i").collect()}
    want = {m: i for i, m in enumerate(sorted(members, key=lambda m: (hashlib.md5(m.encode()).hexdigest(), m)))}
    assert got == want


@pytest.mark.parametrize("n,bins", [(1, 4), (3, 4), (5, 4), (5000, 16), (5000, 1024)])
def test_exact_percentiles(spark, n, bins):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(size=n), 2)  # many ties
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("one", 4.0), ("one", None)], "g string, v double")
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0, "p99": 0.99}
    got = {r["g"]: r for r in group_percentiles(df, ["g"], "v", wanted, bins).collect()}
    for name, p in wanted.items():
        assert got["g"][name] == pytest.approx(np.quantile(values, p), abs=1e-12), name
        assert got["one"][name] == 4.0


def test_percentiles_of_extreme_values_and_null_keys(spark):
    """Values over all scales of a double, one hot group and a null key; no window over the rows of a group."""
    rng = np.random.default_rng(4)
    values = np.concatenate((10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300), [0.0, 1.7e308, -1.7e308]))
    odd = [("c", float("inf")), ("c", 1.7976931348623157e308), ("c", float("-inf")), ("c", float("nan")), ("c", 3.0)]
    df = spark.createDataFrame([(None, float(v)) for v in values] + [("b", 2.0), ("b", 5.0)] + odd, "g string, v double")
    got = {r["g"]: r for r in group_percentiles(df, ["g"], "v", {"median": 0.5, "q1": 0.25}).collect()}
    assert got["c"]["median"] == 1.7976931348623157e308 and got["c"]["q1"] == 3.0
    assert got["b"]["median"] == 3.5 and got["b"]["q1"] == 2.75
    ordered = np.sort(values)
    assert got[None]["median"] == ordered[151] and got[None]["q1"] == pytest.approx((ordered[75] + ordered[76]) / 2)


def test_stable_seed_matches_little_endian_digest(spark):
    digest = hashlib.sha256(b"7|a|b|c").digest()
    want = str(int.from_bytes(digest[:8], "little"))
    row = spark.createDataFrame([("a", "b", "c")], ["x", "y", "z"]).select(X.stable_seed(7, "x", "y", "z")).first()
    assert row[0] == want


def test_coercion_and_formatting(spark):
    df = spark.createDataFrame([(" 1.5 ", "TRUE"), ("nan", "no"), ("x", None), ("Infinity", "false")], ["n", "b"])
    rows = df.select(X.to_number("n").alias("n"), X.parse_bool_strict("b").alias("b"),
                     X.format_fixed(X.to_number("n"), 3).alias("s")).collect()
    assert [r["n"] for r in rows] == [1.5, None, None, None]
    assert [r["b"] for r in rows] == [True, None, None, False]
    assert [r["s"] for r in rows] == ["1.500", "", "", ""]


def test_text_expressions(spark):
    df = spark.createDataFrame([("ENSG001.4(abc)", "Disease  State : x:y", "NP-F60, rest", "a; ;b;")], "s string, c string, t string, l string")
    r = df.select(X.symbol_in_parentheses("s").alias("symbol"), X.feature_id_prefix("s").alias("id"),
                  X.characteristic_key("c").alias("k"), X.characteristic_value("c").alias("v"),
                  X.title_age("t").alias("age"), X.title_sex("t").alias("sex"), X.split_list("l").alias("l"),
                  X.reverse_complement(F.lit("AACGN")).alias("rc"),
                  X.donor_key(F.lit(" "), F.lit("p1"), F.lit("lib")).alias("d")).first()
    assert (r["symbol"], r["id"]) == ("ABC", "ENSG001")
    assert (r["k"].strip(), r["v"]) == ("disease state", "x:y")
    assert (r["age"], r["sex"], r["l"], r["rc"], r["d"]) == ("60", "F", ["a", "b"], "NCGTT", "p1")


def test_broadcast_needs_a_checked_size(spark):
    df = spark.range(50)
    assert broadcast_if_small(df, 50)[1] is True
    assert broadcast_if_small(df, 49)[1] is False


def test_feature_sets_are_checked(spark):
    with pytest.raises(ValueError):
        feature_set_table(spark, {"m": ["A", "a "]})
    with pytest.raises(ValueError):
        feature_set_table(spark, {"m": []})

"""Steps that many queries share: no task per platform, no second pass over the cells."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cells as C
from cohortspark.operators import effects as E
from cohortspark.operators import scores as S
from suite import catalog

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def platform_tables(spark):
    features = spark.createDataFrame([("a", f"f{i}", s) for i, s in enumerate("ABCD")] + [("b", "g", "C")],
                                     "platform string, feature_id string, symbol string")
    counts = "struct<" + ",".join(f"{g}:bigint" for g in "ABCD") + ">"
    cells = spark.createDataFrame([("a", 10, 10, (1, None, 2, 0)), ("b", 10, 10, (1, 0, 2, 0)), ("z", 10, 10, (1, 1, 1, 1))],
                                  f"platform string, total_umi long, total_umi_included_cells long, counts {counts}")
    return features, cells.withColumn("included_cells", F.lit(1).cast("long"))


def test_cells_are_not_dealt_by_platform(spark):
    features, cells = platform_tables(spark)
    sets = {"p": ["D", "B", "A"], "q": ["C", "A"]}
    # Without Spark's own broadcasts, as with tables whose size it cannot tell.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (C.panel_columns(cells, features, sets, feature_keys=["platform"]),
                    S.module_scores(cells, features, sets, ["platform"], feature_keys=["platform"])):
            assert "hashpartitioning(platform" not in plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_panel_sums_by_hand(spark):
    from math import log1p

    features, cells = platform_tables(spark)
    sets = {"p": ["D", "B", "A"], "q": ["C", "A"]}
    rows = {r["platform"]: r for r in C.panel_columns(cells, features, sets, feature_keys=["platform"]).collect()}
    one, two = log1p(1e5), log1p(2e5)
    assert rows["a"]["p_score"] == pytest.approx(one / 3) and rows["a"]["p_detected_genes"] == 1
    assert rows["a"]["q_score"] == pytest.approx((one + two) / 2) and rows["a"]["q_detected_genes"] == 2
    assert (rows["b"]["p_score"], rows["b"]["p_detected_genes"]) == (0.0, 0)
    assert rows["b"]["q_score"] == pytest.approx(two) and rows["b"]["q_detected_genes"] == 1
    assert (rows["z"]["p_score"], rows["z"]["q_score"], rows["z"]["q_detected_genes"]) == (0.0, 0.0, 0)


def test_coverage_and_ledger_read_the_cells_once(spark):
    for name in ("cell_coverage", "ledger_score_agreement"):
        text = plan(catalog.QUERIES[name](spark, DIR))
        assert "l_partkey" not in text, name  # the triples lie behind a settled table


def test_ingestion_audit_counts_the_scores_once(spark):
    scores = spark.range(4).select(F.lit("d").alias("dataset"), F.lit("AF").alias("compartment"), F.lit("x").alias("severity_group"),
                                   F.col("id").cast("double").alias("module_score"), F.lit("score_available").alias("score_status"),
                                   F.lit(1.0).alias("mapped_fraction"))
    spec = spark.createDataFrame([("c", "d", "AF", "x", "y")],
                                 "cohort_id string, dataset string, compartment string, comparison_value string, target_value string")
    out = E.ingestion_audit(scores, spec)
    assert "Range" not in plan(out)
    row = out.collect()[0]
    assert (row["row_count"], row["raw_rows_loaded"], row["rows_matching_contrast_groups"]) == (4, 4, 4)


def test_set_sums_leave_no_lambda_to_the_rows(spark):
    features, cells = platform_tables(spark)
    sets = {"p": ["D", "B", "A"], "q": ["C", "A"]}
    for out in (C.panel_columns(cells, features, sets, feature_keys=["platform"]),
                S.module_scores(cells, features, sets, ["platform"], feature_keys=["platform"])):
        assert "lambda" not in plan(out)  # interpreted for each row and symbol


def test_set_sums_of_odd_rows(spark):
    features = spark.createDataFrame([("f", "A"), ("g", "B")], "feature_id string, symbol string")
    cells = spark.createDataFrame([(0, 10, (1, 1)), (1, 10, None), (2, 0, (0, 0)), (3, None, (0, 1)), (4, 1, (-5, 1))],
                                  "cell_id int, total_umi_included_cells long, counts struct<A:bigint,B:bigint>")
    cells = cells.withColumns({"included_cells": F.lit(1), "total_umi": F.col("total_umi_included_cells")})
    scores = {r["cell_id"]: (r["module_score"], r["score_status"]) for r in S.module_scores(cells, features, {"m": ["B", "A"]}, ["cell_id"]).collect()}
    assert scores[0][0] == pytest.approx(11.512935464920229) and scores[1] == (0.0, S.SCORE_AVAILABLE)
    assert scores[2] == scores[3] == (None, S.SCORE_BLOCKED) and scores[4] == (None, S.SCORE_AVAILABLE)
    panels = {r["cell_id"]: (r["p_score"], r["p_detected_genes"]) for r in C.panel_columns(cells, features, {"p": ["A", "B"]}).collect()}
    assert panels[1] == panels[2] == (0.0, 0) and panels[4] == (None, 1)
    assert panels[3] == (pytest.approx(13.815511557963774 / 2), 1)


def test_profiles_from_entries_and_features(spark):
    features = spark.createDataFrame([("f1", "MT-A"), ("f2", "B"), ("f3", "B"), ("f4", None)], "feature_id string, symbol string")
    entries = spark.createDataFrame([(1, "f1", 1), (1, "f2", 4), (1, "f3", 0), (1, "f2", 5), (3, "f1", 2), (3, "f4", 7), (4, "none", 1)],
                                    "cell_id int, feature_id string, value long")
    whole = C.cell_profiles(entries.join(features, "feature_id"), ["B"], keys=["cell_id"])
    apart = C.cell_profiles(entries, ["B"], keys=["cell_id"], features=features)
    assert sorted(apart.collect()) == sorted(whole.collect())
    assert [r["mt_umi"] for r in apart.orderBy("cell_id").collect()] == [1, 2]


def test_block_sums_hold_few_draws():
    import tracemalloc

    import numpy as np

    scores, n, reps = np.arange(4_096.0), 3 * 4_096, 300
    counts = E.block_slots(7, 1, n, 1, reps, 4_096)
    tracemalloc.start()
    sums = E.block_sums(scores, 7, 1, n, 1, reps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # a million draws at a time took 60 MB and left the cache
    base = E._mix32(7 ^ int(E._mix32(0 ^ int(E._mix32(2 * 1 + 1)))))
    for r in (0, 150, 299):
        drawn = E._mix32(E._mix32(int(base) ^ int(E._mix32(r + 1))) ^ E._mix32(np.arange(counts[r]))).astype(np.uint64)
        assert sums[r] == scores[((drawn * np.uint64(4_096)) >> np.uint64(32)).astype(int)].sum()


def test_contract_gate_reads_the_studies_once(spark, monkeypatch):
    from suite import q_synthesis as Q

    calls, whole = [], Q.studies
    monkeypatch.setattr(Q, "studies", lambda t: calls.append(1) or whole(t))
    catalog.QUERIES["synthesis_contract_gate"](spark, DIR)
    assert len(calls) == 1


def test_percentiles_write_their_rows_once(spark, monkeypatch):
    from cohortspark.functions import quantiles as P

    sizes, settle = [], P.settle
    monkeypatch.setattr(P, "settle", lambda df: sizes.append((out := settle(df)).count()) or out)
    rows = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 1.5).alias("v"))
    got = {r["k"]: r["m"] for r in P.group_percentiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {0: 373.5, 1: 375.0} and sizes.count(500) == 1


def test_entries_are_dealt_themselves_unless_a_cell_is_hot(spark):
    features = spark.createDataFrame([(1, "A"), (2, "B"), (3, "MT-X")], "feature_id long, symbol string")
    ids = spark.range(20000)
    even = ids.select((F.col("id") % 4000).alias("cell_id"), (F.col("id") % 3 + 1).alias("feature_id"), (F.col("id") % 7).alias("value"))
    hot = even.withColumn("cell_id", F.when(F.col("cell_id") < 2000, 0).otherwise(F.col("cell_id")))
    none = even.where("value > 9")
    for entries, dealt in ((even, True), (hot, False), (none, True)):
        made = C.cell_profiles(entries, ["B"], keys=["cell_id"], features=features)
        assert ("REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()) == dealt
        got = made.selectExpr("cell_id", "total_umi", "detected_genes", "mt_umi", "counts.B")
        want = entries.join(features, "feature_id").groupBy("cell_id").agg(F.expr(
            "sum(value)"), F.expr("count_if(value > 0)"), F.expr("sum(if(symbol LIKE 'MT-%', value, 0))"), F.expr("sum(if(symbol = 'B', value, null))"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

"""The end-to-end jobs agree with the queries built from the same operators."""

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import gates as G
from cohortspark.plans import cohort as P
from suite.tables import CELL, LABELS, MODULES, PANELS, QC, Tables

SF = "/root/testdata/sf0.001"


def test_cells_to_pooled_results(spark):
    t = Tables(spark, SF)
    cells = t.cells.withColumnRenamed("cohort_id", "dataset")
    scored = P.score_cells(t.triples, cells, t.features, MODULES, PANELS, QC, LABELS, P.LIBRARY, CELL, 2)
    assert scored["cell_qc"].count() == t.orders.count()
    scores = scored["module_scores"]
    assert scores.count() == scored["library_ledger"].count() * len(MODULES)
    assert scored["mapping_audit"].where("module_id = 'm4'").first()["mapping_pass"]
    result = P.contrast_scores(scores, t.spec, replicates=20)
    effects = result["effects"].cache()
    assert effects.count() == 40
    assert effects.where("effect_status like 'available%' and analytic_ci_status is null").count() == 0
    pooled = P.pool_effects(result["arms"], scenarios={"two": ["AFRICA", "ASIA"]})
    primary = pooled["primary"].collect()
    assert len(primary) == 8
    assert all(r["p_adjusted"] is None or r["p_adjusted"] >= r["p_value"] - 1e-12 for r in primary)
    assert pooled["scenarios"].where(F.col("k") > 2).count() == 0


def score_rows(spark, rows):
    full = [("d", lib, donor, "NP", group, "m1", 1.0 + i, "score_available", 1.0, 40, 900) for i, (lib, donor, group) in enumerate(rows)]
    return spark.createDataFrame(full, "dataset string, library_id string, donor_id string, compartment string, severity_group string, "
                                       "module_id string, module_score double, score_status string, mapped_fraction double, "
                                       "included_cells long, total_umi_included_cells long")


@pytest.mark.parametrize("rows,gate", [
    ([("l1", "a", "x"), ("l2", "a", "x"), ("l3", "b", "y")], "repeated_donor_rows"),
    ([("l1", "a", "x"), ("l2", "a", "y"), ("l3", "b", "y")], "conflicting_arms"),
    ([("l1", " ", "x"), ("l2", "a", "y"), ("l3", None, "y")], "blank_donor")])
def test_faulty_donors_stop_the_plan(spark, rows, gate):
    spec = spark.createDataFrame([("c", "d", "NP", "x", "y")],
                                 "cohort_id string, dataset string, compartment string, comparison_value string, target_value string")
    with pytest.raises(G.GateError, match=gate):
        P.contrast_scores(score_rows(spark, rows), spec, replicates=5)
    gates = {r["gate"]: r["status"] for r in P.contrast_scores(score_rows(spark, rows), spec, replicates=5, strict=False)["gates"].collect()}
    assert gates[gate] == "fail" and len(gates) == 3


def test_second_library_of_a_donor_stops_the_plan(spark):
    t = Tables(spark, SF)
    cells = t.cells.withColumnRenamed("cohort_id", "dataset")
    half = F.when(F.col("cell_id") % 2 == 0, F.concat("library_id", F.lit("b"))).otherwise(F.col("library_id"))
    with pytest.raises(G.GateError, match="several_libraries_per_donor"):
        P.score_cells(t.triples, cells.withColumn("library_id", half), t.features, MODULES, PANELS, QC, LABELS, P.LIBRARY, CELL, 2)

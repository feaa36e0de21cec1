"""Queries: cell quality, panels, labels, pseudobulks, module scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.config import feature_set_table
from cohortspark.functions import expr as X
from cohortspark.functions.lineage import settle
from cohortspark.operators import audits as A
from cohortspark.operators import cells as C
from cohortspark.operators import gates as G
from cohortspark.operators import identity as I
from cohortspark.operators import scores as S

from .registry import query
from .tables import CELL, LABELS, LIBRARY, MODULES, PANELS, THRESHOLDS, Tables


def r6(*names):
    return {n: F.round(n, 6) for n in names}


@query("cell_qc", """
SELECT cell_id, library_id, total_umi, detected_genes, mt_umi, round(pct_mt, 6) AS pct_mt, qc_pass, qc_reason FROM v_qc""")
def cell_qc(t: Tables):
    return t.cell_qc.select("cell_id", "library_id", "total_umi", "detected_genes", "mt_umi",
                            F.round("pct_mt", 6).alias("pct_mt"), "qc_pass", "qc_reason")


@query("library_qc", """
SELECT library_id, compartment, CAST(sum(n) AS BIGINT) AS barcodes,
  CAST(coalesce(sum(n) FILTER (WHERE qc_reason = 'pass'), 0) AS BIGINT) AS qc_cells,
  CAST(coalesce(sum(n) FILTER (WHERE qc_reason <> 'pass'), 0) AS BIGINT) AS excluded_cells,
  round(1e0 * coalesce(sum(n) FILTER (WHERE qc_reason = 'pass'), 0) / sum(n), 6) AS qc_fraction,
  coalesce(string_agg(qc_reason || '=' || n, ';' ORDER BY qc_reason || '=' || n) FILTER (WHERE qc_reason <> 'pass'), '') AS exclusion_reason_counts
FROM (SELECT library_id, compartment, qc_reason, count(*) AS n FROM v_qc GROUP BY ALL) GROUP BY library_id, compartment""")
def library_qc(t: Tables):
    out = C.library_qc(t.cell_qc, ["library_id", "compartment"])
    return out.withColumns(r6("qc_fraction"))


@query("donor_qc_flags", """
SELECT cohort_id, donor_id, compartment, count(*) AS total_cells, count(*) FILTER (WHERE qc_pass) AS qc_cells,
  count(*) FILTER (WHERE qc_pass) >= 1 AS threshold_1_pass, count(*) FILTER (WHERE qc_pass) >= 2 AS threshold_2_pass,
  count(*) FILTER (WHERE qc_pass) >= 3 AS threshold_3_pass
FROM v_qc GROUP BY cohort_id, donor_id, compartment""")
def donor_qc_flags(t: Tables):
    return C.threshold_flags(t.cell_qc, ["cohort_id", "donor_id", "compartment"], F.col("qc_pass"), THRESHOLDS)


@query("panel_scores", """
SELECT cell_id, panel, round(score, 6) AS score, detected_genes FROM v_panel_scores""")
def panel_scores(t: Tables):
    wide = C.panel_columns(t.cell_qc.where("qc_pass"), t.platforms, PANELS, feature_keys=["cohort_id"])
    return C.panel_rows(wide, list(PANELS), CELL).withColumns(r6("score"))


@query("cell_labels", """
SELECT cell_id, library_id, annotation_label, source_marker_discordant, source_support_status, include FROM v_labels""")
def cell_labels(t: Tables):
    return t.annotated.select("cell_id", "library_id", "annotation_label", "source_marker_discordant",
                              "source_support_status", "include")


@query("label_counts", "SELECT cohort_id, donor_id, compartment, count(*) AS qc_cells, " + ", ".join(
    f"count(*) FILTER (WHERE annotation_label = '{n}') AS {n}" for n in C.label_names(LABELS))
    + " FROM v_labels GROUP BY cohort_id, donor_id, compartment")
def label_counts(t: Tables):
    return C.label_counts(t.annotated, ["cohort_id", "donor_id", "compartment"], C.label_names(LABELS))


@query("panel_coverage", """
SELECT l.library_id, p.panel, count(*) AS configured_genes, count(s.symbol) AS measured_genes,
  round(1e0 * count(s.symbol) / count(*), 6) AS measured_fraction
FROM (SELECT DISTINCT library_id, cohort_id FROM v_cells) l CROSS JOIN v_panels p
LEFT JOIN (SELECT DISTINCT cohort_id, symbol FROM v_platform) s ON s.cohort_id = l.cohort_id AND s.symbol = p.gene
GROUP BY l.library_id, p.panel""")
def panel_coverage(t: Tables):
    coverage = C.panel_coverage(t.platforms, PANELS, ["cohort_id"]).withColumns(r6("measured_fraction"))
    return t.cells.select("library_id", "cohort_id").distinct().join(coverage, "cohort_id").drop("cohort_id")


@query("mapped_features", """
SELECT feature_id, symbol, module_id FROM v_features JOIN v_modules ON symbol = gene""")
def mapped_features(t: Tables):
    members = feature_set_table(t.spark, MODULES, "module_id", "symbol")
    return t.features.join(members, "symbol").select("feature_id", "symbol", "module_id")


@query("normalize_symbols", """
SELECT p_partkey AS feature_id, upper(trim(p_brand)) AS symbol, starts_with(upper(trim(p_brand)), 'BRAND#2') AS is_mt,
  split_part(p_brand, '#', 1) AS symbol_prefix, upper(trim(p_name)) AS normalized_name
FROM part""")
def normalize_symbols(t: Tables):
    return t.part.select(
        F.col("p_partkey").alias("feature_id"), X.normalize_symbol("p_brand").alias("symbol"),
        X.has_prefix("p_brand", "BRAND#2").alias("is_mt"), X.barcode_prefix("p_brand", "#").alias("symbol_prefix"),
        X.normalize_symbol("p_name").alias("normalized_name"))


@query("module_fingerprints", """
SELECT p_type AS module_id, count(DISTINCT upper(trim(p_name))) AS members,
  sha256(string_agg(DISTINCT upper(trim(p_name)), chr(10) ORDER BY upper(trim(p_name)))) AS fingerprint
FROM part GROUP BY p_type""")
def module_fingerprints(t: Tables):
    # Distinct members first: a fingerprint needs its whole sorted member list, and only that.
    members = t.part.select(F.col("p_type").alias("module_id"), X.normalize_symbol("p_name").alias("gene")).distinct()
    return members.groupBy("module_id").agg(
        F.count(F.lit(1)).alias("members"), X.set_fingerprint(F.collect_list("gene")).alias("fingerprint"))


@query("missing_members", """
SELECT m.module_id, c.cohort_id, m.gene FROM v_modules m CROSS JOIN (SELECT DISTINCT cohort_id FROM v_donors) c
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT cohort_id, symbol FROM v_triples JOIN v_cells USING (cell_id)) s
                  WHERE s.cohort_id = c.cohort_id AND s.symbol = m.gene)""")
def missing_members(t: Tables):
    seen = (t.triples.join(t.cells.select("cell_id", "cohort_id"), "cell_id")
            .select("cohort_id", "symbol").distinct())
    members = t.donors.select("cohort_id").distinct().select(
        "cohort_id", F.inline(F.array(*[F.struct(F.lit(m).alias("module_id"), F.lit(g).alias("gene"))
                                        for m, genes in MODULES.items() for g in genes])))
    return members.join(seen.withColumnRenamed("symbol", "gene"), ["cohort_id", "gene"], "left_anti").select(
        "module_id", "cohort_id", "gene")


@query("cell_coverage", """
SELECT * FROM (
 SELECT 'archive_vs_qc' AS scope, (SELECT count(*) FROM v_cells) AS required_keys, (SELECT count(*) FROM v_measures) AS observed_keys,
   (SELECT count(*) FROM v_cells WHERE cell_id NOT IN (SELECT cell_id FROM v_measures)) AS missing_keys,
   (SELECT count(*) FROM v_measures WHERE cell_id NOT IN (SELECT cell_id FROM v_cells)) AS unexpected_keys
 UNION ALL
 SELECT 'qc_vs_annotation', (SELECT count(*) FROM v_qc WHERE qc_pass), (SELECT count(*) FROM v_labels),
   (SELECT count(*) FROM v_qc WHERE qc_pass AND cell_id NOT IN (SELECT cell_id FROM v_labels)),
   (SELECT count(*) FROM v_labels WHERE cell_id NOT IN (SELECT cell_id FROM v_qc WHERE qc_pass)))
CROSS JOIN (SELECT CAST(0 AS BIGINT) AS repeated_keys) CROSS JOIN (SELECT 1) WHERE TRUE""".replace(
    "SELECT * FROM (", "SELECT scope, required_keys, observed_keys, missing_keys, unexpected_keys, repeated_keys, "
    "CASE WHEN missing_keys + unexpected_keys = 0 THEN 'pass' ELSE 'fail' END AS status FROM (", 1))
def cell_coverage(t: Tables):
    # Triples list only cells with entries, so the first scope shows the empty cells as missing.
    with_entries = t.lineitem.select(F.col("l_orderkey").alias("cell_id")).distinct()
    barcodes = t.orders.select(F.col("o_orderkey").alias("cell_id"))
    first = I.coverage_check(barcodes, with_entries, CELL, "archive_vs_qc")
    # Settled: both sides read the passing cells, and the labelling keeps its own tasks beside the plain side of the union.
    passing = settle(t.cell_qc.where("qc_pass"))
    second = I.coverage_check(passing.select("cell_id"), t.annotate(passing).select("cell_id"), CELL, "qc_vs_annotation")
    return first.unionByName(second)


@query("pseudobulk_genes", """
SELECT l.library_id, g.module_id, g.gene AS gene_symbol, coalesce(s.n, 0) AS pseudobulk_count
FROM v_libraries l CROSS JOIN v_modules g
LEFT JOIN v_library_symbols s ON s.library_id = l.library_id AND s.symbol = g.gene""")
def pseudobulk_genes(t: Tables):
    return S.pseudobulk_genes(t.library_profiles, MODULES, ["library_id"])


@query("mapping_audit", """
SELECT c.cohort_id, m.module_id, count(DISTINCT m.gene) AS configured_genes, count(DISTINCT s.symbol) AS mapped_genes,
  coalesce(string_agg(DISTINCT s.symbol, ';' ORDER BY s.symbol), '') AS mapped_gene_symbols,
  CAST(coalesce(sum(s.n - 1), 0) AS BIGINT) AS duplicate_feature_rows,
  round(1e0 * count(DISTINCT s.symbol) / count(DISTINCT m.gene), 6) AS mapped_fraction,
  1e0 * count(DISTINCT s.symbol) / count(DISTINCT m.gene) >= 0.8e0 AS mapping_pass
FROM (SELECT r_name AS cohort_id FROM region) c CROSS JOIN v_modules m
LEFT JOIN (SELECT cohort_id, symbol, count(DISTINCT feature_id) AS n FROM v_platform GROUP BY ALL) s
  ON s.cohort_id = c.cohort_id AND s.symbol = m.gene
GROUP BY c.cohort_id, m.module_id""")
def mapping_audit(t: Tables):
    return S.mapping_audit(t.platforms, MODULES, ["cohort_id"]).withColumns(r6("mapped_fraction"))


@query("module_scores", """
SELECT library_id, cohort_id, donor_id, compartment, severity_group, module_id, round(module_score, 6) AS module_score,
  score_status, round(mapped_fraction, 6) AS mapped_fraction, included_cells, total_umi_included_cells FROM v_scores""")
def module_scores(t: Tables):
    return t.module_scores.withColumns(r6("module_score", "mapped_fraction"))


@query("library_ledger", """
SELECT library_id, donor_id, compartment, included_cells, total_umi_included_cells, included_cells >= 1 AS threshold_1_pass,
  included_cells >= 2 AS threshold_2_pass, included_cells >= 3 AS threshold_3_pass FROM v_libraries""")
def library_ledger(t: Tables):
    return t.library_profiles.select(
        "library_id", "donor_id", "compartment", "included_cells", "total_umi_included_cells",
        *[(F.col("included_cells") >= n).alias(f"threshold_{n}_pass") for n in THRESHOLDS])


@query("retained_cells_gate", """
SELECT library_id, included_cells, CASE WHEN included_cells >= 2 THEN 'pass' ELSE 'below_minimum_retained_cells' END AS retained_cells_status
FROM v_libraries""")
def retained_cells_gate(t: Tables):
    return G.retained_cells_gate(t.library_profiles, ["library_id"], 2)


_DISTRIBUTION = """
SELECT cohort_id, metric, count(*) OVER () * 0 + cells AS cells, nonzero_entries, round(fraction_meeting_thresholds, 6) AS fraction_meeting_thresholds,
  round(nonzero_fraction, 6) AS nonzero_fraction, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM v_distribution"""


@query("matrix_distribution", _DISTRIBUTION)
def matrix_distribution(t: Tables):
    width = t.features.select("symbol").distinct().agg(F.count(F.lit(1))).scalar()
    out = A.matrix_distribution(t.cell_qc, "cohort_id", 3, 50, 0.6, width)
    return out.withColumns(r6("fraction_meeting_thresholds", "nonzero_fraction", "q1", "median", "q3"))


@query("range_report", """
SELECT 'cells' AS metric, round(min(cells) * 1e0, 6) AS minimum, round(max(cells) * 1e0, 6) AS maximum, count(*) AS samples FROM v_distribution WHERE metric = 'total'
UNION ALL SELECT 'median_total', round(min(median), 6), round(max(median), 6), count(*) FROM v_distribution WHERE metric = 'total'
UNION ALL SELECT 'fraction_meeting_thresholds', round(min(fraction_meeting_thresholds), 6), round(max(fraction_meeting_thresholds), 6), count(*)
FROM v_distribution WHERE metric = 'total'""")
def range_report(t: Tables):
    width = t.features.select("symbol").distinct().agg(F.count(F.lit(1))).scalar()
    per_cohort = A.matrix_distribution(t.cell_qc, "cohort_id", 3, 50, 0.6, width).where(F.col("metric") == "total")
    out = A.range_report(per_cohort, {"cells": "cells", "median_total": "median",
                                      "fraction_meeting_thresholds": "fraction_meeting_thresholds"})
    return out.withColumns(r6("minimum", "maximum"))

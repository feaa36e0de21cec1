"""Queries: matrices, integrity audits, identifiers, listings, designs, value gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import expr as X
from cohortspark.functions.lineage import settle
from cohortspark.operators import audits as A
from cohortspark.operators import effects as E
from cohortspark.operators import gates as G
from cohortspark.operators import identity as I
from cohortspark.operators import scores as S
from cohortspark.sources import files as FS
from cohortspark.sources import matrices as MX

from .q_cells import r6
from .q_effects import ledger
from .registry import query, view
from .tables import COHORTS, MODULES, Tables

view("v_assay", "SELECT t.*, c.library_id, c.cohort_id FROM v_triples t JOIN v_cells c USING (cell_id)")


def assay(t: Tables):
    return t.triples.join(t.cells.select("cell_id", "library_id", "cohort_id"), "cell_id")


# ---------------------------------------------------------------- sample and dense matrices

@query("unpivot_samples", """
SELECT s.symbol, c.cohort_id AS sample, CAST(coalesce(sum(a.value), 0) AS BIGINT) AS value
FROM (SELECT DISTINCT symbol FROM v_assay) s CROSS JOIN (SELECT DISTINCT r_name AS cohort_id FROM region) c
LEFT JOIN v_assay a ON a.symbol = s.symbol AND a.cohort_id = c.cohort_id GROUP BY ALL""")
def unpivot_samples(t: Tables):
    wide = assay(t).groupBy("symbol").agg(*[
        F.coalesce(F.sum(F.when(F.col("cohort_id") == c, F.col("value"))), F.lit(0)).alias(c) for c in COHORTS])
    return S.unpivot_samples(wide, ["symbol"], COHORTS)


def sample_sql(scale: str, table: str) -> str:
    one = "ln(1e0 + 1e6 * v / total)" if scale == "counts" else "ln(1e0 + v)"
    return f"""
    SELECT '{scale}' AS scale, sample, module_id, count(v) AS mapped_genes, round(1e0 * count(v) / count(*), 6) AS mapped_fraction,
      CASE WHEN 1e0 * count(v) / count(*) >= 0.8e0 THEN round(avg({one}), 6) END AS module_score,
      CASE WHEN 1e0 * count(v) / count(*) >= 0.8e0 THEN 'score_available' ELSE 'mapping_below_minimum' END AS score_status
    FROM (SELECT c.sample, c.total, m.module_id, m.gene, s.v
          FROM (SELECT sample, sum(v) AS total FROM {table} GROUP BY 1) c CROSS JOIN v_modules m
          LEFT JOIN {table} s ON s.sample = c.sample AND s.symbol = m.gene) GROUP BY sample, module_id"""


view("v_sample_counts", "SELECT cohort_id AS sample, symbol, CAST(sum(value) AS DOUBLE) AS v FROM v_assay GROUP BY ALL")
view("v_sample_scaled", "SELECT cohort_id AS sample, symbol, CAST(sum(value) AS DOUBLE) / 1e3 AS v FROM v_assay GROUP BY ALL")


@query("sample_matrix_scores", sample_sql("counts", "v_sample_counts") + " UNION ALL " + sample_sql("fpkm", "v_sample_scaled"))
def sample_matrix_scores(t: Tables):
    values = settle(assay(t).groupBy(F.col("cohort_id").alias("sample"), "symbol").agg(
        F.sum("value").cast("double").alias("value")))
    counts = S.sample_scores(values, MODULES, "counts").withColumn("scale", F.lit("counts"))
    scaled = S.sample_scores(values.withColumn("value", F.col("value") / 1000.0), MODULES, "fpkm").withColumn(
        "scale", F.lit("fpkm"))
    return counts.unionByName(scaled).withColumns(r6("mapped_fraction", "module_score"))


CANONICAL = {"RED PLATE": "7", "SMALL WIDGET": "49", "HOT RING": "-1"}
CONFIGURED = [*CANONICAL, "RED WIDGET"]


@query("dedupe_symbols", f"""
WITH r AS (SELECT upper(trim(p_name)) AS symbol, CAST(p_partkey AS VARCHAR) AS feature_id, p_partkey AS line_no,
             CASE upper(trim(p_name)) {' '.join(f"WHEN '{s}' THEN '{i}'" for s, i in CANONICAL.items())} END AS canonical FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN feature_id = canonical THEN 0 ELSE 1 END, line_no) AS rk,
        count(*) OVER (PARTITION BY symbol) AS n FROM r)
SELECT symbol, feature_id, line_no, CASE WHEN n > 1 AND symbol IN ({', '.join(f"'{s}'" for s in CONFIGURED)}) THEN
    CASE WHEN canonical IS NULL THEN 'undeclared_duplicate' WHEN feature_id = canonical THEN 'canonical_id_kept' ELSE 'canonical_id_absent' END END AS decision
FROM k WHERE rk = 1 AND symbol <> '' AND NOT (n > 1 AND symbol IN ({', '.join(f"'{s}'" for s in CONFIGURED)}) AND (canonical IS NULL OR feature_id <> canonical))
UNION ALL SELECT symbol, NULL, NULL, CASE WHEN canonical IS NULL THEN 'undeclared_duplicate' ELSE 'canonical_id_absent' END
FROM k WHERE rk = 1 AND n > 1 AND symbol IN ({', '.join(f"'{s}'" for s in CONFIGURED)}) AND (canonical IS NULL OR feature_id <> canonical)""")
def dedupe_symbols(t: Tables):
    rows = t.part.select(X.normalize_symbol("p_name").alias("symbol"), F.col("p_partkey").cast("string").alias("feature_id"),
                         F.col("p_partkey").alias("line_no"))
    kept, decisions = S.resolve_duplicate_symbols(rows, CONFIGURED, CANONICAL)
    return kept.join(decisions.select("symbol", "decision"), "symbol", "full").select(
        "symbol", "feature_id", "line_no", "decision")


def dense_lines(t: Tables):
    """Matrix text rendered by Spark: one line per part, one column per supplier nation."""
    nations = t.nation.select("n_name")
    header = nations.agg(F.array_sort(F.collect_list("n_name")).alias("names")).select(
        F.posexplode("names").alias("cell_pos", "cell"))
    sums = (t.lineitem.select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("value"))
            .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("l_partkey", "n_name").agg(F.sum("value").alias("value")))
    names = nations.agg(F.array_sort(F.collect_list("n_name"))).scalar()
    per_part = sums.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "value"))).alias("_m"))
    per_part = per_part.withColumn("_names", names)
    values = F.transform("_names", lambda n: F.coalesce(F.element_at("_m", n), F.lit(0).cast("long")).cast("string"))
    return per_part.select((F.col("l_partkey") + 1).alias("line_no"),
                           F.concat_ws("\t", F.col("l_partkey").cast("string"), values).alias("line")), header


view("v_dense", """
    SELECT p.l_partkey + 1 AS line_no, CAST(p.l_partkey AS VARCHAR) AS feature_id, n.n_name AS cell, CAST(coalesce(s.v, 0) AS DOUBLE) AS value,
      row_number() OVER (PARTITION BY p.l_partkey ORDER BY n.n_name) - 1 AS cell_pos
    FROM (SELECT DISTINCT l_partkey FROM lineitem) p CROSS JOIN nation n
    LEFT JOIN (SELECT l_partkey, s_nationkey, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) s
      ON s.l_partkey = p.l_partkey AND s.s_nationkey = n.n_nationkey""")


@query("melt_dense", "SELECT line_no, feature_id, cell, value FROM v_dense")
def melt_dense(t: Tables):
    lines, header = dense_lines(t)
    values, _ = MX.melt_dense(lines, header)
    return values


@query("sampled_value_check", """
SELECT count(*) AS sampled_values, count(*) FILTER (WHERE value <> floor(value)) AS non_integer_values, count(*) FILTER (WHERE value < 0) AS negative_values
FROM v_dense WHERE (line_no = 1 OR line_no % 500 = 0) AND cell_pos % greatest(25 // 256, 1) = 0""")
def sampled_value_check(t: Tables):
    lines, _ = dense_lines(t)
    fields = F.split("line", "\t")
    rows = lines.select("line_no", F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(1))).alias("fields"))
    return A.sampled_value_check(rows, "line_no", F.col("fields"))


@query("tabular_integrity", """
WITH p AS (SELECT l_returnflag AS source, CAST(l_partkey AS VARCHAR) AS id,
    CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL ELSE [CASE WHEN l_quantity = 1 THEN NULL ELSE l_quantity END, CASE WHEN l_tax = 0.08 THEN -l_discount ELSE l_discount END] END AS f,
    l_discount = 0 AND NOT (l_linenumber = 7 AND l_tax = 0) AS trail FROM lineitem),
v AS (SELECT source, id, f, trail, unnest(coalesce(f, [NULL])) AS x FROM p)
SELECT a.*, b.unique_feature_ids, b.feature_rows - b.unique_feature_ids AS duplicate_feature_ids, b.feature_rows, b.malformed_rows, b.trailing_empty_fields FROM (
  SELECT source, count(*) FILTER (WHERE f IS NOT NULL AND x IS NULL) AS non_finite_values, count(*) FILTER (WHERE x < 0) AS negative_values,
    count(*) FILTER (WHERE x >= 0 AND x <> floor(x)) AS non_integer_values, min(x) AS min_value, max(x) AS max_value FROM v GROUP BY source) a
JOIN (SELECT source, count(DISTINCT id) FILTER (WHERE f IS NOT NULL) AS unique_feature_ids, count(*) FILTER (WHERE f IS NOT NULL) AS feature_rows,
    count(*) FILTER (WHERE f IS NULL) AS malformed_rows, count(*) FILTER (WHERE trail) AS trailing_empty_fields FROM p GROUP BY source) b USING (source)""")
def tabular_integrity(t: Tables):
    # Text lines with the defects the audit counts: missing field, text value, sign, trailing tab.
    quantity = F.when(F.col("l_quantity") == 1, F.lit("NA")).otherwise(F.col("l_quantity").cast("string"))
    discount = F.when(F.col("l_tax") == 0.08, -F.col("l_discount")).otherwise(F.col("l_discount")).cast("string")
    short = (F.col("l_linenumber") == 7) & (F.col("l_tax") == 0)
    key = F.col("l_partkey").cast("string")
    line = (F.when(short, F.concat_ws("\t", key, quantity))
            .when(F.col("l_discount") == 0, F.concat_ws("\t", key, quantity, discount, F.lit("")))
            .otherwise(F.concat_ws("\t", key, quantity, discount)))
    lines = t.lineitem.select(F.col("l_returnflag").alias("source"), line.alias("line"))
    return A.tabular_integrity(lines, ["source"], "line", 3, 1)


view("v_coordinates", """
    SELECT l_returnflag || l_linestatus AS library_id, l_orderkey * 10 + l_linenumber AS pos,
      CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN NULL WHEN l_suppkey = 0 THEN l_partkey + 1 + (SELECT count(*) FROM part) ELSE l_partkey + 1 END AS feature,
      l_orderkey + 1 AS cell,
      CASE WHEN l_tax = 0 AND l_discount = 0.07 AND l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT)
           WHEN l_linenumber = 7 AND l_discount = 0 AND l_returnflag <> 'N' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS value
    FROM lineitem""")
view("v_integrity", """
    SELECT *, coordinate_lines = declared_nnz AS line_count_matches, valid_lines = declared_nnz AS valid_count_matches,
      coordinate_lines = declared_nnz AND valid_lines = declared_nnz AND malformed_lines = 0 AND out_of_range = 0 AND negative_values = 0 AS text_integrity_pass
    FROM (SELECT library_id, (SELECT count(*) FROM part) AS matrix_rows, (SELECT count(*) FROM orders) AS matrix_columns,
        count(*) FILTER (WHERE library_id NOT LIKE 'A%' OR feature IS NOT NULL) AS declared_nnz, count(*) AS coordinate_lines,
        count(feature) AS valid_lines, count(*) FILTER (WHERE feature IS NULL) AS malformed_lines,
        count(*) FILTER (WHERE feature > (SELECT count(*) FROM part)) AS out_of_range,
        count(*) FILTER (WHERE feature IS NOT NULL AND value < 0) AS negative_values, count(*) FILTER (WHERE feature IS NOT NULL AND value = 0) AS zero_values,
        min(pos) FILTER (WHERE feature IS NULL) AS first_malformed_pos, max(pos) FILTER (WHERE feature IS NULL) AS last_malformed_pos
      FROM v_coordinates GROUP BY library_id)""")


def coordinate_audit(t: Tables):
    n_features = t.part.agg(F.count(F.lit(1))).scalar()
    n_cells = t.orders.agg(F.count(F.lit(1))).scalar()
    quantity = F.col("l_quantity").cast("long")
    malformed = (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)
    feature = F.when(malformed, F.lit("x")).when(
        F.col("l_suppkey") == 0, (F.col("l_partkey") + 1 + n_features).cast("string")).otherwise(
        (F.col("l_partkey") + 1).cast("string"))
    value = (F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0.07) & (F.col("l_returnflag") == "R"), -quantity)
             .when((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0) & (F.col("l_returnflag") != "N"), F.lit(0))
             .otherwise(quantity))
    library = F.concat("l_returnflag", "l_linestatus")
    lines = t.lineitem.select(
        library.alias("library_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat_ws(" ", feature, (F.col("l_orderkey") + 1).cast("string"), value.cast("string")).alias("line"))
    # The header of the A* archives declares the well-formed lines only.
    declared = t.lineitem.select(library.alias("library_id"), malformed.alias("_bad")).groupBy("library_id").agg(
        F.count_if(~F.col("library_id").startswith("A") | ~F.col("_bad")).alias("declared_nnz"))
    headers = declared.withColumns({"matrix_rows": n_features, "matrix_columns": n_cells,
                                    "n_features": n_features, "n_barcodes": n_cells})
    return A.coordinate_integrity(lines, headers)


@query("coordinate_integrity", """
SELECT library_id, declared_nnz, coordinate_lines, valid_lines, malformed_lines, out_of_range, negative_values, zero_values,
  first_malformed_pos, last_malformed_pos, line_count_matches, valid_count_matches, text_integrity_pass FROM v_integrity""")
def coordinate_integrity(t: Tables):
    return coordinate_audit(t).select(
        "library_id", "declared_nnz", "coordinate_lines", "valid_lines", "malformed_lines", "out_of_range",
        "negative_values", "zero_values", "first_malformed_pos", "last_malformed_pos", "line_count_matches",
        "valid_count_matches", "text_integrity_pass")


@query("integrity_failures", """
SELECT library_id, failures, NOT illegal AND valid_count_matches AS payload_legal,
  CASE WHEN failures = '' THEN 'included after stream-integrity audit' ELSE 'excluded by stream-integrity audit' END AS inclusion,
  CASE WHEN failures = '' THEN 'exploratory' ELSE 'not analysed' END AS analysis_role
FROM (SELECT *, concat_ws(';', CASE WHEN NOT line_count_matches THEN 'Matrix Market line count mismatch' END,
        CASE WHEN NOT valid_count_matches THEN 'valid coordinate count mismatch' END,
        CASE WHEN illegal THEN 'illegal Matrix Market payload' END, CASE WHEN NOT text_integrity_pass THEN 'text integrity failure' END) AS failures
      FROM (SELECT *, malformed_lines > 0 OR out_of_range > 0 OR negative_values > 0 OR zero_values > 0 AS illegal FROM v_integrity))""")
def integrity_failures(t: Tables):
    return A.integrity_failures(coordinate_audit(t)).select(
        "library_id", "failures", "payload_legal", "inclusion", "analysis_role")


@query("identifier_audit", """
SELECT library_id, count(DISTINCT feature_id) AS unique_feature_ids, count(*) - count(DISTINCT feature_id) AS duplicate_feature_ids,
  count(DISTINCT symbol) AS unique_symbols, count(*) - count(DISTINCT symbol) AS duplicate_symbols, b.unique_barcodes, b.duplicate_barcodes,
  count(*) = count(DISTINCT feature_id) AND b.duplicate_barcodes = 0 AS identifier_check_pass, 'feature_id' AS recommended_key
FROM (SELECT DISTINCT l_returnflag || l_linestatus AS library_id, l_partkey AS feature_id, symbol FROM lineitem JOIN v_features ON l_partkey = feature_id) f
JOIN (SELECT library_id, count(DISTINCT barcode) AS unique_barcodes, count(*) - count(DISTINCT barcode) AS duplicate_barcodes
      FROM (SELECT l_returnflag || l_linestatus AS library_id, l_orderkey AS barcode FROM lineitem) GROUP BY 1) b USING (library_id)
GROUP BY library_id, b.unique_barcodes, b.duplicate_barcodes""")
def identifier_audit(t: Tables):
    library = F.concat("l_returnflag", "l_linestatus").alias("library_id")
    features = (t.lineitem.select(library, F.col("l_partkey").alias("feature_id")).distinct()
                .join(t.features, "feature_id"))
    barcodes = t.lineitem.select(library, F.col("l_orderkey").alias("barcode"))
    return A.identifier_audit(features, barcodes, "library_id")


@query("raw_eligibility", """
WITH a AS (SELECT library_id, donor_id, compartment, CASE WHEN severity_group = 'BUILDING' THEN 'processed matrix' ELSE 'raw 10x counts' END AS matrix_status,
    count(*) = count(m.cell_id) AS dimension_check_pass FROM v_cells c LEFT JOIN v_measures m USING (cell_id) GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY donor_id) AS audit_rows FROM a)
SELECT library_id, donor_id, audit_rows, starts_with(matrix_status, 'raw 10x') AND dimension_check_pass AS raw_count_eligible,
  CASE WHEN audit_rows <> 1 THEN 'repeated audit row' WHEN starts_with(matrix_status, 'raw 10x') AND dimension_check_pass
       THEN 'eligible for pre-QC raw-count ingestion' ELSE 'blocked' END AS analysis_status FROM n""")
def raw_eligibility(t: Tables):
    with_entries = t.lineitem.select(F.col("l_orderkey").alias("cell_id")).distinct().withColumn("_seen", F.lit(1))
    status = F.when(F.col("severity_group") == "BUILDING", F.lit("processed matrix")).otherwise(F.lit("raw 10x counts"))
    audited = (t.cells.join(with_entries, "cell_id", "left")
               .groupBy("library_id", "donor_id", "compartment", status.alias("matrix_status"))
               .agg((F.count(F.lit(1)) == F.count("_seen")).alias("dimension_check_pass")))
    # Compartments come as separate audits, the one without a name too.
    return A.raw_eligibility(settle(audited), "donor_id").select(
        "library_id", "donor_id", "audit_rows", "raw_count_eligible", "analysis_status")


@query("audit_alignment", """
WITH led AS (SELECT library_id, count(*) AS cells FROM v_cells GROUP BY 1),
str AS (SELECT library_id, count(DISTINCT cell_id) AS stream_cells FROM v_assay GROUP BY 1),
nes AS (SELECT library_id, count(*) AS nested_cells, count(*) FILTER (WHERE qc_pass) AS qc_cells FROM v_qc WHERE qc_pass OR total_umi > 0 GROUP BY 1),
ide AS (SELECT library_id, count(*) AS labelled FROM v_labels GROUP BY 1),
j AS (SELECT coalesce(led.library_id, str.library_id, nes.library_id, ide.library_id) AS library_id, led.library_id AS a, str.library_id AS b,
   nes.library_id AS c, ide.library_id AS d, cells, stream_cells, nested_cells, qc_cells, labelled
  FROM led FULL JOIN str ON led.library_id = str.library_id FULL JOIN nes ON nes.library_id = led.library_id FULL JOIN ide ON ide.library_id = led.library_id)
SELECT library_id, failures, failures = '' AS selected FROM (SELECT library_id, concat_ws(';',
  CASE WHEN a IS NULL THEN 'missing_in_ledger' END, CASE WHEN b IS NULL THEN 'missing_in_stream' END,
  CASE WHEN c IS NULL THEN 'missing_in_nested' END, CASE WHEN d IS NULL THEN 'missing_in_identifiers' END,
  CASE WHEN NOT coalesce(cells = stream_cells, FALSE) THEN 'stream_cells_disagree' END,
  CASE WHEN NOT coalesce(nested_cells = stream_cells, FALSE) THEN 'nested_cells_disagree' END,
  CASE WHEN NOT coalesce(labelled = qc_cells, FALSE) THEN 'labelled_cells_disagree' END) AS failures FROM j)""")
def audit_alignment(t: Tables):
    qc = settle(t.cell_qc.select("library_id", "cell_id", "qc_pass", "total_umi", "compartment", "counts"))
    count = F.count(F.lit(1))
    audits = {
        "ledger": t.cells.groupBy("library_id").agg(count.alias("cells")),
        "stream": (t.lineitem.select(F.col("l_orderkey").alias("cell_id")).distinct()
                   .join(t.cells.select("cell_id", "library_id"), "cell_id").groupBy("library_id")
                   .agg(count.alias("stream_cells"))),
        "nested": qc.where(F.col("qc_pass") | (F.col("total_umi") > 0)).groupBy("library_id").agg(
            count.alias("nested_cells"), F.count_if("qc_pass").alias("qc_cells")),
        "identifiers": t.annotated.groupBy("library_id").agg(count.alias("labelled")),
    }
    return I.audit_alignment(audits, "library_id", [
        ("stream_cells_disagree", F.col("cells") == F.col("stream_cells")),
        ("nested_cells_disagree", F.col("nested_cells") == F.col("stream_cells")),
        ("labelled_cells_disagree", F.col("labelled") == F.col("qc_cells"))])


@query("listing_compare", """
SELECT coalesce(a.name, b.name) AS name, a.bytes AS published_bytes, b.bytes AS observed_bytes,
  CASE WHEN b.name IS NULL THEN 'missing_in_archive' WHEN a.name IS NULL THEN 'unexpected_in_archive' WHEN a.bytes <> b.bytes THEN 'size_mismatch' ELSE 'match' END AS listing_status
FROM (SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS bytes FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1) a
FULL JOIN (SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS bytes FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1) b ON a.name = b.name""")
def listing_compare(t: Tables):
    def members(*status):
        return (t.orders.where(F.col("o_orderstatus").isin(*status))
                .groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("bytes")))

    return I.listing_compare(members("F", "P"), members("O", "P"))


@query("asset_verification", """
SELECT 'doc-' || doc_id AS path, n_chars AS bytes,
  CASE WHEN lang = 'es' THEN 'missing' WHEN lang = 'de' THEN 'size_mismatch' WHEN replace(text, 'é', 'e') <> text AND lang = 'fr' THEN 'hash_mismatch' ELSE 'verified' END AS asset_status
FROM documents""")
def asset_verification(t: Tables):
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path")
    manifest = t.documents.select(path, F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    copy = (F.when(F.col("lang") == "de", F.concat("text", F.lit(" ")))
            .when(F.col("lang") == "fr", F.replace("text", F.lit("é"), F.lit("e"))).otherwise(F.col("text")))
    observed = t.documents.where(F.col("lang") != "es").select(path, copy.alias("_t")).select(
        "path", F.length("_t").cast("long").alias("bytes"), F.sha2("_t", 256).alias("sha256"))
    return I.verify_assets(manifest, observed).select("path", "bytes", "asset_status")


@query("column_sample_map", """
SELECT c.library_id, c.severity_group AS column_dataset, l.severity_group AS ledger_dataset,
  CASE WHEN l.library_id IS NULL THEN 'absent_from_ledger' WHEN l.severity_group <> c.severity_group THEN 'dataset_mismatch' ELSE 'mapped' END AS mapping_status
FROM (SELECT DISTINCT library_id, severity_group FROM v_cells) c LEFT JOIN v_ledger l ON l.library_id = c.library_id""")
def column_sample_map(t: Tables):
    columns = t.cells.select("library_id", F.col("severity_group").alias("dataset")).distinct()
    return I.map_columns_to_samples(columns, ledger(t).withColumnRenamed("published_group", "dataset"),
                                    "library_id", "dataset")


@query("id_overlap", """
SELECT l_returnflag || l_linestatus AS library_id, count(*) AS feature_rows, count(DISTINCT l_partkey) AS unique_ids,
  count(DISTINCT CASE WHEN p_size <= 25 THEN l_partkey END) AS platform_intersection, count(DISTINCT CASE WHEN p_size > 25 THEN l_partkey END) AS unmapped_ids,
  (SELECT count(*) FROM part WHERE p_size <= 25) - count(DISTINCT CASE WHEN p_size <= 25 THEN l_partkey END) AS platform_ids_missing,
  CASE WHEN count(DISTINCT CASE WHEN p_size > 25 THEN l_partkey END) = 0 THEN 'pass' ELSE 'fail' END AS status
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def id_overlap(t: Tables):
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("library_id"),
                             F.col("l_partkey").alias("feature_id"))
    platform = t.part.where(F.col("p_size") <= 25).select(F.col("p_partkey").alias("feature_id"))
    return A.id_overlap(rows, platform, "library_id", "feature_id")


@query("id_overlap_lists", """
WITH f AS (SELECT DISTINCT l_returnflag || l_linestatus AS library_id, l_partkey AS feature_id FROM lineitem)
SELECT library_id, feature_id, 'unmapped_id' AS problem FROM f WHERE feature_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
UNION ALL SELECT NULL, p_partkey, 'platform_id_in_no_file' FROM part WHERE p_size <= 25 AND p_partkey NOT IN (SELECT feature_id FROM f)""")
def id_overlap_lists(t: Tables):
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("library_id"), F.col("l_partkey").alias("feature_id"))
    platform = t.part.where(F.col("p_size") <= 25).select(F.col("p_partkey").alias("feature_id"))
    return A.id_overlap_lists(rows, platform, "library_id", "feature_id")


@query("sets_equal", """
SELECT s AS status, count(*) FILTER (WHERE a AND NOT b) = 0 AND count(*) FILTER (WHERE b AND NOT a) = 0 AS sets_equal
FROM (SELECT s, k, bool_or(src = 1) AS a, bool_or(src = 2) AS b FROM (
  SELECT o_orderstatus AS s, o_custkey AS k, 1 AS src FROM orders
  UNION ALL SELECT o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END, 2 FROM orders) GROUP BY ALL) GROUP BY 1""")
def sets_equal(t: Tables):
    left = t.orders.select(F.col("o_orderstatus").alias("status"), "o_custkey")
    right = left.withColumn("o_custkey", F.when(F.col("status") == "P", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return I.sets_equal(left, right, ["status", "o_custkey"], ["status"])


@query("library_presence", """
SELECT DISTINCT library_id, 'archive_library_absent_from_ledger' AS problem FROM v_cells WHERE library_id NOT IN (SELECT library_id FROM v_libraries)
UNION ALL SELECT DISTINCT library_id, 'ledger_library_absent_from_archive' FROM v_libraries l
WHERE NOT EXISTS (SELECT 1 FROM v_cells c JOIN v_measures m ON m.cell_id = c.cell_id WHERE c.library_id = l.library_id AND m.total_umi > 300)""")
def library_presence(t: Tables):
    # The archive lists all libraries against the scored ones; in the strict reverse only libraries with a large cell count as archived.
    known = settle(t.library_profiles.select("library_id"))
    large = t.cells.join(t.profiles.where("total_umi > 300").select("cell_id"), "cell_id").select("library_id")
    absent = I.library_presence(t.cells, known, "library_id")
    return absent.unionByName(I.library_presence(large, known, "library_id", True).where("problem like 'ledger%'"))


@query("identity_conflicts", """
SELECT l_partkey, count(*) AS metadata_tuples FROM (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1 HAVING count(*) > 1""")
def identity_conflicts(t: Tables):
    return I.identity_conflicts(t.lineitem, "l_partkey", ["l_returnflag", "l_linestatus"])


@query("earlier_library", """
SELECT donor_id, compartment, library_id, lag(library_id) OVER (PARTITION BY donor_id, compartment ORDER BY library_id) AS earlier_library
FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS donor_id, o_orderstatus AS compartment, o_orderpriority AS library_id FROM orders)
QUALIFY earlier_library IS NOT NULL""")
def earlier_library(t: Tables):
    return A.earlier_library(t.orders.select(F.col("o_custkey").cast("string").alias("donor_id"), F.col("o_orderstatus").alias("compartment"),
                                             F.col("o_orderpriority").alias("library_id")))


@query("split_and_select", """
SELECT p_partkey, list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '')[1] AS first_word,
  len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS words,
  CASE WHEN regexp_full_match(p_brand, 'BRAND#[1-9]|Brand#[1-9]') THEN 'native_subset' ELSE 'excluded_subset' END AS arm
FROM part""")
def split_and_select(t: Tables):
    words = X.split_list("p_name", " ")
    return t.part.select("p_partkey", F.get(words, F.lit(0)).alias("first_word"), F.size(words).cast("long").alias("words"),
                         X.selection("p_brand", "BRAND#[1-9]|Brand#[1-9]", "native_subset", "excluded_subset").alias("arm"))


def positions(t: Tables):
    """Every line as a coordinate entry of its order status; parts and orders are the two axes, some places do not exist."""
    features = t.part.where(F.col("p_size") <= 45).select(F.explode(F.array(*[F.lit(s) for s in "FOP"])).alias("library_id"),
                                                          F.col("p_partkey").alias("feature_idx"), F.col("p_brand").alias("feature_id"), F.col("p_type").alias("symbol"))
    barcodes = t.orders.where(~F.col("o_orderpriority").startswith("5")).select(
        F.col("o_orderstatus").alias("library_id"), F.col("o_orderkey").alias("cell_idx"), F.concat(F.lit("bc"), F.col("o_custkey").cast("string")).alias("barcode"))
    entries = t.lineitem.join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderstatus").alias("library_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_discount") > 0.09, F.lit(None)).otherwise(F.col("l_partkey")).alias("feature"), F.col("l_orderkey").alias("cell"),
        (F.col("l_quantity").cast("long") - 3).alias("value"))
    return MX.attach_positions(entries, features, barcodes, keep=["pos"])


view("v_positions", """
    SELECT o_orderstatus AS library_id, l_orderkey * 10 + l_linenumber AS pos, l_orderkey AS cell_id, CAST(l_quantity AS BIGINT) - 3 AS value,
      p_brand AS feature_id, p_type AS symbol, 'bc' || o_custkey AS barcode,
      CASE WHEN l_discount > 0.09 THEN 'malformed' WHEN p_partkey IS NULL OR p_size > 45 THEN 'feature_out_of_range'
           WHEN o_orderpriority LIKE '5%' THEN 'cell_out_of_range' WHEN CAST(l_quantity AS BIGINT) < 3 THEN 'negative'
           WHEN CAST(l_quantity AS BIGINT) = 3 THEN 'zero' ELSE '' END AS reason
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""")


@query("attached_positions", "SELECT library_id, cell_id, barcode, feature_id, symbol, value FROM v_positions WHERE reason = ''")
def attached_positions(t: Tables):
    return positions(t)[0]


@query("position_rejects", "SELECT library_id, pos, reason FROM v_positions WHERE reason <> ''")
def position_rejects(t: Tables):
    return positions(t)[1]


@query("key_differences", """
SELECT l_partkey, l_suppkey, CASE WHEN bool_or(l_returnflag IN ('A', 'N')) THEN 'left_only' ELSE 'right_only' END AS side
FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_returnflag IN ('A', 'N')) <> bool_or(l_returnflag IN ('R', 'N'))""")
def key_differences(t: Tables):
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    return I.key_differences(rows.where(F.col("l_returnflag").isin("A", "N")), rows.where(F.col("l_returnflag").isin("R", "N")),
                             ["l_partkey", "l_suppkey"])


@query("duplicate_examples", """
WITH d AS (SELECT l_linestatus, l_orderkey FROM lineitem GROUP BY l_linestatus, l_orderkey, l_linenumber HAVING count(*) > 1),
u AS (SELECT DISTINCT l_linestatus, l_orderkey FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey) AS k, count(*) OVER (PARTITION BY l_linestatus) AS n FROM u)
SELECT l_linestatus, n AS distinct_values, string_agg(CAST(l_orderkey AS VARCHAR), ';' ORDER BY l_orderkey) AS examples FROM r WHERE k <= 5 GROUP BY 1, 2""")
def duplicate_examples(t: Tables):
    repeated = E.duplicate_keys(t.lineitem, ["l_linestatus", "l_orderkey", "l_linenumber"])
    return A.examples(repeated, ["l_linestatus"], "l_orderkey", 5)


# ---------------------------------------------------------------- designs and gates

view("v_design", "SELECT DISTINCT library_id, donor_id, compartment, severity_group FROM v_cells")


def design_ledger(t: Tables):
    return t.cells.select("library_id", "donor_id", "compartment", "severity_group").distinct()


@query("design_summary", """
WITH d AS (SELECT donor_id, count(*) AS n, count(*) FILTER (WHERE compartment = 'AF') AS af, count(*) FILTER (WHERE compartment = 'NP') AS np,
  bool_or(severity_group = 'BUILDING') AS ctl, bool_or(severity_group = 'MACHINERY') AS cas FROM v_design GROUP BY 1)
SELECT 'samples' AS metric, CAST(sum(n) AS BIGINT) AS value FROM d UNION ALL SELECT 'donors', count(*) FROM d
UNION ALL SELECT 'control_donors', count(*) FILTER (WHERE ctl) FROM d UNION ALL SELECT 'case_donors', count(*) FILTER (WHERE cas) FROM d
UNION ALL SELECT 'paired_donors', count(*) FILTER (WHERE af > 0 AND np > 0) FROM d
UNION ALL SELECT 'control_paired_donors', count(*) FILTER (WHERE af > 0 AND np > 0 AND ctl) FROM d
UNION ALL SELECT 'case_paired_donors', count(*) FILTER (WHERE af > 0 AND np > 0 AND cas) FROM d
UNION ALL SELECT 'AF_libraries', CAST(sum(af) AS BIGINT) FROM d UNION ALL SELECT 'NP_libraries', CAST(sum(np) AS BIGINT) FROM d""")
def design_summary(t: Tables):
    return A.design_summary(design_ledger(t), "severity_group", ["BUILDING"], ["MACHINERY"])


@query("pair_status", """
SELECT donor_id, compartment, count(*) AS libraries, min(library_id) AS first_library,
  CASE WHEN (SELECT string_agg(DISTINCT compartment, ',' ORDER BY compartment) FROM v_design x WHERE x.donor_id = d.donor_id) = 'AF,NP'
       THEN 'AF_NP_paired' ELSE compartment || '_only' END AS pair_status, count(*) = 1 AS one_library
FROM v_design d GROUP BY donor_id, compartment""")
def pair_status(t: Tables):
    return A.pair_status(design_ledger(t))


@query("value_gate", """
SELECT gate, scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'not_finite' AS gate, l_returnflag AS scope, count(*) FILTER (WHERE l_extendedprice IS NULL OR NOT isfinite(l_extendedprice)) AS violations FROM lineitem GROUP BY 2
  UNION ALL SELECT 'negative', l_returnflag, count(*) FILTER (WHERE l_extendedprice < 0) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'not_integer', l_returnflag, count(*) FILTER (WHERE l_extendedprice <> floor(l_extendedprice)) FROM lineitem GROUP BY 2)""")
def value_gate(t: Tables):
    return G.value_gate(t.lineitem, "l_extendedprice", F.col("l_returnflag"), True)


@query("cell_mapping_gate", """
WITH n AS (SELECT o_orderstatus AS s, o_orderkey AS pos, 'c' || o_custkey AS a,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'c' || o_orderkey ELSE 'c' || o_custkey END AS b FROM orders)
SELECT gate, scope, violations, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'order_differs' AS gate, s AS scope, count(*) FILTER (WHERE a <> b) AS violations FROM n GROUP BY 2
  UNION ALL SELECT 'repeated_cell_names', s, count(*) FILTER (WHERE k > 1) FROM (SELECT s, a, count(*) AS k FROM n GROUP BY 1, 2) GROUP BY 2
  UNION ALL SELECT 'repeated_header_names', s, count(*) FILTER (WHERE k > 1) FROM (SELECT s, b, count(*) AS k FROM n GROUP BY 1, 2) GROUP BY 2)""")
def cell_mapping_gate(t: Tables):
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    other = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    names = t.orders.select("o_orderstatus", "o_orderkey", name.alias("name"))
    header = t.orders.select("o_orderstatus", "o_orderkey",
                             F.when(F.col("o_orderpriority").startswith("1"), other).otherwise(name).alias("name"))
    return G.cell_mapping_gate(names, header, "o_orderstatus", "o_orderkey", "name")


@query("file_hashes")
def file_hashes(t: Tables):
    hashed = FS.hash_files(t.spark, f"{t.dir}/*.parquet")
    return hashed.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")

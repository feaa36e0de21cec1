"""Shared views of the oracle SQL: the same bindings as ``tables.py``, written relationally."""

from __future__ import annotations

from .registry import view
from .tables import COMPARISON, MODULES, PANELS, TARGET, THRESHOLDS


def values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


view("v_modules", values([(m, i, g) for m, genes in MODULES.items() for i, g in enumerate(genes)],
                         "module_id, ord, gene"))
view("v_panels", values([(p, g) for p, genes in PANELS.items() for g in genes], "panel, gene"))
view("v_panel_names", "SELECT DISTINCT panel FROM v_panels")
view("v_features", "SELECT p_partkey AS feature_id, upper(trim(p_brand)) AS symbol FROM part")
view("v_platform", """
    SELECT r_name AS cohort_id, feature_id, symbol FROM v_features CROSS JOIN region
    WHERE (CAST(split_part(symbol, '#', 2) AS INTEGER) + r_regionkey) % 7 <> 0""")
view("v_triples", """
    SELECT l_orderkey AS cell_id, l_partkey AS feature_id, symbol, CAST(l_quantity AS BIGINT) AS value
    FROM lineitem JOIN v_features ON feature_id = l_partkey""")
view("v_donors", """
    SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS donor_id, r_name AS cohort_id,
           c_mktsegment AS severity_group, c_acctbal
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
view("v_cells", """
    SELECT o_orderkey AS cell_id, CAST(o_custkey AS VARCHAR) || '-' || o_orderstatus AS library_id, donor_id,
           CASE o_orderstatus WHEN 'F' THEN 'AF' WHEN 'O' THEN 'NP' ELSE '' END AS compartment,
           cohort_id, severity_group
    FROM orders JOIN v_donors ON o_custkey = c_custkey""")
view("v_measures", """
    SELECT cell_id, CAST(sum(value) AS BIGINT) AS total_umi,
           count(*) FILTER (WHERE value > 0) AS detected_genes,
           CAST(coalesce(sum(value) FILTER (WHERE starts_with(symbol, 'BRAND#2')), 0) AS BIGINT) AS mt_umi
    FROM v_triples GROUP BY cell_id""")
view("v_metrics", """
    SELECT c.*, coalesce(m.total_umi, 0) AS total_umi, coalesce(m.detected_genes, 0) AS detected_genes,
           coalesce(m.mt_umi, 0) AS mt_umi,
           CASE WHEN coalesce(m.total_umi, 0) = 0 THEN 0e0 ELSE 1e2 * m.mt_umi / m.total_umi END AS pct_mt
    FROM v_cells c LEFT JOIN v_measures m USING (cell_id)""")
view("v_qc", """
    SELECT *, reason = '' AS qc_pass, CASE WHEN reason = '' THEN 'pass' ELSE reason END AS qc_reason
    FROM (SELECT *, concat_ws(';', CASE WHEN detected_genes < 3 THEN 'detected_genes_below_min' END,
                                   CASE WHEN total_umi < 50 THEN 'umi_below_min' END,
                                   CASE WHEN pct_mt >= 60 THEN 'mt_pct_at_or_above_max' END) AS reason
          FROM v_metrics)""")
view("v_cell_symbols", "SELECT cell_id, symbol, CAST(sum(value) AS BIGINT) AS n FROM v_triples GROUP BY ALL")
view("v_panel_measured", """
    SELECT cohort_id, panel, gene, count(*) OVER (PARTITION BY cohort_id, panel) AS n_measured
    FROM v_panels JOIN (SELECT DISTINCT cohort_id, symbol FROM v_platform) ON gene = symbol""")
view("v_panel_scores", """
    SELECT q.cell_id, p.panel,
           coalesce(sum(CASE WHEN s.n IS NOT NULL THEN ln(1e0 + 1e6 * s.n / greatest(q.total_umi, 1)) ELSE 0e0 END)
                    / max(p.n_measured), 0e0) AS score,
           count(*) FILTER (WHERE s.n > 0) AS detected_genes
    FROM (SELECT cell_id, cohort_id, total_umi FROM v_qc WHERE qc_pass) q JOIN v_panel_measured p ON p.cohort_id = q.cohort_id
    LEFT JOIN v_cell_symbols s ON s.cell_id = q.cell_id AND s.symbol = p.gene
    GROUP BY q.cell_id, p.panel""")
_pick = ",\n".join(
    f"max(CASE WHEN panel = '{p}' THEN score END) AS s_{p}, max(CASE WHEN panel = '{p}' THEN detected_genes END) AS d_{p}"
    for p in PANELS)
view("v_panel_wide", f"SELECT cell_id, {_pick} FROM v_panel_scores GROUP BY cell_id")
view("v_label_facts", """
    SELECT q.*, w.* EXCLUDE (cell_id),
      CASE q.compartment WHEN 'AF' THEN d_AF_support >= 1 AND s_AF_support >= 0.2e0
                         WHEN 'NP' THEN d_NP_support >= 1 AND s_NP_support >= 0.2e0 ELSE FALSE END AS support,
      CASE q.compartment WHEN 'AF' THEN s_NP_support > s_AF_support + 0.2e0
                         WHEN 'NP' THEN s_AF_support > s_NP_support + 0.2e0 ELSE FALSE END AS source_marker_discordant,
      CASE WHEN d_immune_exclusion >= 3 AND s_immune_exclusion >= 2 THEN 'immune'
           WHEN d_endothelial_exclusion >= 3 AND s_endothelial_exclusion >= 2 THEN 'endothelial'
           WHEN d_mural_exclusion >= 3 AND s_mural_exclusion >= 2 THEN 'mural'
           WHEN d_erythroid_exclusion >= 3 AND s_erythroid_exclusion >= 2 THEN 'erythroid' END AS exclusion
    FROM v_qc q JOIN v_panel_wide w ON q.cell_id = w.cell_id WHERE q.qc_pass""")
view("v_labels", """
    SELECT *, annotation_label IN ('source_AF_nonexcluded', 'source_NP_nonexcluded') AS include
    FROM (SELECT *,
            CASE WHEN support AND exclusion IS NOT NULL THEN 'mixed_or_nonresident'
                 WHEN exclusion IS NOT NULL THEN 'nonresident_' || exclusion
                 WHEN compartment <> '' THEN 'source_' || compartment || '_nonexcluded'
                 ELSE 'ambiguous' END AS annotation_label,
            CASE WHEN support THEN 'supporting'
                 WHEN compartment <> '' AND exclusion IS NULL THEN 'support_insufficient'
                 ELSE 'not_applicable' END AS source_support_status
          FROM v_label_facts)""")
view("v_libraries", """
    SELECT cohort_id, library_id, donor_id, compartment, severity_group, count(*) AS included_cells,
           CAST(sum(total_umi) AS BIGINT) AS total_umi_included_cells
    FROM v_labels WHERE include GROUP BY ALL""")
view("v_library_symbols", """
    SELECT l.library_id, s.symbol, CAST(sum(s.n) AS BIGINT) AS n
    FROM v_labels l JOIN v_cell_symbols s USING (cell_id) WHERE l.include GROUP BY ALL""")
view("v_module_map", """
    SELECT r_name AS cohort_id, module_id, count(*) AS configured, count(symbol) AS mapped
    FROM region CROSS JOIN v_modules
    LEFT JOIN (SELECT DISTINCT cohort_id, symbol FROM v_platform) ON cohort_id = r_name AND symbol = gene
    GROUP BY r_name, module_id""")
view("v_scores", """
    SELECT l.*, m.module_id,
      CASE WHEN 1e0 * m.mapped / m.configured >= 0.8e0 AND l.total_umi_included_cells > 0 THEN s.score END AS module_score,
      CASE WHEN 1e0 * m.mapped / m.configured >= 0.8e0 AND l.total_umi_included_cells > 0
           THEN 'score_available' ELSE 'mapping_below_minimum_or_zero_library_umi' END AS score_status,
      1e0 * m.mapped / m.configured AS mapped_fraction
    FROM v_libraries l JOIN v_module_map m ON m.cohort_id = l.cohort_id
    LEFT JOIN (SELECT l.library_id, g.module_id,
                 avg(ln(1e0 + 1e6 * coalesce(s.n, 0) / l.total_umi_included_cells)) AS score
               FROM v_libraries l CROSS JOIN v_modules g
               LEFT JOIN v_library_symbols s ON s.library_id = l.library_id AND s.symbol = g.gene
               WHERE EXISTS (SELECT 1 FROM v_platform f WHERE f.cohort_id = l.cohort_id AND f.symbol = g.gene)
               GROUP BY ALL) s ON s.library_id = l.library_id AND s.module_id = m.module_id""")
view("v_arms", f"""
    SELECT *, CASE severity_group WHEN '{COMPARISON}' THEN 'comparison' ELSE 'target' END AS contrast_arm
    FROM v_scores WHERE severity_group IN ('{COMPARISON}', '{TARGET}') AND compartment IN ('AF', 'NP')
      AND score_status = 'score_available' AND mapped_fraction >= 0.8e0 AND module_score IS NOT NULL""")


def moments(source: str, keys: str = "cohort_id, compartment, module_id") -> str:
    def arm(a):
        f = f"FILTER (WHERE contrast_arm = '{a}')"
        return (f"count(*) {f} AS {a}_n, sum(module_score) {f} AS {a}_sum, avg(module_score) {f} AS {a}_mean, "
                f"var_samp(module_score) {f} AS {a}_var, stddev_samp(module_score) {f} AS {a}_sd")
    return f"SELECT {keys}, {arm('comparison')}, {arm('target')} FROM {source} GROUP BY {keys}"


def direction(e: str) -> str:
    return (f"CASE WHEN {e} IS NULL THEN 'not_estimable' WHEN {e} > 0 THEN 'positive_higher_target_severity' "
            f"WHEN {e} < 0 THEN 'negative_lower_target_severity' ELSE 'zero' END")


def effects(source: str) -> str:
    return f"""
    SELECT *, {direction('effect')} AS effect_direction,
      CASE WHEN target_n = 0 OR comparison_n = 0 THEN 'not_estimable_one_or_both_contrast_groups_empty'
           ELSE 'available_unweighted_target_minus_comparison_mean_difference' END AS effect_status
    FROM (SELECT *, target_mean - comparison_mean AS effect FROM {source})"""


view("v_moments", moments("v_arms"))
view("v_effects", effects("v_moments"))
view("v_welch", """
    SELECT *, CASE WHEN analytic_ci_status = 'available_welch_t' THEN sqrt(se_sq) END AS analytic_se,
      CASE WHEN analytic_ci_status = 'available_welch_t' THEN se_sq * se_sq / denominator END AS analytic_df
    FROM (SELECT *, CASE WHEN target_n < 2 OR comparison_n < 2 THEN 'not_estimable_group_n_lt_2'
              WHEN NOT coalesce(se_sq > 0, FALSE) THEN 'not_estimable_zero_or_nonpositive_standard_error'
              WHEN NOT coalesce(denominator > 0, FALSE) THEN 'not_estimable_welch_df'
              ELSE 'available_welch_t' END AS analytic_ci_status
          FROM (SELECT *, target_var / target_n + comparison_var / comparison_n AS se_sq,
                  target_var * target_var / (target_n * target_n * nullif(target_n - 1, 0))
                  + comparison_var * comparison_var / (comparison_n * comparison_n * nullif(comparison_n - 1, 0)) AS denominator
                FROM v_effects))""")


def t_quantiles(name: str, df: str, source: str) -> None:
    """View ``name``(df, q): two-sided 95% t quantiles by Simpson's rule and bisection.

    P(0 <= T <= t) = C * integral of cos^(df-1) from 0 to atan(t/sqrt(df)), which is an
    independent method from the continued fraction used by the library.
    """
    view(f"{name}_seek", f"""(df, c, lo, hi, step)
        SELECT df, exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(pi()), 0e0, atan(60e0 / sqrt(df)), 0
        FROM (SELECT DISTINCT CAST({df} AS DOUBLE) AS df FROM {source}) WHERE df >= 1
        UNION ALL
        SELECT df, c, CASE WHEN p < 0.475e0 THEN mid ELSE lo END, CASE WHEN p < 0.475e0 THEN hi ELSE mid END, step + 1
        FROM (SELECT *, (lo + hi) / 2 AS mid,
                c * (lo + hi) / 2 / 6000 * list_sum(list_transform(range(0, 2001), lambda i:
                  CASE WHEN i = 0 OR i = 2000 THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END
                  * pow(cos((lo + hi) / 2 * i / 2000), df - 1))) AS p
              FROM {name}_seek WHERE step < 48)""")
    view(name, f"SELECT df, sqrt(df) * tan((lo + hi) / 2) AS q FROM {name}_seek WHERE step = 48")


t_quantiles("v_tq_welch", "analytic_df", "v_welch")
THRESHOLD_VALUES = values([(t,) for t in THRESHOLDS], "threshold")
view("v_thresholds", THRESHOLD_VALUES)
view("v_distribution", """
    SELECT s.*, q.metric, q.q1, q.median, q.q3
    FROM (SELECT cohort_id, count(*) AS cells, CAST(sum(detected_genes) AS BIGINT) AS nonzero_entries,
            avg(CASE WHEN detected_genes >= 3 AND total_umi >= 50 AND 1e0 * mt_umi / nullif(total_umi, 0) <= 0.6e0 THEN 1e0 ELSE 0e0 END) AS fraction_meeting_thresholds,
            1e0 * sum(detected_genes) / ((SELECT count(DISTINCT symbol) FROM v_features) * count(*)) AS nonzero_fraction
          FROM v_metrics GROUP BY cohort_id) s
    JOIN (SELECT cohort_id, metric, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
          FROM (SELECT cohort_id, 'total' AS metric, 1e0 * total_umi AS v FROM v_metrics
                UNION ALL SELECT cohort_id, 'detected', 1e0 * detected_genes FROM v_metrics
                UNION ALL SELECT cohort_id, 'mt_fraction', 1e0 * mt_umi / nullif(total_umi, 0) FROM v_metrics WHERE total_umi > 0)
          GROUP BY ALL) q USING (cohort_id)""")

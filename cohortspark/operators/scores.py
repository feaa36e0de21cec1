"""Pseudobulks, mapping gates and module scores at the library grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.config import literal_array
from .cells import quoted, symbol_count, with_set_sums

MIN_MAPPED_FRACTION = 0.80
SCORE_AVAILABLE = "score_available"
SCORE_BLOCKED = "mapping_below_minimum_or_zero_library_umi"


def _set_structs(sets: Mapping[str, Sequence[str]], name: str = "module_id") -> Column:
    return F.array(*[F.struct(F.lit(m).alias(name), literal_array(x.strip().upper() for x in g).alias("genes"))
                     for m, g in sets.items()])


def library_profiles(included: DataFrame, keys: Sequence[str], symbols: Sequence[str]) -> DataFrame:
    """One row per library: included cells, total over all features, symbol counts.

    Totals and symbol counts are sums over the cell rows in one shuffle, so the total never
    fans out with a symbol that belongs to several sets.
    """
    return included.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("included_cells"), F.sum("total_umi").alias("total_umi_included_cells"),
        F.expr("struct(" + ", ".join(f"coalesce(sum(counts.{quoted(s)}), 0L) AS {quoted(s)}" for s in symbols)
               + ") AS counts"))


def pseudobulk_genes(libraries: DataFrame, modules: Mapping[str, Sequence[str]],
                     keep: Sequence[str]) -> DataFrame:
    """Count of every configured gene of every module, zeros kept."""
    rows = ", ".join(f"struct('{m}' AS module_id, '{g.strip().upper()}' AS gene_symbol, {symbol_count(g)} AS pseudobulk_count)"
                     for m, genes in modules.items() for g in genes)
    return libraries.select(*keep, F.expr(f"inline(array({rows}))"))


def mapping_audit(features: DataFrame, modules: Mapping[str, Sequence[str]],
                  keys: Sequence[str] = (), minimum: float = MIN_MAPPED_FRACTION) -> DataFrame:
    """Configured and mapped genes per (keys, module) with the coverage gate.

    ``features`` has the keys, ``feature_id`` and ``symbol``.  Symbols outside the
    configuration fold into one row per key before the first shuffle, so a library that lists
    no configured symbol still gets its failing rows.
    """
    keys = list(keys)
    symbols = sorted({g.strip().upper() for genes in modules.values() for g in genes})
    wanted = F.col("symbol").isin(symbols)
    ids = (features.select(*keys, F.when(wanted, F.col("symbol")).alias("symbol"),
                           F.when(wanted, F.col("feature_id")).alias("feature_id")).distinct()
           .groupBy(*keys, "symbol").agg((F.count(F.lit(1)) - 1).alias("_extra")))
    seen = ids.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.when(F.col("symbol").isNotNull(), F.struct("symbol", "_extra")))).alias("_ids"))
    mapped = F.array_sort(F.filter("genes", lambda g: F.map_contains_key("_ids", g)))
    return (seen.select(*keys, "_ids", F.inline(_set_structs(modules)))
            .select(*keys, "module_id", F.size("genes").cast("long").alias("configured_genes"),
                    mapped.alias("_mapped"), "_ids")
            .select(*keys, "module_id", "configured_genes",
                    F.size("_mapped").cast("long").alias("mapped_genes"),
                    F.array_join("_mapped", ";").alias("mapped_gene_symbols"),
                    F.aggregate("_mapped", F.lit(0).cast("long"),
                                lambda acc, g: acc + F.element_at("_ids", g)).alias("duplicate_feature_rows"))
            .withColumn("mapped_fraction", F.col("mapped_genes") / F.col("configured_genes"))
            .withColumn("mapping_pass", F.col("mapped_fraction") >= minimum))


def module_scores(libraries: DataFrame, features: DataFrame, modules: Mapping[str, Sequence[str]],
                  keep: Sequence[str], minimum: float = MIN_MAPPED_FRACTION,
                  feature_keys: Sequence[str] = ()) -> DataFrame:
    """Mean log1p(CPM) over mapped genes per (library, module), gated by coverage and total.

    A gene is mapped if the library's own feature table lists it: ``feature_keys`` name the columns,
    shared by both tables, that tell platforms apart.  Only mapped genes count, in the sum and in
    the denominator; a mapped gene without a count adds log1p(0) = 0.
    """
    total = F.col("total_umi_included_cells")
    sums = ", ".join(
        f"struct('{m}' AS module_id, {len(genes)} AS _configured, _sets.n{i} AS _mapped, _sets.s{i} AS _sum)"
        for i, (m, genes) in enumerate(modules.items()))
    rows = (with_set_sums(libraries, features, modules, total, feature_keys)
            .select(*keep, "included_cells", "total_umi_included_cells", F.expr(f"inline(array({sums}))"))
            .withColumn("mapped_fraction", F.col("_mapped") / F.col("_configured")))
    ready = (F.col("mapped_fraction") >= minimum) & (total > 0)
    return rows.select(
        *keep, "module_id", F.when(ready, F.col("_sum") / F.col("_mapped")).alias("module_score"),
        F.when(ready, F.lit(SCORE_AVAILABLE)).otherwise(F.lit(SCORE_BLOCKED)).alias("score_status"),
        "mapped_fraction", "included_cells", "total_umi_included_cells")


def threshold_table(libraries: DataFrame, keep: Sequence[str], thresholds: Sequence[int]) -> DataFrame:
    """Libraries × thresholds with the eligibility flag (thresholds are configuration)."""
    return (libraries.select(*keep, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
            .withColumn("threshold", F.col("threshold").cast("long"))
            .withColumn("threshold_pass", F.col("included_cells") >= F.col("threshold")))


def threshold_run_summary(eligibility: DataFrame) -> DataFrame:
    return (eligibility.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("libraries_scored"),
        F.count_if("threshold_pass").alias("libraries_passing"),
        F.count_if(~F.col("threshold_pass")).alias("libraries_failing"),
        F.min("included_cells").alias("minimum_included_cells"))
        .withColumn("threshold_run_status", F.when(
            F.col("libraries_failing") == 0, F.lit("all_libraries_scored"))
            .otherwise(F.lit("unexpected_below_threshold_library_in_output"))))


def compare_to_reference(rows: DataFrame, keys: Sequence[str], setting: str, reference,
                         values: Sequence[str], settings: Sequence) -> DataFrame:
    """Rows at each setting beside the rows at the reference setting (full outer join).

    The reference rows are replicated once per setting (settings are configuration), so the
    join is an equi join on setting and keys.  ``row_match_status`` is both / left_only /
    right_only, left being the reference.
    """
    keys = list(keys)
    base = (rows.where(F.col(setting) == reference)
            .select(*keys, *[F.col(v).alias(f"{v}_reference") for v in values], F.lit(1).alias("_l"))
            .withColumn(setting, F.explode(F.array(*[F.lit(s) for s in settings]))))
    base = base.withColumn(setting, F.col(setting).cast(rows.schema[setting].dataType))
    current = rows.select(setting, *keys, *[F.col(v).alias(f"{v}_current") for v in values],
                          F.lit(1).alias("_r"))
    joined = base.join(current, [setting, *keys], "full")
    status = (F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("both"))
              .when(F.col("_l").isNotNull(), F.lit("left_only")).otherwise(F.lit("right_only")))
    return joined.withColumn("row_match_status", status).drop("_l", "_r")


def score_identity(compared: DataFrame, setting: str) -> DataFrame:
    """Per setting: key match, largest score change, equal cell counts, identity status."""
    both = F.col("row_match_status") == "both"
    same_cells = F.col("included_cells_reference").eqNullSafe(F.col("included_cells_current"))
    out = compared.groupBy(setting).agg(
        F.count_if(F.col("row_match_status") != "right_only").alias("score_rows_reference"),
        F.count_if(F.col("row_match_status") != "left_only").alias("score_rows_current"),
        F.count_if(both).alias("matched_score_rows"),
        F.count_if(F.col("row_match_status") == "left_only").alias("reference_only_score_rows"),
        F.count_if(F.col("row_match_status") == "right_only").alias("current_only_score_rows"),
        F.max(F.abs(F.col("module_score_reference") - F.col("module_score_current")))
        .alias("maximum_absolute_score_delta"),
        F.count_if(both & ~same_cells).alias("_cells_differ"))
    matched = F.col("matched_score_rows")
    identical = ((matched == F.col("score_rows_reference")) & (matched == F.col("score_rows_current"))
                 & (F.col("maximum_absolute_score_delta") == 0.0) & (F.col("_cells_differ") == 0))
    return out.withColumns({
        "included_cell_counts_identical": (matched > 0) & (F.col("_cells_differ") == 0),
        "score_identity_status": F.when(identical, F.lit("identical_score_keys_and_values"))
        .otherwise(F.lit("different_score_keys_or_values")),
    }).drop("_cells_differ")


def effect_stability(compared: DataFrame) -> DataFrame:
    """Effect change against the reference setting and direction agreement."""
    both = F.col("row_match_status") == "both"
    return compared.withColumns({
        "effect_delta": F.when(both, F.col("effect_current") - F.col("effect_reference")),
        "effect_directions_agree": F.when(
            both, F.col("effect_direction_reference") == F.col("effect_direction_current")),
    })


# ---------------------------------------------------------------- feature × sample matrices

def resolve_duplicate_symbols(rows: DataFrame, symbols: Sequence[str], canonical: Mapping[str, str],
                              position: str = "line_no", feature: str = "feature_id") -> tuple[DataFrame, DataFrame]:
    """Keep one row per symbol; return (kept rows, decisions about configured symbols).

    A configured symbol with several rows keeps its declared canonical id.  Without a declared id
    (``undeclared_duplicate``) or without a row of it (``canonical_id_absent``) nothing says which row
    is meant: the symbol has a decision but no kept row, so it is not scored.  Any other symbol keeps
    its first row; rows without a symbol are left out.
    ``min_by`` combines map-side, so a symbol with very many rows is no problem.
    """
    from ..functions.config import config_table, strings

    canon = config_table(rows.sparkSession,
                         [{"symbol": s.upper(), "canonical_id": i} for s, i in canonical.items()],
                         strings("symbol", "canonical_id"))
    rank = F.struct(F.when(F.col(feature) == F.col("canonical_id"), 0).otherwise(1), F.col(position))
    rows = rows.where(~X.is_blank("symbol"))
    tagged = rows.join(canon, "symbol", "left")
    best = tagged.groupBy("symbol", "canonical_id").agg(
        F.min_by(F.struct(feature, position), rank).alias("_kept"), F.count(F.lit(1)).alias("rows_for_symbol"))
    wanted = [s.strip().upper() for s in symbols]
    decisions = (best.where(F.col("symbol").isin(wanted) & (F.col("rows_for_symbol") > 1))
                 .select("symbol", "rows_for_symbol", F.when(F.col(f"_kept.{feature}") == F.col("canonical_id"), F.col("canonical_id")).alias("kept_feature_id"),
                         F.when(F.col("canonical_id").isNull(), F.lit("undeclared_duplicate"))
                         .when(F.col(f"_kept.{feature}") == F.col("canonical_id"), F.lit("canonical_id_kept"))
                         .otherwise(F.lit("canonical_id_absent")).alias("decision")))
    unresolved = F.col("symbol").isin(wanted) & (F.col("rows_for_symbol") > 1) & ~F.coalesce(
        F.col(f"_kept.{feature}") == F.col("canonical_id"), F.lit(False))
    kept = (rows.join(best.where(~unresolved).select("symbol", F.col(f"_kept.{feature}").alias(feature),
                                  F.col(f"_kept.{position}").alias(position)),
                      ["symbol", feature, position], "left_semi"))
    return kept, decisions


def unpivot_samples(matrix: DataFrame, ids: Sequence[str], samples: Sequence[str]) -> DataFrame:
    """Wide feature × sample rows to (ids, sample, value); sample columns are few by design."""
    return matrix.unpivot(list(ids), list(samples), "sample", "value")


def sample_scores(values: DataFrame, modules: Mapping[str, Sequence[str]], scale: str,
                  minimum: float = MIN_MAPPED_FRACTION) -> DataFrame:
    """Module scores of a feature × sample matrix (``sample, symbol, value``; one row a symbol).

    ``scale='counts'`` uses log1p(CPM) with the sample total over all features; any processed
    scale (FPKM, RPKM, TPM) uses log1p(value).
    """
    symbols = sorted({g.strip().upper() for genes in modules.values() for g in genes})
    wanted = F.col("symbol").isin(symbols)
    # (sample, symbol) combines map-side; other symbols fold into one NULL-symbol row.
    per_symbol = values.groupBy("sample", F.when(wanted, F.col("symbol")).alias("symbol")).agg(
        F.sum("value").alias("_sum"))
    per_sample = per_symbol.groupBy("sample").agg(
        F.sum("_sum").alias("sample_total"),
        F.map_from_entries(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("symbol", "_sum"))))
        .alias("counts"))
    rows = per_sample.select("sample", "sample_total", "counts", F.inline(_set_structs(modules)))
    mapped = F.filter("genes", lambda g: F.map_contains_key("counts", g))
    rows = rows.withColumn("_mapped", mapped).withColumn(
        "mapped_fraction", F.size("_mapped") / F.size("genes"))
    one = ((lambda g: X.log1p_cpm(F.element_at("counts", g), "sample_total")) if scale == "counts"
           else (lambda g: X.log1p_value(F.element_at("counts", g))))
    total = F.aggregate("_mapped", F.lit(0.0), lambda acc, g: acc + one(g))
    ready = F.col("mapped_fraction") >= minimum
    return rows.select(
        "sample", "module_id", F.size("_mapped").cast("long").alias("mapped_genes"), "mapped_fraction",
        F.when(ready, total / F.size("_mapped")).alias("module_score"),
        F.when(ready, F.lit(SCORE_AVAILABLE)).otherwise(F.lit("mapping_below_minimum")).alias("score_status"))



def union_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack score tables; absent optional columns get their declared defaults.

    Defaults: ``score_status`` is ``score_available``, ``mapped_fraction`` is 1, any other
    missing column is NULL.
    """
    defaults = {"score_status": F.lit(SCORE_AVAILABLE), "mapped_fraction": F.lit(1.0)}
    filled = [df.withColumns({n: d for n, d in defaults.items() if n not in df.columns}) for df in tables]
    out = filled[0]
    for df in filled[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out

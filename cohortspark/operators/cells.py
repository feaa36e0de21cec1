"""Per-cell quality, panel scores and rule-based labels.

``cell_profiles`` reads the triples once and keeps one row per cell: totals and the counts
of the configured symbols.  QC, panel scores, labels and pseudobulks are projections or
re-aggregations of that row, so the large table is scanned and shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.config import (
    BROADCAST_CONFIG_ROWS, broadcast_if_small, check_feature_sets, config_table, feature_set_table, literal_array)
from ..functions.lineage import evaluate_once, settle, spread, spread_if_even


#: Configured symbols that are looked up in a literal list; more of them are joined.
LISTED_SYMBOLS = 256


@dataclass(frozen=True)
class QcRule:
    """Default limits for sparse cell matrices."""

    min_detected: int = 200
    min_total: int = 500
    max_mt_pct: float = 20.0
    mt_prefix: str = "MT-"


@dataclass(frozen=True)
class LabelRule:
    """Default label limits.  ``exclusion`` is in rule order."""

    min_support_detected: int = 1
    min_support_score: float = 0.2
    min_exclusion_detected: int = 3
    min_exclusion_score: float = 2.0
    margin: float = 0.2
    support: Mapping[str, str] = field(
        default_factory=lambda: {"AF": "AF_support", "NP": "NP_support"})
    exclusion: tuple[tuple[str, str], ...] = (
        ("immune", "immune_exclusion"), ("endothelial", "endothelial_exclusion"),
        ("mural", "mural_exclusion"), ("erythroid", "erythroid_exclusion"))


def configured_symbols(*collections: Mapping[str, Sequence[str]]) -> list[str]:
    """Distinct normalised symbols of all feature sets: the bound on a cell's count map."""
    seen = {}
    for sets in collections:
        check_feature_sets(sets)
        for genes in sets.values():
            for gene in genes:
                seen[gene.strip().upper()] = None
    return list(seen)


def cell_profiles(triples: DataFrame, symbols: Sequence[str], mt_prefix: str = "MT-",
                  keys: Sequence[str] = ("library_id", "cell_id"), features: DataFrame | None = None) -> DataFrame:
    """One row per cell with entries: total, detected entries, mt total, symbol counts.

    One shuffle: everything combines map-side, so a hot cell arrives as one row per task.  With ``features``
    the entries themselves are shuffled where all tasks get about equally many: a map-side row per cell is
    as wide as the configuration, and a cell's few entries take less.  ``triples`` bring their ``symbol``, or only a ``feature_id`` of ``features`` (feature_id, symbol): then a symbol is
    looked at once per feature, and the entries meet a number and a flag instead of texts.
    ``counts`` is a struct with one field per configured symbol (NULL where the cell has no
    entry); its width is the configuration's, whatever the number of features.
    """
    value = F.col("value")
    # By expression up to a bound: a table of features keeps its known size, so a small one is still broadcast.
    if len(symbols) <= LISTED_SYMBOLS:
        slot = F.nullif(F.array_position(literal_array(symbols), F.col("symbol")), F.lit(0)).cast("int") - 1
        placed = (triples if features is None else features).withColumn("_slot", slot)
    else:
        index = config_table(triples.sparkSession, [{"symbol": s, "_slot": i} for i, s in enumerate(symbols)],
                             pa.schema([("symbol", pa.string()), ("_slot", pa.int32())]))
        placed = (triples if features is None else features).join(index, "symbol", "left")
    marks = (F.col("_slot"), F.col("symbol").startswith(mt_prefix).alias("_mt"))
    if features is None:
        placed = placed.select(*keys, "value", *marks)
    else:
        placed = triples.select(*keys, "feature_id", "value").join(placed.select("feature_id", *marks), "feature_id")
        placed = spread_if_even(placed, triples, *keys)
    # One SQL text for the wide struct: a configuration has many symbols.
    counts = ", ".join(f"sum(CASE WHEN _slot = {i} THEN value END) AS {quoted(s)}" for i, s in enumerate(symbols))
    return placed.groupBy(*keys).agg(
        F.sum(value).alias("total_umi"),
        F.count_if(value > 0).alias("detected_genes"),
        F.sum(F.when(F.col("_mt"), value).otherwise(F.lit(0))).alias("mt_umi"),
        F.expr(f"struct({counts}) AS counts"))


def quoted(name: str) -> str:
    """A symbol as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def symbol_count(symbol: str) -> str:
    """SQL text: count of one configured symbol, zero where there is none."""
    return f"coalesce(counts.{quoted(symbol.strip().upper())}, 0L)"


def cell_metrics(cells: DataFrame, profiles: DataFrame, rule: QcRule = QcRule(),
                 keys: Sequence[str] = ("library_id", "cell_id")) -> DataFrame:
    """Every listed cell with its metrics; cells without entries get zeros.

    Cells are spread by number: coalesced to just over one task per core, the widest step of a query
    had two or three tasks left over for a second turn.
    """
    zero = F.lit(0).cast("long")
    joined = spread(cells, *keys).join(profiles, list(keys), "left")
    metrics = {name: F.coalesce(F.col(name), zero) for name in ("total_umi", "detected_genes", "mt_umi")}
    out = joined.withColumns(metrics).withColumn(
        "pct_mt", F.when(F.col("total_umi") == 0, F.lit(0.0)).otherwise(
            F.lit(100.0) * F.col("mt_umi") / F.col("total_umi")))
    reason = X.reason_list(
        (F.col("detected_genes") < rule.min_detected, "detected_genes_below_min"),
        (F.col("total_umi") < rule.min_total, "umi_below_min"),
        (F.col("pct_mt") >= rule.max_mt_pct, "mt_pct_at_or_above_max"))
    return out.withColumn("qc_reason", reason).withColumn("qc_pass", F.col("qc_reason") == "pass")


def library_qc(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells, passes, exclusions and the ``reason=count`` list of each library."""
    keys = list(keys)
    by_reason = cells.groupBy(*keys, "qc_reason").agg(F.count(F.lit(1)).alias("_n"))
    failed = F.col("qc_reason") != "pass"
    return by_reason.groupBy(*keys).agg(
        F.sum("_n").alias("barcodes"),
        F.coalesce(F.sum(F.when(~failed, F.col("_n"))), F.lit(0)).alias("qc_cells"),
        # Bounded: one entry per combination of the three reasons.
        F.array_join(F.array_sort(F.collect_list(
            F.when(failed, F.concat_ws("=", "qc_reason", F.col("_n").cast("string"))))), ";")
        .alias("exclusion_reason_counts"),
    ).withColumns({
        "excluded_cells": F.col("barcodes") - F.col("qc_cells"),
        "qc_fraction": F.col("qc_cells") / F.col("barcodes"),
    })


def threshold_flags(rows: DataFrame, keys: Sequence[str], condition: Column,
                    thresholds: Sequence[int], count_name: str = "qc_cells") -> DataFrame:
    """Rows, rows meeting ``condition``, and one pass flag per threshold."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_cells"),
                                      F.count_if(condition).alias(count_name))
    return counted.withColumns(
        {f"threshold_{t}_pass": F.col(count_name) >= t for t in thresholds})


def measured_members(features: DataFrame, sets: Mapping[str, Sequence[str]],
                     set_name: str = "panel", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, set, sorted measured symbols, duplicate feature rows); one row per set with a hit.

    ``features`` is the feature table of one platform, or of several told apart by ``keys``.  The
    result is bounded by platforms and configuration, whatever the size of the feature tables.
    """
    members = feature_set_table(features.sparkSession, sets, set_name, "symbol")
    per_symbol = (features.groupBy(*keys, "symbol").agg(F.count_distinct("feature_id").alias("_ids"))
                  .join(members, "symbol"))
    return per_symbol.groupBy(*keys, set_name).agg(
        F.array_sort(F.collect_list("symbol")).alias("measured"),
        F.sum(F.col("_ids") - 1).alias("duplicate_feature_rows"))


def with_measured(rows: DataFrame, features: DataFrame, sets: Mapping[str, Sequence[str]],
                  keys: Sequence[str] = (), flags: bool = False) -> DataFrame:
    """Add ``_measured``: set -> places, among ``configured_symbols(sets)``, of the symbols that the row's platform measures.

    With ``flags`` it is a text instead, with 1 for each measured member of each set and 0 for the
    others, sets and members in the order of ``member_places``.

    With ``keys`` (columns of both sides) each row meets the feature table of its own library or
    platform by an equi join with one small row per platform; a platform without any configured
    symbol leaves NULL.  The rows of a few platforms are broadcast: a shuffle on ``keys`` would give
    all cells of a platform to one task.  Without keys all rows share one table, read as a scalar subquery.
    """
    table = measured_members(features, sets, "_set", keys)
    symbols = literal_array(configured_symbols(sets))
    places = F.array_sort(F.transform("measured", lambda s: F.array_position(symbols, s).cast("int") - 1))
    entries = F.map_from_entries(F.collect_list(F.struct("_set", places.alias("places")))).alias("_measured")
    platforms = table.groupBy(*keys).agg(entries)
    if flags:
        marks = ", ".join(f"transform(array({', '.join(map(str, members))}), i -> if(array_contains({measured_places(name)}, i), '1', '0'))"
                          for name, members in member_places(sets).items())
        platforms = platforms.withColumn("_measured", F.expr(f"array_join(flatten(array({marks})), '')"))
    if not keys:
        return rows.withColumn("_measured", platforms.scalar())
    platforms, _ = broadcast_if_small(settle(platforms), BROADCAST_CONFIG_ROWS)
    return rows.join(platforms, list(keys), "left")


def member_places(sets: Mapping[str, Sequence[str]]) -> dict[str, list[int]]:
    """Places of each set's symbols among ``configured_symbols(sets)``, in rising order."""
    place = {s: i for i, s in enumerate(configured_symbols(sets))}
    return {name: sorted(place[g.strip().upper()] for g in genes) for name, genes in sets.items()}


def with_set_sums(rows: DataFrame, features: DataFrame, sets: Mapping[str, Sequence[str]], total: Column,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Add ``_sets``: for the i-th set its measured symbols ``n{i}``, the sum ``s{i}`` of their terms
    log1p(1e6 * count / total), and the number ``p{i}`` of positive terms.

    The sum is NULL where a measured term is none (no total, or a ratio of -1 or less).  Whole batches
    are summed by column: as expressions of one row these sums were most of the work of a query.
    """
    sums = F.arrow_udf(_set_sums([*member_places(sets).values()], len(configured_symbols(sets))),
                       ", ".join(f"n{i} int, s{i} double, p{i} bigint" for i in range(len(sets))))
    counts = F.struct(*[F.col(f"counts.{quoted(s)}").alias(f"c{i}") for i, s in enumerate(configured_symbols(sets))])
    width = sum(len(genes) for genes in sets.values())
    marked = with_measured(rows, features, sets, keys, flags=True)
    flags = F.coalesce("_measured", F.lit("0" * width))
    return evaluate_once(marked, {"_sets": sums(flags, total.cast("double"), counts)}).drop("_measured")


def _set_sums(sets: list[list[int]], symbols: int):
    """The batch function of ``with_set_sums``; ``sets`` are places among the ``symbols`` counts."""
    width = sum(map(len, sets))

    def sums(flags: pa.Array, total: pa.Array, counts: pa.Array) -> pa.Array:
        import numpy as np

        rows = len(total)
        # All flag texts have ``width`` bytes.
        marks = flags.cast(pa.binary())
        start = int(np.frombuffer(marks.buffers()[1], dtype=np.int32)[marks.offset]) if rows else 0
        bits = (np.frombuffer(marks.buffers()[2], dtype=np.uint8, count=rows * width, offset=start) if rows else
                np.zeros(0, dtype=np.uint8)).reshape(rows, width) == ord("1")
        known = np.asarray(total.is_valid())
        per = total.fill_null(0.0).to_numpy(zero_copy_only=False)
        terms, none = [], []
        with np.errstate(all="ignore"):
            # Most cells have no entry of a symbol: those terms are made once.
            zero = np.log1p(1e6 * 0.0 / per)
            lacking = ~known | (per == 0)
            for count in counts.flatten():
                at = np.flatnonzero(count.is_valid())
                ratio = 1e6 * count.drop_null().to_numpy(zero_copy_only=False).astype(float) / per[at]
                term, lost = zero.copy(), lacking
                term[at] = np.log1p(ratio)
                if (ratio <= -1).any():
                    lost = lacking.copy()
                    lost[at] |= ratio <= -1
                terms.append(term)
                none.append(lost)
        assert len(terms) == symbols
        positive_terms = [~(t <= 0) & ~n for t, n in zip(terms, none)]
        some_none = [n.any() for n in none]
        out, at = {}, 0
        for i, places in enumerate(sets):
            size, positive, amount = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int64), np.zeros(rows)
            absent = np.zeros(rows, dtype=bool)
            for place in places:
                measured = np.ascontiguousarray(bits[:, at])
                size += measured
                amount += np.where(measured, terms[place], 0.0)
                positive += measured & positive_terms[place]
                if some_none[place]:
                    absent |= measured & none[place]
                at += 1
            out |= {f"n{i}": pa.array(size), f"s{i}": pa.array(amount, mask=absent), f"p{i}": pa.array(positive)}
        return pa.StructArray.from_arrays(list(out.values()), names=list(out))

    return sums


def measured_places(name: str) -> str:
    """SQL text: places of a set's measured symbols; empty where the platform measures none."""
    return f"coalesce(_measured[{text_literal(name)}], cast(array() AS array<int>))"


def measured_size(name: str) -> str:
    """SQL text: measured symbols of a set in ``_measured``."""
    return f"array_size({measured_places(name)})"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def panel_columns(cells: DataFrame, features: DataFrame, panels: Mapping[str, Sequence[str]],
                  denominator: str = "measured", feature_keys: Sequence[str] = ()) -> DataFrame:
    """Add ``<panel>_score`` and ``<panel>_detected_genes`` for every panel.

    ``denominator``: ``measured`` divides by the symbols of the panel that the cell's own platform
    measures (``feature_keys`` name its columns), ``configured`` by all configured ones.  Only
    measured symbols count; a panel without any scores 0.
    """
    added = {}
    for i, (panel, genes) in enumerate(panels.items()):
        size = f"_sets.n{i}" if denominator == "measured" else str(len(genes))
        added[f"{panel}_score"] = F.expr(f"CASE WHEN {size} > 0 THEN _sets.s{i} / {size} ELSE 0D END")
        added[f"{panel}_detected_genes"] = F.col(f"_sets.p{i}")
    cells = with_set_sums(cells, features, panels, F.greatest("total_umi", F.lit(1)), feature_keys)
    return cells.withColumns(added).drop("_sets")


def panel_rows(cells: DataFrame, panels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form (cell, panel, score, detected) of ``panel_columns``; no shuffle."""
    entries = ", ".join(f"struct('{p}' AS panel, {p}_score AS score, {p}_detected_genes AS detected_genes)"
                        for p in panels)
    return cells.select(*keep, F.expr(f"inline(array({entries}))"))


def label_cells(cells: DataFrame, source: str = "compartment", rule: LabelRule = LabelRule(),
                collapse_nonresident: bool = False) -> DataFrame:
    """Priority rules -> label, reason, discordance, support status and include flag."""
    src = F.upper(F.trim(F.col(source)))
    codes = list(rule.support)
    support = F.lit(False)
    discordant = F.lit(False)
    for code, panel in rule.support.items():
        other = next(p for c, p in rule.support.items() if c != code)
        support = support | ((src == code)
                             & (F.col(f"{panel}_detected_genes") >= rule.min_support_detected)
                             & (F.col(f"{panel}_score") >= rule.min_support_score))
        discordant = discordant | ((src == code)
                                   & (F.col(f"{other}_score") > F.col(f"{panel}_score") + rule.margin))
    first_exclusion = F
    for name, panel in rule.exclusion:
        first_exclusion = first_exclusion.when(
            (F.col(f"{panel}_detected_genes") >= rule.min_exclusion_detected)
            & (F.col(f"{panel}_score") >= rule.min_exclusion_score), F.lit(name))
    prepared = cells.withColumns({"_source": src, "_support": support,
                                  "_exclusion": first_exclusion.otherwise(F.lit(None)),
                                  "source_marker_discordant": discordant})
    excluded = F.col("_exclusion").isNotNull()
    known = F.col("_source").isin(codes)
    nonresident = F.lit("nonresident") if collapse_nonresident else F.concat(
        F.lit("nonresident_"), F.col("_exclusion"))
    label = (F.when(F.col("_support") & excluded, F.lit("mixed_or_nonresident"))
             .when(excluded, nonresident)
             .when(known, F.concat(F.lit("source_"), F.col("_source"), F.lit("_nonexcluded")))
             .otherwise(F.lit("ambiguous")))
    status = (F.when(F.col("_support"), F.lit("supporting"))
              .when(known & ~excluded, F.lit("support_insufficient"))
              .otherwise(F.lit("not_applicable")))
    return prepared.withColumns({"annotation_label": label, "source_support_status": status}).withColumn(
        "include", F.col("annotation_label").isin([f"source_{c}_nonexcluded" for c in codes])
    ).drop("_source", "_support", "_exclusion")


def label_names(rule: LabelRule = LabelRule()) -> list[str]:
    """All labels the rules can give, in rule order."""
    return (["mixed_or_nonresident"] + [f"nonresident_{n}" for n, _ in rule.exclusion]
            + [f"source_{c}_nonexcluded" for c in rule.support] + ["ambiguous"])


def label_counts(cells: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Cells per label with fixed label columns."""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("qc_cells"),
        *[F.count_if(F.col("annotation_label") == name).alias(name) for name in labels])


def panel_coverage(features: DataFrame, panels: Mapping[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Configured and measured symbols per (keys, panel); unmeasured panels appear with 0.

    A symbol is measured if the feature table of ``keys`` lists it, whether or not it has counts.
    """
    platforms = features.select(*keys).distinct()
    rows = ", ".join(f"struct('{p}' AS panel, {len(genes)}L AS configured_genes, cast({measured_size(p)} AS bigint) AS measured_genes)"
                     for p, genes in panels.items())
    return with_measured(platforms, features, panels, keys).select(*keys, F.expr(f"inline(array({rows}))")).withColumn(
        "measured_fraction", F.col("measured_genes") / F.col("configured_genes"))

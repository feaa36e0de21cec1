"""The two end-to-end jobs: cells -> module scores, and scores -> effects -> synthesis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..operators import cells as C
from ..operators import effects as E
from ..operators import gates as G
from ..operators import scores as S
from ..operators import synthesis as M

LIBRARY = ("dataset", "library_id", "donor_id", "compartment", "severity_group")
CELL = ("library_id", "cell_id")


def score_cells(triples: DataFrame, cells: DataFrame, features: DataFrame,
                modules: Mapping[str, Sequence[str]], panels: Mapping[str, Sequence[str]],
                qc: C.QcRule = C.QcRule(), labels: C.LabelRule = C.LabelRule(),
                library: Sequence[str] = LIBRARY, cell: Sequence[str] = CELL,
                retained: int = 30, feature_keys: Sequence[str] = (), strict: bool = True,
                library_id: str = "library_id") -> dict[str, DataFrame]:
    """Triples to cell QC, labels, library ledger, mapping audit and module scores.

    ``cells`` lists every barcode with its library's ledger columns.  Libraries below
    ``retained`` included cells keep their row and a failing status.  ``feature_keys`` are the
    columns that tie a library to its feature table where ``features`` holds several platforms.

    A donor with several libraries in one compartment, or a library with several sets of metadata, is
    an error: technical libraries are to be merged before scoring.  With ``strict`` false the faults
    only stand in ``gates``.
    """
    symbols = C.configured_symbols(modules, panels)
    measured = C.cell_metrics(cells, C.cell_profiles(triples, symbols, qc.mt_prefix, cell), qc, cell)
    measured = settle(measured)
    annotated = C.label_cells(C.panel_columns(
        measured.where("qc_pass"), features, panels, feature_keys=feature_keys), "compartment", labels)
    libraries = settle(S.library_profiles(annotated.where("include"), library, symbols))
    # The ledger is already written: its gates read a small table and no cell again.
    fields = [c for c in library if c != library_id]
    gates = settle(G.library_contract(libraries, [c for c in fields if c != "severity_group"], library_id, fields))
    if strict:
        G.require(gates)
    return {
        "gates": gates,
        "cell_qc": measured.drop("counts"),
        "library_qc": C.library_qc(measured, list(library)),
        "annotation": annotated.drop("counts"),
        "library_ledger": libraries.drop("counts").withColumn(
            "retained_cells_pass", F.col("included_cells") >= retained),
        "mapping_audit": S.mapping_audit(features, modules, feature_keys),
        "module_scores": S.module_scores(libraries, features, modules, list(library), feature_keys=feature_keys),
    }


def contrast_scores(scores: DataFrame, spec: DataFrame, replicates: int = E.REPLICATES,
                    seed: int = E.SEED, strict: bool = True) -> dict[str, DataFrame]:
    """Module scores to arms, effects with all intervals, leave-one-out and alignment.

    A blank donor, a donor in both arms of a contrast, or a donor with several rows of a module is an
    error before anything is estimated; with ``strict`` false the faults only stand in ``gates``.
    """
    arms = settle(E.retained_arms(E.assign_arms(scores, spec)))
    gates = settle(G.donor_contract(arms))
    if strict:
        G.require(gates)
    loo = E.leave_one_out(arms)
    effects = E.welch_interval(E.mean_difference(E.contrast_moments(arms)))
    effects = (effects.join(E.donor_bootstrap(arms, replicates=replicates, seed=seed).drop("comparison_n", "target_n"),
                            E.CONTRAST, "left")
               .join(E.direction_retention(loo).drop("full_effect_direction"), E.CONTRAST, "left"))
    # What the specification says of a contrast; without it, one orientation and no confirmatory cohort.
    stated = {"severity_orientation": "severity_orientation", "cohort_role": "analysis_role", "confirmatory_eligible": "confirmatory_eligible"}
    context = spec.select("cohort_id", "compartment", *[
        (F.col(c) if c in spec.columns else F.lit("False" if name == "confirmatory_eligible" else "")).alias(name)
        for name, c in stated.items()]).distinct()
    return {"gates": gates, "arms": arms, "ingestion_audit": E.ingestion_audit(scores, spec), "effects": effects,
            "leave_one_out": loo, "group_descriptives": E.group_descriptives(arms),
            "direction_consistency": E.direction_consistency(effects.join(context, ["cohort_id", "compartment"]))}


def pool_effects(arms: DataFrame, keys: Sequence[str] = ("module_id", "compartment"),
                 scenarios: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Arms to standardised effects, the pooled model and its sensitivity variants."""
    wide = M.wide_arms(E.arm_moments(arms), E.CONTRAST)
    studies = settle(M.standardized_effects(wide.where(M.poolable(wide))))
    models = {"hedges_reml": ("hedges_g", "hedges_g_variance", "REML"),
              "smdh_pm": ("smdh", "smdh_variance", "PM")}
    out = {"studies": M.study_intervals(studies, "smdh", "smdh_variance"),
           "primary": M.adjust_bh(settle(M.random_effects(studies, keys)), list(keys)[1:], "p_value"),
           "sensitivity": M.model_sensitivity(studies, keys, models),
           "leave_one_out": M.leave_one_study_out(studies, keys)}
    if scenarios:
        out["scenarios"] = M.scenario_synthesis(studies, keys, scenarios)
    return out

"""Data-quality gates: one row per check with ``gate, scope, violations, status``.

A gate is a DataFrame like any other.  ``require`` turns a failing gate into an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


class GateError(ValueError):
    """A strict gate failed."""


def gate_rows(rows: DataFrame, scope: Column, checks: Mapping[str, Column]) -> DataFrame:
    """Count the rows that violate each named condition, per scope: one pass over the data."""
    counted = rows.groupBy(scope.alias("scope")).agg(
        *[F.count_if(F.coalesce(c, F.lit(True))).alias(name) for name, c in checks.items()])
    return with_status(counted.unpivot(["scope"], list(checks), "gate", "violations"))


def with_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("violations") == 0, F.lit("pass")).otherwise(
        F.lit("fail"))).select("gate", "scope", "violations", "status")


#: Status of a fault that a tolerant gate counts but lets pass.
TOLERATED = "tolerated"


def tolerant(gates: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named checks count their faults without failing."""
    lenient = (F.col("status") == "fail") & F.col("gate").isin(list(names))
    return gates.withColumn("status", F.when(lenient, F.lit(TOLERATED)).otherwise(F.col("status")))


def require(gates: DataFrame, limit: int = 20) -> None:
    """Raise with the first failing checks; at most ``limit`` rows reach the driver."""
    failed = gates.where(~F.col("status").isin("pass", TOLERATED)).limit(limit).collect()
    if failed:
        raise GateError("; ".join(f"{r['gate']} [{r['scope']}]: {r['violations']}" for r in failed))


def duplicate_gate(rows: DataFrame, keys: Sequence[str], name: str, scope: str) -> DataFrame:
    """Number of keys met more than once."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return with_status(repeated.agg(F.count_if(F.col("_n") > 1).alias("violations")).select(
        F.lit(name).alias("gate"), F.lit(scope).alias("scope"), "violations"))


def spec_gate(spec: DataFrame, required: Sequence[str], comparison: str, target: str, boolean: str,
              key: Sequence[str]) -> DataFrame:
    """Required fields, distinct contrast values, strict booleans and a unique key."""
    checks = {f"blank_{c}": X.is_blank(c) for c in required}
    checks["same_contrast_values"] = F.col(comparison).eqNullSafe(F.col(target))
    checks["invalid_boolean"] = X.parse_bool_strict(boolean).isNull()
    return gate_rows(spec, F.lit("contrast_specification"), checks).unionByName(
        duplicate_gate(spec, key, "duplicate_contrast", "contrast_specification"))


def ledger_gate(ledger: DataFrame, required: Sequence[str], donor_candidates: Sequence[str],
                scope: Column) -> DataFrame:
    """Mandatory ledger fields and a usable donor key."""
    checks = {f"blank_{c}": X.is_blank(c) for c in required}
    checks["no_donor_key"] = X.donor_key(*donor_candidates).isNull()
    return gate_rows(ledger, scope, checks)


def value_gate(rows: DataFrame, value: str, scope: Column, integer: bool) -> DataFrame:
    """Finite, non-negative and, where demanded, integer values."""
    v = F.col(value)
    finite = X.finite(v)
    checks = {"not_finite": finite.isNull(), "negative": F.coalesce(finite < 0, F.lit(False))}
    if integer:
        checks["not_integer"] = F.coalesce(finite != F.floor(finite), F.lit(False))
    return gate_rows(rows, scope, checks)


def retained_cells_gate(libraries: DataFrame, keep: Sequence[str], minimum: int,
                        count: str = "included_cells") -> DataFrame:
    """Status per library instead of an aborted run."""
    return libraries.select(*keep, count, F.when(
        F.col(count) >= minimum, F.lit("pass")).otherwise(F.lit("below_minimum_retained_cells"))
        .alias("retained_cells_status"))


def arm_gate(wide: DataFrame, scope: Column) -> DataFrame:
    """Every synthesis arm: exactly one row, n >= 2, sd > 0."""
    either = lambda f: f("target") | f("comparison")
    return gate_rows(wide, scope, {
        "arm_not_exactly_once": either(lambda a: F.col(f"{a}_rows") != 1),
        "arm_n_below_two": either(lambda a: F.coalesce(F.col(f"{a}_n") < 2, F.lit(True))),
        "arm_sd_not_positive": either(lambda a: ~F.coalesce(X.finite(f"{a}_sd") > 0, F.lit(False)))})


def role_gate(rows: DataFrame, scope: Column, eligible: str, role: str, expected_role: str,
              isolated: Column) -> DataFrame:
    """No confirmatory row, the expected role only, and no isolated cohort in the default set."""
    return gate_rows(rows, scope, {
        "confirmatory_eligible_row": ~F.coalesce(X.parse_bool_strict(eligible) == F.lit(False), F.lit(False)),
        "unexpected_role": ~F.col(role).eqNullSafe(F.lit(expected_role)),
        "isolated_cohort_in_default": isolated})


def ledger_score_agreement(scores: DataFrame, ledger: DataFrame, key: Sequence[str], minimum: int) -> DataFrame:
    """Retained-cell counts of scores and ledger agree and reach the minimum."""
    s = scores.select(*key, F.col("included_cells").alias("score_cells")).distinct()
    l = ledger.select(*key, F.col("included_cells").alias("ledger_cells"))
    joined = s.join(l, list(key), "full")
    return gate_rows(joined, F.lit("score_ledger"), {
        "library_missing_on_one_side": F.col("score_cells").isNull() | F.col("ledger_cells").isNull(),
        "retained_cell_counts_differ": F.coalesce(F.col("score_cells") != F.col("ledger_cells"), F.lit(False)),
        "below_minimum_retained_cells": F.coalesce(F.col("ledger_cells") < minimum, F.lit(False))})


def sensitivity_gate(identity: DataFrame, setting: str) -> DataFrame:
    """All settings identical to the reference run."""
    return gate_rows(identity, F.concat_ws("=", F.lit(setting), F.col(setting).cast("string")), {
        "scores_differ_from_reference": F.col("score_identity_status") != "identical_score_keys_and_values",
        "keys_differ_from_reference": (F.col("reference_only_score_rows") > 0) | (F.col("current_only_score_rows") > 0),
        "cell_counts_differ_from_reference": ~F.col("included_cell_counts_identical")})


def synthesis_package_gate(results: DataFrame, scope: Column, expected_k: int, numbers: Sequence[str]) -> DataFrame:
    """Expected number of studies and finite results in every pooled row."""
    missing = F.lit(False)
    for n in numbers:
        missing = missing | X.finite(n).isNull()
    return gate_rows(results, scope, {
        "unexpected_study_count": F.col("k") != expected_k,
        "missing_or_nonfinite_result": missing,
        "interval_excludes_estimate": F.coalesce(~F.col("pooled_effect").between(
            F.col("ci_lower"), F.col("ci_upper")), F.lit(True))})


def scenario_gate(config: DataFrame, scope: Column, scenario: str, expected: Mapping[str, Sequence[str]], position: str,
                  study: str = "cohort_id", eligible: str = "confirmatory_eligible") -> DataFrame:
    """Study lists of a configuration: exactly the expected ids in their order, and none confirmatory.

    config: one row per listed study with its ``position`` from 1.  Rows of a scenario that is not
    expected are faults, as are expected places that nobody fills.
    """
    # The lists are configuration.
    wanted = F.create_map(*[x for name, ids in expected.items() for x in (F.lit(name), F.array(*[F.lit(i) for i in ids]))])
    rows = config.withColumn("_want", F.get(F.element_at(wanted, F.col(scenario)), (F.col(position) - 1).cast("int")))
    counted = rows.groupBy(scope.alias("scope"), F.col(scenario).alias("_name")).agg(
        F.count_if(~F.col(study).eqNullSafe(F.col("_want"))).alias("_off"),
        F.count_if(F.col(study).eqNullSafe(F.col("_want"))).alias("_on"),
        F.count_if(~F.coalesce(X.parse_bool_strict(eligible) == F.lit(False), F.lit(False))).alias("_eligible"))
    size = F.coalesce(F.size(F.element_at(wanted, F.col("_name"))), F.lit(0))
    return gate_sums(counted, F.col("scope"), {
        "unexpected_study_order": F.col("_off"), "missing_studies": F.greatest(size - F.col("_on"), F.lit(0)),
        "confirmatory_eligible_study": F.col("_eligible")})


def synthesis_contract_gate(results: DataFrame, studies: DataFrame, scope: str, modules: Sequence[str], cohorts: Mapping[str, Sequence[str]],
                            measure: str, model: Mapping[str, str], module: str = "module_id", study: str = "cohort_id",
                            eligible: str = "confirmatory_eligible") -> DataFrame:
    """What a pooled table claims to be: module set, cohort set, effect measure, model, no confirmatory study; per ``scope``.

    results: scope, module, effect_measure and a column per entry of ``model``; studies: scope, study and
    ``eligible``.  ``cohorts`` gives the expected set of each scope.
    """
    named = F.array(*[F.lit(m) for m in modules])
    off = F.lit(False)
    for column, value in model.items():
        off = off | ~F.col(column).eqNullSafe(F.lit(value))
    tables = results.groupBy(scope).agg(
        F.count_if(~F.coalesce(F.array_contains(named, F.col(module)), F.lit(False))).alias("_other"),
        F.count_distinct(F.when(F.array_contains(named, F.col(module)), F.col(module))).alias("_found"),
        F.count_if(~F.coalesce(F.col("effect_measure").contains(measure), F.lit(False))).alias("_measure"), F.count_if(off).alias("_model"))
    first = gate_sums(tables, F.col(scope), {
        "unexpected_module_set": F.col("_other") + F.lit(len(set(modules))) - F.col("_found"),
        "unexpected_measure": F.col("_measure"), "unexpected_model": F.col("_model")})
    wanted = F.create_map(*[x for name, ids in cohorts.items() for x in (F.lit(name), F.array(*[F.lit(i) for i in ids]))])
    expected = F.coalesce(F.element_at(wanted, F.col(scope)), F.array().cast("array<string>"))
    inside = F.coalesce(F.array_contains(expected, F.col(study)), F.lit(False))
    sets = studies.groupBy(scope).agg(
        F.count_if(~inside).alias("_other"), F.count_distinct(F.when(inside, F.col(study))).alias("_found"),
        F.count_if(~F.coalesce(X.parse_bool_strict(eligible) == F.lit(False), F.lit(False))).alias("_eligible"))
    second = gate_sums(sets, F.col(scope), {
        "unexpected_cohort_set": F.col("_other") + F.size(expected) - F.col("_found"), "confirmatory_eligible_study": F.col("_eligible")})
    return first.unionByName(second)


def cell_mapping_gate(names: DataFrame, header: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """Cell-name file against matrix header: same id at each position, both unique."""
    a = names.select(key, position, F.col(name).alias("_a"))
    b = header.select(key, position, F.col(name).alias("_b"))
    order = a.join(b, [key, position], "full").groupBy(key).agg(
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("order_differs"))

    def repeats(df, column, out):
        return (df.groupBy(key, column).agg(F.count(F.lit(1)).alias("_n")).groupBy(key)
                .agg(F.count_if(F.col("_n") > 1).alias(out)))

    joined = (order.join(repeats(a, "_a", "repeated_cell_names"), key, "left")
              .join(repeats(b, "_b", "repeated_header_names"), key, "left")
              .fillna(0).withColumn("scope", F.col(key).cast("string")))
    return with_status(joined.unpivot(
        ["scope"], ["order_differs", "repeated_cell_names", "repeated_header_names"], "gate", "violations"))


def donor_contract(arms: DataFrame, keys: Sequence[str] = ("cohort_id", "compartment", "donor_id"),
                   unit: str = "module_id", arm: str = "contrast_arm") -> DataFrame:
    """Gates on retained score rows: a donor key, one arm per donor, one row per donor and unit; by cohort.

    One aggregate of the donors, itself counted once; nothing is joined back to the rows.
    """
    keys = list(keys)
    donors = arms.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("_rows"), F.min(arm).alias("_first"), F.max(arm).alias("_last"))
    per_donor = donors.groupBy(*keys).agg(F.max("_rows").alias("_rows"), F.count_if(F.col("_rows") > 1).alias("_repeated"),
                                          F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return gate_sums(per_donor, F.col(keys[0]), {
        "blank_donor": F.when(X.is_blank(keys[-1]), F.lit(1)).otherwise(F.lit(0)),
        "conflicting_arms": (F.col("_first") != F.col("_last")).cast("int"),
        "repeated_donor_rows": F.col("_repeated")})


def library_contract(libraries: DataFrame, donor: Sequence[str], library: str, fields: Sequence[str] = ()) -> DataFrame:
    """Gates on a library ledger: one library per donor key, and one set of metadata ``fields`` per library."""
    donor = list(donor)
    one = libraries.groupBy(*donor).agg(F.count_distinct(library).alias("_n"))
    gates = gate_sums(one, F.lit("libraries"), {"several_libraries_per_donor": (F.col("_n") > 1).cast("int")})
    if fields:
        tuples = libraries.select(library, *fields).distinct().groupBy(library).agg(F.count(F.lit(1)).alias("_n"))
        gates = gates.unionByName(gate_sums(tuples, F.lit("libraries"), {"conflicting_library_metadata": (F.col("_n") > 1).cast("int")}))
    return gates


def gate_sums(rows: DataFrame, scope: Column, checks: Mapping[str, Column]) -> DataFrame:
    """Gates whose violations are sums of numbers that the rows already hold; nulls count as faults."""
    counted = rows.groupBy(scope.cast("string").alias("scope")).agg(
        *[F.sum(F.coalesce(c.cast("long"), F.lit(1).cast("long"))).alias(n) for n, c in checks.items()])
    return with_status(counted.unpivot(["scope"], list(checks), "gate", "violations"))

"""The driver's tables seen as cohort data: triples, cells, donors, feature sets.

See FIXTURES.md for the binding.  Everything is a lazy view; columns are pruned at the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import expr as X
from cohortspark.functions.lineage import evaluate_once, spread_scan
from cohortspark.operators import cells as C
from cohortspark.operators import effects as E
from cohortspark.operators import scores as S

# The study configuration used by the queries.
MODULES = {
    "m1": [f"BRAND#{i}" for i in range(1, 6)],
    "m2": [f"BRAND#{i}" for i in range(5, 11)],
    "m3": [f"BRAND#{i}" for i in range(11, 16)],
    "m4": [f"BRAND#{i}" for i in range(16, 20)] + ["BRAND#99"],
    "m5": [f"BRAND#{i}" for i in range(20, 23)] + ["BRAND#98", "BRAND#99"],
}
PANELS = {
    "AF_support": [f"BRAND#{i}" for i in range(1, 7)],
    "NP_support": [f"BRAND#{i}" for i in range(7, 13)],
    "immune_exclusion": [f"BRAND#{i}" for i in range(13, 18)],
    "endothelial_exclusion": [f"BRAND#{i}" for i in range(18, 22)] + ["BRAND#99"],
    "mural_exclusion": [f"BRAND#{i}" for i in range(22, 26)],
    "erythroid_exclusion": ["BRAND#5", "BRAND#10", "BRAND#15", "BRAND#20", "BRAND#99"],
}
SYMBOLS = C.configured_symbols(MODULES, PANELS)
COHORTS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
QC = C.QcRule(min_detected=3, min_total=50, max_mt_pct=60.0, mt_prefix="BRAND#2")
LABELS = C.LabelRule()
THRESHOLDS = (1, 2, 3)
REFERENCE_THRESHOLD = 2
COMPARISON, TARGET = "BUILDING", "MACHINERY"
REPLICATES = E.REPLICATES
CELL = ["cell_id"]
LIBRARY = ["cohort_id", "library_id", "donor_id", "compartment", "severity_group"]


# Declared, so that no job is spent on reading footers before a query starts.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """Named views over one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def features(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("feature_id"),
                                X.normalize_symbol("p_brand").alias("symbol"))

    @cached_property
    def platforms(self) -> DataFrame:
        """Feature table of each cohort's platform: none lists all symbols, no two list the same."""
        regions = self.region.select(F.col("r_name").alias("cohort_id"), "r_regionkey")
        number = {"_number": F.split_part("symbol", F.lit("#"), F.lit(2)).cast("int")}
        numbered = evaluate_once(evaluate_once(spread_scan(self.part.select("p_partkey", "p_brand")), {
            "symbol": X.normalize_symbol("p_brand")}).withColumnRenamed("p_partkey", "feature_id"), number)
        return (numbered.join(F.broadcast(regions), (F.col("_number") + F.col("r_regionkey")) % 7 != 0)  # five regions
                .select("cohort_id", "feature_id", "symbol"))

    @cached_property
    def entries(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("feature_id"),
                                    F.col("l_quantity").cast("long").alias("value"))

    @cached_property
    def triples(self) -> DataFrame:
        return spread_scan(self.entries, "cell_id").join(self.features, "feature_id")

    @cached_property
    def donors(self) -> DataFrame:
        return (self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select("c_custkey", F.col("c_custkey").cast("string").alias("donor_id"),
                        F.col("r_name").alias("cohort_id"), F.col("c_mktsegment").alias("severity_group"),
                        "c_acctbal"))

    @cached_property
    def cells(self) -> DataFrame:
        status = F.col("o_orderstatus")
        compartment = F.when(status == "F", F.lit("AF")).when(status == "O", F.lit("NP")).otherwise(F.lit(""))
        return (self.orders.join(self.donors, F.col("o_custkey") == F.col("c_custkey"))
                .select(F.col("o_orderkey").alias("cell_id"),
                        F.concat_ws("-", F.col("o_custkey").cast("string"), status).alias("library_id"),
                        "donor_id", compartment.alias("compartment"), "cohort_id", "severity_group"))

    @cached_property
    def profiles(self) -> DataFrame:
        return C.cell_profiles(self.entries, SYMBOLS, QC.mt_prefix, CELL, self.features)

    @cached_property
    def cell_qc(self) -> DataFrame:
        return C.cell_metrics(self.cells, self.profiles, QC, CELL)

    @cached_property
    def annotated(self) -> DataFrame:
        return self.annotate(self.cell_qc.where("qc_pass"))

    def annotate(self, passing: DataFrame) -> DataFrame:
        return C.label_cells(C.panel_columns(passing, self.platforms, PANELS, feature_keys=["cohort_id"]), "compartment", LABELS)

    @cached_property
    def library_profiles(self) -> DataFrame:
        return S.library_profiles(self.annotated.where("include"), LIBRARY, SYMBOLS)

    @cached_property
    def module_scores(self) -> DataFrame:
        return S.module_scores(self.library_profiles, self.platforms, MODULES, LIBRARY, feature_keys=["cohort_id"])

    @cached_property
    def spec(self) -> DataFrame:
        from cohortspark.functions.config import config_table, strings

        names = ("cohort_id", "dataset", "compartment", "comparison_value", "target_value",
                 "comparison_label", "target_label", "analysis_role", "confirmatory_eligible")
        rows = [dict(zip(names, (c, c, p, COMPARISON, TARGET, "mild", "severe", "exploratory", "false")))
                for c in COHORTS for p in ("AF", "NP")]
        return config_table(self.spark, rows, strings(*names))

    def arms_from(self, scores: DataFrame) -> DataFrame:
        assigned = E.assign_arms(scores.withColumnRenamed("cohort_id", "dataset"), self.spec)
        return E.retained_arms(assigned)

    @cached_property
    def arms(self) -> DataFrame:
        return self.arms_from(self.module_scores)

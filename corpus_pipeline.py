"""From raw documents to a training mix: filter, deduplicate, decontaminate, mix.

Each stage works on all documents its predecessor kept. All but the last return the columns of
``documents``; the last adds the words to take from each document of the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontamination, line_dedup, mixing, quality, simhash
from cohortspark.llm.common import cut, shared_folder

#: The classifier's own threshold: the stage drops what op9 marks 0.
REJECT_BELOW = quality.THRESHOLD


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier, trained on the labels, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), REJECT_BELOW)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occurred before; a document may become empty but stays."""
    kept = line_dedup.dedup_lines(docs)
    length = F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with size, target (their source's) and taken, in words."""
    mix = mixing.mixed_documents(docs)
    return mix.select(*docs.columns, *[F.col(f"_{c}").alias(c) for c in ("size", "target", "taken")])


STAGES = [("quality", good_documents), ("line_dedup", distinct_lines), ("simhash", distinct_documents),
          ("decontamination", clean_of_benchmark), ("mixing", mixed)]

#: The network of the first stage has no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; the folders go once the result stands."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    result = cut(STAGES[-1][1](spark, docs, sf_dir))
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result

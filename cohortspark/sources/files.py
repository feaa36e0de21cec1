"""File hashes, table sinks and the run manifest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class SinkError(ValueError):
    """A table does not fit its sink contract."""


def hash_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, bytes and SHA-256 of each file.

    The listing reads no content; each task then streams its files in blocks, so a file of
    any size works and no content passes through a row or the driver.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
             .select("path", F.col("length").alias("bytes")))

    def digest(batches):
        import hashlib

        from pyarrow import fs as arrow_fs

        for pdf in batches:
            hashes = []
            for path in pdf["path"]:
                system, local = arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1)
                                                             if path.startswith("file:/") and not path.startswith("file://")
                                                             else path)
                sha = hashlib.sha256()
                with system.open_input_stream(local) as stream:
                    while block := stream.read(8 << 20):
                        sha.update(block)
                hashes.append(sha.hexdigest())
            yield pdf.assign(sha256=hashes)

    return files.repartition(F.col("path")).mapInPandas(digest, "path string, bytes long, sha256 string")


def write_table(df: DataFrame, path: str, fields: Sequence[str], format: str = "csv",
                overwrite: bool = False, gzip: bool = False, sep: str = ",",
                refuse_empty: bool = True) -> int:
    """Write exactly ``fields`` in order and return the number of rows; an audit is never overwritten by default.

    An unexpected or missing column and (by default) an empty table are errors.  CSV output writes NULL as
    an empty field.  Rows are counted by the job that writes them, beside the target; the folder takes its
    name only once it is complete and accepted, so a failed or refused write leaves neither a part nor a
    changed target behind.
    """
    unexpected = [c for c in df.columns if c not in fields]
    missing = [c for c in fields if c not in df.columns]
    if unexpected or missing:
        raise SinkError(f"{path}: unexpected columns {unexpected}, missing columns {missing}")
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    target, staging = jvm.Path(path), jvm.Path(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target) and not overwrite:
        raise SinkError(f"{path}: exists already")
    seen = Observation()
    writer = df.select(*fields).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    try:
        if format == "csv":
            writer = writer.option("header", True).option("sep", sep).option("emptyValue", "")
            if gzip:
                writer = writer.option("compression", "gzip")
            writer.csv(staging.toString())
        else:
            writer.format(format).save(staging.toString())
        rows = seen.get["rows"]
        if refuse_empty and rows == 0:
            raise SinkError(f"{path}: refusing to write an empty table")
        if overwrite:
            system.delete(target, True)
        if not system.rename(staging, target):
            raise SinkError(f"{path}: could not take its name")
        return rows
    finally:
        system.delete(staging, True)


def write_run_manifest(spark: SparkSession, path: str, contract: str, settings: dict[str, str],
                       inputs: DataFrame, outputs: DataFrame, row_counts: dict[str, int]) -> None:
    """One JSON object: contract, settings, input and output hashes, row counts.

    ``inputs`` and ``outputs`` come from ``hash_files``; they list files, not data.
    """
    def as_array(df):
        entry = F.struct("path", "bytes", "sha256")
        return df.agg(F.array_sort(F.collect_list(entry))).scalar()

    def as_map(values):
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
        return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")

    manifest = spark.range(1).select(
        F.lit(contract).alias("contract"), as_map({k: str(v) for k, v in settings.items()}).alias("settings"),
        as_array(inputs).alias("inputs"), as_array(outputs).alias("outputs"),
        as_map(row_counts).alias("row_counts"))
    manifest.coalesce(1).write.mode("errorifexists").json(path)

"""Matrix ingest: dense text, feature × sample tables and archives of coordinate triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.lineage import settle
from ..operators import gates as G


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file name and a position that grows within the file.

    The position is unique and ordered but not dense: it needs no second pass.
    """
    return spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def melt_dense(lines: DataFrame, header: DataFrame, line: str = "line", line_no: str = "line_no",
               separator: str = "\t", integers: bool = False) -> tuple[DataFrame, DataFrame]:
    """Wide feature × cell lines to (line_no, feature_id, cell, value) and per-line violations.

    ``header``: (cell_pos, cell), one row per matrix column, 0-based.  The matrix is never a
    wide DataFrame: each line is split and exploded, so any number of columns works.  The
    second result has one row per line with a wrong width or an invalid value; with ``integers``
    a value with a fraction is invalid, too.
    """
    fields = F.split(F.col(line), separator)
    width = header.agg(F.count(F.lit(1))).scalar()
    parsed = lines.select(F.col(line_no).alias("line_no"), fields[0].alias("feature_id"), fields.alias("_f"))
    long = parsed.select("line_no", "feature_id", F.size("_f").alias("_size"), F.posexplode("_f").alias("_p", "_raw"))
    values = long.where(F.col("_p") > 0).select(
        "line_no", "feature_id", (F.col("_p") - 1).alias("cell_pos"), X.to_number("_raw").alias("value"))
    bad = parsed.select("line_no", "feature_id", X.reason_list(
        (F.size("_f") - 1 != width, "width"),
        (F.exists(F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(1))),
                  lambda v: X.to_number(v).isNull()), "not_finite"),
        (F.exists(F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(1))),
                  lambda v: F.coalesce(X.to_number(v) < 0, F.lit(False))), "negative"),
        (F.lit(integers) & F.exists(F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(1))),
                                    lambda v: F.coalesce(X.to_number(v) != F.floor(X.to_number(v)), F.lit(False))), "not_integer"),
        none="").alias("violations"))
    return (values.join(header, "cell_pos").select("line_no", "feature_id", "cell", "value"),
            bad.where(F.col("violations") != ""))


def body_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines but the first of a text file, by position: data lines equal to the header stay."""
    lines = number_lines(spark, path)
    first = lines.agg(F.min("pos")).scalar()
    return lines.where(F.col("pos") > first)


def read_dense_matrix(spark: SparkSession, path: str, separator: str = "\t", integers: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ingest one dense text matrix: header line, then one line per feature."""
    first = spark.read.text(path).limit(1)
    # posexplode of the header line only; positions join the values by equality.
    header = first.select(F.posexplode(F.split("value", separator)).alias("_p", "cell")).where(
        F.col("_p") > 0).select((F.col("_p") - 1).alias("cell_pos"), "cell")
    return melt_dense(body_lines(spark, path), header, "line", "pos", separator, integers)


def read_sample_matrix(spark: SparkSession, path: str, separator: str = "\t"
                       ) -> tuple[DataFrame, DataFrame]:
    """Feature × sample text matrix -> wide rows and width counts.

    One explicitly empty trailing field is dropped per row and counted; any other width is a
    violation.  Sample tables have few columns, so the wide form is safe.
    """
    head = spark.read.text(path).limit(1).first()
    names = [n.strip().strip('"') for n in head[0].split(separator)]
    width = len(names)
    raw = F.split("line", separator)
    trailing = (F.size(raw) == width + 1) & (F.element_at(raw, -1) == "")
    rows = body_lines(spark, path).select(
        "pos", trailing.alias("_trail"), F.when(trailing, F.slice(raw, 1, width)).otherwise(raw).alias("_f"))
    counts = rows.agg(F.count_if("_trail").alias("trailing_empty_fields"),
                      F.count_if(F.size("_f") != width).alias("malformed_rows"), F.count(F.lit(1)).alias("rows"))
    wide = rows.where(F.size("_f") == width).select(
        F.col("pos").alias("line_no"), *[F.col("_f")[i].alias(n) for i, n in enumerate(names)])
    return wide, counts


def ingest_matrix_archives(spark: SparkSession, glob: str, library_pattern: str = r"(GSM[0-9]+)",
                           batch: int = 200_000) -> DataFrame:
    """Archives of (barcodes, features, matrix) members -> long rows; run once, write Parquet.

    One task reads one archive as a stream (an archive cannot be split) and emits bounded
    Arrow batches; nothing is held whole.  Nested ``.tar.gz`` members are followed.  Raw
    coordinate lines are kept as text, bad ones included, so ``coordinate_integrity`` can
    audit them; rows are (library_id, kind, pos, line) with kind barcode / feature / header /
    entry.  Partition the written table by ``library_id`` and ``kind``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(glob).select("path", "length")
    # Only the path is read here: the content column is pruned and the task opens the file.
    spread = files.repartition(F.col("path"))

    def parse(batches):
        import gzip
        import io
        import re
        import tarfile

        import pandas as pd
        from pyarrow import fs as arrow_fs

        def kind_of(name):
            low = name.lower()
            for token, kind in (("barcodes", "barcode"), ("features", "feature"), ("genes", "feature"),
                                ("matrix", "matrix")):
                if token in low:
                    return kind
            return None

        def members(stream, outer):
            with tarfile.open(fileobj=stream, mode="r|*") as tar:
                for member in tar:
                    if not member.isfile():
                        continue
                    handle = tar.extractfile(member)
                    name = f"{outer}/{member.name}"
                    if member.name.endswith((".tar.gz", ".tgz", ".tar")):
                        yield from members(handle, name)
                    elif kind_of(member.name):
                        yield name, kind_of(member.name), (
                            gzip.GzipFile(fileobj=handle) if member.name.endswith(".gz") else handle)

        def rows(path):
            system, local = arrow_fs.FileSystem.from_uri(path)
            with system.open_input_stream(local) as stream:
                for name, kind, handle in members(io.BufferedReader(stream), path):
                    found = re.findall(library_pattern, name)
                    library = found[-1] if found else name
                    sized = False
                    for pos, raw in enumerate(handle, start=1):
                        line = raw.decode("utf-8", "replace").rstrip("\r\n")
                        row_kind = kind
                        if kind == "matrix":
                            comment = line.startswith("%")
                            row_kind = "header" if comment or not sized else "entry"
                            sized = sized or not comment
                        yield library, row_kind, pos, line

        names = ["library_id", "kind", "pos", "line"]
        for pdf in batches:
            for path in pdf["path"]:
                chunk = []
                for row in rows(path):
                    chunk.append(row)
                    if len(chunk) >= batch:
                        yield pd.DataFrame(chunk, columns=names)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=names)

    return spread.mapInPandas(parse, "library_id string, kind string, pos long, line string")


def archive_tables(rows: DataFrame, mt_prefix: str = "MT-") -> dict[str, DataFrame]:
    """Typed tables of ingested archive rows: features, barcodes, headers, entries, triples."""
    def of(kind):
        return rows.where(F.col("kind") == kind)

    f = F.split("line", "\t")
    features = of("feature").select(
        "library_id", F.col("pos").alias("feature_idx"), f[0].alias("feature_id"),
        X.normalize_symbol(F.when(F.size(f) > 1, f[1]).otherwise(f[0])).alias("symbol")).withColumn(
        "is_mt", F.col("symbol").startswith(mt_prefix))
    barcodes = of("barcode").select("library_id", F.col("pos").alias("cell_idx"), F.trim("line").alias("barcode"))
    h = F.split(F.trim("line"), r"\s+")
    headers = of("header").where(~F.col("line").startswith("%")).select(
        "library_id", h[0].try_cast("long").alias("matrix_rows"), h[1].try_cast("long").alias("matrix_columns"),
        h[2].try_cast("long").alias("declared_nnz"))
    entries = of("entry").select("library_id", "pos", "line")
    from ..operators.audits import parse_coordinates

    triples, rejects = attach_positions(parse_coordinates(entries), features, barcodes)
    return {"features": features, "barcodes": barcodes, "headers": headers, "entries": entries, "triples": triples,
            "rejects": rejects}


def attach_positions(entries: DataFrame, features: DataFrame, barcodes: DataFrame, key: str = "library_id",
                     keep: Sequence[str] = ("pos", "line")) -> tuple[DataFrame, DataFrame]:
    """Coordinate entries with what stands at their positions, and the entries that have no place.

    entries: key, feature, cell, value (NULL where a field is malformed) and ``keep``; features: key, feature_idx,
    feature_id, symbol; barcodes: key, cell_idx, barcode, all counted from 1.  Every entry is in exactly
    one result: a triple, or a reject whose ``reason`` is the first of malformed, feature_out_of_range,
    cell_out_of_range, negative and zero.
    """
    f = features.select(F.col(key).alias("_fk"), F.col("feature_idx").alias("_fi"), "feature_id", "symbol")
    b = barcodes.select(F.col(key).alias("_bk"), F.col("cell_idx").alias("_bi"), "barcode")
    joined = entries.join(f, (F.col(key) == F.col("_fk")) & (F.col("feature") == F.col("_fi")), "left").join(
        b, (F.col(key) == F.col("_bk")) & (F.col("cell") == F.col("_bi")), "left")
    malformed = F.col("feature").isNull() | F.col("cell").isNull() | F.col("value").isNull()
    placed = settle(joined.withColumn("reason", X.first_reason(
        (malformed, "malformed"), (F.col("_fi").isNull(), "feature_out_of_range"), (F.col("_bi").isNull(), "cell_out_of_range"),
        (F.col("value") < 0, "negative"), (F.col("value") == 0, "zero"), none="")))
    triples = placed.where("reason = ''").select(key, F.col("cell").alias("cell_id"), "barcode", "feature_id", "symbol", "value")
    return triples, placed.where("reason <> ''").select(key, *keep, "reason")


#: Faults of single entries, which a tolerant matrix gate counts without failing.
ENTRY_FAULTS = ("malformed", "feature_out_of_range", "cell_out_of_range", "negative")


def matrix_gate(headers: DataFrame, rejects: DataFrame, key: str = "library_id", strict: bool = True) -> DataFrame:
    """Gate rows per library: dimensions, number of entries and faulty entries; zero values never fail.

    headers: key, matrix_rows, matrix_columns, declared_nnz, n_features, n_barcodes, entries_read.  A strict gate
    fails on any faulty entry; a tolerant one lets faulty entries pass and still wants dimensions and counts.
    """
    found = rejects.groupBy(F.col(key).alias("_key")).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ENTRY_FAULTS])
    rows = headers.join(found, F.col(key) == F.col("_key"), "left").fillna(0, subset=list(ENTRY_FAULTS))
    off = (F.col("matrix_rows") != F.col("n_features")) | (F.col("matrix_columns") != F.col("n_barcodes"))
    gates = G.gate_sums(rows, F.col(key), {
        "dimension_mismatch": off.cast("int"), "entry_count_mismatch": (F.col("entries_read") != F.col("declared_nnz")).cast("int"),
        **{r: F.col(r) for r in ENTRY_FAULTS}})
    return gates if strict else G.tolerant(gates, ENTRY_FAULTS)

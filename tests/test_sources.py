"""Readers, ingest jobs and sinks on files written by the test."""

import gzip
import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import audits as A
from cohortspark.operators import gates as G
from cohortspark.operators import scores as S
from cohortspark.sources import files as FS
from cohortspark.sources import matrices as MX
from cohortspark.sources import tables as ST


def status(gates):
    return {r["gate"]: r["violations"] for r in gates.collect()}


def test_ledger_with_mark_and_duplicates(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text("﻿library_id,donor_id\n l1 ,d1\nl1,d2\n,d3\n", encoding="utf-8")
    df, gates = ST.read_ledger(spark, str(path), ["donor_id"], "library_id")
    assert df.columns == ["library_id", "donor_id"]
    assert status(gates) == {"blank_library_id": 1, "duplicate_library_id": 1, "empty_file": 0}
    with pytest.raises(ST.ColumnError):
        ST.read_ledger(spark, str(path), ["absent"], "library_id")


def test_contrast_spec_lists(spark, tmp_path):
    path = tmp_path / "spec.csv"
    values = {c: "x" for c in ST.CONTRAST_COLUMNS} | {"score_files": "a.csv; b.csv", "dataset_values": "d1"}
    path.write_text(",".join(ST.CONTRAST_COLUMNS) + "\n" + ",".join(values[c] for c in ST.CONTRAST_COLUMNS) + "\n")
    row = ST.read_contrast_spec(spark, str(path)).first()
    assert row["score_files"] == ["a.csv", "b.csv"] and row["dataset_values"] == ["d1"]


def test_cell_ledger_gzip(spark, tmp_path):
    path = tmp_path / "cells.tsv.gz"
    with gzip.open(path, "wt") as handle:
        handle.write("library_id\tbarcode\tqc_pass\nl\tb1\tTrue\nl\tb1\tFalse\n")
    df, gate = ST.read_cell_ledger(spark, str(path), ["qc_pass"], partitions=3)
    assert df.count() == 2 and status(gate) == {"duplicate_cell": 1}


def test_feature_sets_from_json(spark, tmp_path):
    path = tmp_path / "modules.json"
    path.write_text(json.dumps({"modules": {"m1": {"label": "One", "genes": ["a", " B "]}, "m2": {"label": "Two", "genes": ["C", "c"]},
                                            "m3": {"label": "None", "genes": []}}}))
    rows, gates = ST.read_feature_sets(spark, str(path))
    assert {(r["set_name"], r["gene"]) for r in rows.where("gene is not null").collect()} == {("m1", "A"), ("m1", "B"), ("m2", "C")}
    found = [(r["gate"], r["scope"]) for r in gates.where("violations > 0").collect()]
    assert ("empty_set_or_member", "m3") in found and ("duplicate_member", "feature_sets") in found
    panels = tmp_path / "panels.json"
    panels.write_text(json.dumps({"panels": {"p": ["X", "Y"]}}))
    rows, _ = ST.read_feature_sets(spark, str(panels), "panels")
    assert sorted(r["gene"] for r in rows.collect()) == ["X", "Y"]


def test_manifest_listing_and_intervals(spark, tmp_path):
    manifest = tmp_path / "manifest.tsv"
    good = ["g1;g2", "data/a.tar", "acc", "r", "k", "s", "u", "10", "a" * 64, ""]
    bad = ["g1", "../x", "acc", "r", "k", "s", "u", "ten", "zz", ""]
    manifest.write_text("\n".join("\t".join(r) for r in [ST.MANIFEST_COLUMNS, good, bad]) + "\n")
    rows, gates = ST.read_asset_manifest(spark, str(manifest))
    assert rows.where("path = 'data/a.tar'").first()["groups"] == ["g1", "g2"]
    assert status(gates) == {"invalid_sha256": 1, "invalid_bytes": 1, "unsafe_path": 1, "duplicate_path": 0}
    listing = tmp_path / "filelist.txt"
    listing.write_text("#Archive/File\tName\tTime\tSize\tType\nFile\ta.gz\t01\t12\tGZ\n")
    assert ST.read_file_listing(spark, str(listing)).first()["bytes"] == 12
    gtf = tmp_path / "genes.gtf"
    gtf.write_text('#!x\n1\ts\tgene\t5\t9\t.\t+\t.\tgene_id "ENSG1.2"; gene_name "AB C";\n1\ts\texon\t5\t9\t.\t+\t.\tgene_id "ENSG1";\n')
    assert [tuple(r) for r in ST.read_attribute_intervals(spark, str(gtf)).collect()] == [("1", 5, 9, "ENSG1", "AB C")]


def test_dense_matrix(spark, tmp_path):
    path = tmp_path / "dense.tsv"
    path.write_text("gene\tc1\tc2\nA\t1\t2\nB\t0\t-1\nC\t3\nD\tnan\t4\n")
    values, bad = MX.read_dense_matrix(spark, str(path))
    got = {(r["feature_id"], r["cell"]): r["value"] for r in values.collect()}
    assert got[("A", "c2")] == 2.0 and got[("D", "c1")] is None and got[("C", "c1")] == 3.0
    assert {r["feature_id"]: r["violations"] for r in bad.collect()} == {"B": "negative", "C": "width", "D": "not_finite"}


def test_sample_matrix_trailing_field(spark, tmp_path):
    path = tmp_path / "fpkm.tsv"
    path.write_text("id\ts1\ts2\nA\t1\t2\t\nB\t3\t4\nC\t5\n")
    wide, counts = MX.read_sample_matrix(spark, str(path))
    c = counts.first()
    assert (c["trailing_empty_fields"], c["malformed_rows"], c["rows"]) == (1, 1, 3)
    long = S.unpivot_samples(wide, ["id"], ["s1", "s2"])
    assert {(r["id"], r["sample"]): r["value"] for r in long.collect()}[("B", "s2")] == "4"


def test_data_line_equal_to_the_header_and_integers(spark, tmp_path):
    path = tmp_path / "again.tsv"
    path.write_text("gene\t1\t2\nA\t1\t2\ngene\t1\t2\nB\t1.5\t2\n")
    values, bad = MX.read_dense_matrix(spark, str(path), integers=True)
    assert values.where("feature_id = 'gene'").count() == 2
    assert {r["feature_id"]: r["violations"] for r in bad.collect()} == {"B": "not_integer"}
    assert MX.read_sample_matrix(spark, str(path))[1].first()["rows"] == 3


def test_every_entry_is_a_triple_or_a_reject(spark):
    features = spark.createDataFrame([("l", 1, "E1", "A"), ("l", 2, "E2", "B")], "library_id string, feature_idx long, feature_id string, symbol string")
    barcodes = spark.createDataFrame([("l", 1, "AAA"), ("l", 2, "CCC")], "library_id string, cell_idx long, barcode string")
    entries = [(1, 1, 5), (2, 2, 1), (3, 1, 1), (0, 1, 1), (1, 3, 1), (1, 1, -2), (2, 1, 0), (None, 1, 1), (1, 1, None), (9, 9, -1)]
    df = spark.createDataFrame([("l", i, str(e), *e) for i, e in enumerate(entries)],
                               "library_id string, pos long, line string, feature long, cell long, value long")
    triples, rejects = MX.attach_positions(df, features, barcodes)
    assert sorted((r["barcode"], r["feature_id"], r["value"]) for r in triples.collect()) == [("AAA", "E1", 5), ("CCC", "E2", 1)]
    assert [r["reason"] for r in rejects.orderBy("pos").collect()] == [
        "feature_out_of_range", "feature_out_of_range", "cell_out_of_range", "negative", "zero", "malformed", "malformed", "feature_out_of_range"]
    headers = spark.createDataFrame([("l", 2, 2, 10, 2, 2, 10)], "library_id string, matrix_rows long, matrix_columns long, declared_nnz long, "
                                    "n_features long, n_barcodes long, entries_read long")
    strict = {r["gate"]: (r["violations"], r["status"]) for r in MX.matrix_gate(headers, rejects).collect()}
    assert strict["feature_out_of_range"] == (3, "fail") and strict["entry_count_mismatch"] == (0, "pass") and "zero" not in strict
    lenient = MX.matrix_gate(headers, rejects, strict=False)
    G.require(lenient)
    assert lenient.where("status = 'tolerated'").count() == 4
    with pytest.raises(G.GateError):
        G.require(MX.matrix_gate(headers.withColumn("declared_nnz", F.lit(11)), rejects, strict=False))


def _add(tar, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


def _members(prefix):
    matrix = b"%%MatrixMarket matrix coordinate integer general\n%x\n2 2 3\n1 1 4\n2 1 1\n1 2 bad\n"
    return {f"{prefix}_barcodes.tsv.gz": gzip.compress(b"AAA\nCCC\n"),
            f"{prefix}_features.tsv.gz": gzip.compress(b"E1\tMT-a\tGene\nE2\tb\tGene\n"),
            f"{prefix}_matrix.mtx.gz": gzip.compress(matrix)}


def test_archives_flat_and_nested(spark, tmp_path):
    with tarfile.open(tmp_path / "flat_RAW.tar", "w") as tar:
        for name, data in _members("GSM1_x").items():
            _add(tar, name, data)
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as tar:
        for name, data in _members("sample").items():
            _add(tar, f"dir/{name}", data)
    with tarfile.open(tmp_path / "nested_RAW.tar", "w") as tar:
        _add(tar, "GSM2_NP1.tar.gz", inner.getvalue())
    rows = MX.ingest_matrix_archives(spark, f"{tmp_path}/*.tar", batch=2)
    out = tmp_path / "ingested"
    rows.write.partitionBy("library_id", "kind").parquet(str(out))
    parts = MX.archive_tables(spark.read.parquet(str(out)))
    triples = sorted(tuple(r) for r in parts["triples"].collect())
    assert triples == [("GSM1", 1, "AAA", "E1", "MT-A", 4), ("GSM1", 1, "AAA", "E2", "B", 1),
                       ("GSM2", 1, "AAA", "E1", "MT-A", 4), ("GSM2", 1, "AAA", "E2", "B", 1)]
    assert sorted((r["library_id"], r["line"], r["reason"]) for r in parts["rejects"].collect()) == [
        ("GSM1", "1 2 bad", "malformed"), ("GSM2", "1 2 bad", "malformed")]
    sizes = parts["features"].groupBy("library_id").agg(F.count("*").alias("n_features"))
    cells = parts["barcodes"].groupBy("library_id").agg(F.count("*").alias("n_barcodes"))
    headers = parts["headers"].join(sizes, "library_id").join(cells, "library_id")
    audit = {r["library_id"]: r for r in A.coordinate_integrity(parts["entries"], headers).collect()}
    assert (audit["GSM2"]["coordinate_lines"], audit["GSM2"]["malformed_lines"], audit["GSM2"]["dimension_match"]) == (3, 1, True)


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    out = str(tmp_path / "out")
    FS.write_table(df, out, ["k", "v"], gzip=True)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["k", "v"] and back.where("v is null").count() == 1
    with pytest.raises(Exception):
        FS.write_table(df, out, ["k", "v"])  # never overwrites by default
    with pytest.raises(FS.SinkError):
        FS.write_table(df, str(tmp_path / "o2"), ["k"])
    with pytest.raises(FS.SinkError):
        FS.write_table(df.limit(0), str(tmp_path / "o3"), ["k", "v"])
    assert FS.write_table(df, out, ["k", "v"], format="parquet", overwrite=True) == 2 and spark.read.parquet(out).count() == 2
    broken = df.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    for target in (out, str(tmp_path / "o4")):
        with pytest.raises(Exception, match="lost"):
            FS.write_table(broken, target, ["k", "v"], overwrite=True)
    # A failed or refused write leaves the old target and no parts.
    assert spark.read.parquet(out).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    source = tmp_path / "in" / "x.bin"
    source.parent.mkdir()
    source.write_bytes(b"hello" * 1000)
    hashed = FS.hash_files(spark, str(source.parent))
    row = hashed.first()
    assert row["bytes"] == 5000 and row["sha256"] == hashlib.sha256(b"hello" * 1000).hexdigest()
    target = str(tmp_path / "manifest")
    FS.write_run_manifest(spark, target, "contract_v1", {"seed": "7"}, hashed, hashed, {"rows": 2})
    manifest = json.loads(spark.read.text(target).first()[0])
    assert manifest["contract"] == "contract_v1" and manifest["inputs"][0]["bytes"] == 5000
    assert manifest["row_counts"] == {"rows": 2}

"""Each stage of the pipeline against a plain version of its decision."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline as P  # noqa: E402
from cohortspark.llm import quality, simhash  # noqa: E402
from test_decontamination_and_topk import brute as windows  # noqa: E402
from test_line_dedup import brute as repeated  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in docs.collect()})
        assert docs.columns[:len(columns)] == columns
        if name == "simhash":
            groups = simhash.near_duplicates(before).select("doc_id", "component_id").collect()
            assert set(seen[name][1]) == {r["component_id"] for r in groups}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["quality"]
    assert sum((i in after) == (labels[i] == 1) for i in before if i in labels) / len(labels) > 0.85
    before, after = seen["line_dedup"]
    gone = repeated([(i, r["text"]) for i, r in before.items()])
    for i, r in before.items():
        want = "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (i, p) not in gone)
        assert after[i]["text"] == want and after[i]["n_chars"] == len(want)
    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {r[0] for r in windows([(i, r["text"]) for i, r in before.items()], items) if not r[5]}
    before, after = seen["mixing"]
    assert set(after) <= set(before) and all(0 < r["taken"] <= 2 * r["size"] for r in after.values())
    total = sum(len(r["text"].split()) for r in before.values())
    assert abs(sum(r["taken"] for r in after.values()) - 1.5 * total) < 20
    assert sorted((r["doc_id"], r["taken"]) for r in P.run(spark, SF).collect()) == sorted((i, r["taken"]) for i, r in after.items())


def test_first_stage_drops_what_op9_rejects(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in P.good_documents(spark, docs, SF).select("doc_id").collect()}
    judged = quality.judge_quality(docs, labels).select("doc_id", "predicted", "score").collect()
    assert any(0.5 <= r["score"] < 0.7 for r in judged)
    assert kept == {r["doc_id"] for r in judged if r["predicted"] == 1}


def test_stages_survive_edges(spark, edge_docs, no_docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (8, 0, 0), (9, 1, 0), (None, 1, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for i, (name, stage) in enumerate(P.STAGES):
        for j, docs in enumerate((edge_docs, no_docs)):
            out = stage(spark, docs, sf)
            assert out.columns[:len(docs.columns)] == docs.columns
            out.write.parquet(str(tmp_path / f"{i}-{j}"))
            assert j == 0 or spark.read.parquet(str(tmp_path / f"{i}-{j}")).count() == 0

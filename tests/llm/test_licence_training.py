"""The licence scan learns from all paragraphs."""

from cohortspark.llm import licences


def test_all_paragraphs_teach_and_calibrate(spark):
    # 6,000 lines, more than a sample once took; the model sees how many there are of each.
    text = "software of this work is sold"
    rows = [(i, f"plain words number {i}") for i in range(5000)] + [(5000 + i, f"{text} {i}") for i in range(1000)]
    seen = {}
    keep, licences.necessary_grams = licences.necessary_grams, lambda n, m, i, s: seen.update(s) or keep(n, m, i, s)
    try:
        model = licences.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    finally:
        licences.necessary_grams = keep
    teaching = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(text) % 2 = 0 AS t", "doc_id >= 5000 AS s").where("t")
    share = licences.PLAIN_WEIGHT / teaching.count()
    assert abs(seen["work is"] - teaching.where("s").count() * share) < 2.5  # and the constant lines
    found = licences.find_licences(spark.createDataFrame([(1, "Released under the MIT License."), (2, text)], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["family"] for r in found.where("confirmed").collect()} == {1: "mit"}


def test_least_probability():
    assert licences.least_probability({}, 5000) == 0.5
    assert licences.least_probability({9000: 3, 8000: 1, 7000: 1}, 5000) == 0.5  # five may pass
    assert licences.least_probability({9000: 3, 8000: 1, 7000: 2}, 5000) == 0.7
    assert licences.least_probability({9000: 3, 8000: 4, 7000: 2}, 5000) == 0.8


def test_each_text_is_split_once(spark, monkeypatch):
    """Training and finding share one reading of the paragraphs, and its marks stand for all their n-grams of the vocabulary."""
    lines = [t for _, t in licences.TEMPLATES] + licences.PLAIN + ["", "  ", "Ünïcode the MIT License", "the the of the", "copyright"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, lines[0])], "doc_id long, text string")
    known = set(licences._vocabulary(spark).vocabulary)
    whole = licences._with_grams(licences.paragraphs(docs, "doc_id", "text"), "paragraph").select("doc_id", "pos", "grams").collect()
    marked = licences._unmarked(licences.marked_paragraphs(docs)).collect()
    assert {(r["doc_id"], r["pos"]): set(r["grams"]) for r in marked} == {(r["doc_id"], r["pos"]): set(r["grams"]) & known for r in whole}
    readings, keep = [], licences.paragraphs
    monkeypatch.setattr(licences, "paragraphs", lambda *a: readings.append(1) or keep(*a))
    assert licences.scan_licences(docs).count() == 4
    assert len(readings) == 1

import re
import time

from pyspark.sql import functions as F

from cohortspark.llm import langid, licences, pii, quality

SF = "/root/testdata/sf0.01"


def luhn(digits):
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


TEXTS = [
    "card 4539 1488 0343 6467, again 4539148803436467; not one 4539148803436468.",
    "mail José.da-Silva+x@mail.example.org or a@b.co, not @home nor a@b",
    "from 10.0.255.1 to 255.255.255.255. Not 256.1.1.1 nor 1.2.3.4.5",
    "born 1980-02-29, 31.12.1999 and 02/29/2000; not 1981-02-29 nor 13/13/2000",
    "ssn 123-45-6789 but not 000-45-6789, 666-12-3456 or 123-00-6789",
    "call +1 (212) 555-0199 or (212) 555-0199 or 212-555-0199",
    "iban GB82WEST12345698765432 not GB83WEST12345698765432",
    'key="24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 1234', "nothing here", "", None,
]
FOUND = [["card", "card"], ["email", "email"], ["ip", "ip"], ["date"] * 3, ["ssn"], ["phone"] * 3, ["iban"], ["secret"], [], [], []]


def made(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in pii.pseudonymise(docs, key).orderBy("doc_id").collect()]


def test_each_kind_keeps_its_format_and_validity(spark):
    got = made(spark, TEXTS)
    assert [k for _, k in got] == FOUND
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", t)))
    for i in (0, 1, 3, 4, 5, 6):
        assert shape(got[i][0]) == shape(TEXTS[i]) and got[i][0] != TEXTS[i]
    first, second, third = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[0][0])
    assert luhn(first.replace(" ", "")) and luhn(second) and third == "4539148803436468"
    assert got[1][0].split(" ")[1].endswith("@mail.example.org") and "é" in got[1][0] and got[1][0].endswith("not @home nor a@b")
    assert all(int(o) < 256 for a in re.findall(r"\d+(?:\.\d+){3}", got[2][0].split("Not")[0]) for o in a.split("."))
    assert got[2][0].endswith("Not 256.1.1.1 nor 1.2.3.4.5") and got[3][0].endswith("not 1981-02-29 nor 13/13/2000")
    assert got[4][0].endswith("not 000-45-6789, 666-12-3456 or 123-00-6789")
    iban = re.search(r"GB\d\d[A-Z]{4}\d{14}", got[6][0]).group()
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and got[6][0].endswith("GB83WEST12345698765432")
    assert re.fullmatch('key="[0-9a-f]{40}" and 1234', got[7][0])
    assert [t for t, _ in got[8:]] == ["nothing here", "", None]


def test_printed_ibans_and_phones_of_other_groupings(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82-WEST-1234-5698-7654-32", "NO93 8601 1117 947", "BE68 5390 0754 7034"]
    phones = ["+44 20 7946 0958", "+49 30 12345678", "+33 1 42 68 53 00", "555.123.4567", "5551234567", "+442079460958", "+1.212.555.0199",
              "+44 (20) 7946 0958"]
    others = ["1700000000", "DE88 3704 0044 0532 0130 00", "+1234 is short", "3.1415926535", "12345678901"]
    shape = lambda t: re.sub("[A-Z]", "A", re.sub(r"\d", "0", t))
    rows = [f"{b} {v} {a}" for v in ibans + phones for b, a in (("pay", "AND call"), ("x:", "."))]
    got = made(spark, rows)
    for i, (new, kinds) in enumerate(got):
        value = (ibans + phones)[i // 2]
        assert kinds == ["iban" if value in ibans else "phone"], rows[i]
        assert shape(new) == shape(rows[i]) and value not in new
        assert new.startswith(rows[i].split(" ")[0]) and new.endswith(rows[i].rsplit(" ", 1)[1])
        if value in ibans:
            plain = re.sub("[ -]", "", new[len(rows[i].split(" ")[0]) + 1:][:len(value)])
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[:2] == value[:2]
    assert made(spark, others) == [(t, []) for t in others]
    # The forms of one number stay linked.
    (a, _), (b, _) = made(spark, ["DE89370400440532013000", ibans[0]])
    assert a == b.replace(" ", "")


def test_equal_values_stay_linked_and_others_apart(spark):
    cards = []
    for n in range(400):
        body = f"4{n:014d}"
        cards.append(next(body + str(c) for c in range(10) if luhn(body + str(c))))
    days = [f"{1900 + i // 12}-{i % 12 + 1:02d}-1{i % 10}" for i in range(600)]
    ips = [f"10.{i % 3}.{i}.{255 - i}" for i in range(250)]
    for values in (cards, days, ips):
        got = [t for t, _ in made(spark, [f"{v} and {v}" for v in values])]
        pairs = [g.split(" and ") for g in got]
        assert all(a == b for a, b in pairs) and len({a for a, _ in pairs}) == len(values)
    assert made(spark, [cards[0]], "k") != made(spark, [cards[0]], "other")


def test_pii_reads_long_runs_once(spark):
    """Runs of a million letters, digits or dotted letters without a blank, with an address behind them, take seconds."""
    runs = ["x" * 1_000_000, "7" * 1_000_000, "a." * 500_000, "漢" * 500_000]
    df = spark.createDataFrame([(i, r + " __ann.b@mail.example.org ") for i, r in enumerate(runs)], "doc_id long, text string")
    start = time.time()
    rows = pii.pseudonymise(df, "00ff").collect()
    assert time.time() - start < 60
    for r, run in zip(sorted(rows, key=lambda r: r["doc_id"]), runs):
        assert r["_kinds"] == ["email"] and r["text"].startswith(run + " __") and "ann.b@" not in r["text"]


def test_pii_edges(edge_docs, no_docs):
    out = pii.pseudonymise(edge_docs, "k")
    assert out.columns == [*edge_docs.columns, "_kinds"] and out.count() == edge_docs.count()
    assert out.drop("_kinds").exceptAll(edge_docs).count() == 0
    assert pii.pseudonymise(no_docs, "k").count() == 0


def test_quality_on_held_out_documents(spark, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge_quality(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    # Held-out labels teach nothing: turning them round changes no score.
    turned = labels.withColumn("quality", F.when(quality.crc_fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert got.select("doc_id", "score").exceptAll(quality.judge_quality(docs, turned).select("doc_id", "score")).count() == 0
    model = quality.train(docs, labels, bound=300)
    scored = edge_docs.select("doc_id", "text", quality.scorer(spark, model)("text").alias("s")).collect()
    assert len(scored) == edge_docs.count() and all(0 <= r["s"] <= 1 for r in scored)
    assert len({r["s"] for r in scored if not (r["text"] or "").strip()}) == 1
    kept = quality.keep_good(edge_docs.unionByName(docs.limit(0), allowMissingColumns=True), labels.limit(0).union(
        spark.createDataFrame([(0, 1, 0), (2, 0, 0), (None, 1, 0)], labels.schema)), 0.0)
    assert kept.count() == edge_docs.count()
    for few, score in ((labels.limit(0), 0.5), (spark.createDataFrame([(0, 1, 0), (1, 1, 0)], labels.schema), 5 / 6)):  # id 0 has three rows
        rows = quality.judge_quality(edge_docs, few).collect()
        assert len(rows) == edge_docs.count() and {r["score"] for r in rows} == {score}
        assert quality.keep_good(edge_docs, few).count() == edge_docs.count()
    assert quality.judge_quality(no_docs, labels).collect() == []


def test_languages_on_held_out_documents(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    rows = langid.identify_languages(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (3, 4, 5)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify_languages(no_docs).count() == 0
    nothing = langid.identify_languages(edge_docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_profiles_against_counting(monkeypatch):
    from collections import Counter
    text = "Ab, ba! été ab 12 x_y"
    plain = langid.letters(text)
    assert plain == " ab ba été ab x y "
    want = Counter(plain[i:i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))
    want = {g: c for g, c in want.items() if g.strip() and " " not in g[1:-1]}
    def decoded(size):
        monkeypatch.setattr(langid, "BLOCK", size)
        kinds, counts = langid.gram_counts(plain)
        out = {}
        for k, c in zip(kinds.tolist(), counts.tolist()):
            gram = ""
            while k:
                gram, k = chr(k & 0x1FFFFF) + gram, k >> 21
            out[gram] = c
        return out
    assert decoded(1 << 20) == want
    assert decoded(4) == want


def test_licences_in_documents(spark, edge_docs, no_docs):
    named = {"apache-2.0": "Apache License, Version 2.0", "mit": "MIT License", "gpl": "GNU General Public", "cc-by-nc": "CC BY-NC"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licences.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = {}
    for r in licences.find_licences(docs, model).where("confirmed").collect():
        found.setdefault(r["doc_id"], set()).add(r["family"])
    want = {i: {f for f, p in named.items() if p in t} for i, t in texts.items()}
    assert found == {i: f for i, f in want.items() if f}
    extra = spark.createDataFrame([
        (1, "word word\nFree: Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software "
            "without restriction\nend"), (2, "his driver's license was lost"), (3, "Licensed under the Homemade Whatever License 7"),
        (4, "Licensed under CC BY-SA 4.0.")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.find_licences(extra, model).collect()}
    assert rows[1]["family"] == "mit" and rows[1]["pos"] == 1 and rows[1]["confirmed"]
    assert rows[4]["family"] == "cc-by-sa" and 2 not in rows
    assert 3 not in rows or not rows[3]["confirmed"]
    per = licences.scan_licences(edge_docs, model=model)
    assert per.count() == edge_docs.count() and {r["families"] for r in per.collect()} == {""}
    assert licences.scan_licences(no_docs, model=model).count() == 0

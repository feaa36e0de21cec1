"""Collocations against plain counting, with every edge of the pieces, cuts and ties."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import collocations, common

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, score double, ws string"


def plain(rows, longest, least, top, share):
    counts, totals = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        found, n = [], totals[lang]
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in frequent.items())
            if not inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def mined(df, **settings):
    return sorted(tuple(r) for r in collocations.mine(df, **settings).collect())


@pytest.mark.parametrize("share", [100, 60])
def test_equals_plain_counts(spark, share):
    rng = random.Random(7)
    vocabulary = ["a", "B", "b", "é", "É", "x.y", " ", "new", "york", "-", "ß"]
    rows = []
    for i in range(120):
        ws = rng.choices(vocabulary, k=rng.randrange(60)) + ["New", "York", "city", "hall"] * rng.randrange(3)
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?"]) for w in ws)
        rows.append((text, rng.choice(["en", "en", "en", "und", None, ""])))
    rows += [(None, "en"), ("", None), ("...", "zz"), (None, None), rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, lang, 1, "p", 0.5, "w") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    want = plain(rows, 5, 6, 40, share)
    assert len(want) > 60
    assert mined(df, least=6, top=40, share=share) == want
    assert mined(df, least=3, top=1000, share=share, longest=3) == plain(rows, 3, 3, 1000, share)


def test_hot_word_long_text_and_no_rows(spark, edge_docs, no_docs):
    assert mined(no_docs) == []
    rows = [("go " * 20_000, "en"), ("go go stop " * 300, None)]
    df = spark.createDataFrame([(i, t, lang, 1, "p", 0.5, "w") for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert mined(df) == plain(rows, 5, 100, 2000, 100)
    assert mined(edge_docs, least=3) == plain([(r["text"], r["lang"]) for r in edge_docs.collect()], 5, 3, 2000, 100)


def test_plans_do_not_hold_the_filter(spark, edge_docs):
    texts = edge_docs.select("lang", collocations.words(F.col("text")).alias("ws"))
    plan = collocations.padded_windows(texts, 5, 2)._jdf.queryExecution().toString()
    assert len(plan) < 100_000  # the least filter has 16,384 numbers, and each word but the first is tested twice


@pytest.mark.parametrize("bits", [1 << 13, 1 << 20])
def test_filter_row_holds_the_bits_of_all_hashes(spark, bits):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    for some in (hashes, hashes.where("h is null")):
        rows = common.filter_row(some, bits).collect()
        want = [0] * (bits // 64)
        for (h,) in some.collect():
            for bit in (h % bits, (h >> 32) % bits):
                want[bit // 64] |= 1 << bit % 64
        assert [[n % (1 << 64) for n in r["flags"]] for r in rows] == [want]

"""N-gram Jaccard join against all pairs of exact sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import graph, jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, component string, key string, base int"


def shingles(text, size=4):
    ws = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    width = min(size, len(ws))
    return {" ".join(ws[i:i + width]) for i in range(len(ws) - width + 1)} if ws else set()


def plain(rows, percent=85):
    """(doc_id, n_shingles, component_id) of each row, from all pairs of distinct sets."""
    distinct = sorted({frozenset(shingles(t)) for _, t in rows} - {frozenset()}, key=len)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(a)] = root(b)
    lowest = {}
    for doc, text in rows:
        s = frozenset(shingles(text))
        if s and doc is not None:
            lowest[root(s)] = min(doc, lowest.get(root(s), doc))
    out = []
    for doc, text in rows:
        s = frozenset(shingles(text))
        out.append((doc, len(s), lowest.get(root(s)) if s else doc))
    return Counter(out)


def joined(df, **settings):
    return Counter(tuple(r) for r in jaccard.jaccard_join(df, **settings).collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, 1, "c", "k", 2) for i, t in rows], SCHEMA).repartition(parts)


def corpus(seed, bases, passage):
    """Texts with a common passage, edited at rates around the threshold, in groups of very different size."""
    rng, out = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    common = rng.choices(words, k=passage)
    for g in range(bases):
        base = rng.choices(words, k=rng.choice([5, 12, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                at = rng.randrange(len(text))
                text[at:at + rng.randrange(2)] = rng.choices(words, k=rng.randrange(3))
            if rng.random() < 0.4:
                text = common + text
            out.append(rng.choice([" ", "\n", "\t "]).join(text))
    return list(enumerate(out, 100))


@pytest.mark.parametrize("percent,orders", [(85, 3), (60, 2), (100, 3)])
def test_equals_all_pairs(spark, percent, orders):
    rows = corpus(percent, 60, 40)
    rows += [(1, None), (2, ""), (3, " \n"), (None, None), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"),
             (8, "Été é"), (9, "été é"), (None, rows[3][1]), (11, rows[3][1].upper()), rows[5], rows[5], (100, "a b c d e f g h")]
    want = plain(rows, percent)
    assert len({c for _, n, c in want if n}) < len({frozenset(shingles(t)) for _, t in rows})
    assert joined(frame(spark, rows), percent=percent, orders=orders) == want


def test_large_groups_share_their_tokens(spark):
    """A crowd of near copies, a crowd that shares most words but not enough, and long texts: no pair is lost."""
    rng = random.Random(3)
    base = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join(base[:150] + [f"q{i}"] + base[150:])) for i in range(600)]
    rows += [(1000 + i, " ".join(base[:40] + [f"r{i}x{j}" for j in range(3 + i % 9)])) for i in range(300)]
    long = [f"z{rng.randrange(5000)}" for _ in range(30_000)]
    rows += [(5000, " ".join(long)), (5001, " ".join(long[:-100])), (5002, " ".join(long[:20_000]))]
    assert joined(frame(spark, rows, 8)) == plain(rows)


def test_tables_with_edges(spark, edge_docs, no_docs):
    assert jaccard.jaccard_join(no_docs).collect() == []
    assert joined(edge_docs) == plain([(r["doc_id"], r["text"]) for r in edge_docs.collect()])


def test_every_order_is_a_sufficient_filter():
    """Similar sets meet in their prefixes under each order, whatever the rarity classes are."""
    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, n // 12).astype(np.uint64))))
        if len(b) == 0 or not jaccard.similar(a, b, 85):
            continue
        classes = rng.integers(0, 4, 1 << 16).astype(np.uint8)
        for order in (1, 2, 3):
            first = [jaccard._first(s, classes, order, len(s) - jaccard.least_overlap(len(s), 85) + 1)[0] for s in (a, b)]
            assert len(np.intersect1d(*first))


def test_members_are_dealt_once(spark, monkeypatch):
    """A small bucket is one block, and a group that meets under many keys sends each full set once; every open pair is kept."""
    kinds = "key long, id long, base boolean, star long, component long, c0 long"
    placed = spark.createDataFrame([(7, i, True, 0, max(0, i - 3), 0) for i in range(12)], kinds)
    rows = graph.block_pairs(placed).collect()
    assert len(rows) == 12 and len({(r["key"], r["i"], r["j"]) for r in rows}) == 1
    monkeypatch.setattr(graph, "MEMBERS", 3)
    blocks = {}
    for r in graph.block_pairs(placed).collect():
        blocks.setdefault((r["i"], r["j"]), []).append(r["id"])
    met = {tuple(sorted((a, b))) for ids in blocks.values() for a in ids for b in ids}
    assert met >= {(a, b) for a in range(12) for b in range(max(a + 1, 4), 12)}
    # Ten ids under eight keys, all but one of them under each; two ids under one key of their own.
    work = [(k, 0, 0, i, i, True, 9) for k in range(8) for i in range(10) if i != k] + [(90, 0, 0, i, i, True, 9) for i in (90, 91)]
    work = spark.createDataFrame(work, "key long, i long, j long, id long, component long, other boolean, n long")
    for members in (256, 3):
        monkeypatch.setattr(graph, "MEMBERS", members)
        blocks = {}
        for r in jaccard._gathered(work).collect():
            blocks.setdefault((r["key"], r["i"], r["j"]), []).append(r["id"])
        met = {tuple(sorted((a, b))) for ids in blocks.values() for a in ids for b in ids if a != b}
        assert met == {(a, b) for a in range(10) for b in range(a + 1, 10)} | {(90, 91)}
        assert sum(map(len, blocks.values())) == (12 if members == 256 else 32)  # by key: 74


def test_full_sets_are_sent_once_and_met_in_slots(spark, monkeypatch):
    import pyarrow as pa

    to = pa.array([[{"u": 1, "slot": 0}]] * 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), to, pa.array(["a b c d", "a b c d", "x"])], names=["id", "to", "text"])
    assert [b.column("id").to_pylist() for b in jaccard._sets(4)(iter([batch, batch]))] == [[1, 2]]
    monkeypatch.setattr(graph, "MEMBERS", 2)
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base] + [f"{base} n{i}" for i in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 4 + [(99, "alone here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect())
    assert got == sorted([(i, 0) for i in range(10)] + [(3, 0)] * 4 + [(99, 99)])

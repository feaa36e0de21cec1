import hashlib
import random
import re

import numpy as np

from cohortspark.llm import decontamination as D
from cohortspark.llm import topk

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(10, len(iw))
            for w in ({tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else ()):
                for at in range(len(ws) - n + 1):
                    if tuple(ws[at:at + n]) == w:
                        hit |= set(range(at, at + n))
                        found.add(item)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(ws), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in D.contamination(d, b).drop("k1", "k2").collect()]
    assert sorted(got, key=str) == brute(docs, items)
    kept = {r["doc_id"] for r in D.drop_contaminated(d, b).collect()}
    assert kept == {r[0] for r in brute(docs, items) if not r[5]}


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "a", "b", "c7", "été", "Zoo", "x"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([10, 11, 14, 30, 9, 3, 2, 1, 40, 12])]
    docs = []
    for i in range(60):
        ws = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            iw = items[rng.randrange(len(items))][1].split()
            a = rng.randrange(len(iw))
            ws[5:5] = iw[a:a + 12]
        docs.append((i, ", ".join(ws).upper() if i % 5 == 0 else " ".join(ws)))
    check(spark, docs, [x for x in items if len(x[1].split()) > 2])
    check(spark, docs[:20], items)


def test_decontamination_edges(spark, edge_docs, no_docs):
    docs = [(0, None), (1, ""), (2, "one two"), (2, "one two"), (None, "alpha beta gamma delta"), (3, "É é"), (4, "w " * 5000)]
    check(spark, docs, [(0, None), (1, ""), (2, "two"), (3, "Alpha BETA gamma"), (3, "Alpha BETA gamma"), (None, "gamma delta"), (4, "w w w w w w w w w w w")])
    check(spark, docs, [(0, None)])
    check(spark, docs, [])
    bench = spark.createDataFrame([(1, "quick brown fox jumps over")], "item_id long, text string")
    kept = D.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8, None}
    assert D.contamination(no_docs, bench).count() == 0


def nearest(rows, k=5, every=50):
    vectors = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows
               if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in vectors:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, k1 int" if len(rows[0]) > 2 else f"vec_id long, embedding array<{kind}>")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_products(frame).collect())


def test_many_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_NUMBERS", 8 * 300)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CHUNK", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=8) * 0.1]) for i in range(1500)]
    rows += [(i, rows[100][1]) for i in range(1500, 1900)]  # a large group of equals: ties to smaller ids
    assert run(spark, rows) == nearest(rows)


def test_tree_prunes_and_is_exact_for_large_numbers():
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(2000, 4)) * 2 ** 30).astype(np.int64)
    tree = topk.BallTree(np.arange(2000), vectors)
    least = np.full(3, np.iinfo(np.int64).min)
    found = tree.search(np.array([0, 1, 2]), vectors[:3], least, 5)
    for pos in range(3):
        exact = sorted(((-sum(int(a) * int(b) for a, b in zip(vectors[pos], v)), i) for i, v in enumerate(vectors) if i != pos))[:5]
        mine = found[found["pos"] == pos]
        assert list(zip(-mine["score"], mine["vec_id"])) == exact


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (1, [1.0, None]), (2, [inf, 1.0]), (None, [1.0, 1.0]), (3, [0.5, -0.1]), (4, []),
            (150, [1.0, 1.0, 1.0]), (5, [0.5, -0.1])]
    assert run(spark, rows) == nearest(rows)
    assert run(spark, [(7, [1.0])]) == [] and run(spark, [(50, [1.0])]) == []
    assert topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

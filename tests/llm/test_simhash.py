import random

import pytest

from cohortspark.llm import simhash
from cohortspark.llm.graph import components


def brute(prints):
    """doc -> least doc of its component, over all pairs."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and bin((prints[a] ^ prints[b]) & (2 ** 64 - 1)).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("part_edges", [40, 150, 1_000_000])
def test_components_of_a_long_path_and_a_star(spark, part_edges):
    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(9), part_edges=part_edges).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and len(got) == 400
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_of_planted_fingerprints(spark, monkeypatch):
    rng = random.Random(7)
    prints = {i: rng.getrandbits(64) for i in range(60)}
    for i in range(60, 400):  # chains and dense groups within 1 to 4 bits of earlier ones
        x = prints[rng.randrange(i) if i % 3 else rng.randrange(5)]
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints[i] = x
    signed = [(i, x - 2 ** 64 if x >= 2 ** 63 else x) for i, x in prints.items()]
    frame = spark.createDataFrame(signed, "doc long, fp long")
    linked = simhash.linked_groups(simhash.ring_members(frame.select("fp").distinct()), simhash.within_budgets, simhash.compare_blocks)
    component = {r["id"]: r["component"] for r in linked.collect()}
    groups = {}
    for i, x in signed:
        groups.setdefault(component.get(x, x), set()).add(i)
    want = {}
    for i, c in brute(prints).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_edges(edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[0]["component_id"] == by[1]["component_id"] == by[10]["component_id"] == 0  # case of A-Z does not count
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"] == "0" * 16
    assert {by[i]["component_id"] for i in (3, 4, 5)} == {3}
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and None not in ids and 4 not in ids
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = brute({i: int(r["fingerprint"], 16) for i, r in got.items()})
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert sum(r["stays"] for r in got.values()) == len(set(want.values()))

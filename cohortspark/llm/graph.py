"""Connected components, and groups of ids that share buckets and pass a test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import broadcast_if_small, cut

#: Members of a block in the comparison of crowded buckets, and copies of a component's head in a join.
MEMBERS, SALTS = 256, 16
#: Edges united by one task at a time, in 150 MB or less.
PART_EDGES = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one part, by least labels and pointer jumping: each node with the least of its part."""
    pairs = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches if b.num_rows]
    if pairs:
        ids, places = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
        u, v = places.reshape(2, -1)
        label = np.arange(len(ids))
        while True:
            before, low = label.copy(), np.minimum(label[u], label[v])
            for end in (u, v):
                np.minimum.at(label, label[end], low)
                np.minimum.at(label, end, low)
            label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(ids[label]), pa.array(ids)], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 100, part_edges: int = PART_EDGES) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v) of longs: rows (id, component), component the least id.

    A distributed union-find. Each round unites the edges inside parts of about ``part_edges``, whose stars have
    at most as many edges as nodes, then joins the parts' stars by a large-star and a small-star step (two
    aggregates and two equi joins), until nothing changes; edges that fit one part need no second. Nodes
    without an edge do not appear.
    """
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        parts = max(1, -(-state[0] // part_edges))
        stars = edges.coalesce(parts).mapInArrow(_united, "u bigint, v bigint")
        if parts == 1:
            return cut(stars).select(F.col("v").alias("id"), F.col("u").alias("component"))
        edges = stars.where("u <> v")
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("u"), F.col("b").alias("v"))
                 .distinct())
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(lowest, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
                 .union(lowest.select("m", "v")).distinct())
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            nodes = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
            return nodes.union(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def with_heads(placed: DataFrame, first: str, head: str) -> DataFrame:
    """``placed`` with the least ``first`` of each row's ``component`` as ``head``.

    Each head meets its component's rows in SALTS parts, so that a component that holds most rows is no hot key.
    """
    heads = placed.groupBy("component").agg(F.min(first).alias(head)).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64(first), F.lit(SALTS)).cast("int"))
    return salted.join(heads, ["component", "_salt"]).drop("_salt")


def block_pairs(placed: DataFrame) -> DataFrame:
    """(key, i, j, id, component, other): the members of each bucket dealt to pairs of blocks that cover all its open pairs.

    placed: (key, id, base, component, star, c0). Members outside the pivot's component (other) meet each
    other and those inside. Equal member sets of several keys are dealt once.
    """
    placed = cut(placed.select("key", "id", "base", "component", (F.col("component") != F.col("c0")).alias("other")))
    sets = placed.groupBy("key").agg(
        F.count_if("other").alias("n1"), F.count_if(~F.col("other")).alias("n0"),
        F.sum(F.xxhash64("id", "base").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64("id", "base", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
    sets = sets.groupBy("s1", "s2", "n0", "n1").agg(F.min("key").alias("key"))
    sets = sets.select("key", F.ceil(F.col("n0") / MEMBERS).alias("b0"), F.ceil(F.col("n1") / MEMBERS).alias("b1"))
    members = placed.join(sets, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("other"), F.col("b1")).otherwise(
        F.col("b0"))))
    # Blocks of others are numbered 0.. b1-1, of the pivot's component b1.. b1+b0-1; pairs are (i, j), i < j, i an other
    # block. A block meets itself wherever it meets another, and there is always one: the pivot's.
    one, last = F.lit(1).cast("bigint"), F.col("b1") - 1
    others = F.filter(F.sequence(one * 0, last + F.col("b0")), lambda k: k != F.col("block"))
    partners = F.when(F.col("other"), F.transform(others, lambda k: F.struct(
        F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j")))).otherwise(
        F.transform(F.sequence(one * 0, last), lambda k: F.struct(k.alias("i"), (F.col("block") + F.col("b1")).alias("j"))))
    return members.select("key", "id", "component", "other", "base", F.explode(partners).alias("p")).select(
        "key", "p.i", "p.j", "id", "component", "other", "base")


def linked_groups(members: DataFrame, verify, compare) -> DataFrame:
    """Components of the ids that share a bucket and pass ``verify``: rows (id, component) of linked ids.

    members: (key, id, base); a pair is a candidate if it shares a key and one of the two has base = true.
    verify: takes distinct candidate pairs (u, v) and returns those that are links.
    compare: takes what is left, (key, id, base, component, star, c0) of the buckets with several
    components, star the bucket's pivot and c0 that one's component, and returns links (u, v) across components.

    A bucket is first tried as a star around its least base id, so a bucket of copies costs one
    candidate per member. Only buckets whose members are then still in different components are
    compared further, and only across components: no link is lost and no group of copies is squared.
    """
    # Every key with two ids at least; buckets of two need no join back.
    buckets = members.groupBy("key").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.when(F.col("base"), F.col("id"))).alias("star"),
        F.count("*").alias("n")).where("lo <> hi and star is not null")
    buckets = cut(buckets)
    pairs = buckets.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    crowded = broadcast_if_small(cut(buckets.where("n > 2").select("key", "star")))
    within = cut(members.join(crowded, "key"))
    stars = within.where("id <> star").select(F.least("id", "star").alias("u"), F.greatest("id", "star").alias("v"))
    first = components(verify(pairs.union(stars).distinct()))
    placed = within.join(first, "id", "left").select(
        "key", "id", "base", "star", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("c"), F.max("component").alias("c1"),
        F.min(F.when(F.col("id") == F.col("star"), F.col("component"))).alias("c0")).where("c <> c1")
    placed = placed.join(mixed.select("key", "c0"), "key")
    rest = compare(placed)
    return components(first.select(F.col("component").alias("u"), F.col("id").alias("v")).union(rest.select("u", "v")))


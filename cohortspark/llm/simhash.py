"""Near duplicates by SimHash; candidates come from pigeonring chains of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import cut, keyed, row_keys, same_key, unpacked
from cohortspark.llm.graph import block_pairs, linked_groups, with_heads

SEED, SEGMENTS, WIDTH, DISTANCE = 42, 4, 16, 3
#: Shingles whose bits are counted at a time, so a very long text needs no more memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash: bit set if it is set in over half of the shingles' XXH64; 0 without words.

    Bytes are split at ASCII blanks and A-Z lowered, so all other letters stay as they are.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined, n = b" ".join(words), len(words) - width + 1
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > n, bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprints(shingle: int):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(prints, pa.int64())],
                names=["doc_id", "k1", "k2", "fp"])
    return batches


def _rotated(fp: Column, i: int) -> Column:
    """The fingerprint with segment ``i`` in its lowest bits and the ring's next segments above it."""
    return fp if i == 0 else F.shiftrightunsigned(fp, WIDTH * i).bitwiseOR(F.shiftleft(fp, 64 - WIDTH * i))


def ring_members(prints: DataFrame) -> DataFrame:
    """(key, id, base): chain keys of distinct fingerprints ``fp``.

    Two fingerprints within DISTANCE = 3 have, on the ring of 4 segments, a start whose chains of
    1, 2, 3, 4 segments differ in at most 0, 1, 2, 3 bits (l * 3 / 4, rounded down). The first two
    chains become an equality: segment i as it is, and segment i+1 of one side with at most one bit
    changed. Each fingerprint gives, per start, one base key and 16 changed ones.
    """
    mask = (1 << (2 * WIDTH)) - 1
    keys = []
    for i in range(SEGMENTS):
        chain = _rotated(F.col("fp"), i).bitwiseAND(F.lit(mask))
        tag = F.lit(i << (2 * WIDTH))
        keys.append(F.struct(chain.bitwiseOR(tag).alias("key"), F.lit(True).alias("base")))
        keys += [F.struct(chain.bitwiseXOR(F.lit(1 << (WIDTH + b))).bitwiseOR(tag).alias("key"),
                          F.lit(False).alias("base")) for b in range(WIDTH)]
    return prints.select(F.col("fp").alias("id"), F.explode(F.array(*keys)).alias("m")).select("m.key", "id", "m.base")


def within_budgets(pairs: DataFrame) -> DataFrame:
    """Keep pairs (u, v) that have a start whose chains all stay within their budgets, then check the distance."""
    x = F.col("u").bitwiseXOR(F.col("v"))
    segment = [F.bit_count(F.shiftrightunsigned(x, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)))
               for i in range(SEGMENTS)]
    starts = F.lit(False)
    for i in range(SEGMENTS):
        chain, fits = F.lit(0), F.lit(True)
        for length in range(1, SEGMENTS + 1):
            chain = chain + segment[(i + length - 1) % SEGMENTS]
            fits = fits & (chain <= length * DISTANCE // SEGMENTS)
        starts = starts | fits
    return pairs.where(starts).where(F.bit_count(x) <= DISTANCE).select("u", "v")


def _block_links(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components inside each (key, i, j), whose rows are adjacent: all distances of a block's fingerprints."""
    group, rows = None, []

    def links() -> pa.RecordBatch:
        ids, component, other = (np.array([r[k] for r in rows]) for k in range(3))
        prints = ids.view(np.uint64)
        far = np.bitwise_count(prints[:, None] ^ prints[None])
        close = np.triu((far <= DISTANCE) & (component[:, None] != component[None]) & (other[:, None] | other[None]), 1)
        u, v = np.nonzero(close)
        # One link for each pair of components; the others add nothing.
        ends = np.sort(np.stack([component[u], component[v]], axis=1), axis=1) if len(u) else np.empty((0, 2), dtype=np.int64)
        at = np.unique(ends, axis=0, return_index=True)[1] if len(u) else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[u[at]]), pa.array(ids[v[at]])], names=["u", "v"])

    for batch in source:
        for key, i, j, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "id", "component", "other")]):
            if (key, i, j) != group and rows:
                yield links()
                rows = []
            group = (key, i, j)
            rows.append(row)
    if rows:
        yield links()


def compare_blocks(placed: DataFrame) -> DataFrame:
    """Compare the members of crowded chain keys in pairs of blocks, so that no bucket is squared in rows."""
    work = block_pairs(placed).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return work.select("key", "i", "j", "id", "component", "other").mapInArrow(_block_links, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, k1, k2, stays.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most 3 bits, the
    row's own included (null only if no reachable row has an id). k1, k2 identify the row by its id
    and text; ``stays`` is true for the rows of one (k1, k2) of each component, that with the
    smallest id, nulls last. Null and empty texts have fingerprint zero and link like any other;
    repeated rows share a fingerprint and so a component. Other columns of ``docs`` are not read.
    """
    k1, k2 = row_keys(id_column, text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_column).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    prints = cut(rows.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, k1 bigint, k2 bigint, fp bigint"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    distinct = cut(prints.groupBy("fp").agg(first.alias("first")))
    linked = linked_groups(ring_members(distinct.select("fp")), within_budgets, compare_blocks)
    placed = distinct.join(linked, distinct["fp"] == linked["id"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    groups = cut(with_heads(placed, "first", "best").select(F.col("fp").alias("_fp"), "best"))
    return prints.join(groups, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"), "k1", "k2",
        ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("stays"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, its columns unchanged."""
    kept = near_duplicates(docs).where("stays").select("k1", "k2").distinct()
    rows = keyed(docs, "doc_id", "text").join(kept, same_key())
    return unpacked(rows.dropDuplicates(["_k1", "_k2"]))

"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortspark.llm.common import broadcast_if_small, cut, keyed, row_keys, same_key
from cohortspark.llm.graph import block_pairs, linked_groups, with_heads

SHINGLE, SIMILARITY, MIN_WORDS = 8, 0.8, 1
#: At Jaccard 0.8 a band of 4 agrees with probability 0.41, one of 10 with 0.995; at 0.9 one of 10 with 0.99998.
BANDS, ROWS = 10, 4
SLOTS = BANDS * ROWS
#: Lines with at most SHORT distinct shingles hash them SLOTS times; lines with at least LONG deal one hash of
#: each to SLOTS bins. LONG = SIMILARITY * SHORT, so two similar lines always have a scheme in common.
SHORT, LONG = 120, 96
#: Characters signed or compared at a time, and columns of shingles multiplied at a time.
BLOCK, COLUMNS = 1 << 18, 1 << 13
#: Places a line's hashes are dealt to: as many as are taken, so many distinct ones at least it has.
PLACES = 1 << 10

_ODD = 0x9E3779B1
_INVERSE = pow(_ODD, -1, 1 << 32)


def _single(line: str) -> str:
    """With each run of blanks one space, and none around; most lines already are so, and all blanks but the space are unprintable."""
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line
    return " ".join(line.split())


def normal(line: str) -> str:
    """Lower-cased, with each run of blanks one space."""
    return _single(line.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


_A = _mix(np.arange(1, SLOTS + 1, dtype=np.uint32)) | np.uint32(1)
_B = _mix(np.arange(101, SLOTS + 101, dtype=np.uint32))
_NONE = np.uint32(0xFFFFFFFF)


@functools.lru_cache(1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.full(length, x, dtype=np.uint32), dtype=np.uint32) for x in (_ODD, _INVERSE))


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lines' character shingles, and each line's number of them; a shorter line is one shingle."""
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    powers, inverse = _powers(1 << max(BLOCK * 2, len(codes)).bit_length())
    # A polynomial's prefix sums give each window's value, here also of windows that leave their line.
    sums = np.zeros(len(codes) + 1, dtype=np.uint32)
    np.cumsum((codes + np.uint32(1)) * powers[:len(codes)], dtype=np.uint32, out=sums[1:])
    values = (sums[SHINGLE:] - sums[:-SHINGLE]) * inverse[:len(codes) - SHINGLE + 1]
    inside = np.ones(len(codes), dtype=bool)
    inside[(np.cumsum(lengths)[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    return _mix(values[inside[:len(values)]]), lengths - SHINGLE + 1


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of distinct hashes of the lines: exact up to SHORT, more than SHORT otherwise; of lines below LONG, always short, all hashes."""
    lines = np.flatnonzero(counts >= LONG)
    if not len(lines):
        return counts
    chosen, sizes = hashes[np.repeat(counts >= LONG, counts)], counts[lines]
    owners = np.repeat(np.arange(len(lines)), sizes)
    taken = np.zeros((len(lines), PLACES), dtype=bool)
    taken[owners, chosen & np.uint32(PLACES - 1)] = True
    found = taken.sum(axis=1)
    # Only lines with few places taken are counted exactly.
    few = found <= SHORT
    if few.any():
        at = few[owners]
        keys = owners[at].astype(np.uint64) << np.uint64(32) | chosen[at]
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
        found = np.where(few, np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(lines)), found)
    counts = counts.copy()
    counts[lines] = found
    return counts


def _short(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    return np.stack([np.minimum.reduceat(hashes * a + b, starts) for a, b in zip(_A, _B)], axis=1)


def _long(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    slots = np.full(len(counts) * SLOTS, _NONE, dtype=np.uint32)
    bins = ((hashes >> np.uint32(16)) * np.uint32(SLOTS)) >> np.uint32(16)
    np.minimum.at(slots, np.repeat(np.arange(len(counts)) * SLOTS, counts) + bins, hashes * _A[0])
    slots = slots.reshape(-1, SLOTS)
    while (empty := slots == _NONE).any():  # an empty bin takes its neighbour's value
        slots = np.where(empty, np.roll(slots, 1, axis=1), slots)
    return slots


def _bands(slots: np.ndarray, scheme: int) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000 * (scheme + 1)), (len(slots), 1))
    for r in range(ROWS):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, r::ROWS])
    return key.view(np.int64)


def band_keys(lines: list[str]) -> pa.ListArray:
    """Band keys of normalised, non-empty lines: BANDS keys, twice that for lines of both schemes."""
    owners, keys = [], []
    start = 0
    while start < len(lines):
        end, size = start + 1, len(lines[start])
        while end < len(lines) and size + len(lines[end]) <= BLOCK:
            size += len(lines[end])
            end += 1
        hashes, counts = _shingle_hashes(lines[start:end])
        # Similarity is one of sets: a repetitive line counts each shingle once. Minima need no distinct hashes.
        distinct = _distinct(hashes, counts)
        for scheme, chosen, sign in ((0, distinct <= SHORT, _short), (1, distinct >= LONG, _long)):
            if chosen.any():
                owners.append(np.repeat(np.flatnonzero(chosen) + start, BANDS))
                keys.append(_bands(sign(hashes[np.repeat(chosen, counts)], counts[chosen]), scheme).ravel())
        start = end
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=len(lines))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys)[order]))


def _lines(min_words: int, signed: bool):
    """Rows of lines from rows of texts: the row's id and keys, the line's position and 128-bit hash, its band keys."""
    def packed(batch: pa.RecordBatch, at: list[int], pos: list[int], lines: list[str]) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), dtype="<i8").reshape(-1, 2)
        head = batch.select(["id", "k1", "k2"]).take(pa.array(at, pa.int64()))
        arrays = [*head.columns, pa.array(pos, pa.int32()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
        if signed:
            arrays.append(band_keys(lines))
        return pa.RecordBatch.from_arrays(arrays, names=["id", "k1", "k2", "pos", "h1", "h2", "bands"][:len(arrays)])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at, pos, lines, size = [], [], [], 0
            for row, text in enumerate(batch.column("text")):
                for i, line in enumerate(text.as_py().lower().split("\n")):
                    line = _single(line)
                    if not line or line.count(" ") + 1 < min_words:
                        continue
                    at.append(row)
                    pos.append(i)
                    lines.append(line)
                    size += len(line)
                    if size > BLOCK:
                        yield packed(batch, at, pos, lines)
                        at, pos, lines, size = [], [], [], 0
            if lines:
                yield packed(batch, at, pos, lines)
    return batches


def _picked_lines(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normalised lines at the wanted places (line, pos) of each text."""
    for batch in source:
        ids, lines = [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            parts = text.as_py().split("\n")
            for w in wanted.as_py():
                ids.append(w["id"])
                lines.append(normal(parts[w["pos"]]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], names=["id", "line"])


def shingle_ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the distinct shingles of each line as sorted numbers, equal only for equal shingles, and where each line's end.

    Eight characters below 256 are one 64-bit number; windows with others, and shorter lines, are compared as they are.
    """
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    short = np.maximum(SHINGLE - lengths, 0)
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    # Shorter lines are filled up with what no text can hold.
    codes = np.full(int((lengths + short).sum()), 0x110000, dtype=np.uint32)
    starts = np.cumsum(lengths + short) - (lengths + short)
    codes[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(text))] = text
    counts = lengths + short - SHINGLE + 1
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    # First at all places, also of windows that leave their line.
    last = len(codes) - SHINGLE + 1
    packed, wide = np.zeros(last, dtype=np.uint64), np.zeros(last, dtype=bool)
    for i in range(SHINGLE):
        code = codes[i:last + i]
        wide |= code > 255
        packed |= code.astype(np.uint64) << np.uint64(8 * i)
    packed, wide = packed[at], wide[at]
    ids = np.zeros(len(at), dtype=np.uint64)
    ids_plain, plain = pd.factorize(packed[~wide])
    ids[~wide] = ids_plain
    if wide.any():
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, SHINGLE)[at[wide]])
        ids[wide] = np.unique(windows.view(f"V{4 * SHINGLE}").ravel(), return_inverse=True)[1] + len(plain)
    keys = np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << np.uint64(32) | ids
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & np.uint64(0xFFFFFFFF), np.searchsorted(keys, np.arange(1, len(lines) + 1, dtype=np.uint64) << np.uint64(32))


def _taken(ids: np.ndarray, ends: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the chosen lines, one after the other, and the place of each one's line among the chosen."""
    starts = np.append(0, ends[:-1])[lines]
    sizes = ends[lines] - starts
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return ids[places], np.repeat(np.arange(len(lines), dtype=np.uint64), sizes)


def similarities(lines: list[str], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sizes of the intersections and unions of the shingle sets of the lines numbered ``a`` and ``b``."""
    ids, ends = shingle_ids(lines)
    sizes = np.diff(np.append(0, ends))
    both, at = np.zeros(len(a), dtype=np.int64), 0
    while at < len(a):
        # As many pairs as hold BLOCK shingles, one at least.
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[a[at:]] + sizes[b[at:]]), BLOCK, side="right")))
        keys = np.concatenate([pair << np.uint64(32) | i for i, pair in (_taken(ids, ends, x[at:end]) for x in (a, b))])
        keys.sort()
        met = keys[1:][keys[1:] == keys[:-1]]
        both[at:end] = np.bincount((met >> np.uint64(32)).astype(np.int64), minlength=end - at)
        at = end
    return both, sizes[a] + sizes[b] - both


def jaccard(a: str, b: str) -> float:
    """Exact similarity of the lines' sets of character shingles."""
    both, either = similarities([a, b], np.array([0]), np.array([1]))
    return both[0] / either[0]


def _similar(similarity: float):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sizes, at = np.cumsum([len(x) + len(y) for x, y in zip(a, b)]), 0
            while at < len(a):
                # As many pairs as hold BLOCK characters, one at least.
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, side="right")))
                numbers: dict[str, int] = {}
                places = [np.array([numbers.setdefault(x, len(numbers)) for x in side[at:end]]) for side in (a, b)]
                both, either = similarities(list(numbers), *places)
                yield batch.select(["u", "v"]).slice(at, end - at).filter(pa.array(both / either >= similarity))
                at = end
    return batches


def similar_pairs(lines: list[str], component: list[int], other: list[bool], similarity: float) -> list[tuple[int, int]]:
    """Links that join components of ``lines``: a spanning set of the pairs of at least ``similarity`` with an ``other`` line.

    Intersections of the shingle sets come from a product of 0/1 matrices, some columns at a time.
    """
    columns, ends = shingle_ids(lines)
    columns, sizes = columns.astype(np.int64), np.diff(np.append(0, ends))
    at = np.repeat(np.arange(len(lines)), sizes)
    both = np.zeros((len(lines), len(lines)), dtype=np.float32)
    # A shingle of one line only is in no intersection.
    shared = np.bincount(columns) > 1
    at, columns = at[shared[columns]], (np.cumsum(shared) - 1)[columns[shared[columns]]]
    for low in range(0, int(shared.sum()), COLUMNS):
        use = (columns >= low) & (columns < low + COLUMNS)
        held = np.zeros((len(lines), min(COLUMNS, int(shared.sum()) - low)), dtype=np.float32)
        held[at[use], columns[use] - low] = 1
        both += held @ held.T
    either = sizes[:, None] + sizes[None] - both
    kind = np.array(component)
    links = (both >= similarity * either - 1e-6) & (kind[:, None] != kind[None]) & (np.array(other)[:, None] | np.array(other)[None])
    found, joined = [], {}

    def root(c: int) -> int:
        while joined.get(c, c) != c:
            c = joined[c]
        return c

    for i, j in zip(*np.nonzero(np.triu(links, 1))):
        a, b = root(component[i]), root(component[j])
        if a != b and both[i, j] / either[i, j] >= similarity:
            joined[max(a, b)] = min(a, b)
            found.append((int(i), int(j)))
    return found


def _blocks_compared(similarity: float):
    """Links of the rows of each (key, i, j), whose rows are adjacent."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def links() -> pa.RecordBatch:
            pairs = similar_pairs([r[2] for r in rows], [r[1] for r in rows], [r[3] for r in rows], similarity)
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in side], pa.int64()) for side in (
                [p[0] for p in pairs], [p[1] for p in pairs])], names=["u", "v"])

        for batch in source:
            cols = [batch.column(n).to_pylist() for n in ("key", "i", "j", "id", "component", "line", "other")]
            for key, i, j, *row in zip(*cols):
                if (key, i, j) != group and rows:
                    yield links()
                    rows = []
                group = (key, i, j)
                rows.append(row)
        if rows:
            yield links()
    return batches


def _lines_of(rows: DataFrame, lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the distinct lines with ``ids``, read from the text of their first occurrence."""
    wanted = cut(lines.join(ids.distinct(), "id").groupBy(F.col("first.k1").alias("w1"), F.col("first.k2").alias("w2")).agg(
        F.collect_list(F.struct("id", F.col("first.pos").alias("pos"))).alias("wanted")))
    source = rows.join(broadcast_if_small(wanted, F.size("wanted")),
                       (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")))
    return cut(source.select("text", "wanted").mapInArrow(_picked_lines, "id bigint, line string").dropDuplicates(["id"]))


def _verifier(rows: DataFrame, lines: DataFrame, similarity: float):
    def verify(pairs: DataFrame) -> DataFrame:
        """Compare the lines of candidate pairs exactly."""
        pairs = cut(pairs)
        texts = _lines_of(rows, lines, pairs.select(F.col("u").alias("id")).union(pairs.select("v")))
        # Last by u: a star's pairs are then neighbours, and its shingles are made once.
        both = pairs.join(texts.select(F.col("id").alias("v"), F.col("line").alias("b")), "v").join(
            texts.select(F.col("id").alias("u"), F.col("line").alias("a")), "u")
        return both.mapInArrow(_similar(similarity), "u bigint, v bigint")
    return verify


def _comparer(rows: DataFrame, lines: DataFrame, similarity: float):
    def compare(placed: DataFrame) -> DataFrame:
        """Compare the lines of crowded buckets in pairs of blocks."""
        work = block_pairs(placed)
        work = work.join(_lines_of(rows, lines, work.select("id")), "id")
        work = work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
        return work.select("key", "i", "j", "id", "component", "line", "other").mapInArrow(
            _blocks_compared(similarity), "u bigint, v bigint")
    return compare


@F.pandas_udf(StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def strip(t, positions):
        if t is None or positions is None:
            return t
        positions = set(positions)
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in positions)
    return pd.Series([strip(t, g) for t, g in zip(text, gone)], dtype=object)


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, gone): positions of the lines to remove from the rows of ``docs`` with these keys.

    Each distinct line sends its band keys, not its text; only lines of candidate pairs are read again
    for the exact test. A hot line is counted before the shuffle and is one node of the graph.
    """
    k1, k2 = row_keys(id_column, text_column)
    rows = docs.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_column).alias("text"))
    fields = f"id {dict(rows.dtypes)['id']}, k1 bigint, k2 bigint, pos int, h1 bigint, h2 bigint"
    signed = rows.mapInArrow(_lines(min_words, True), f"{fields}, bands array<bigint>")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "pos")
    lines = signed.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    lines = cut(lines.withColumn("id", F.monotonically_increasing_id()))
    members = lines.select(F.explode("bands").alias("key"), "id", F.lit(True).alias("base"))
    places = lines.select("id", "first")
    groups = linked_groups(members, _verifier(rows, places, similarity), _comparer(rows, places, similarity))
    placed = lines.select("id", "h1", "h2", "n", "first").join(groups, "id", "left")
    # A line that occurs once and has no partner stays; all others follow their component's first place.
    placed = cut(placed.where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "id")))
    placed = cut(with_heads(placed, "first", "head"))
    at = ["k1", "k2", "pos"]
    single = placed.where("n = 1 and first <> head").select(*[F.col(f"first.{c}").alias(c) for c in at])
    many = broadcast_if_small(cut(placed.where("n > 1").select(
        "h1", "h2", *[F.col(f"head.{c}").alias(f"head_{c}") for c in at])))
    again = rows.mapInArrow(_lines(min_words, False), fields).join(many, ["h1", "h2"]).where(
        "k1 <> head_k1 or k2 <> head_k2 or pos <> head_pos").select(*at)
    return single.union(again).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, and the column _removed, the number of lines removed.

    A line is what "\\n" separates. Lines whose sets of 8-character shingles, lower-cased and with
    single blanks, have a Jaccard similarity of at least ``similarity`` link; of all occurrences of a
    component only the first stays, ordered by the document's id (nulls last), the row's keys and the
    position. By default each line with a visible character counts; scripts without blanks have lines of
    one word. Lines of fewer than ``min_words`` words, blank ones too, are left alone. All other
    columns pass unchanged; null texts stay null, a text of only repeated lines becomes empty. Fully
    repeated rows are one document: each keeps the same lines.
    """
    gone = cut(repeated_lines(docs, id_column, text_column, similarity, min_words))
    joined = keyed(docs, id_column, text_column).join(broadcast_if_small(gone, F.size("gone") + 4), same_key(), "left")
    text = F.col(f"_row.`{text_column}`")
    kept = F.when(F.col("gone").isNull(), text).otherwise(_without(F.when(F.col("gone").isNotNull(), text), "gone"))
    return joined.select(*[(kept if c == text_column else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns],
                         F.coalesce(F.size("gone"), F.lit(0)).alias("_removed"))

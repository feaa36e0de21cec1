"""Set-similarity self-join of word n-grams: prefixes under several global token orders, then exact overlaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import graph
from cohortspark.llm.common import broadcast_if_small, cut, row_keys
from cohortspark.llm.graph import block_pairs, components, linked_groups, with_heads

SHINGLE, PERCENT, ORDERS = 4, 85, 3
#: Counters of the rarity sketch: about one a word, in these bounds (a byte each once they are classes). Fewer
#: counters than shingles only make the first prefix less rare; any fixed order finds every link.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 24
#: Counters a task sends as one block, and columns multiplied at a time.
SECTION, COLUMNS = 1 << 16, 1 << 13


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit numbers for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words; of the whole sequence if it is shorter; empty without words.

    Bytes are split at ASCII blanks and A-Z lowered, so all other letters stay as they are.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    width, h = min(size, len(words)), np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n], 0)
    return np.unique(out)


def _counters(width: int, size: int):
    """Per task: how many of its distinct sets touch each counter, in compressed sections."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(width, dtype=np.uint32), set()
        shift = np.uint64(64 - (width.bit_length() - 1))
        for batch in source:
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), size)
                mark = xxhash.xxh3_128_digest(tokens)
                if len(tokens) and mark not in seen:
                    seen.add(mark)
                    counts[tokens >> shift] += 1
        if seen:
            parts = [np.minimum(counts[at:at + SECTION], 0xFFFF).astype("<u2") for at in range(0, width, SECTION)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(
                [zlib.compress(p, 1) for p in parts], pa.binary())], names=["section", "counts"])
    return batches


def _classes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections, each on adjacent rows, summed over tasks and turned into logarithmic classes of a byte."""
    section, total = None, np.zeros(SECTION, dtype=np.int64)

    def packed() -> pa.RecordBatch:
        classes = np.minimum(255, 6 * np.log2(total + 1.0)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([section], pa.int32()), pa.array([classes.tobytes()], pa.binary())],
                                          names=["section", "classes"])

    for batch in source:
        for at, counts in zip(batch.column("section").to_pylist(), batch.column("counts").to_pylist()):
            if at != section:
                if section is not None:
                    yield packed()
                section, total = at, np.zeros(SECTION, dtype=np.int64)
            total += np.frombuffer(zlib.decompress(counts), dtype="<u2")
    if section is not None:
        yield packed()


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """A class of rarity per counter, over all texts: at most MOST_COUNTERS bytes, whatever the corpus holds."""
    spent = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(LEAST_COUNTERS, min(MOST_COUNTERS, 1 << (spent // 6).bit_length()))
    sections = texts.mapInArrow(_counters(width, size), "section int, counts binary")
    sections = sections.repartition("section").sortWithinPartitions("section").mapInArrow(_classes, "section int, classes binary")
    found = np.zeros(width, dtype=np.uint8)
    for row in sections.collect():
        found[row["section"] * SECTION:(row["section"] + 1) * SECTION] = np.frombuffer(row["classes"], dtype=np.uint8)
    return found


def _first(tokens: np.ndarray, classes: np.ndarray, order: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` first tokens in a global order (rarity class, then the order's own permutation), ties included, and their ranks."""
    shift = np.uint64(64 - (len(classes).bit_length() - 1))
    rank = classes[tokens >> shift].astype(np.uint64) << np.uint64(56) | _mixed(tokens, order) >> np.uint64(8)
    limit = np.partition(rank, count - 1)[count - 1]
    chosen = rank <= limit
    return tokens[chosen], rank[chosen]


def least_overlap(n: int, percent: int) -> int:
    """Tokens a set of n must share with any set of at least that similarity."""
    return -(-percent * n // 100)


def _prefixes(classes, size: int, percent: int, orders: int):
    """(id columns, n, h1, h2, keys, base, others) of each text; the lists only for the first text of a set in its task.

    keys: the prefix under the first order, those of the shorter index prefix first (base of them);
    others: the prefixes under the other orders, as 32-bit numbers.
    """
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in source:
            n, marks, keys, base, others = [], [], [], [], [[] for _ in range(orders - 1)]
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), size)
                mark = xxhash.xxh3_128_digest(tokens)
                n.append(len(tokens))
                marks.append(mark)
                if mark in seen or not len(tokens):
                    for column in (keys, base, *others):
                        column.append(None)
                    continue
                seen.add(mark)
                count = len(tokens) - least_overlap(len(tokens), percent) + 1
                # A partner at least as large shares 2p / (100 + p) of this set: its index prefix is shorter.
                index = len(tokens) + -(-2 * percent * len(tokens) // (100 + percent)) * -1 + 1
                chosen, rank = _first(tokens, classes.value, 1, count)
                by = np.argsort(rank, kind="stable")
                keys.append(chosen[by].view(np.int64))
                base.append(int((rank <= rank[by][index - 1]).sum()))
                for o, column in enumerate(others, 2):
                    column.append((_first(tokens, classes.value, o, count)[0] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            marks = np.frombuffer(b"".join(marks), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "k1", "k2"]).columns, pa.array(n, pa.int64()), pa.array(marks[:, 0].copy()),
                 pa.array(marks[:, 1].copy()), pa.array(keys, pa.list_(pa.int64())), pa.array(base, pa.int32()),
                 *[pa.array(c, pa.list_(pa.int32())) for c in others]],
                names=["doc_id", "k1", "k2", "n", "h1", "h2", "keys", "base"] + [f"q{o}" for o in range(2, orders + 1)])
    return batches


def _sets(size: int):
    """(id, to, tokens): the set of each text, where it is sent; once an id and task, however often its row is repeated."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in source:
            ids = batch.column("id").to_pylist()
            new = [k for k, i in enumerate(ids) if i not in seen and not seen.add(i)]
            if new:
                batch = batch.take(pa.array(new, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("to"), pa.array(
                    [shingle_set(t.as_py(), size).tobytes() for t in batch.column("text")], pa.binary())], names=["id", "to", "tokens"])
    return batches


def _tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, in integers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(percent: int):
    """Links (u, v) of rows (u, slot, id, tokens), sorted so that the set of u itself comes before those it is compared with."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in source:
            found = []
            for u, i, data in zip(batch.column("u").to_pylist(), batch.column("id").to_pylist(), batch.column("tokens")):
                tokens = _tokens(data.as_py())
                if i == u:
                    at, own = u, tokens.copy()
                elif u != at:
                    raise RuntimeError("a pair without its first set")
                elif similar(own, tokens, percent):
                    found.append((u, i))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
    return batches


def _meet(left: list, right: list) -> np.ndarray:
    """Which lists on the left share a number with which on the right, from a product of 0/1 matrices, some columns at a time."""
    sides = [np.concatenate([np.asarray(x, dtype=np.int64) for x in side]) for side in (left, right)]
    at = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    common = np.intersect1d(*sides)
    both = np.zeros((len(left), len(right)), dtype=bool)
    for low in range(0, len(common), COLUMNS):
        columns, held = common[low:low + COLUMNS], []
        for values, rows, n in zip(sides, at, both.shape):
            places = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
            use = columns[places] == values
            part = np.zeros((n, len(columns)), dtype=np.float32)
            part[rows[use], places[use]] = 1
            held.append(part)
        both |= held[0] @ held[1].T > 0
    return both


def _open(rows: list[tuple], percent: int) -> np.ndarray:
    """Pairs (upper triangle) of a block's rows (id, component, other, n, ...) that may join two components, by their sizes."""
    component, other, n = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    fits = 100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None])
    return np.triu(fits & (component[:, None] != component[None]) & (other[:, None] | other[None]), 1)


def _candidates(group: tuple, rows: list[tuple], percent: int) -> list[tuple]:
    """Rows (id, component, other, n, keys, base, prefixes...) with a partner of compatible size whose prefixes meet under every order.

    Two sets may share many keys. They are compared only under the smallest that is in the index prefix of
    one of them, so only there their full sets are needed.
    """
    pairs = _open(rows, percent)
    if pairs.any():
        every = [np.asarray(r[4], dtype=np.int64) for r in rows]
        index = [keys[:r[5]] for keys, r in zip(every, rows)]
        earlier = _meet([k[k < group[0]] for k in index], [k[k < group[0]] for k in every])
        pairs &= ~(earlier | earlier.T)
    for q in range(6, len(rows[0])):
        if pairs.any():
            pairs &= _meet([r[q] for r in rows], [r[q] for r in rows])
    return [(*group, *r[:4]) for r, keep in zip(rows, pairs.any(axis=0) | pairs.any(axis=1)) if keep]


def _sized(group: tuple, rows: list[tuple], percent: int) -> list[tuple]:
    """Rows (id, component, other, n) with a partner of compatible size in another component."""
    pairs = _open(rows, percent)
    return [(*group, *r) for r, keep in zip(rows, pairs.any(axis=0) | pairs.any(axis=1)) if keep]


def _gathered(work: DataFrame) -> DataFrame:
    """The members of blocks (key, i, j, id, component, other, n) dealt anew, so that full sets are sent seldom.

    Members of linked blocks meet under many keys. A group of linked blocks is dealt once as a whole where that takes
    neither more rows nor more pairs than its blocks; every pair of a block is also one of its group.
    """
    at = ["key", "i", "j"]
    blocks = cut(work.groupBy(*at).agg(F.min("id").alias("least"), F.count("*").alias("size")))
    edges = work.join(blocks, at).select(F.col("least").alias("u"), F.col("id").alias("v"))
    groups = components(edges).select(F.col("id").alias("least"), F.col("component").alias("group"))
    blocks = cut(blocks.join(groups, "least"))
    ids = cut(work.join(blocks, at).select("group", "id", "component", "n").distinct())
    spent = blocks.groupBy("group").agg(F.sum("size").alias("rows"), F.sum(F.col("size") * F.col("size")).alias("pairs"))
    members = ids.groupBy("group").agg(F.count("*").alias("m")).withColumn("b", F.ceil(F.col("m") / graph.MEMBERS))
    whole = members.join(spent, "group").where("m * greatest(1, b - 1) <= rows and m * m <= pairs").select("group", "b")
    own = F.pmod(F.xxhash64("id"), F.col("b"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("b") - 1), lambda k: (k != F.col("own")) | (F.col("b") == 1))
    dealt = ids.join(whole, "group").withColumn("own", own).select(
        F.col("group").alias("key"), "own", "id", "component", F.lit(True).alias("other"), "n", F.explode(others).alias("k"))
    dealt = dealt.select("key", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "id", "component", "other", "n")
    return dealt.union(work.join(blocks.join(whole, "group", "left_anti").select(*at), at).select(*dealt.columns))


def _spanning(group: tuple, rows: list[tuple], percent: int) -> list[tuple]:
    """Links that join components of rows (id, component, other, n, tokens): exact overlaps, unless others have joined the two."""
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while joined.get(c, c) != c:
            c = joined[c]
        return c

    sets, found = [_tokens(r[4]) for r in rows], []
    for i, j in zip(*np.nonzero(_open(rows, percent))):
        a, b = root(rows[i][1]), root(rows[j][1])
        if a != b and similar(sets[i], sets[j], percent):
            joined[max(a, b)] = min(a, b)
            found.append((rows[i][0], rows[j][0]))
    return found


def _values(column: pa.Array) -> list:
    """Python values of a column; lists of numbers as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    return np.split(column.flatten().to_numpy().astype(np.int64), ends[1:-1]) if len(column) else []


def _by_block(names: list[str], work, out: list[str]):
    """Apply ``work`` to each (key, i, j) and its rows (columns ``names``), which are adjacent; its tuples become columns ``out``."""
    kinds = {"other": pa.bool_()}

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def result() -> pa.RecordBatch:
            found = work(group, rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], kinds.get(c, pa.int64())) for k, c in enumerate(out)], names=out)

        for batch in source:
            for key, i, j, *row in zip(*[_values(batch.column(c)) for c in ("key", "i", "j", *names)]):
                if (key, i, j) != group and rows:
                    yield result()
                    rows = []
                group = (key, i, j)
                rows.append(tuple(row))
        if rows:
            yield result()
    return batches


def _node_id(nodes: DataFrame) -> Column:
    """64 of a set's 128 bits as its number, such that no two sets of the table have the same."""
    for turn in range(64):
        number = F.col("h1") if turn == 0 else F.xxhash64("h1", "h2", F.lit(turn))
        if nodes.groupBy(number.alias("h")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return number
    raise RuntimeError("no injective numbering of the sets")


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE,
                 percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of ``size`` words (A-Z lowered, split at ASCII blanks),
    or its whole shorter sequence. Two documents link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable, the row's own included (null only if no reachable
    row has an id). Null texts and texts without words have an empty set and link with nothing, not even
    with each other; equal sets are one node, so copies and repeated rows cost one hash each. Shingles
    are told apart by 64 bits, sets by 128. Other columns are not read.

    Candidates share a token of their prefixes under the first order (rarest shingles first); of these
    only pairs of compatible sizes whose prefixes also meet under every other order are compared.
    Every similar pair shares prefix tokens under any global order, so no link is lost.
    """
    spark = docs.sparkSession
    k1, k2 = row_keys(id_column, text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_column).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    classes = spark.sparkContext.broadcast(rarity(rows.where(F.col("text").isNotNull()).select("text"), size))
    qs = [f"q{o}" for o in range(2, orders + 1)]
    made = cut(rows.mapInArrow(
        _prefixes(classes, size, percent, orders), f"doc_id {kind}, k1 bigint, k2 bigint, n bigint, h1 bigint, h2 bigint, "
        "keys array<bigint>, base int" + "".join(f", {q} array<int>" for q in qs)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = cut(made.where("n > 0").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("n").alias("n")))
    number = _node_id(nodes)
    sizes = nodes.select(number.alias("id"), "n")
    held = made.where("keys is not null").withColumn("id", number)
    members = held.select("id", "base", F.posexplode("keys").alias("at", "key")).select(
        "key", "id", (F.col("at") < F.col("base")).alias("base"))

    def sides_of(ids: DataFrame, *columns: str) -> DataFrame:
        """What is known of the prefixes of sets that have candidates; a set that several tasks met counts once."""
        wanted = broadcast_if_small(cut(ids.distinct()))
        return held.select("id", *columns).join(wanted, "id").dropDuplicates(["id"])

    def sets_of(targets: DataFrame) -> DataFrame:
        """(id, tokens, fields of to) of targets (id, to): full sets go from their texts to each place they are wanted, without a stop."""
        targets = targets.groupBy("id").agg(F.collect_set("to").alias("to"))
        wanted = cut(nodes.withColumn("id", number).join(targets, "id").select(
            "id", "to", F.col("first.k1").alias("w1"), F.col("first.k2").alias("w2")))
        width = len(wanted.schema["to"].dataType.elementType.names)
        source = rows.join(broadcast_if_small(wanted, F.size("to") * width + 3), (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")))
        made = source.select("id", "to", "text").mapInArrow(_sets(size), f"id bigint, to {wanted.schema['to'].dataType.simpleString()}, tokens binary")
        return made.select("id", "tokens", F.inline("to"))

    def meeting(pairs: DataFrame) -> DataFrame:
        """Pairs of compatible sizes whose prefixes meet under the other orders, too."""
        # Sizes alone first: most pairs that meet by chance need no prefixes.
        sized = pairs.join(sizes.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v").join(
            sizes.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u")
        sized = cut(sized.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent).select("u", "v"))
        sides = sides_of(sized.select(F.col("u").alias("id")).union(sized.select("v")), *qs)
        sized = sized.join(sides.select(F.col("id").alias("v"), *[F.col(q).alias(f"v_{q}") for q in qs]), "v").join(
            sides.select(F.col("id").alias("u"), *[F.col(q).alias(f"u_{q}") for q in qs]), "u")
        for q in qs:
            sized = sized.where(F.arrays_overlap(f"u_{q}", f"v_{q}"))
        return sized.select("u", "v")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(meeting(cut(pairs)).distinct())
        # The sets of a star go to its centre, MEMBERS at a time, and the centre's own to each such slot.
        slots = pairs.groupBy("u").agg(F.ceil(F.count("*") / graph.MEMBERS).alias("slots"))
        place = F.struct("u", "slot").alias("to")
        members = pairs.join(slots, "u").withColumn("slot", F.pmod(F.xxhash64("v"), F.col("slots"))).select(F.col("v").alias("id"), place)
        centres = members.select(F.col("to.u").alias("id"), "to").distinct()
        sent = sets_of(members.union(centres)).repartition("u", "slot").sortWithinPartitions("u", "slot", F.col("id") != F.col("u"), "id")
        return sent.select("u", "slot", "id", "tokens").mapInArrow(_verified(percent), "u bigint, v bigint")

    def compare(placed: DataFrame) -> DataFrame:
        """First the filters alone, on sizes, then on prefixes; full sets go only to members with a partner left in their block."""
        head = ["id", "component", "other", "n"]
        fields = "key bigint, i bigint, j bigint, id bigint, component bigint, other boolean, n bigint"

        def dealt(df: DataFrame, *columns: str) -> DataFrame:
            sorted_blocks = df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
            return sorted_blocks.select("key", "i", "j", *head, *columns)

        def kept(df: DataFrame, columns: list[str], test) -> DataFrame:
            return cut(dealt(df, *columns).mapInArrow(
                _by_block([*head, *columns], lambda group, rows: test(group, rows, percent), ["key", "i", "j", *head]), fields))

        work = kept(block_pairs(placed).drop("base").join(sizes, "id"), [], _sized)
        # Of the first order's prefixes a block needs only the keys before its own.
        earlier = lambda keys: F.filter(keys, lambda k: k < F.col("key"))
        work = work.join(sides_of(work.select("id"), "keys", "base", *qs), "id").withColumn(
            "base", F.size(earlier(F.slice("keys", F.lit(1), F.col("base"))))).withColumn("keys", earlier(F.col("keys")))
        work = _gathered(kept(work, ["keys", "base", *qs], _candidates))
        work = dealt(sets_of(work.select("id", F.struct("key", "i", "j", "component", "other", "n").alias("to"))), "tokens")
        return work.mapInArrow(_by_block([*head, "tokens"], lambda group, rows: _spanning(group, rows, percent), ["u", "v"]), "u bigint, v bigint")

    linked = linked_groups(members, verify, compare)
    placed = cut(nodes.withColumn("id", number).join(linked, "id", "left").select("h1", "h2", "first", "component"))
    # A set without a link heads itself.
    alone = placed.where("component is null").select("h1", "h2", F.col("first.doc_id").alias("component_id"))
    groups = cut(with_heads(placed.where("component is not null"), "first", "head").select(
        "h1", "h2", F.col("head.doc_id").alias("component_id")).union(alone))
    return made.select("doc_id", "n", "h1", "h2").join(groups, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

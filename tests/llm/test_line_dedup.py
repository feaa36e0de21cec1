import random

import pytest

from cohortspark.llm import graph
from cohortspark.llm import line_dedup as L


def brute(texts):
    """Positions to remove, by exact similarity of all pairs of lines."""
    places = [(i, p, L.normal(line)) for i, t in texts for p, line in enumerate((t or "").split("\n"))
              if len(line.split()) >= L.MIN_WORDS]
    kinds = sorted({x for *_, x in places})
    parent = {x: x for x in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if L.jaccard(a, b) >= L.SIMILARITY:
                parent[root(a)] = root(b)
    seen, gone = set(), set()
    for i, p, x in sorted(places):
        if root(x) in seen:
            gone.add((i, p))
        seen.add(root(x))
    return gone


def check(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.dedup_lines(docs).collect()}
    gone = brute(texts)
    for i, t in texts:
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i]["text"] == want, i
        assert got[i]["_removed"] == sum(g[0] == i for g in gone)


@pytest.fixture
def near_copies():
    """Lines in groups of near copies whose distances lie on both sides of the limit."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    bases = [[word() for _ in range(n)] for n in (5, 9, 20, 40, 60)]
    lines = []
    for base in bases:
        for _ in range(24):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            lines.append(" ".join(copy))
    rng.shuffle(lines)
    return [(i, "\n".join(lines[i * 4:i * 4 + 4])) for i in range(len(lines) // 4)]


def test_near_copies_against_all_pairs(spark, near_copies):
    check(spark, near_copies)


def test_crowded_buckets_in_small_blocks(spark, near_copies, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 3)
    check(spark, near_copies)


def test_exact_similarities_of_any_characters():
    rng = random.Random(4)
    for alphabet in ("ab", "abcé", "aé漢𝄞", "\0a漢"):
        lines = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        sets = [{x[i:i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
        a, b = (L.np.array([rng.randrange(60) for _ in range(400)]) for _ in range(2))
        both, either = L.similarities(lines, a, b)
        assert both.tolist() == [len(sets[i] & sets[j]) for i, j in zip(a, b)]
        assert either.tolist() == [len(sets[i] | sets[j]) for i, j in zip(a, b)]
    assert L.jaccard("abc", "abc\0") == 0 and L.jaccard("abc", "abc") == 1


def test_spanning_links_equal_all_pairs():
    lines = ["abcdefghij klmnop", "abcdefghij klmnoq", "abcdefghij klmnox", "zzz yyy xxx www vvv"]
    assert L.similar_pairs(lines, [0, 1, 2, 3], [True] * 4, 0.7) == [(0, 1), (0, 2)]
    assert L.similar_pairs(lines, [0, 0, 2, 3], [False, False, True, True], 0.7) == [(0, 2)]
    assert L.similar_pairs(lines, [0, 1, 2, 3], [False, False, False, True], 0.7) == []


def test_recall_of_bands_at_the_limit():
    rng = random.Random(2)
    met = total = 0
    for n in (30, 90, 110, 400):
        for _ in range(120):
            a = "".join(rng.choice("abcdefghij") for _ in range(n))
            b = list(a)
            for _ in range(max(1, n // 110)):
                b[rng.randrange(n)] = "#"
            b = "".join(b)
            if 0.8 <= L.jaccard(a, b) < 0.95:
                total += 1
                x, y = L.band_keys([a, b]).to_pylist()
                met += bool(set(x) & set(y))
    assert total > 100 and met / total > 0.97


def test_repetitive_lines_of_any_length(spark):
    units = ["ha ", "- ", "buy now cheap ", "home about contact help "]
    lines = [(u * (n // len(u) + 1)).strip() for u in units for n in (70, 90, 130, 400, 3000)]
    lines += [f"{'ha ' * 40}{x}" for x in ("once more with feeling", "and then nothing at all")]
    check(spark, list(enumerate(lines)))
    docs = spark.createDataFrame([(0, "ha " * 25), (1, "ha " * 60)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()} == {0: "ha " * 25, 1: ""}


def test_lines_of_one_or_two_words(spark):
    chinese = "".join(chr(0x4E00 + i * 37 % 4000) for i in range(150))
    texts = [(0, f"{chinese}\nRead more\nAdvertisement\n\nhttps://example.org/{'a' * 60}"),
             (1, f"{chinese[:-1]}\nread  more\n \nAdvertisement\nhttps://example.org/{'a' * 60}\nlast"), (2, "x\n\nx"), (3, "xy")]
    check(spark, texts)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == " \nlast" and got[2] == "x\n" and got[3] == "xy"


def test_edges(edge_docs, no_docs):
    got = L.dedup_lines(edge_docs)
    assert got.columns == [*edge_docs.columns, "_removed"]
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r["text"] for r in rows if r["doc_id"] == 0)[0] == [r["text"] for r in edge_docs.collect() if r["doc_id"] == 0][0]
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (0, None)}
    assert by[1]["text"] == "" and by[1]["_removed"] == 1 and by[2]["text"] == ""
    assert by[3]["text"] is None and by[9]["text"] == "a\nb\n" and by[6]["text"] == "one"
    assert L.dedup_lines(no_docs).count() == 0


def test_pairs_are_compared_in_bounded_memory():
    import random
    import tracemalloc

    import pyarrow as pa

    draw = random.Random(1)
    a = ["".join(draw.choices("abcdefghij ", k=200)) for _ in range(4_000)]
    b = [x[:-4] + "?" if i % 2 else x[::-1] for i, x in enumerate(a)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4_000)), pa.array(range(4_000)), pa.array(a), pa.array(b)], names=["u", "v", "a", "b"])
    tracemalloc.start()
    found = [u for out in L._similar(0.8)([batch]) for u in out.column("u").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == list(range(1, 4_000, 2))
    assert peak < 60e6  # with the rows of a batch, 200 MB and more


def test_schemes_follow_the_distinct_shingles():
    rng = random.Random(6)
    lines = ["ab" * 300, "x" * 500] + ["".join(rng.choice(a) for _ in range(n)) for a in ("abc", "abcdefghijkl ") for n in range(80, 180, 3)]
    lines = [L.normal(x) for x in lines]
    hashes, counts = L._shingle_hashes(lines)
    held = [set(x.tolist()) for x in L.np.split(hashes, L.np.cumsum(counts)[:-1])]
    found = L._distinct(hashes, counts)
    for n, all_hashes, got in zip(map(len, held), counts, found):
        assert got == (all_hashes if all_hashes < L.LONG else n) or min(got, n) > L.SHORT
    wide = [L.BANDS * (int(c) <= L.SHORT) + L.BANDS * (int(c) >= L.LONG) for c in found]
    assert [len(k) for k in L.band_keys(lines).to_pylist()] == wide


def test_single_blanks_of_any_kind():
    for line in ("", " ", "a", " a", "a ", "a  b", "a b", "a\tb", "\xa0a　b\x85", "ΑΣ ΣΑΣ.", "a\x00b", "\x1c", "é 漢​b"):
        assert L.normal(line) == " ".join(line.lower().split())
    lines = ["ΑΣ", " ΣΑΣ.", "x"]
    assert "\n".join(lines).lower().split("\n") == [x.lower() for x in lines]

import math
import random

from cohortspark.llm import mixing, url_rules
from cohortspark.llm.queries import URL_RULES


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, default))


def check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    got = url_rules.judge_urls(pages, url_rules.rules_table(spark, rules), default).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(urls[r["page_id"]], rules, default), urls[r["page_id"]]


def test_given_rules_and_odd_urls(spark):
    check(spark, [None, "", "no scheme", "http://", "https://EXAMPLE.org/en/12", "http://a.b.example.org/es/", "http://example.org/es",
                  "x://org/", "x://xorg/", "x://notexample.org/es/1", "http://a.com/fr/x?y=://b.org/", "http://a.com/de/#/x", "http://com/de/",
                  "http://a.com?/de/", "http://a..com/de/", "ftp://É.example.org/en/1", "http://a.com/de/ " * 300, "://x.org/é"] * 2, URL_RULES)


def test_nested_rules_in_many_ranges(spark):
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "aa.com", "a-b.com", "org", "x.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/b"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.5]
    urls = [f"http://{rng.choice(['', 'q.', 'a.', 'b.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '/', '?q'])}" for _ in range(400)]
    check(spark, urls + ["http://a.com/a/b/c"] * 300, rules, "block")


def test_no_rules_no_pages_and_repeated_rules(spark):
    check(spark, ["http://a.com/"], [])
    both = [("allow", "A.com", "/"), ("block", "a.com", "/"), ("allow", "", "/"), ("allow", None, "/")]
    pages = spark.createDataFrame([(1, "http://a.com/")] * 2, "page_id long, url string")
    got = url_rules.judge_urls(pages, url_rules.rules_table(spark, both)).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("a.com/", "block")] * 2
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_table(spark, both)).count() == 0


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (goal - sum(limit * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_targets_and_takes(spark, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame in (docs, edge_docs):
        got = mixing.mix_sources(frame).collect()
        assert len(got) == frame.count()
        sizes = {}
        for r in got:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        want = targets(sizes)
        taken = dict.fromkeys(sizes, 0)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix_sources(docs.repartition(5))
    assert sorted(map(tuple, again.select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect())


def test_better_documents_are_taken_more_often(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"w{i} w w w", "s0") for i in range(4000)] + [(i, "w " * 9, f"s{j}") for j in (1, 2) for i in range(20_000, 20_100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), weights=(1, 9, 9), share=0.3).where("source = 's0'")
    good, bad = got.where("doc_id % 2 = 0 and taken > 0").count(), got.where("doc_id % 2 = 1 and taken > 0").count()
    assert good > 2 * bad > 0


def test_mixed_documents_and_empty_tables(spark, edge_docs, no_docs):
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == [*edge_docs.columns, "_size", "_target", "_taken"]
    assert mixed.where("_taken <= 0").count() == 0
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["taken"], r["target"]) for r in mixing.mix_sources(blank).collect()} == {(0, 0, 0.0)}

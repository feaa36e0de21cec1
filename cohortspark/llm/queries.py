"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import (collocations, decontamination, jaccard, langid, licences, line_dedup, mixing, pii, quality, simhash, topk,
                             url_rules, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op1: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages, url_rules.rules_table(spark, URL_RULES))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source", "k1", "k2")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "stays")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", F.col("_removed").alias("n_removed"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("k1", "k2")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"))


#: A key for tests; production passes its own.
PII_KEY = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return made.select("doc_id", "text", F.array_join("_kinds", ",").alias("kinds"), F.size("_kinds").alias("n_found"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.drop("k1", "k2")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_url_rules": op1_url_rules, "op2_licences": op2_licences, "op3_mixing": op3_mixing, "op4_simhash": op4_simhash,
           "op5_line_dedup": op5_line_dedup, "op6_decontamination": op6_decontamination,
           "op7_topk": op7_topk, "op8_pii": op8_pii, "op9_quality": op9_quality, "op10_language": op10_language,
           "op11_whitening": op11_whitening, "op12_collocations": op12_collocations,
           "op13_ngram_jaccard": op13_ngram_jaccard}
ORACLES: dict[str, str] = {
    "op1_url_rules": r"""
        WITH u AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        j AS (
            SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
            FROM (SELECT DISTINCT host, path FROM u) d JOIN r
              ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            GROUP BY host, path)
        SELECT page_id, u.host, u.path, j.rule, coalesce(j.verdict, 'allow') AS verdict
        FROM u LEFT JOIN j ON u.host = j.host AND u.path = j.path""",
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   -ln((('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, chr(0)), chr(31), coalesce(md5(text), chr(0)))), 1, 13))::BIGINT
                        + 1)::DOUBLE / 4503599627370496)
                   / coalesce(1 + (length(text) - length(regexp_replace(text, '[A-Za-z]+', '', 'g')))
                              / nullif(length(text), 0), 1.0) AS key
            FROM documents),
        s AS (
            SELECT source, size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
            FROM (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source)),
        c AS (
            SELECT *, sum(2 * size) OVER o AS held, sum(w) OVER o AS spent, lead(2 * size / w) OVER (ORDER BY size / w, source) AS next,
                   row_number() OVER (ORDER BY size / w, source) AS k
            FROM s WINDOW o AS (ORDER BY size / w, source ROWS UNBOUNDED PRECEDING)),
        l AS (
            SELECT k, (1.5 * t - held)::DOUBLE / (v - spent)::DOUBLE AS level, next
            FROM (SELECT 0 AS k, 0 AS held, 0 AS spent, min(2 * size / w) AS next FROM s
                  UNION ALL SELECT k, held, spent, next FROM c), (SELECT sum(size) AS t, sum(w) AS v FROM s) WHERE next IS NOT NULL),
        t AS (
            SELECT source, size AS source_size,
                   least((2 * size)::DOUBLE, w * (SELECT level FROM l WHERE next >= level ORDER BY k LIMIT 1)) AS target
            FROM s),
        r AS (
            SELECT d.*, t.source_size, t.target,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto,
                   CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size::BIGINT AS source_size, target,
               (epochs * size + greatest(0, least(size, round(target - epochs * source_size) - (upto - size))))::BIGINT AS taken
        FROM r""",
    "op7_topk": """
        WITH e AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS ws
            FROM documents),
        i AS (
            SELECT DISTINCT item_id, regexp_extract_all(translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
            FROM benchmark WHERE text IS NOT NULL),
        w AS (
            SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS g
            FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS p FROM i WHERE len(ws) > 0)),
        g AS (
            SELECT rid, p, n, array_to_string(ws[p : p + n - 1], ' ') AS g
            FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
                  FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
        o AS (SELECT g.rid, g.p, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.g = w.g),
        h AS (
            SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM o) GROUP BY rid),
        t AS (
            SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
            FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM o WHERE item_id IS NOT NULL) GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)""",
    "op12_collocations": r"""
        WITH p AS (
            SELECT rid, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi
            FROM (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
        g AS (
            SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
        u AS (
            SELECT lang, k, phrase, a, j, array_to_string(ws[1 : j], ' ') AS x, array_to_string(ws[j + 1 : k], ' ') AS y
            FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        s AS (
            SELECT u.lang, u.k, u.phrase, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM u JOIN f x ON u.lang = x.lang AND u.x = x.phrase AND x.k = j
            JOIN f y ON u.lang = y.lang AND u.y = y.phrase AND y.k = u.k - j JOIN t ON u.lang = t.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        i AS (
            SELECT lang, array_to_string(ws[st : st + size - 1], ' ') AS phrase, max(a) AS around
            FROM (SELECT *, unnest(range(1, k - size + 2)) AS st FROM (SELECT *, unnest(range(2, k)) AS size FROM c WHERE k > 2))
            GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM b LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a
        QUALIFY rank <= 2000""",
}

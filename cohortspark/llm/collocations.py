"""Phrase collocation mining: padded longest windows are counted once, ROLLUP sums their prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import broadcast_if_small, cut, filter_bits, filter_row, lower_ascii, passes

LONGEST, LEAST_COUNT, TOP, SHARE = 5, 100, 2000, 100
#: Characters that end a piece, and those between words.
ENDS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Stands between pieces; no word can hold it, since it ends a piece.
MARK = "."
_BIG = "decimal(38,0)"


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered, with a mark wherever pieces end; none for null."""
    marked = F.regexp_replace(lower_ascii(text), ENDS, f" {MARK} ")
    return F.filter(F.split(F.coalesce(marked, F.lit("")), BLANKS), lambda w: w != "")


def lead_windows(texts: DataFrame, longest: int) -> DataFrame:
    """(lang, w1, ..., w<longest>): one row per token; after the end of the text the leading words are null."""
    ws, n = F.col("ws"), F.size("ws")
    leads = [ws] + [F.slice(ws, i + 1, n) for i in range(1, longest)]
    return texts.select("lang", F.inline(F.arrays_zip(*leads)).alias(*[f"w{i + 1}" for i in range(longest)])).where(
        F.col("w1") != MARK)


def _pair(lang: Column, a: Column, b: Column) -> Column:
    return F.xxhash64(lang, a, b)


def padded_windows(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """Lead windows padded with null from the first word that ends a piece or a frequent phrase.

    No phrase through a rare pair of neighbours can be frequent, so windows are cut there: pairs are
    counted by hash, the frequent ones fill a filter that grows with them. The filter may pass rare
    pairs, never the reverse, so counts of frequent phrases are complete.
    """
    pairs = lead_windows(texts, 2).where(F.col("w2").isNotNull() & (F.col("w2") != MARK)).select(
        _pair(F.col("lang"), F.col("w1"), F.col("w2")).alias("h"))
    common = cut(pairs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h"))
    bits = filter_bits(common.count())
    flags = filter_row(common, bits).scalar()
    windows = lead_windows(texts, longest)
    for i in range(2, longest + 1):
        before, word = F.col(f"w{i - 1}"), F.col(f"w{i}")
        fits = before.isNotNull() & (word != MARK) & passes(flags, _pair(F.col("lang"), before, word), bits)
        windows = windows.withColumn(f"w{i}", F.when(fits, word))
    return windows


def frequent_phrases(windows: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase words, f) of the phrases with f >= least, and (lang, n): one ROLLUP over counted windows.

    A phrase of k words starts as many windows as it occurs, so it is the sum of the padded longest
    windows over their words after the k-th.
    """
    ws = [f"w{i}" for i in range(1, longest + 1)]
    counted = windows.groupBy("lang", *ws).agg(F.count("*").alias("f"))
    # grouping_id has a set bit per word summed over: size of the prefix from the number of bits.
    sums = counted.rollup("lang", *ws).agg(F.sum("f").alias("f"), (longest - F.bit_count(F.grouping_id())).alias("k"))
    whole = F.array_compact(F.array(*ws))
    kept = cut(sums.where((F.col("k") == 0) | ((F.col("k") > 0) & (F.col("f") >= least))).select(
        "lang", "k", whole.alias("ws"), "f").where(F.size("ws") == F.col("k")))
    return kept.where("k > 0").select("lang", "ws", "f"), kept.where("k = 0").select("lang", F.col("f").alias("n"))


def mine(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST,
         least: int = LEAST_COUNT, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z lowered, end pieces at [.,;:!?] and line ends; words are what blanks and tabs separate.
    All counts are per language (null: ``und``, joined with a language of that name) and of all occurrences
    inside pieces: n words, a of the phrase, l and r of the two parts of its lowest-scoring cut, the
    score being floor(1000 a n / (l r)), ties to the first cut. Phrases have 2 to ``longest`` words and
    at least ``least`` occurrences; one that lies inside a longer one, itself frequent, with at least
    ``share`` per cent of its occurrences is left out. Order: score, a (falling), phrase (bytes).

    Null and empty texts have no words; repeated rows count again; other columns are not read, so their
    names cannot clash. Products are decimals of 38 digits.
    """
    texts = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), words(F.col(text_column)).alias("ws"))
    phrases, totals = frequent_phrases(padded_windows(texts, longest, least), longest, least)
    counts = phrases.select("lang", F.array_join("ws", " ").alias("phrase"), "f")
    candidates = phrases.where("size(ws) > 1").select("lang", "ws", F.array_join("ws", " ").alias("phrase"), F.col("f").alias("a"))

    def part(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("ws", start, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"),
                       part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("rest"))
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(broadcast_if_small(totals), "lang"))
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    score = F.call_function("div", (big["a"] * F.lit(1000) * big["n"]).cast(_BIG), (big["l"] * big["r"]).cast(_BIG))
    lowest = cuts.select("lang", "phrase", "a", "n", "l", "r", "k", score.alias("score")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")
    # Every contiguous part of two words or more of each longer candidate, with the most frequent one around it.
    inner = candidates.where("size(ws) > 2").select("lang", "ws", F.col("a").alias("around"), F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.size("ws") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.size("ws") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size")))))).alias("p"))
    inner = inner.groupBy("lang", part(F.col("p.at"), F.col("p.size")).alias("phrase")).agg(F.max("around").alias("around"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around").cast(_BIG) * 100 < F.col("a").cast(_BIG) * share))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

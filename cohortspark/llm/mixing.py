"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import cut, keyed, range_parts, row_keys, running_sum, same_key, unpacked

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and how often a source may be taken at most.
SHARE, LIMIT = 1.5, 2
#: Hexadecimal digits of the digest that make a document's uniform number.
DIGITS = 13


def text_size(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def letter_quality(text: str | Column) -> Column:
    """Quality weight of 1 to 2: one plus the share of characters that are ASCII letters."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))
    return F.coalesce(1 + letters / F.nullif(F.length(text), F.lit(0)), F.lit(1.0))


def exponential_key(quality: Column, *identity: Column) -> Column:
    """-ln(u) / quality with u in (0, 1] from a digest of ``identity``: the lowest keys form a weighted sample."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in identity]))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 1) / float(16 ** DIGITS)
    return -F.ln(u) / quality


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources by code point, null last, weigh in turn.

    The mix is ``share`` of all sizes. Targets are proportional to weight but stop at ``limit`` times
    the source's size; the excess is dealt by weight to the others until none is above. A source of
    size zero has target zero.
    """
    parts = range_parts(sizes.select(F.col("source").isNull().alias("none"), "source", "source_size", F.lit(0).alias("all"),
                                     F.lit(1).alias("one")), "none", "source")
    ranked = running_sum(parts, "all", ["none", "source"], "one", "rank")
    turn = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    ranked = cut(ranked.select("source", "source_size", turn.cast("double").alias("weight"),
                               (F.col("source_size") * limit).cast("double").alias("cap")))
    goal = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:  # each round caps a source at least
        full = F.col("weight") * level > F.col("cap")
        held, rest, n = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                                   F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))).first()
        if n is None or n == capped or not rest:
            break
        level, capped = (goal - held) / rest, n
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, k1, k2.

    A source is taken whole as often as its target holds its size; for what remains, its documents
    are sorted by exponential key scaled by ``quality`` (above zero; null counts as one) and taken
    until their prefix sum meets the budget. The document that crosses it gives only its first words
    up to it, so a source's taken words miss its target by half a word at most. Null and empty texts
    have size zero and take nothing; a null source is a source. Keys depend on id and text alone, so
    reruns agree; fully repeated rows are neighbours in the order and share (k1, k2), the row's keys.
    Other columns of ``docs`` are not read, and texts are not shuffled.

    The prefix sums run over ranges of (source, key), so a source that holds most rows is many tasks.
    """
    quality = F.coalesce(letter_quality(text_column) if quality is None else quality, F.lit(1.0))
    k1, k2 = row_keys(id_column, text_column)
    rows = cut(docs.select(
        F.col(source_column).alias("source"), exponential_key(quality, F.col(id_column), F.md5(text_column)).alias("key"),
        F.col(id_column).alias("doc_id"), text_size(text_column).alias("size"), k1.alias("k1"), k2.alias("k2")))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes, weights, share, limit).withColumnRenamed("source", "of")
    order = ["key", "doc_id", "k1", "k2"]
    summed = running_sum(range_parts(rows, "source", *order), "source", order, "size", "upto")
    summed = summed.join(targets, F.col("source").eqNullSafe(F.col("of")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.round(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), left - (F.col("upto") - F.col("size"))))
    return summed.select("doc_id", "source", "size", "source_size", "target",
                         (epochs * F.col("size") + part).cast("bigint").alias("taken"), "k1", "k2")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` of the mix with their columns and _size, _target, _taken: words to take, size times epochs or part of one more.

    Rows of equal id and text count once; documents of which nothing is taken go.
    """
    rows = keyed(docs, "doc_id", "text").dropDuplicates(["_k1", "_k2"])
    mix = mix_sources(unpacked(rows)).where("taken > 0").select("k1", "k2", "size", "target", "taken")
    return unpacked(rows.join(mix, same_key()), *[F.col(c).alias(f"_{c}") for c in ("size", "target", "taken")])

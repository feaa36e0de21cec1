"""Benchmark decontamination: a prefix-filtered set join of word shingles. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import LOWER, UPPER, cut, hash_filter, keyed, passes, row_keys, same_key, unpacked

WINDOW, SHINGLE = 10, 3
#: A word is a run of digits, letters and non-ASCII characters; A-Z are lowered afterwards, word by word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

def words(text: str | Column) -> Column:
    """Words of a text with A-Z lowered; none for null."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # lower() alone would lower other letters too; most words have nothing to lower.
    plain = F.transform(found, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER)))
    return F.coalesce(plain, F.array().cast("array<string>"))


def _hash(ws: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(ws, i + j) for j in range(size)])


def windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, len, window) of the distinct windows: WINDOW consecutive words, or the whole of a shorter item."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item_id"), words(text_column).alias("ws"))
    items = items.where("size(ws) > 0").withColumn("len", F.least(F.size("ws"), F.lit(WINDOW)))
    return items.select("item_id", "len", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1), lambda i: F.slice("ws", i, F.col("len")))).alias("window")
    ).distinct()


_PLACES = "array<struct<size:int,at:int,h:bigint>>"


def _places(ws: Column, size: int, flags: Column) -> Column:
    """Positions of the shingles of ``size`` words that pass the filter."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.struct(
        F.lit(size).alias("size"), i.alias("at"), _hash(ws, i, size).alias("h")))
    return F.when(F.size(ws) >= size, F.filter(hashed, lambda x: passes(flags, x["h"]))).otherwise(F.array().cast(_PLACES))


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, k1, k2.

    A word is hit if it lies inside an occurrence of an item's window. Null and empty texts have no
    words and are clean; items without words have no windows; rows with equal id and text share one
    result and each get a row; items with the same id are one item. Null item ids match but are left
    out of n_items and of the ids. Other columns of both tables are not read.

    A window that occurs brings all its shingles of three words (of all its words, if fewer), so its
    rarest one over all documents is a sufficient prefix. Each text is read once: positions whose
    shingle passes a fixed-size filter are kept with the words around them, as many as a window can
    reach. Frequencies, the join on rarest shingles, the bounds on length and position and the exact
    comparison work on these rows.
    """
    grams = cut(windows(benchmark, item_column, item_text).withColumn("size", F.least("len", F.lit(SHINGLE))))
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most 1, 2, 3
    hashed = F.lit(None).cast("bigint")
    for s in range(1, SHINGLE + 1):
        hashed = F.when(F.col("size") == s, _hash(F.col("window"), F.col("offset"), s)).otherwise(hashed)
    shingles = cut(grams.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))))
                   .withColumn("h", hashed))
    flags = hash_filter(shingles)

    k1, k2 = row_keys(id_column, text_column)
    ws = F.col("ws")
    found = F.concat(*[_places(ws, s, flags) for s in sizes]) if sizes else F.array().cast(_PLACES)
    reach = WINDOW - 1
    around = F.transform(found, lambda x: F.struct(
        x["size"].alias("size"), x["at"].alias("at"), x["h"].alias("h"),
        F.least(x["at"], F.lit(reach)).alias("lead"),
        F.slice(ws, F.greatest(x["at"] - reach, F.lit(0)) + 1, F.lit(2 * WINDOW - 1)).alias("near")))
    rows = docs.select(F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), words(text_column).alias("ws"))
    rows = cut(rows.select("doc_id", "k1", "k2", F.size("ws").alias("n_words"), around.alias("hits")))

    places = rows.select("k1", "k2", F.explode("hits").alias("x")).select("k1", "k2", "x.*")
    counts = places.groupBy("h").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, "h").groupBy("item_id", "len", "window").agg(
        F.min(F.struct("n", "h", "offset")).alias("rarest"), F.count("*").alias("offsets"))
    # A window of which some shingle occurs nowhere cannot occur.
    prefixes = ranked.where("offsets = len - least(len, 3) + 1").select(
        "item_id", "len", "window", F.col("rarest.h").alias("ph"), F.col("rarest.offset").alias("offset"))
    found = places.join(prefixes, F.col("h") == F.col("ph")).where("offset <= lead").where(
        F.slice("near", F.col("lead") - F.col("offset") + 1, F.col("len")) == F.col("window"))
    occurrences = cut(found.select("k1", "k2", (F.col("at") - F.col("offset")).alias("start"), "len", "item_id").distinct())
    spans = occurrences.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    merged = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", "end"))), F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"),
                              (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"])
    hit = spans.groupBy("k1", "k2").agg(merged.alias("n_hit"))
    items = occurrences.where("item_id is not null").select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))
    result = rows.drop("hits").join(hit, ["k1", "k2"], "left").join(items, ["k1", "k2"], "left")
    return result.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "k1", "k2")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs, its columns unchanged."""
    bad = contamination(docs, benchmark).where("contaminated").select("k1", "k2").distinct()
    return unpacked(keyed(docs, "doc_id", "text").join(bad, same_key(), "left_anti"))

"""URL filter: a sort-merge range join of urls and prefix rules on reversed-host keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import cut, lower_ascii, range_parts

#: First "://", then the host up to / ? # or the end, then the path up to ? # or the end.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Ends the host part of a key; it sorts before all printable characters.
_END = "\x01"


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path): host A-Z lower-cased; both empty for null or without "://"."""
    url = F.col(url) if isinstance(url, str) else url
    return (F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit("")),
            F.coalesce(F.regexp_extract(url, _URL, 2), F.lit("")))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("verdict", "host", "path"), r)]) for r in rules]
    empty = F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def _reversed(host: str | Column) -> Column:
    """a.example.org -> org.example.a. : a host's subdomains share its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def nested_rules(rules: DataFrame) -> DataFrame:
    """(key, stack): for each distinct rule its sort key and the rules active once it is pushed.

    A rule's key is a prefix of exactly the keys in the interval that starts at it, so intervals nest
    or are apart. The stack of a rule holds the rules of its host whose path is a prefix of its own:
    one at most for each length of its path. A rule given twice with both verdicts blocks.
    """
    rules = (rules.where("host is not null and host <> '' and path is not null")
             .groupBy(lower_ascii("host").alias("host"), "path").agg(F.max("verdict").alias("verdict")))
    lengths = F.sequence(F.lit(0), F.length("path"))
    prefixes = rules.select("host", "path", F.explode(lengths).alias("n")).withColumn(
        "head", F.expr("left(path, n)"))
    above = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    active = prefixes.join(above, (prefixes["host"] == above["h"]) & (prefixes["head"] == above["p"]))
    return active.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct(
        F.length("p").alias("length"), F.col("h").alias("host"), F.col("p").alias("path"),
        F.col("v").alias("verdict")))).alias("stack")).select(
            F.concat(_reversed("host"), F.lit(_END), "path").alias("key"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id",
               url_column: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest
    rule (host and path together, then the greater text) wins; ``verdict`` is ``default`` and
    ``rule`` null where none fits, as for null urls and urls without "://". Repeated rows each get a
    row. Rules with a null part or an empty host are void. Other columns of ``pages`` are not read.

    Distinct (host, path) pairs enter the sweep once per host level that rules have. Levels and rules
    are range-sorted together; sweeping a range, a url meets the last rule pushed before it, and the
    rules of that stack whose interval has ended are popped by the prefix test. What is on the stack
    at the end of a range is handed to the next one. A hot host or url is thus neither one group nor
    one task.
    """
    host, path = url_parts(url_column)
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    stacks = cut(nested_rules(rules))
    deepest = stacks.agg(F.max(F.size(F.split(F.col("stack")[0]["host"], r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    levels = (rows.where("host <> ''").distinct()
              .withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest))))))
              .withColumn("suffix", F.expr(r"array_join(slice(split(host, '\\.'), -level, level), '.')")))
    urls = levels.select(F.concat(_reversed("suffix"), F.lit(_END), "path").alias("key"), F.lit(1).alias("kind"),
                         "host", "path", "suffix", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    pushes = stacks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"),
                           F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("suffix"), "stack")
    parts = range_parts(urls.union(pushes), "key", "kind", "host")
    ends = parts.where("kind = 0").groupBy("_part").agg(F.max_by("stack", "key").alias("end"))
    marks = parts.select("_part").distinct().join(ends, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = marks.select("_part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("_part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = parts.withColumn("top", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    met = swept.join(carried, "_part").withColumn("top", F.coalesce("top", "carried"))
    fits = F.filter("top", lambda r: (r["host"] == F.col("suffix")) & F.startswith(F.col("path"), r["path"]))
    judged = met.select(
        "host", "path", F.array_max(F.transform(fits, lambda r: F.struct(
            F.length(F.concat(r["host"], r["path"])).alias("length"), F.concat(r["host"], r["path"]).alias("rule"),
            r["verdict"].alias("verdict")))).alias("best"))
    best = judged.groupBy("host", "path").agg(F.max("best").alias("best")).where("best is not null")
    joined = rows.alias("r").join(best.alias("b"), (F.col("r.host") == F.col("b.host")) & (F.col("r.path") == F.col("b.path")), "left")
    return joined.select("r.page_id", "r.host", "r.path", F.col("b.best.rule").alias("rule"),
                         F.coalesce("b.best.verdict", F.lit(default)).alias("verdict"))

"""Line-oriented text: sections, embedded tables, multi-line records, scans, relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import spread_scan
from ..functions.scans import PART, carry_forward, latest_over, range_parts, running_sum, sum_over


# Patterns of machine paths and credentials that a release must not contain.
RELEASE_PATTERNS = {
    "windows_path": r"(?i)[A-Za-z]:\\\\(?:Users|home)\\\\",
    "windows_path_escaped": r"(?i)[A-Za-z]:\\\\\\\\(?:Users|home)\\\\\\\\",
    "windows_path_slash": r"(?i)[A-Za-z]:/(?:Users|home)/",
    "unix_home": r"/(?:Users|home)/",
    "file_url": r"file:///",
    "ghp_token": r"\bghp_[A-Za-z0-9]{30,}\b",
    "github_pat": r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    "sk_key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
}


def split_lines(texts: DataFrame, keys: Sequence[str], text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per line with its 1-based position."""
    return (texts.select(*keys, *keep, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "line"))
            .select(*keys, *keep, (F.col("_p") + 1).cast("long").alias("pos"), "line"))


def section_rows(lines: DataFrame, keys: Sequence[str], section: Column, pos: str = "pos") -> DataFrame:
    """Lines with the section they belong to; ``section`` is non-NULL on start lines only.

    Lines in front of the first section of a key are dropped.
    """
    marked = carry_forward(lines, list(keys), pos, section, "section")
    return marked.where(F.col("section").isNotNull())


def first_values(rows: DataFrame, keys: Sequence[str], field: str, value: str, fields: Sequence[str],
                 pos: str = "pos") -> DataFrame:
    """First value of each declared field per section (fields are configuration)."""
    return rows.groupBy(*keys).agg(*[
        F.min_by(F.when(F.col(field) == f, F.col(value)), F.when(F.col(field) == f, F.col(pos))).alias(f)
        for f in fields])


def table_between_markers(lines: DataFrame, keys: Sequence[str], begin: Column, end: Column,
                          pos: str = "pos") -> DataFrame:
    """Lines strictly between a begin and the next end marker, numbered by begin marker.

    A line is inside when the latest marker before it is a begin; end markers outside a table
    change nothing.
    """
    marker = F.when(begin, F.lit("begin")).when(end, F.lit("end"))
    ranges = range_parts(lines, keys, pos)
    inside = latest_over(ranges, keys, pos, marker, "_marker")
    numbered = sum_over(inside, keys, pos, F.when(begin, 1).otherwise(0), "_table")
    return (numbered.where((F.col("_marker") == "begin") & ~begin & ~end)
            .withColumn("table_no", F.col("_table").cast("long")).drop("_marker", "_table", PART))


def multiline_records(lines: DataFrame, keys: Sequence[str], is_header: Column, line: str = "line",
                      pos: str = "pos") -> DataFrame:
    """Header line plus its body lines as (record_no, header, sequence, body_lines).

    A record is the unit of output; the pieces of one record are joined in line order.
    """
    numbered = running_sum(lines, list(keys), pos, F.when(is_header, 1).otherwise(0), "record_no")
    body = F.when(~is_header, F.struct(F.col(pos).alias("pos"), F.col(line).alias("line")))
    return (numbered.where(F.col("record_no") > 0).groupBy(*keys, "record_no").agg(
        F.max(F.when(is_header, F.col(line))).alias("header"),
        F.array_sort(F.collect_list(body)).alias("_body"))
        .select(*keys, F.col("record_no").cast("long").alias("record_no"), "header",
                F.array_join(F.transform("_body", lambda s: s["line"]), "").alias("sequence"),
                F.size("_body").cast("long").alias("body_lines")))


#: Characters of a piece of a long record: a multiple of every seed length of the pattern search.
PIECE = 65_536
# Fixed value: where a record's header names its gene; the version after the point is left out.
GENE = r"(?:^|\s)gene:([^\s]+)"


def header_gene_id(header: str | Column, pattern: str = GENE) -> Column:
    """Gene identifier of a header without its version, or an empty string."""
    return F.split_part(F.regexp_extract(header, pattern, 1), F.lit("."), F.lit(1))


def record_pieces(lines: DataFrame, keys: Sequence[str], start: str = ">", line: str = "line", pos: str = "pos",
                  chunk: int = PIECE) -> DataFrame:
    """Records of a header and many lines, as (keys, record_no, header, piece_no, offset, piece).

    Lines are trimmed and blank ones skipped; a line that begins with ``start`` opens a record, the rest of
    it being the header. Body lines are upper-cased and joined. Lines before the first header and
    records with an empty header are left out; a record without body lines is one empty piece.

    No row holds more than ``chunk`` characters of a record: running offsets place every line, lines are
    cut where pieces end, and each piece is put together by itself.
    """
    keys = list(keys)
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    clean = lines.select(*keys, pos, text.alias("_text")).where(F.col("_text") != "")
    opens = F.col("_text").startswith(start)
    ranges = range_parts(clean.withColumn("_opens", opens), keys, pos)
    numbered = sum_over(ranges, keys, pos, F.when(F.col("_opens"), 1).otherwise(0), "record_no").where("record_no > 0")
    body = F.when(F.col("_opens"), F.lit("")).otherwise(F.upper("_text"))
    numbered = numbered.withColumn("_text", F.when(F.col("_opens"), F.col("_text")).otherwise(body)).withColumn(
        "_size", F.when(F.col("_opens"), F.lit(0)).otherwise(F.length("_text")).cast("long"))
    # Records lie in ranges in order, so the same ranges serve for offsets within a record.
    placed = sum_over(numbered, [*keys, "record_no"], pos, F.col("_size"), "_end").withColumn("_from", F.col("_end") - F.col("_size"))
    headers = placed.where("_opens").select(
        *keys, "record_no", F.substring("_text", len(start) + 1, 1 << 30).alias("header"))
    headers = headers.where(F.length("header") > 0)
    # The first part of a line fills its piece, the others are whole pieces or the line's end.
    room = (F.lit(chunk) - F.col("_from") % chunk).cast("int")
    parts = F.concat(F.array(F.left("_text", room)), F.regexp_extract_all(
        F.substring(F.col("_text"), room + 1, F.length("_text")), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    cut = placed.where("not _opens").select(*keys, "record_no", "_from", F.posexplode(parts).alias("_i", "_part"))
    cut = cut.withColumn("piece_no", F.floor(F.col("_from") / chunk) + F.col("_i"))
    joined = cut.groupBy(*keys, "record_no", "piece_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("_from", "_i", "_part"))), lambda s: s["_part"]), "").alias("piece"))
    return (headers.join(joined, [*keys, "record_no"], "left").withColumn("piece_no", F.coalesce("piece_no", F.lit(0).cast("long")))
            .select(*keys, F.col("record_no").cast("long").alias("record_no"), "header", "piece_no",
                    (F.col("piece_no") * chunk).alias("offset"), F.coalesce("piece", F.lit("")).alias("piece")))


def text_pattern_scan(texts: DataFrame, keys: Sequence[str], text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(keys, pattern) for each named regex found in a text; no join, patterns are literals."""
    names = F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()])
    return spread_scan(texts.select(*keys, text)).select(
        *keys, F.explode(F.array_compact(names)).alias("pattern"))


def sanitize(texts: DataFrame, keys: Sequence[str], text: str, clean: Column) -> DataFrame:
    """Cleaned text with a flag for changed rows."""
    return texts.select(*keys, clean.alias("content"), (~clean.eqNullSafe(F.col(text))).alias("changed"))


def relation_ids(lines: DataFrame, keys: Sequence[str], text: str, pattern: str, group: int = 1) -> DataFrame:
    """Distinct (keys, id) found by a regex anywhere in the text."""
    return (lines.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("id"))
            .distinct())


def relation_sets(ids: DataFrame, keys: Sequence[str], default_ids: DataFrame) -> DataFrame:
    """Per key: how many distinct ids, how many are absent from the default set, and a flag."""
    known = default_ids.select("id").distinct().withColumn("_known", F.lit(True))
    return (ids.join(known, "id", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_ids"),
        F.count_if(F.col("_known").isNull()).alias("ids_not_in_default"))
        .withColumn("distinct_from_default", F.col("ids_not_in_default") == F.col("distinct_ids")))

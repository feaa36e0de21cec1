"""Queries: sectioned and embedded text, scans, pattern search, intervals, specificity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import expr as X
from cohortspark.functions.lineage import settle
from cohortspark.operators import sequences as Q
from cohortspark.operators import text as T

from .q_cells import r6
from .registry import query, view
from .tables import Tables

view("v_doc_lines", """
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""")


def doc_lines(t: Tables):
    return T.split_lines(t.documents, ["doc_id"], "text")


@query("section_attributes", """
WITH l AS (SELECT conv_id, conv_id * 1000000 + turn AS pos, turn, role, text FROM conversations),
s AS (SELECT *, last_value(CASE WHEN turn = 0 THEN conv_id END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
SELECT section, arg_min(text, pos) FILTER (WHERE role = 'user') AS user_text, arg_min(text, pos) FILTER (WHERE role = 'assistant') AS assistant_text,
  arg_min(text, pos) FILTER (WHERE role = 'system') AS system_text, count(*) AS lines
FROM s WHERE section IS NOT NULL AND turn > 0 GROUP BY section""")
def section_attributes(t: Tables):
    # The whole table is one sectioned file: a section opens at turn 0, later turns are values.
    lines = t.conversations.select(F.lit("conversations").alias("file"),
                                   (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("pos"),
                                   "conv_id", "turn", "role", "text")
    rows = T.section_rows(lines, ["file"], F.when(F.col("turn") == 0, F.col("conv_id")))
    rows = rows.where(F.col("turn") > 0)
    first = T.first_values(rows, ["section"], "role", "text", ["user", "assistant", "system"])
    counts = rows.groupBy("section").agg(F.count(F.lit(1)).alias("lines"))
    return first.join(counts, "section").select(
        "section", F.col("user").alias("user_text"), F.col("assistant").alias("assistant_text"),
        F.col("system").alias("system_text"), "lines")


@query("table_between_markers", """
WITH m AS (SELECT *, starts_with(line, 'The and ') AS b, starts_with(line, 'And ') OR starts_with(line, 'In ') AS e FROM v_doc_lines),
s AS (SELECT *, last_value(CASE WHEN b THEN 1 WHEN e THEN 2 END IGNORE NULLS) OVER w AS state,
        CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER w AS BIGINT) AS table_no
      FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, table_no, pos, replace(line, '"', '') AS line FROM s WHERE state = 1 AND NOT b AND NOT e""")
def table_between_markers(t: Tables):
    line = F.col("line")
    rows = T.table_between_markers(doc_lines(t), ["doc_id"], line.startswith("The and "),
                                   line.startswith("And ") | line.startswith("In "))
    return rows.select("doc_id", "table_no", "pos", F.replace(line, F.lit('"'), F.lit("")).alias("line"))


@query("multiline_records", """
WITH s AS (SELECT *, starts_with(line, 'The ') AS h, CAST(sum(CASE WHEN starts_with(line, 'The ') THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS record_no FROM v_doc_lines)
SELECT doc_id, record_no, max(line) FILTER (WHERE h) AS header,
  md5(coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE NOT h), '')) AS sequence_md5,
  count(*) FILTER (WHERE NOT h) AS body_lines
FROM s WHERE record_no > 0 GROUP BY doc_id, record_no""")
def multiline_records(t: Tables):
    rows = T.multiline_records(doc_lines(t), ["doc_id"], F.col("line").startswith("The "))
    return rows.select("doc_id", "record_no", "header", F.md5("sequence").alias("sequence_md5"), "body_lines")


# Pieces this short cut most records of the documents; a multiple of every seed length.
RECORD_PIECE = 1024
view("v_record_lines", r"""
    SELECT doc_id, pos, l, starts_with(l, 'The ') AS h,
      CAST(sum(CASE WHEN starts_with(l, 'The ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS record_no
    FROM (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS l FROM v_doc_lines) WHERE l <> ''""")
view("v_records", """
    SELECT doc_id, record_no, substr(max(l) FILTER (WHERE h), 5) AS header,
      coalesce(string_agg(upper(replace(l, 'ß', 'SS')), '' ORDER BY pos) FILTER (WHERE NOT h), '') AS sequence
    FROM v_record_lines WHERE record_no > 0 GROUP BY doc_id, record_no""")


def record_pieces_frame(t: Tables):
    return T.record_pieces(doc_lines(t), ["doc_id"], "The ", chunk=RECORD_PIECE)


@query("record_pieces", f"""
SELECT doc_id, record_no, md5(header) AS header_md5, split_part(regexp_extract(header, '(?:^|\\s)the ([^\\s]+)', 1), '.', 1) AS gene_id,
  i AS piece_no, i * {RECORD_PIECE} AS "offset", md5(substr(sequence, (i * {RECORD_PIECE} + 1)::BIGINT, {RECORD_PIECE})) AS piece_md5
FROM (SELECT *, unnest(range(0, greatest(1, (len(sequence) + {RECORD_PIECE - 1}) // {RECORD_PIECE}))) AS i FROM v_records WHERE header <> '')""")
def record_pieces(t: Tables):
    return record_pieces_frame(t).select(
        "doc_id", "record_no", F.md5("header").alias("header_md5"), T.header_gene_id("header", r"(?:^|\s)the ([^\s]+)").alias("gene_id"),
        "piece_no", "offset", F.md5("piece").alias("piece_md5"))


@query("record_hits", """
SELECT doc_id, record_no, item_id, pos AS start, pos + len(p) - 1 AS "end"
FROM (SELECT r.doc_id, r.record_no, b.item_id, p,
        unnest(list_filter(range(1, len(r.sequence) - len(p) + 2), lambda i: substr(r.sequence, i, len(p)) = p)) AS pos
      FROM (SELECT * FROM v_records WHERE header <> '') r
      JOIN (SELECT item_id, upper(replace(substr(text, 1, 60), 'ß', 'SS')) AS p FROM benchmark WHERE len(text) > 0) b ON contains(r.sequence, p))""")
def record_hits(t: Tables):
    # The first 60 characters of each item, in whichever piece or across whichever border they lie.
    patterns = t.benchmark.where(F.length("text") > 0).select("item_id", F.upper(F.substring("text", 1, 60)).alias("pattern"))
    hits = Q.search_pieces(record_pieces_frame(t), patterns, ["doc_id", "record_no"], "piece_no", "piece", RECORD_PIECE)
    return hits.select("doc_id", "record_no", "item_id", "start", "end")


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "hex_token": r'token = "[0-9a-f]{20,}',
    "license_line": r"(?i)\blicen[cs]ed?\b",
    **T.RELEASE_PATTERNS,
}


@query("text_pattern_scan", " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern FROM documents WHERE regexp_matches(text, '{p}')" for n, p in PATTERNS.items()))
def text_pattern_scan(t: Tables):
    return T.text_pattern_scan(t.documents, ["doc_id"], "text", PATTERNS)


@query("sanitize_text", """
SELECT doc_id, md5(clean) AS content_md5, len(clean) AS content_length, clean <> text AS changed FROM (
  SELECT doc_id, text, replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 'The and ', '. '), 'Copyright', '.') AS clean
  FROM documents)""")
def sanitize_text(t: Tables):
    clean = X.sanitize_text("text", {"The and ": ". ", "Copyright": "."})
    return T.sanitize(t.documents, ["doc_id"], "text", clean).select(
        "doc_id", F.md5("content").alias("content_md5"),
        F.length("content").cast("long").alias("content_length"), "changed")


@query("relation_sets", """
WITH ids AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS id FROM pages),
d AS (SELECT DISTINCT id FROM ids WHERE starts_with(url, 'https'))
SELECT page_id, count(*) AS distinct_ids, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = ids.id)) AS ids_not_in_default,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = ids.id)) = count(*) AS distinct_from_default
FROM ids WHERE NOT starts_with(url, 'https') GROUP BY page_id""")
def relation_sets(t: Tables):
    pattern = 'href="/([A-Za-z]+)"'
    default = T.relation_ids(t.pages.where(F.col("url").startswith("https")), ["page_id"], "html", pattern)
    ids = T.relation_ids(t.pages.where(~F.col("url").startswith("https")), ["page_id"], "html", pattern)
    return T.relation_sets(ids, ["page_id"], default)


view("v_titles", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NP-F' || (c_nationkey + 30) || ', mildly degenerated disc, replicate ' || c_nationkey
      WHEN c_mktsegment = 'MACHINERY' THEN 'NP-' || (c_nationkey + 30) || 'M, Thompson grade ' || c_nationkey
      ELSE c_mktsegment || ' severely degenerated disc' END AS title,
      CASE WHEN c_acctbal < 0 THEN 'Disease  State: ' || c_mktsegment ELSE c_mktsegment END AS characteristic,
      'ENSG' || c_custkey || '.' || c_nationkey AS versioned, 'ENSG' || c_custkey || '(' || c_mktsegment || ')' AS combined
    FROM customer""")


@query("title_fields", r"""
SELECT c_custkey, regexp_extract(title, '(?i)Thompson\s+grade\s+([A-Za-z0-9-]+)', 1) AS grade,
  CASE WHEN regexp_matches(title, '(?:^|[^0-9])[0-9]{1,3}[FM](?:\s*,|\s*$)') THEN regexp_extract(title, '(?:^|[^0-9])([0-9]{1,3})([FM])(?:\s*,|\s*$)', 1)
       ELSE regexp_extract(title, '-([FM])([0-9]{1,3})(?:\s*,|\s*$)', 2) END AS age,
  CASE WHEN regexp_matches(title, '(?:^|[^0-9])[0-9]{1,3}[FM](?:\s*,|\s*$)') THEN regexp_extract(title, '(?:^|[^0-9])([0-9]{1,3})([FM])(?:\s*,|\s*$)', 2)
       ELSE regexp_extract(title, '-([FM])([0-9]{1,3})(?:\s*,|\s*$)', 1) END AS sex,
  trim(split_part(title, ',', 1)) AS title_prefix,
  CASE WHEN title LIKE '%mildly%' THEN 'mild' WHEN title LIKE '%severely%' THEN 'severe' END AS severity,
  regexp_extract(title, '(?i)replicate\s*([0-9]+)', 1) AS replicate,
  CASE WHEN characteristic LIKE '%:%' THEN 'disease state' END AS characteristic_key,
  CASE WHEN characteristic LIKE '%:%' THEN trim(split_part(characteristic, ':', 2)) END AS characteristic_value,
  split_part(versioned, '.', 1) AS stable_id, split_part(rtrim(combined, ')'), '(', 2) AS symbol
FROM v_titles""")
def title_fields(t: Tables):
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    number = (nation + 30).cast("string")
    title = (F.when(segment == "BUILDING", F.concat(F.lit("NP-F"), number, F.lit(", mildly degenerated disc, replicate "),
                                                    nation.cast("string")))
             .when(segment == "MACHINERY", F.concat(F.lit("NP-"), number, F.lit("M, Thompson grade "), nation.cast("string")))
             .otherwise(F.concat(segment, F.lit(" severely degenerated disc"))))
    key = F.col("c_custkey").cast("string")
    rows = t.customer.select(
        "c_custkey", title.alias("title"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("Disease  State: "), segment)).otherwise(segment).alias("characteristic"),
        F.concat(F.lit("ENSG"), key, F.lit("."), nation.cast("string")).alias("versioned"),
        F.concat(F.lit("ENSG"), key, F.lit("("), segment, F.lit(")")).alias("combined"))
    return rows.select(
        "c_custkey", X.title_grade("title").alias("grade"), X.title_age("title").alias("age"),
        X.title_sex("title").alias("sex"), X.title_prefix("title").alias("title_prefix"),
        X.title_severity("title").alias("severity"), X.title_replicate("title").alias("replicate"),
        X.characteristic_key("characteristic").alias("characteristic_key"),
        X.characteristic_value("characteristic").alias("characteristic_value"),
        X.feature_id_prefix(X.without_version("versioned")).alias("stable_id"),
        X.symbol_in_parentheses("combined").alias("symbol"))


@query("reverse_complement", """
SELECT item_id, md5(reverse(translate(text, 'ACGTN', 'TGCAN'))) AS reverse_complement_md5,
  len(text) >= 45 AND regexp_matches(text, '^[A-Za-z., ]+$') AND NOT contains(text, 'token') AS usable
FROM benchmark""")
def reverse_complement(t: Tables):
    usable = X.usable_sequence("text", F.col("text").contains("token"), 45, "A-Za-z., ")
    return t.benchmark.select("item_id", F.md5(X.reverse_complement("text")).alias("reverse_complement_md5"),
                              usable.alias("usable"))


# ---------------------------------------------------------------- search

view("v_hits", """
    SELECT doc_id, source, lang, item_id, orientation, pos AS start, pos + len(p) - 1 AS stop
    FROM (SELECT d.doc_id, d.source, d.lang, b.item_id, orientation, p,
            unnest(list_filter(range(1, len(d.text) - len(p) + 2), lambda i: substr(d.text, i, len(p)) = p)) AS pos
          FROM documents d JOIN (SELECT item_id, 'forward' AS orientation, text AS p FROM benchmark
                                 UNION ALL SELECT item_id, 'reverse', reverse(text) FROM benchmark) b ON contains(d.text, p))""")


def pattern_hits_frame(t: Tables):
    patterns = Q.both_orientations(t.benchmark.select("item_id", F.col("text").alias("pattern")), F.reverse("pattern"))
    return Q.multi_pattern_search(t.documents.select("doc_id", "text"), patterns, "doc_id", "text")


@query("pattern_hits", 'SELECT doc_id, item_id, orientation, start, stop AS "end" FROM v_hits')
def pattern_hits(t: Tables):
    return pattern_hits_frame(t)


@query("interval_overlap", """
SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id
FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'signup' AND r.event_type = 'error'
  AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 12 HOUR""")
def interval_overlap(t: Tables):
    # Microseconds of a zone-free timestamp, so that no session time zone is involved.
    micros = F.expr("datediff(ts, DATE'1970-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
                    " + cast(date_part('SECOND', ts) * 1000000 as bigint)")
    events = t.events.where(F.col("event_type").isin("signup", "error")).select(
        "user_id", "event_id", "event_type", micros.alias("start"))
    spans = events.where(F.col("event_type") == "signup").withColumn("end", F.col("start") + 12 * 3600 * 1_000_000)
    points = events.where(F.col("event_type") == "error").withColumn("end", F.col("start"))
    return Q.interval_overlap(spans, points, "user_id", "event_id", "event_id")


view("v_specificity", """
    SELECT b.item_id AS probe_id, 'src' || b.item_id AS expected_gene,
      count(h.doc_id) AS transcript_hits, count(DISTINCT h.source) AS transcript_genes,
      count(DISTINCT CASE WHEN h.source = 'src' || b.item_id THEN 1 END) AS ok,
      count(DISTINCT CASE WHEN h.source <> 'src' || b.item_id THEN h.source END) AS other
    FROM benchmark b LEFT JOIN v_hits h ON h.item_id = b.item_id AND h.orientation = 'forward' GROUP BY b.item_id""")
view("v_loci", """SELECT item_id AS probe_id, count(*) AS loci FROM (SELECT DISTINCT item_id, doc_id, start, stop FROM v_hits) GROUP BY 1""")
view("v_locus_genes", """
    SELECT DISTINCT h.item_id AS probe_id, g.gene
    FROM v_hits h JOIN (SELECT doc_id, 1 AS a, n_chars // 2 AS z, source AS gene FROM documents
                        UNION ALL SELECT doc_id, n_chars // 2 + 100, n_chars, lang FROM documents WHERE n_chars // 2 + 100 <= n_chars) g
      ON g.doc_id = h.doc_id AND h.start <= g.z AND h.stop >= g.a""")


@query("probe_specificity", """
WITH o AS (SELECT probe_id, count(*) AS overlap_genes, count(*) FILTER (WHERE gene <> 'src' || probe_id) AS over_other FROM v_locus_genes GROUP BY 1),
j AS (SELECT s.*, coalesce(l.loci, 0) AS loci, coalesce(o.overlap_genes, 0) AS overlap_genes, coalesce(o.over_other, 0) AS over_other
      FROM v_specificity s LEFT JOIN v_loci l ON l.probe_id = s.probe_id LEFT JOIN o ON o.probe_id = s.probe_id),
r AS (SELECT *, concat_ws(';', CASE WHEN ok = 0 THEN 'no_expected_release113_transcript_match' END,
        CASE WHEN other > 0 THEN 'cross_gene_transcript_match' END, CASE WHEN loci > 1 THEN 'multiple_primary_assembly_loci' END,
        CASE WHEN over_other > 0 THEN 'cross_gene_primary_assembly_overlap' END,
        CASE WHEN loci > 0 AND overlap_genes = 0 THEN 'primary_assembly_hit_outside_annotated_gene' END) AS failure_reasons FROM j)
SELECT probe_id, expected_gene, transcript_hits, transcript_genes, loci, overlap_genes, failure_reasons,
  CASE WHEN loci = 0 AND ok > 0 THEN 'transcript_only_exact_match_no_contiguous_primary_assembly_hit'
       WHEN loci > 0 THEN 'primary_assembly_locus_checked_against_release113_gtf' ELSE 'no_exact_reference_hit' END AS specificity_boundary,
  CASE WHEN failure_reasons = '' THEN 'pass_unique_expected_gene' ELSE 'fail_specificity_gate' END AS specificity_status
FROM r""")
def probe_specificity(t: Tables):
    hits = settle(pattern_hits_frame(t))
    docs = t.documents.select("doc_id", "source", "lang", "n_chars")
    queries = t.benchmark.select(F.col("item_id").alias("probe_id"),
                                 F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("expected_gene"))
    transcripts = (hits.where(F.col("orientation") == "forward").join(docs, "doc_id")
                   .select(F.col("item_id").alias("probe_id"), F.col("source").alias("gene")))
    locus = F.struct("doc_id", "start", "end")
    loci = hits.select(F.col("item_id").alias("probe_id"), locus.alias("locus")).distinct()
    half = F.floor(F.col("n_chars") / 2)
    spans = docs.select("doc_id", F.inline(F.array(
        F.struct(F.lit(1).cast("long").alias("start"), half.alias("end"), F.col("source").alias("gene")),
        F.struct((half + 100).alias("start"), F.col("n_chars").alias("end"), F.col("lang").alias("gene"))))).where(
        F.col("start") <= F.col("end"))
    found = hits.select("doc_id", "start", "end", F.col("item_id").alias("probe_id")).distinct()
    pairs = Q.interval_overlap(found, spans, "doc_id", "probe_id", "gene")
    overlaps = pairs.select(F.col("left_id").alias("probe_id"), F.col("right_id").alias("gene"))
    return Q.classify_specificity(queries, transcripts, loci, overlaps)


@query("probe_collisions", """
WITH g AS (SELECT DISTINCT lang AS module_id, source AS gene FROM documents),
p AS (SELECT DISTINCT source AS gene, item_id FROM v_hits),
c AS (SELECT gene, count(*) AS candidate_probes, count(*) FILTER (WHERE n > 1) AS collision_probes
      FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM p) GROUP BY gene),
d AS (SELECT g.*, coalesce(candidate_probes, 0) AS candidate_probes, coalesce(collision_probes, 0) AS collision_probes FROM g LEFT JOIN c ON c.gene = g.gene),
u AS (SELECT *, CASE WHEN candidate_probes = 0 THEN 'no_exact_canonical_transcript_match'
        WHEN collision_probes = 0 THEN 'sequence_match_unique_within_locked_genes' ELSE 'sequence_match_ambiguous_within_locked_genes' END AS mapping_status FROM d),
m AS (SELECT module_id, round(1e0 * count(*) FILTER (WHERE mapping_status = 'sequence_match_unique_within_locked_genes') / count(*), 6) AS mapped_fraction FROM u GROUP BY 1)
SELECT u.module_id, u.gene, candidate_probes, collision_probes, mapping_status, mapped_fraction,
  CASE WHEN mapped_fraction >= 0.8e0 THEN 'pass' ELSE 'fail' END AS gate FROM u JOIN m ON m.module_id = u.module_id""")
def probe_collisions(t: Tables):
    docs = t.documents.select("doc_id", "source", "lang")
    hits = pattern_hits_frame(t).join(docs.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("gene"), F.col("item_id").alias("probe_id"))
    genes = docs.select(F.col("lang").alias("module_id"), F.col("source").alias("gene")).distinct()
    rows = settle(Q.gene_collisions(hits, genes))
    gate = Q.collision_gate(rows).select("module_id", "mapped_fraction", "gate")
    return rows.join(gate, "module_id").withColumns(r6("mapped_fraction")).select(
        "module_id", "gene", "candidate_probes", "collision_probes", "mapping_status", "mapped_fraction", "gate")

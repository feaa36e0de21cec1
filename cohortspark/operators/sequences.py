"""Exact multi-pattern search, interval overlap and the specificity classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.config import broadcast_if_small
from ..functions.lineage import spread_scan

SEED_LENGTHS = (64, 32, 16, 8, 4, 2, 1)  # each divides the next larger one and the chunk length
CHUNK = 2_048
MAX_BROADCAST_SEEDS = 200_000


def both_orientations(patterns: DataFrame, reverse: Column, sequence: str = "pattern") -> DataFrame:
    """Each pattern as given and reversed (or reverse-complemented)."""
    other = [c for c in patterns.columns if c != sequence]
    return patterns.select(*other, F.inline(F.array(
        F.struct(F.lit("forward").alias("orientation"), F.col(sequence).alias(sequence)),
        F.struct(F.lit("reverse").alias("orientation"), reverse.alias(sequence)))))


def multi_pattern_search(texts: DataFrame, patterns: DataFrame, text_id: str, text: str,
                         pattern: str = "pattern", chunk: int = CHUNK,
                         seed_lengths: Sequence[int] = SEED_LENGTHS) -> DataFrame:
    """All exact, overlapping occurrences of many patterns in long texts (1-based, closed).

    A pattern of length L uses the largest seed length s with 2s - 1 <= L.  Texts offer only
    their block-aligned s-mers (one row per s characters, not per character); a pattern
    offers its s-mers at offsets 0..s-1.  Any occurrence contains exactly one aligned block
    at an offset below s, so each occurrence is found once, by an equi join, and then
    verified in full.  Texts are cut into chunks that overlap by a pattern's reach, so the
    work of one long text is spread out as well.  Equal patterns are searched once and
    expanded afterwards.

    The seed table is broadcast only after its size is checked.  Otherwise the join shuffles
    on the seed and carries positions only; the surviving candidates then meet the texts.
    """
    plan = _Seeds(patterns, pattern, seed_lengths)
    # A chunk is never shorter than the longest pattern, so the overlaps at most triple a text.
    longest = max(seed_lengths)
    chunk = max(chunk, -(-plan.reach // longest) * longest)
    # One pass cuts a text into its chunks; each is zipped with what it needs of its neighbours.
    cut = spread_scan(texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text"))).select(
        "_id", F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("_own"))
    none = F.array(F.lit(""))
    before = F.concat(none, F.transform(F.slice("_own", 1, F.size("_own") - 1), lambda c: F.right(c, F.lit(plan.before))))
    after = F.concat(F.transform(F.slice("_own", 2, F.size("_own")), lambda c: F.left(c, F.lit(plan.after))), none)
    pieces = cut.where(F.size("_own") > 0).select("_id", F.posexplode(F.arrays_zip(
        F.col("_own").alias("o"), before.alias("b"), after.alias("a"))).alias("_chunk", "_z"))
    pieces = pieces.select("_id", F.col("_chunk").cast("long").alias("_chunk"), F.col("_z.o").alias("_own"),
                           F.col("_z.b").alias("_before"), F.col("_z.a").alias("_after"))
    return plan.hits(pieces, chunk).withColumnRenamed("_id", text_id)


def search_pieces(pieces: DataFrame, patterns: DataFrame, keys: Sequence[str], piece_no: str, piece: str, chunk: int,
                  pattern: str = "pattern", seed_lengths: Sequence[int] = SEED_LENGTHS) -> DataFrame:
    """:func:`multi_pattern_search` of texts that come in pieces of ``chunk`` characters (the last may be shorter).

    Every piece sends its ends to its neighbours, so no row ever holds more than a piece and its
    borders; positions count from the start of the whole text. Pieces must be as long as the longest
    pattern at least, and a multiple of every seed length.
    """
    plan = _Seeds(patterns, pattern, seed_lengths)
    if plan.after > chunk or any(chunk % s for s in seed_lengths):
        raise ValueError(f"pieces of {chunk} characters are too short for the patterns or no multiple of the seeds")
    own = pieces.select(F.struct(*keys).alias("_id"), F.col(piece_no).cast("long").alias("_chunk"), F.col(piece).alias("_own"))
    sides = F.array(
        F.struct(F.col("_chunk").alias("c"), F.lit("own").alias("side"), F.col("_own").alias("t")),
        F.struct((F.col("_chunk") + 1).alias("c"), F.lit("before").alias("side"), F.right("_own", F.lit(plan.before)).alias("t")),
        F.struct((F.col("_chunk") - 1).alias("c"), F.lit("after").alias("side"), F.left("_own", F.lit(plan.after)).alias("t")))
    bordered = own.select("_id", F.inline(sides)).groupBy("_id", F.col("c").alias("_chunk")).agg(*[
        F.max(F.when(F.col("side") == side, F.col("t"))).alias(f"_{side}") for side in ("own", "before", "after")])
    bordered = bordered.where(F.col("_own").isNotNull()).select(
        "_id", "_chunk", "_own", F.coalesce("_before", F.lit("")).alias("_before"), F.coalesce("_after", F.lit("")).alias("_after"))
    return plan.hits(bordered, chunk).select("_id.*", "*").drop("_id")


class _Seeds:
    """Distinct patterns, their seeds, and the join that finds them in pieces of text."""

    def __init__(self, patterns: DataFrame, pattern: str, seed_lengths: Sequence[int]):
        self.named = patterns.where(F.length(pattern) >= 1).withColumnRenamed(pattern, "_pattern")
        distinct = self.named.select("_pattern").distinct().withColumn("_s", size_of("_pattern", seed_lengths))
        seeds = (distinct.select("_pattern", "_s", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_offset"))
                 .withColumn("_seed", F.substring("_pattern", F.col("_offset") + 1, F.col("_s"))))
        self.seeds, self.small = broadcast_if_small(seeds, MAX_BROADCAST_SEEDS)
        # At most one row per seed length: bounded by the constant list above.
        facts = distinct.groupBy("_s").agg(F.max(F.length("_pattern")).alias("reach")).collect()
        self.used = sorted(r["_s"] for r in facts) or [seed_lengths[-1]]
        self.reach = max((r["reach"] for r in facts), default=1)
        #: Characters needed of the neighbours to verify a pattern around a block.
        self.before, self.after = self.reach, self.reach + max(self.used)

    def hits(self, pieces: DataFrame, chunk: int) -> DataFrame:
        """Occurrences in pieces (_id, _chunk, _own, _before, _after), with the patterns' other columns.

        A piece answers for the blocks that start in its own part.
        """
        first = F.col("_chunk") * chunk
        piece = pieces.select("_id", "_chunk", (first + F.length("_own")).alias("_end"), (first - F.length("_before")).alias("_left"),
                              F.concat("_before", "_own", "_after").alias("_piece"))

        def at(start: Column, size) -> Column:
            return F.substring("_piece", (start - F.col("_left") + 1).cast("int"), size)

        last = F.col("_end") - F.col("_s")
        blocks = (piece.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in self.used]))).where(last >= first)
                  .withColumn("_pos", F.explode(F.sequence(first, last, F.col("_s").cast("long"))))
                  .withColumn("_seed", at(F.col("_pos"), F.col("_s"))))
        start = F.col("_pos") - F.col("_offset")
        fits = at(F.col("_start"), F.length("_pattern")) == F.col("_pattern")
        if self.small:
            found = blocks.join(self.seeds, ["_s", "_seed"]).withColumn("_start", start).where((F.col("_start") >= 0) & fits)
        else:
            candidates = (blocks.select("_id", "_chunk", "_s", "_seed", "_pos").join(self.seeds, ["_s", "_seed"])
                          .select("_id", "_chunk", start.alias("_start"), "_pattern").where(F.col("_start") >= 0))
            found = candidates.join(piece, ["_id", "_chunk"]).where(fits)
        hits = found.select("_id", "_pattern", (F.col("_start") + 1).cast("long").alias("start"),
                            (F.col("_start") + F.length("_pattern")).cast("long").alias("end"))
        return hits.join(self.named, "_pattern").drop("_pattern")


def size_of(pattern: str, seed_lengths: Sequence[int]) -> Column:
    """Largest seed length s with 2s - 1 <= length of the pattern."""
    out = F
    for s in seed_lengths:
        out = out.when(F.length(pattern) >= 2 * s - 1, F.lit(s))
    return out.otherwise(F.lit(1))


# ---------------------------------------------------------------- intervals

LEVEL_BITS = 2


def _level(length: Column) -> Column:
    """Smallest level whose bin width 2^(bits·level) is at least ``length``."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) / F.lit(float(LEVEL_BITS))).cast("int")


def _points_in_intervals(points: DataFrame, spans: DataFrame, strict_start: bool) -> DataFrame:
    """Pairs with start <= point <= end (start < point when ``strict_start``).

    An interval sits at the level of its own length and so touches at most two bins; a point
    looks up one bin at each level in use.  Neither side's expansion grows with the lengths.
    """
    leveled = spans.withColumn("_lvl", _level(F.col("_end") - F.col("_start") + 1))
    width = F.pow(F.lit(2.0), F.lit(LEVEL_BITS) * F.col("_lvl")).cast("long")
    binned = (leveled.withColumn("_w", width)
              .withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_start") / F.col("_w")),
                                                       F.floor(F.col("_end") / F.col("_w"))))))
    # Bounded: a level is at most 32 for 64-bit coordinates.
    levels = sorted(r[0] for r in leveled.select("_lvl").distinct().collect())
    if not levels:
        levels = [0]
    at = points.withColumn("_lvl", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn(
        "_bin", F.floor(F.col("_point") / F.pow(F.lit(2.0), F.lit(LEVEL_BITS) * F.col("_lvl")).cast("long")))
    pairs = at.join(binned, ["_chrom", "_lvl", "_bin"])
    low = F.col("_point") > F.col("_start") if strict_start else F.col("_point") >= F.col("_start")
    return pairs.where(low & (F.col("_point") <= F.col("_end")))


def interval_overlap(left: DataFrame, right: DataFrame, chrom: str, left_id: str, right_id: str,
                     start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of closed intervals that overlap on one chromosome: (chrom, left id, right id).

    Two intervals overlap when the left one starts inside the right one, or the right one
    starts inside the left one (strictly, so the cases are disjoint and no pair repeats).
    """
    def points(df, key):
        return df.select(F.col(chrom).alias("_chrom"), F.col(key).alias("_pid"), F.col(start).alias("_point"))

    def spans(df, key):
        return df.select(F.col(chrom).alias("_chrom"), F.col(key).alias("_sid"),
                         F.col(start).alias("_start"), F.col(end).alias("_end"))

    a = _points_in_intervals(points(left, left_id), spans(right, right_id), False).select(
        F.col("_chrom").alias(chrom), F.col("_pid").alias("left_id"), F.col("_sid").alias("right_id"))
    b = _points_in_intervals(points(right, right_id), spans(left, left_id), True).select(
        F.col("_chrom").alias(chrom), F.col("_sid").alias("left_id"), F.col("_pid").alias("right_id"))
    return a.unionByName(b)


# ---------------------------------------------------------------- classification

def classify_specificity(queries: DataFrame, transcript_hits: DataFrame, loci: DataFrame,
                         overlaps: DataFrame) -> DataFrame:
    """Specificity of each probe.

    ``queries``: probe_id, expected_gene.  ``transcript_hits``: probe_id, gene (one row per
    hit).  ``loci``: probe_id, locus.  ``overlaps``: probe_id, gene.  Sets are reduced to
    distinct rows and counts first; gene lists are reported, loci only counted.
    """
    def other_gene(df):
        return df.join(queries.select("probe_id", "expected_gene"), "probe_id")

    tx = other_gene(transcript_hits.groupBy("probe_id", "gene").agg(F.count(F.lit(1)).alias("_n")))
    expected = F.col("gene") == F.col("expected_gene")
    tx = tx.groupBy("probe_id").agg(
        F.sum("_n").alias("transcript_hits"), F.count(F.lit(1)).alias("transcript_genes"),
        F.count_if(expected).alias("_tx_expected"), F.count_if(~expected).alias("_tx_other"))
    places = loci.distinct().groupBy("probe_id").agg(F.count(F.lit(1)).alias("loci"))
    over = other_gene(overlaps.select("probe_id", "gene").distinct()).groupBy("probe_id").agg(
        F.count(F.lit(1)).alias("overlap_genes"), F.count_if(~expected).alias("_over_other"))
    counts = ["transcript_hits", "transcript_genes", "_tx_expected", "_tx_other", "loci",
              "overlap_genes", "_over_other"]
    rows = (queries.join(tx, "probe_id", "left").join(places, "probe_id", "left")
            .join(over, "probe_id", "left").fillna(0, subset=counts))
    has_expected = F.col("_tx_expected") > 0
    reasons = X.reason_list(
        (~has_expected, "no_expected_release113_transcript_match"),
        (F.col("_tx_other") > 0, "cross_gene_transcript_match"),
        (F.col("loci") > 1, "multiple_primary_assembly_loci"),
        (F.col("_over_other") > 0, "cross_gene_primary_assembly_overlap"),
        ((F.col("loci") > 0) & (F.col("overlap_genes") == 0),
         "primary_assembly_hit_outside_annotated_gene"), none="")
    boundary = (F.when((F.col("loci") == 0) & has_expected,
                       F.lit("transcript_only_exact_match_no_contiguous_primary_assembly_hit"))
                .when(F.col("loci") > 0, F.lit("primary_assembly_locus_checked_against_release113_gtf"))
                .otherwise(F.lit("no_exact_reference_hit")))
    return rows.withColumns({
        "failure_reasons": reasons, "specificity_boundary": boundary,
    }).withColumn("specificity_status", F.when(
        F.col("failure_reasons") == "", F.lit("pass_unique_expected_gene"))
        .otherwise(F.lit("fail_specificity_gate"))).drop("_tx_expected", "_tx_other", "_over_other")


def gene_collisions(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Per gene: matching probes and how many of them also match another gene.

    ``hits``: (gene, probe_id), repeated or not; ``genes``: the configured (module_id, gene).
    """
    pairs = hits.select("gene", "probe_id").distinct()
    shared = pairs.groupBy("probe_id").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    per_gene = pairs.join(shared, "probe_id").groupBy("gene").agg(
        F.count(F.lit(1)).alias("candidate_probes"), F.count_if("_shared").alias("collision_probes"))
    rows = genes.join(per_gene, "gene", "left").fillna(0, subset=["candidate_probes", "collision_probes"])
    return rows.withColumn("mapping_status", F.when(
        F.col("candidate_probes") == 0, F.lit("no_exact_canonical_transcript_match"))
        .when(F.col("collision_probes") == 0, F.lit("sequence_match_unique_within_locked_genes"))
        .otherwise(F.lit("sequence_match_ambiguous_within_locked_genes")))


def collision_gate(collisions: DataFrame, minimum: float = 0.80) -> DataFrame:
    """Share of uniquely matched genes per module and the coverage gate."""
    unique = F.col("mapping_status") == "sequence_match_unique_within_locked_genes"
    return collisions.groupBy("module_id").agg(
        F.count(F.lit(1)).alias("configured_genes"),
        F.count_if(F.col("candidate_probes") > 0).alias("matched_genes"),
        F.count_if(unique).alias("unique_genes")).withColumn(
        "mapped_fraction", F.col("unique_genes") / F.col("configured_genes")).withColumn(
        "gate", F.when(F.col("mapped_fraction") >= minimum, F.lit("pass")).otherwise(F.lit("fail")))

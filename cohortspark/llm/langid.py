"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortspark.llm.common import cut
from cohortspark.llm.quality import crc_fold

#: Letters of an n-gram at most, and n-grams of a profile.
LONGEST, PROFILE = 3, 300
#: Profiles that are compared with a document; more than these are refused, never dropped.
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: Characters counted at a time.
BLOCK = 1 << 20

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased words of letters, single blanks between and around them; empty if there is no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {plain} " if plain else ""


def gram_counts(plain: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (of 1 to LONGEST characters, none a blank only, none across words) and their counts.

    An n-gram is coded in 21 bits a character, so equal codes are equal n-grams.
    """
    codes, counts = [], []
    for at in range(0, len(plain), BLOCK):
        block = plain[at:at + BLOCK + LONGEST - 1]
        points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        blank = points == 32
        starts = min(BLOCK, len(plain) - at)
        for n in range(1, LONGEST + 1):
            m = min(starts, len(points) - n + 1)
            if m <= 0:
                continue
            gram, inside = points[:m].copy(), ~blank[:m] if n < 3 else np.ones(m, dtype=bool)
            for j in range(1, n):
                gram = gram << 21 | points[j:j + m]
            if n == 2:
                inside = ~(blank[:m] & blank[1:1 + m])
            if n == 3:
                inside = ~blank[1:1 + m]
            kinds, n_each = np.unique(gram[inside], return_counts=True)
            codes.append(kinds)
            counts.append(n_each)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(plain) <= BLOCK:
        return np.concatenate(codes), np.concatenate(counts)
    kinds, back = np.unique(np.concatenate(codes), return_inverse=True)
    return kinds, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def most_frequent(kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams in order; ties by code."""
    if len(kinds) > PROFILE:  # all that may rank, ties of the last place included
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        kinds, counts = kinds[counts >= least], counts[counts >= least]
    return kinds[np.lexsort((kinds, -counts))[:PROFILE]]


def _counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch of (lang, text)."""
    for batch in source:
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            by.setdefault(lang.as_py(), []).append(gram_counts(letters(text.as_py())))
        for lang, each in by.items():
            kinds, back = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([c for _, c in each]), minlength=len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(n)], names=["lang", "gram", "n"])


def profiles(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, gram, rank): the PROFILE most frequent n-grams of each language over all of ``docs``; rows of null lang are left out."""
    rows = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The limit of a ranked window is applied before the shuffle too.
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank")


class Profiles:
    """Profiles as one sorted table of n-grams with their rank in each language (PROFILE where absent)."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank - 1

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language of least out-of-place distance, ties to the lesser name, and one minus that distance over its maximum."""
        plain = letters(text)
        if not plain or not self.langs:
            return UNKNOWN, 0.0
        mine = most_frequent(*gram_counts(plain))
        at = np.searchsorted(self.grams, mine)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != mine)] = len(self.grams)
        theirs = self.ranks[at]
        place = np.arange(len(mine))[:, None]
        away = np.where(theirs < 0, PROFILE, np.abs(theirs - place)).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (PROFILE * len(mine)))


def _predicted(model):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in source:
            found = [known.nearest(t.as_py()) for t in batch.column("text")]
            rest = batch.select([n for n in batch.schema.names if n != "text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*rest.schema.names, "lang_pred", "score"])
    return batches


def identify_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                       folds: int = 3, held_fold: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Profiles come from all rows with a language whose crc32(doc_id as text) mod ``folds`` is not
    ``held_fold``; a null id is not held out. Predictions read the whole text and nothing else:
    ``und`` with score 0 if it is null, has no letter, or nothing was learned; ties go to the lesser
    name. Repeated rows get equal rows. More than MAX_LANGUAGES languages raise ValueError.
    """
    held = F.coalesce(crc_fold(F.col(id_column), folds) == held_fold, F.lit(False))
    learned = cut(profiles(docs.where(~held), text_column, lang_column))
    names = learned.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in learned.collect()]))
    rows = docs.select(F.col(id_column).alias("doc_id"), held.alias("held_out"), F.col(text_column).alias("text"))
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_predicted(model), f"{fields}, lang_pred string, score double")

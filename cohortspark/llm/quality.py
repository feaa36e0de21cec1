"""Quality classifier: random-indexing word vectors, a two-layer network and a calibrated temperature."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortspark.llm.common import cut, row_keys

#: Labelled documents the model is fitted on at most, chosen by a hash of their id: the one bound of the fit.
MAX_TRAINING = 4000
#: Words share BUCKETS vectors of DIM numbers (8 MB), whatever the vocabulary.
BUCKETS, DIM, NONZERO, REACH = 1 << 16, 64, 4, 2
HIDDEN, EPOCHS, SEED = 32, 300, 7
THRESHOLD = 0.7
#: Words pooled at a time, and words whose bucket a task remembers.
BLOCK, REMEMBERED = 1 << 14, 1 << 18

#: A token is a run of letters and digits or a run of other visible characters.
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Buckets(dict):
    """Bucket of a token: lower-cased words by hash; words in capitals by their length, as case is what they tell."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        word = f"\x00{min(len(token), 8)}" if len(token) > 1 and token.isupper() else token.lower()
        self[token] = bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


#: Bucket of the word that stands for a token repeated from one or two places before.
_REPEAT = zlib.crc32(b"\x01") % BUCKETS


def _tokens(text: str | None, buckets: _Buckets) -> np.ndarray:
    """Buckets of all tokens, and one _REPEAT for each repetition: pooling alone would not see order."""
    words = np.array([buckets[t] for t in _TOKEN.findall(text or "")], dtype=np.int64)
    repeats = np.count_nonzero(words[1:] == words[:-1]) + np.count_nonzero(words[2:] == words[:-2])
    return np.append(words, np.full(repeats, _REPEAT))


def index_vectors() -> np.ndarray:
    """The sparse ternary vector of each bucket."""
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS, DIM), dtype=np.float32)
    at = rng.integers(0, DIM, (BUCKETS, NONZERO))
    np.put_along_axis(vectors, at, rng.choice(np.array([-1, 1], dtype=np.float32), (BUCKETS, NONZERO)), axis=1)
    return vectors


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Index vector of each bucket plus the mean of its neighbours' (REACH words either side) in ``texts``."""
    index = index_vectors()
    context, seen = np.zeros((BUCKETS, DIM), dtype=np.float64), np.zeros(BUCKETS, dtype=np.float64)
    for words in texts:
        for at in range(0, len(words), BLOCK):
            block = words[at:at + BLOCK]
            near = np.zeros((len(block), DIM), dtype=np.float32)
            for d in range(1, REACH + 1):
                near[d:] += index[block[:-d]]
                near[:-d] += index[block[d:]]
            order = np.argsort(block, kind="stable")
            kinds, starts, counts = np.unique(block[order], return_index=True, return_counts=True)
            context[kinds] += np.add.reduceat(near[order], starts, axis=0)
            seen[kinds] += counts
    context /= np.maximum(seen, 1)[:, None]
    return (index + 0.5 * context / REACH).astype(np.float16)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and scaled length of a document's word vectors; zeros for no words."""
    total = np.zeros(DIM, dtype=np.float64)
    for at in range(0, len(words), BLOCK):
        total += vectors[words[at:at + BLOCK]].astype(np.float32).sum(axis=0, dtype=np.float64)
    mean = total / max(len(words), 1)
    return np.append(mean, np.linalg.norm(mean))


def _logits(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    return np.tanh((x - p["mean"]) / p["scale"] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Two layers by Adam on all but each fifth row, on which the temperature is then fitted."""
    rng = np.random.default_rng(SEED)
    held = np.arange(len(y)) % 5 == 4
    xt, yt = x[~held], y[~held]
    p = {"mean": xt.mean(0), "scale": xt.std(0) + 1e-6, "w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
         "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b2": np.zeros(1)}
    names = ("w1", "b1", "w2", "b2")
    m, v = ({n: np.zeros_like(p[n]) for n in names} for _ in range(2))
    z = (xt - p["mean"]) / p["scale"]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ p["w1"] + p["b1"])
        d = (_sigmoid(h @ p["w2"] + p["b2"]) - yt) / len(yt)
        back = np.outer(d, p["w2"]) * (1 - h * h)
        grads = {"w1": z.T @ back + 1e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum(keepdims=True)}
        for n in names:
            m[n] = 0.9 * m[n] + 0.1 * grads[n]
            v[n] = 0.999 * v[n] + 0.001 * grads[n] ** 2
            p[n] = p[n] - 0.02 * (m[n] / (1 - 0.9 ** step)) / (np.sqrt(v[n] / (1 - 0.999 ** step)) + 1e-8)
    grid = np.geomspace(0.25, 8, 61)
    if held.any():
        logits, ones = _logits(x[held], p), y[held].sum()
        # Smoothed targets, so that separable rows do not ask for certainty.
        target = np.where(y[held] > 0, (ones + 1) / (ones + 2), 1 / (held.sum() - ones + 2))
        loss = [np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in grid]
        p["t"] = np.array([grid[int(np.argmin(loss))]])
    else:
        p["t"] = np.ones(1)
    return p


def _fit(frame: pd.DataFrame) -> bytes:
    buckets = _Buckets()
    # An order of its own, so that the fit does not depend on the shuffle.
    frame = frame.sort_values(["h", "doc_id", "text"], kind="stable", na_position="first")
    texts = [_tokens(t, buckets) for t in frame["text"]]
    vectors = word_vectors(texts)
    x = np.stack([pooled(t, vectors) for t in texts])
    out = io.BytesIO()
    np.savez_compressed(out, vectors=vectors, **fit_network(x, frame["label"].to_numpy(dtype=np.float64)))
    return out.getvalue()


def _constant(labels: list[float]) -> bytes:
    """A model without a network, for labels of one class or none: the smoothed share of label 1, 0.5 without labels."""
    out = io.BytesIO()
    np.savez(out, constant=np.array([(sum(labels) + 1) / (len(labels) + 2)]))
    return out.getvalue()


def is_constant(model: bytes) -> bool:
    return "constant" in np.load(io.BytesIO(model)).files


_LOADED: dict[int, dict[str, np.ndarray]] = {}


def scorer(spark: SparkSession, model: bytes):
    """A column function text -> calibrated probability of label 1, for empty and null texts too. Only texts go to Python."""
    held = spark.sparkContext.broadcast(model)  # at most BUCKETS x DIM half-precision numbers

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        data = held.value
        if hash(data) not in _LOADED:
            _LOADED.clear()
            _LOADED[hash(data)] = dict(np.load(io.BytesIO(data)))
        p, buckets = _LOADED[hash(data)], _Buckets()
        for texts in batches:
            if "constant" in p:
                yield pd.Series(np.full(len(texts), p["constant"][0]), dtype="float64")
                continue
            x = np.stack([pooled(_tokens(t, buckets), p["vectors"]) for t in texts]) if len(texts) else np.zeros((0, DIM + 1))
            yield pd.Series(_sigmoid(_logits(x, p) / p["t"]), dtype="float64")

    return F.pandas_udf(scores, DoubleType())


def crc_fold(identity: Column, folds: int) -> Column:
    return F.pmod(F.crc32(identity.cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text",
          bound: int = MAX_TRAINING) -> bytes:
    """Model of ``labels`` (doc_id, label 0 or 1) over at most ``bound`` labelled documents.

    Labels with a null id or label and labels without a document teach nothing; of several labels of
    an id the lowest counts. Without labelled documents, or with one class only, there is nothing to tell
    apart: every text gets the smoothed share of label 1 as its score, 0.5 without labels.
    """
    known = (labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("_id"))
             .agg(F.min(label).cast("double").alias("label")))
    known = known.withColumn("h", F.xxhash64("_id"))
    # The choice is made on ids alone; texts meet only the chosen ones, which are few by the bound.
    ids = docs.select(F.col(id_column).alias("doc_id"))
    few = cut(known.join(ids, F.col("_id") == F.col("doc_id"), "left_semi").orderBy("h", "_id").limit(bound))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    chosen = texts.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label", "h").orderBy(
        "h", "doc_id", "text").limit(bound)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in batches if len(f)]
        if frames:
            frame = pd.concat(frames, ignore_index=True)
            yield pd.DataFrame({"model": [_fit(frame) if frame["label"].nunique() == 2 else _constant(frame["label"].tolist())]})

    models = chosen.coalesce(1).mapInPandas(fit, "model binary").collect()  # one row of fixed size
    return bytes(models[0][0]) if models else _constant([])


def judge_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  folds: int = 4, held_fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, k1, k2.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are held out of the training; a
    null id is not held out and has no label. Only the text enters a score, all of it; empty and null
    texts get the score of no words. Repeated rows get equal rows. Training labels of one class or none give
    every row one score.
    """
    teachers = labels.where(crc_fold(F.col(id_column), folds) != held_fold)
    model = train(docs, teachers, id_column=id_column, text_column=text_column)
    k1, k2 = row_keys(id_column, text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(crc_fold(F.col(id_column), folds) == held_fold, F.lit(False)).alias("held_out"),
        scorer(docs.sparkSession, model)(text_column).alias("score"), k1.alias("k1"), k2.alias("k2"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "k1", "k2")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows the classifier rejects, its columns unchanged; labels of one class or none reject nothing."""
    model = train(docs, labels.where(crc_fold(F.col("doc_id"), 4) != 2))
    if is_constant(model):
        return docs
    return docs.where(scorer(docs.sparkSession, model)("text") >= threshold)

"""Embedding whitening: exact distributed covariance, float32 eigenvectors refined in higher precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

from cohortspark.llm.common import cut

#: An entry becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size or more have no exact long; their rows take no part.
LARGEST = float(1 << 40)
#: Rows multiplied at a time, and refinement steps at most (each roughly squares the error).
BLOCK, STEPS = 4096, 24


def refine(a: np.ndarray, vectors: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and orthonormal eigenvectors of the symmetric ``a``, from approximate ``vectors``.

    Ogita-Aishima: with R = I - X'X and S = X'AX the correction X + XE needs only matrix products,
    carried out in the precision of ``a``. Eigenvalues nearer to each other than the residual's bound
    form a cluster, inside which only orthogonality is corrected; a cluster is then turned to its own
    eigenvectors by solving the small shifted problem X_k'(A - mean)X_k, whose entries are as small as the
    cluster's width and so keep full relative precision in double.
    """
    kind, eps = a.dtype, np.finfo(a.dtype).eps
    d, x = len(a), vectors.astype(a.dtype)
    size = np.sqrt((a * a).sum())
    if size == 0:
        return np.zeros(d, dtype=kind), np.eye(d, dtype=kind)
    before, solved = np.inf, None
    for _ in range(steps):
        r = np.eye(d, dtype=kind) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # so that a step across a narrow gap stays a rotation
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        values, x, r, s = values[order], x[:, order], r[order][:, order], s[order][:, order]
        off = s - np.diag(values * (1 - np.diag(r)))
        bound = max(2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())), 8 * d * eps * size)
        cluster = np.cumsum(np.append(0, np.diff(values) > bound))
        near = cluster[:, None] == cluster[None]
        step = np.where(near, r / 2, (s + values[None] * r) / np.where(near, 1, values[None] - values[:, None]))
        x = x + x @ step
        moved = np.abs(step).max()
        if moved <= 1e-7 and near.sum() > d and near.sum() != solved:
            # Columns are orthogonal and clusters apart from each other: turn each cluster by itself.
            for g in (np.flatnonzero(cluster == c) for c in np.unique(cluster)):
                part = x[:, g]
                inner = part.T @ (a @ part - values[g].mean() * part)
                x[:, g] = part @ np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1].astype(kind)
            before, solved = np.inf, near.sum()
            continue
        if moved <= 4 * eps or (moved >= before / 2 and moved < 1e-15):
            break
        before = moved
    for _ in range(2):  # steps across gaps near the precision of a never vanish; leave their last trace out
        x = x + x @ ((np.eye(d, dtype=kind) - x.T @ x) / 2)
    s = x.T @ (a @ x)
    values = np.diag(s) / (x * x).sum(axis=0)
    order = np.argsort(values, kind="stable")
    return values[order], x[:, order]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit vectors: a float32 solution refined in extended precision."""
    size = np.abs(a).max() if a.size else 0
    start = np.linalg.eigh((a / size).astype(np.float32))[1] if size else np.eye(len(a), dtype=np.float32)
    values, x = refine(a.astype(np.longdouble), start)
    return values[::-1], x[:, ::-1]


def _entries(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """floor(SCALE * c) of a batch of valid vectors, as longs."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d)


def _packed(d: int):
    """Each vector as bytes, 4 an entry where all its entries fit and 8 otherwise, so equal vectors have equal bytes."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            y = _entries(batch, d)
            fits = (np.abs(y) < 1 << 31).all(axis=1)
            rows = [row.astype("<i4").tobytes() if ok else row.astype("<i8").tobytes() for row, ok in zip(y, fits)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["y"])
    return batches


def _unpacked(batch: pa.RecordBatch, d: int) -> np.ndarray:
    rows = batch.column("y").to_pylist()
    if all(len(row) == 4 * d for row in rows):
        return np.frombuffer(b"".join(rows), dtype="<i4").reshape(-1, d).astype(np.int64)
    return np.stack([np.frombuffer(row, dtype="<i4" if len(row) == 4 * d else "<i8").astype(np.int64) for row in rows])


def _product(y: np.ndarray) -> np.ndarray:
    """y'y in exact Python integers; doubles multiply wherever their sums stay exact."""
    total, largest = np.zeros((y.shape[1],) * 2, dtype=object), max(1, int(np.abs(y).max()))
    rows = min(BLOCK, (1 << 53) // largest ** 2)
    if rows == 0:
        exact = y.astype(object)
        return exact.T @ exact
    for at in range(0, len(y), rows):
        part = y[at:at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


_SUMS = StructType([StructField("i", LongType()), StructField("j", LongType()), StructField("s", DecimalType(38, 0))])


def _sums(d: int, centre: np.ndarray):
    """Per task: the count at (-1, -1), sums of (y - centre) at (i, -1), sums of products at (i, j), i <= j."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in source:
            if batch.num_rows:
                y = _unpacked(batch, d) - centre
                fits = int(np.abs(y).max()) * len(y) < 1 << 62
                first = first + (y if fits else y.astype(object)).sum(axis=0).astype(object)
                n, second = n + len(y), second + _product(y)
        if n:
            i, j = np.triu_indices(d)
            values = [n, *first, *second[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(([-1], np.arange(d), i))), pa.array(np.concatenate(([-1], np.full(d, -1), j))),
                 pa.array([int(v) for v in values], pa.decimal128(38, 0))], names=["i", "j", "s"])
    return batches


def _whitened(y: np.ndarray, model: dict) -> np.ndarray:
    """Projections of (x - S/n) over sqrt(e); the numerator n*x - S is exact."""
    n, offset = model["n"], y - model["centre"]
    exact = offset * n - model["first"] if model["narrow"] else offset.astype(object) * n - model["first"].astype(object)
    return (exact / n).astype(np.float64) @ model["axes"]


def _products(model: dict):
    """Per task: sums of the whitened components at (i, -1) and of their products at (i, j)."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model["axes"].shape[1]
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in source:
            if batch.num_rows:
                w = _whitened(_unpacked(batch, model["d"]), model)
                first, second = first + w.sum(axis=0), second + w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((np.arange(k), i))), pa.array(np.concatenate((np.full(k, -1), j))),
             pa.array(np.concatenate((first, second[i, j])))], names=["i", "j", "s"])
    return batches


def _projections(model: dict):
    """One row per vector and component."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n, k = model["d"], model["n"], len(model["explained"])
        for batch in source:
            for part in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                y = _entries(part, d)
                live = model["axes"].shape[1]
                w = np.full((len(y), k), np.nan)
                w[:, :live] = _whitened(y, model)
                exact = (y - model["centre"]) * n - model["first"] if model["narrow"] else (
                    (y - model["centre"]).astype(object) * n - model["first"].astype(object))
                spread = np.abs(exact).max(axis=1)
                if model["narrow"] and int(spread.max()) ** 2 * d < 1 << 63:
                    deviation = pa.array((exact * exact).sum(axis=1))
                else:
                    sums = (exact.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(v) if v < 1 << 63 else None for v in sums], pa.int64())
                times = np.repeat(np.arange(len(y)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(times), n)), deviation.take(pa.array(times)),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(np.array(model["explained"], dtype=object), len(y)), pa.float64()),
                    pa.array([model["error"]] * len(times), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return batches


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per valid row of ``vectors`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become integers floor(64 c) + 1,000,000. The fit list is each distinct integer vector once;
    its sums and products are added exactly, as integers centred near the mean, so the covariance is
    that of exact arithmetic rounded once. Components are its unit eigenvectors by falling eigenvalue,
    from a float32 solution refined in extended precision. What reaches the driver is one matrix of the
    vectors' dimension, whatever the number of rows.

    Rows whose vector is null or empty, holds a null, non-finite or unrepresentable entry (2^40 or
    more), or has another length than most valid vectors (ties: the longer) return nothing. Repeated
    rows return repeated rows; null ids stay null. Vectors of less than ``components`` entries have a
    component per entry. A component without variance has no scale: whitened is null and explained 0, or
    null if nothing varies. ``deviation`` is null where it exceeds a long. Other columns are not read.
    """
    v = F.col(vector_column)
    valid = v.isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST))
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v")).where(valid)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows"))
    schema = (f"vec_id {dict(rows.dtypes)['id']}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    most = lengths.orderBy(F.desc("rows"), F.desc("d")).first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = most["d"]
    rows = rows.where(F.size("v") == d)
    # A centre near the mean, from all rows and without a shuffle of vectors; sums are corrected exactly below.
    means = rows.select(F.posexplode("v").alias("i", "c")).groupBy("i").agg(F.avg(F.floor(F.col("c").cast("double") * SCALE)).alias("m"))
    centre = np.zeros(d, dtype=np.int64)
    for row in means.collect():
        centre[row["i"]] = round(row["m"])
    fit = cut(rows.select("v").mapInArrow(_packed(d), "y binary").distinct())
    sums = {(r["i"], r["j"]): int(r["s"]) for r in fit.mapInArrow(_sums(d, centre), _SUMS).groupBy("i", "j").agg(
        F.sum("s").alias("s")).collect()}
    n, first = sums[-1, -1], [sums[i, -1] for i in range(d)]
    # n * sum(zz') - sum(z) sum(z)', over n^2: exact until the one division.
    exact = [[n * sums[min(i, j), max(i, j)] - first[i] * first[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[np.longdouble(str(c)) for c in row] for row in exact], dtype=np.longdouble) / np.longdouble(str(n * n))
    values, axes = eigenvectors(covariance)
    k, trace = min(components, d), np.trace(covariance)
    live = int((values[:k] > 8 * d * np.finfo(np.float64).eps * values[0]).sum()) if trace > 0 else 0
    reach = max(1, *(abs(s) for s in first)) + n * (1 << 31)
    model = {"d": d, "n": n, "centre": centre, "narrow": reach < 1 << 62, "first": np.array(first, dtype=object),
             "axes": (axes[:, :live] / np.sqrt(values[:live])).astype(np.float64), "error": None,
             "explained": [float(values[i] / trace) if i < live else 0.0 if trace > 0 else None for i in range(k)]}
    # Entries of up to 31 bits stay in longs; wider ones are multiplied as Python integers.
    wide = fit.agg(F.max(F.length("y"))).first()[0] > 4 * d
    model["narrow"] = model["narrow"] and not wide and int(np.abs(centre).max()) < 1 << 31
    if model["narrow"]:
        model["first"] = model["first"].astype(np.int64)
    if live:
        found = {(r["i"], r["j"]): r["s"] for r in fit.mapInArrow(_products(model), "i bigint, j bigint, s double").groupBy(
            "i", "j").agg(F.sum("s").alias("s")).collect()}
        mean = [found[i, -1] / n for i in range(live)]
        model["error"] = max(abs(found[i, j] / n - mean[i] * mean[j] - (i == j)) for i in range(live) for j in range(i, live))
    return rows.mapInArrow(_projections(model), schema)

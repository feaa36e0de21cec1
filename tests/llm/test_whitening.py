"""Embedding whitening against a plain eigensolver, exact integers, and matrices with clustered eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cohortspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, y int, centre string, component double"


def plain(rows, k=16):
    """(n, deviation per valid row, eigenvalues, V) with Python integers and one dense solution."""
    xs = [(i, tuple(math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[n * x[j] - total[j] for j in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n ** 3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    deviations = [(i, sum((n * x[j] - total[j]) ** 2 for j in range(d))) for i, x in xs]
    project = {x: np.array([(n * x[j] - total[j]) / n for j in range(d)]) @ axes[:, ::-1][:, :k] / np.sqrt(
        np.maximum(values[::-1][:k], 1e-300)) for x in fit}
    return n, deviations, values[::-1], v, [(i, project[x]) for i, x in xs]


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], []).append(r)
    return out


def test_equals_plain_solution(spark):
    rng = np.random.default_rng(5)
    made = [(i, (rng.normal(size=20) * np.linspace(1, 3, 20)).astype(np.float32).tolist()) for i in range(300)]
    made += [(1000 + i, made[7][1]) for i in range(200)] + [(7, made[7][1])]  # copies and a repeated row
    df = spark.createDataFrame([(i, v, 1, "c", 2.0) for i, v in made], SCHEMA).repartition(5)
    n, deviations, values, v, projected = plain(made)
    got = collected(whitening.whiten(df))
    assert sorted(got) == list(range(1, 17))
    assert n == 300
    for c, rows in got.items():
        assert len(rows) == len(made) and {r["n"] for r in rows} == {300}
        assert sorted((r["vec_id"], r["deviation"]) for r in rows) == sorted(deviations)
        assert all(r["explained"] == pytest.approx(values[c - 1] / v.trace(), rel=1e-10) for r in rows)
        assert max(r["identity_error"] for r in rows) < 1e-9
        a = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["deviation"]))])
        b = np.array([w[c - 1] for _, w in sorted(projected, key=lambda p: p[0])])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_defined_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1e30, 1.0]), (7, [1.0, 2.0, 3.0])]
    good = [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (None, [3.0, 1.0]), (13, [-2.5, 0.25])]
    df = spark.createDataFrame([(i, v, 0, "x", 0.0) for i, v in bad + good], SCHEMA)
    rows = whitening.whiten(df).collect()
    assert sorted({r["vec_id"] for r in rows}, key=str) == [10, 11, 13, None] and {r["n"] for r in rows} == {3}
    assert {r["component"] for r in rows} == {1, 2} and all(r["whitened"] is not None for r in rows)
    one = whitening.whiten(df.where("vec_id in (10, 11)")).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0], 0, "", 0.0) for i in range(5)], SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None, r["explained"]) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    assert whitening.whiten(df.where("vec_id < 0")).collect() == []
    wide = [(i, [x * 1e9, x, 1.0]) for i, x in enumerate([1.0, 2.0, -3.0, 5.5])]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} and max(abs(r["whitened"]) for r in got if r["whitened"]) < 3


@pytest.mark.parametrize("values", [
    np.arange(1.0, 41), np.concatenate((np.full(10, 1.0) + np.arange(10) * 1e-9, np.arange(2.0, 32))),
    np.concatenate((np.full(15, 2.0), np.full(10, 2.0 + 1e-12), np.arange(3.0, 10))), np.geomspace(1e-12, 1, 30), np.full(12, 3.0)])
def test_refinement_reaches_double_precision(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    q = q @ (1.5 * np.eye(len(values)) - 0.5 * q.T @ q)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigenvectors(a)
    scale = np.abs(values).max()
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16
    assert np.abs(a @ x - x * found).max() < 2e-15 * scale
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-15 * scale

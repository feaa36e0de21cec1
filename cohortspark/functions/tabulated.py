"""Weighted sums of a group as functions of τ², tabulated once and evaluated anywhere.

Every sum is a combination of 1 / (v + τ²) and its square, so it is smooth for τ² >= 0. On segments over
which (least v + τ²) doubles, its Chebyshev interpolation through NODES + 1 points is exact to rounding
(the nearest pole lies three half-widths from the middle: an error factor of 5.8 per node). A row that
needs a sum without its own study subtracts its term at the same τ².
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Ship the helpers with the function, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = 22
SUMS = ("w", "wy", "wyy", "w2", "w2y", "w2yy")
STEPS = 90
_POINTS = (1 - np.cos(np.pi * np.arange(NODES + 1) / NODES)) / 2
_WEIGHTS = np.where(np.arange(NODES + 1) % 2, -1.0, 1.0) * np.where(np.isin(np.arange(NODES + 1), (0, NODES)), 0.5, 1.0)


def points() -> list[float]:
    """Places of the nodes in a segment, from 0 to 1."""
    return _POINTS.tolist()


def _at(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Interpolated sums (rows, SUMS) at a place in [0, 1] of each row's segment."""
    gap = place[:, None] - _POINTS[None]
    exact = gap == 0
    scale = _WEIGHTS[None] / np.where(exact, 1.0, gap)
    value = np.einsum("rn,rns->rs", scale, table) / scale.sum(axis=1)[:, None]
    hit = exact.any(axis=1)
    value[hit] = table[hit, exact[hit].argmax(axis=1)]
    return value


def _omitted(ys, vs, t: np.ndarray) -> np.ndarray:
    """The omitted studies' own terms (rows, SUMS) at each row's τ²."""
    width = max((len(y) for y in ys), default=0)
    out = np.zeros((len(t), len(SUMS)))
    for i in range(width):
        has = np.array([len(y) > i for y in ys])
        y = np.array([y[i] for y in ys if len(y) > i])
        w = 1.0 / (np.array([v[i] for v in vs if len(v) > i]) + t[has])
        out[has] += np.stack([w, w * y, w * y * y, w * w, w * w * y, w * w * y * y], axis=1)
    return out


def score(s: np.ndarray, k: np.ndarray, pm: np.ndarray) -> np.ndarray:
    """Estimating function whose root is τ²: restricted likelihood, or Paule-Mandel where ``pm``."""
    w, wy, wyy, w2, w2y, w2yy = s.T
    mu = wy / w
    return np.where(pm, (wyy - mu * wy) - (k - 1), (w2yy - 2 * mu * w2y + mu * mu * w2) - (w - w2 / w))


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("t", *SUMS)]))
def root(table: pd.Series, low: pd.Series, high: pd.Series, k: pd.Series, pm: pd.Series, ys: pd.Series, vs: pd.Series) -> pd.DataFrame:
    """τ² at which the score of the remaining studies falls to zero inside [low, high], and their sums there.

    table: the sums at the segment's nodes, node by node; ys, vs: what is omitted, empty lists for nothing.
    The bracket is halved until no double lies inside. Without a table (no fit) everything is null.
    """
    out = np.full((len(k), 1 + len(SUMS)), np.nan)
    live = np.flatnonzero(table.notna().to_numpy())
    if len(live):
        grid = np.stack([np.asarray(x, dtype=float) for x in table.iloc[live]]).reshape(len(live), NODES + 1, len(SUMS))
        a, b = low.to_numpy(float)[live], high.to_numpy(float)[live]
        left_y, left_v = [list(ys.iloc[i]) for i in live], [list(vs.iloc[i]) for i in live]
        size, how = k.to_numpy(float)[live], pm.to_numpy(bool)[live]

        def sums(t):
            return _at(grid, np.where(b > a, (t - a) / np.where(b > a, b - a, 1.0), 0.0)) - _omitted(left_y, left_v, t)

        down, up = a.copy(), b.copy()
        for _ in range(STEPS):
            middle = (down + up) / 2
            positive = score(sums(middle), size, how) > 0
            down, up = np.where(positive, middle, down), np.where(positive, up, middle)
        # A segment without width is the bound τ² = 0.
        t = np.where(b > a, (down + up) / 2, a)
        out[live, 0], out[live, 1:] = t, sums(t)
    frame = pd.DataFrame(out, columns=["t", *SUMS])
    return frame.astype(object).where(frame.notna(), None).astype("Float64")


def column_score(s: Column, k: Column, pm: Column) -> Column:
    """:func:`score` of a struct of sums."""
    mu = s["wy"] / s["w"]
    reml = (s["w2yy"] - 2 * mu * s["w2y"] + mu * mu * s["w2"]) - (s["w"] - s["w2"] / s["w"])
    return F.when(pm, (s["wyy"] - mu * s["wy"]) - (k - 1)).otherwise(reml)


def terms(y: Column, v: Column, t: Column) -> Column:
    """One study's contribution to the sums at τ² = t, as a struct."""
    w = F.lit(1.0) / (v + t)
    return F.struct(*[e.alias(n) for n, e in zip(SUMS, (w, w * y, w * y * y, w * w, w * w * y, w * w * y * y))])

"""Robust locally weighted smoothing of each series (Cleveland 1979), x = row index
after trimming leading zeros.

A series is one array (bounded by the calendar): the prepared series filled in place, or
one shuffle of panel rows on the series key. For rows of one length the windows and their tricube weights are the same, so
the moments of all windows of all series of a batch are five matrix products per
pass: the local lines, the residuals and the bisquare weights of the next pass
follow elementwise. (A form in higher-order functions on the JVM was right but too
slow: a run of the smoothing and ranking queries that takes about two minutes with
this form had not ended after fifteen, on a busy machine.)

Window of a fit point: the ``ns = max(2, floor(n * f))`` nearest rows, so its
bandwidth is the distance to the farthest of them. Series of over 101 rows are fitted
at every ``floor(0.01 (n - 1))``-th row and at the last, and straight in between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .describe import trimmed_arrays
from .prepare import C, D, G, TS

ROBUST = 3                 # robust passes after the first fit
SLICE = 2048               # series smoothed at a time
NEAR, FAR = 0.001, 0.999   # weights are 1 up to NEAR and 0 beyond FAR of the bandwidth


def fit_matrices(n: int, f: float) -> tuple[np.ndarray, ...]:
    """Fit points, tricube weights and offsets (point by row), and the matrix that draws
    straight lines between the points."""
    ns, step = max(2, min(n, int(n * f + 1e-7))), max(1, int(0.01 * (n - 1)))
    at = np.unique(np.r_[0:n:step, n - 1])
    left = np.clip(np.ceil((2 * at - ns + 2) / 2).astype(int) - 1, 0, n - ns)
    h = np.maximum(at - left, left + ns - 1 - at)[:, None].astype(float)
    u = np.arange(n) - at[:, None].astype(float)
    d = np.abs(u)
    k = np.where(d <= NEAR * h, 1.0, (1 - np.minimum(d / h, 1) ** 3) ** 3) * (d <= FAR * h)
    between = np.stack([np.interp(np.arange(n), at, e) for e in np.eye(len(at))], 1)
    return at, k, u, between


def smooth_rows(y: np.ndarray, f: float = 1.0 / 3.0) -> np.ndarray:
    """Smoothed rows; each row of ``y`` is a series."""
    n = y.shape[1]
    if n < 2:
        return y.copy()
    at, k, u, between = fit_matrices(n, f)
    weight, out, busy = np.ones_like(y), y.copy(), np.ones(len(y), bool)
    for robust in range(ROBUST + 1):
        w, v = weight[busy], y[busy]
        s0, s1, s2 = w @ k.T, w @ (k * u).T, w @ (k * u * u).T
        t0, t1 = (w * v) @ k.T, (w * v) @ (k * u).T
        with np.errstate(divide="ignore", invalid="ignore"):
            shift, level = s1 / s0, t0 / s0
            spread = s2 / s0 - shift ** 2
            steep = np.sqrt(np.maximum(spread, 0)) > NEAR * (n - 1)
            line = np.where(steep, level - shift * (t1 / s0 - shift * level) / spread, level)
        out[busy] = np.where(s0 > 0, line, v[:, at]) @ between.T
        if robust == ROBUST:
            break
        r = np.abs(y - out)
        m = 6 * np.median(r, axis=1, keepdims=True)
        busy = busy & (m[:, 0] >= 1e-7 * r.mean(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(r <= NEAR * m, 1.0, np.where(r <= FAR * m, (1 - (r / m) ** 2) ** 2, 0.0))
        if not busy.any():
            break
    return out


def lowess_series(p: DataFrame, f: float = 1.0 / 3.0, period: str | None = None) -> DataFrame:
    """``(group_id, ts_id, active, d, y, ys)``: one row per trimmed series."""
    x = trimmed_arrays(p, period)

    def smooth(batches):
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            t = pa.Table.from_batches([b])
            n = np.array([len(v) for v in t.column("y")], int)
            out = [None] * b.num_rows
            for size in np.unique(n).tolist():
                at = np.flatnonzero(n == size)
                y = t.column("y").take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                for i, row in zip(at.tolist(), smooth_rows(y.reshape(len(at), size), f)):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, "ys"])

    return x.mapInArrow(smooth, f"{G} string, {TS} string, active boolean, d array<date>, y array<double>, ys array<double>")


def series_points(x: DataFrame) -> DataFrame:
    """Rows ``(group_id, ts_id, active, date, count, count_smooth)`` of ``lowess_series``."""
    return x.select(G, TS, "active", F.explode(F.arrays_zip("d", "y", "ys")).alias("v")) \
        .select(G, TS, "active", F.col("v.d").alias(D), F.col("v.y").alias(C), F.col("v.ys").alias("count_smooth"))


def lowess_smooth(p: DataFrame, f: float = 1.0 / 3.0, period: str | None = None) -> DataFrame:
    """Trimmed panel rows with ``count_smooth`` per series."""
    return series_points(lowess_series(p, f, period))

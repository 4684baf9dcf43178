"""Default model: every other active series of the group as a covariate.

Counts are split per series into a base (mean and season) and a remainder x. The
remainder of series i is regressed on the remainders of *all* other series by ridge
regression, in its dual form: with K the sum of x_j x_j' over the group (buckets by
buckets), P its pre rows and columns and l = ``ridge`` * trace(P) / n,

    A = (P + l I)^-1,  a_i = A x_i / (1 - h_i),  h_i = x_i' A x_i

are the dual weights of series i against the others, by the rank-one downdate of
its own share of K (Sherman-Morrison); the coefficient of peer j is x_j' a_i. So one
matrix of the calendar's size per group and one pass over the series fit all models
on all others, at any number of series, without pairs.

* Season (12 months, 52 weeks, 7 days by position on the bucket grid): mean per season
  over the last full cycles of the pre period, less a linear trend between the
  cycles' means; it needs two full cycles, else there is none.
* Residual sd: leave-one-out residuals of the pre period, e_t = a_t / B_tt with
  B = A + A x x' A / (1 - h), over n - 1 degrees of freedom less one per season
  beyond the first.
* The cumulative effect over m post buckets has the variance sigma^2 (m + m^2 / n +
  w' w), w being the weights of the pre buckets in the summed prediction; its tail
  probability is one-sided normal.

Coefficient draws are a Bayesian bootstrap: draw b weighs the pre buckets with
exponential weights hashed from (bucket, b), which makes A_b = (P + l / w_b)^-1, and
keeps the ``MODEL_SIZE`` peers that contribute most (coefficient times the peer's
norm); all other coefficients of the draw are zero. Draws are made only for the
targets asked for, as products of blocks of targets and cuts of the series whose best
peers are merged; products in single precision only rule peers out. Draw 0 holds the strongest peers of the fit itself.

Spark partitions the series (``PART`` to a task, targets and peers of the draws in blocks, see ``impact.blocks_of``),
sums the partial matrices and merges the best peers; numpy does the products.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import SEASONS, check_period
from ..functions.columns import norm_cdf
from ..session import reuse, sized_broadcast
from .impact import (EFFECT_COLUMNS, SERIES_COLUMNS, Models, _series_columns, blocks_of, dealt, every, model_rows,
                     pre_end_table, series_arrays)
from .prepare import C, D, G, TS

RIDGE = 1.0
DRAWS = 20
MODEL_SIZE = 3         # peers of one draw
MAX_PEERS = 50         # strongest peers of the fit that are listed
PART = 2048            # series of one task
TARGETS = 256          # targets of one block, at least
HELD = 1 << 21         # cells of partial matrices a task holds
CELLS = 1 << 20        # products at a time
LANES = 64
GATHERED = 1 << 16     # products in double precision at a time

FIT = "group_id string, ts_id string, n int, d array<int>, y array<double>, pred array<double>, sigma double, ww double"


def adjusted(y: np.ndarray, n: int, season: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Remainder and base of each row (a series by bucket), and the number of seasons
    removed; ``n`` buckets are before the change."""
    cycles = n // season
    base = np.zeros_like(y)
    if cycles >= 2:
        off = n - cycles * season
        w = y[:, off:n].reshape(len(y), cycles, season)
        mean = w.mean(2)
        slope = (mean[:, -1] - mean[:, 0]) / ((cycles - 1) * season)
        dev = w.mean(1) - mean.mean(1)[:, None] - slope[:, None] * (np.arange(season) - (season - 1) / 2)
        base = dev[:, (np.arange(y.shape[1]) - off) % season]
    base = base + (y - base)[:, :n].mean(1)[:, None]
    return y - base, base, season if cycles >= 2 else 0


def draw_weights(n: int, draw: int) -> np.ndarray:
    """Exponential weights of mean 1 of the pre buckets; draw 0 has equal ones."""
    if draw == 0:
        return np.ones(n)
    v = np.arange(n, dtype=np.int64) * 7919 + draw * 104729 + 1
    for _ in range(3):
        v = v * 48271 % 2147483647
    w = -np.log(v / 2147483647)
    return w / w.mean()


def _rows(t: pa.Table, col: str) -> np.ndarray:
    return t.column(col).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def series_rows(p: DataFrame, start_date) -> DataFrame:
    """One row per active series: bucket days ``d`` and counts ``y`` in order, ``n`` pre
    buckets, and its part of the group (``parts`` in all)."""
    x = model_rows(p, start_date)
    s = reuse(series_arrays(x, F.count_if("is_pre").cast("int").alias("n")))
    parts = s.groupBy(G).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    return s.join(sized_broadcast(parts), G).withColumn("part", F.pmod(F.xxhash64(TS), F.col("parts")).cast("int"))


def group_matrices(series: DataFrame, season: int, ridge: float, draws: int) -> DataFrame:
    """``(group_id, draw, n, a, k, u)``: the inverse of each draw as bytes; K's pre
    columns and the pre weights of the summed post rows with draw 0."""
    def partial(batches):
        held: dict = {}
        cells = 0

        def out():
            for g, (n, k) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(k), pa.string()), pa.array(np.arange(len(k), dtype=np.int32)),
                     pa.array(np.full(len(k), n, np.int32)), _lists(k)], [G, "t", "n", "row"])

        # a batch of long series is taken in parts: its copies stay small
        for b in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            t = pa.Table.from_batches([b])
            for g in t.column(G).unique().to_pylist():
                some = t.filter(pa.compute.equal(t.column(G), g))
                n = some.column("n")[0].as_py()
                x = adjusted(_rows(some, "y"), n, season)[0]
                if g in held:
                    held[g][1][:] += x.T @ x
                else:
                    held[g] = (n, x.T @ x)
                    cells += x.shape[1] ** 2
                if cells > HELD:
                    yield from out()
                    held, cells = {}, 0
        yield from out()

    rows = series.select(G, "n", "y").mapInArrow(partial, f"{G} string, t int, n int, row array<double>")
    total = F.aggregate(F.slice("rows", 2, F.size("rows")), F.element_at("rows", 1),
                        lambda s, r: F.zip_with(s, r, lambda a, b: a + b))
    rows = reuse(rows.groupBy(G, "t").agg(F.first("n").alias("n"), F.collect_list("row").alias("rows"))
                 .select(G, "t", "n", total.alias("row")))

    def solve(key, t):
        t = t.sort_by("t")
        draw, n, k = key[1].as_py(), t.column("n")[0].as_py(), _rows(t, "row")
        pre = k[:n, :n]
        lam = ridge * np.trace(pre) / n if np.trace(pre) > 0 else 1.0
        a = np.linalg.inv(pre + lam * np.diag(1 / draw_weights(n, draw)))
        a = (a + a.T) / 2
        first = draw == 0
        cols = [[key[0].as_py()], [draw], [n], [a.tobytes()], [np.ascontiguousarray(k[:, :n]).tobytes() if first else None],
                [(a @ k[n:, :n].sum(0)).tobytes() if first else None]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                        [G, "draw", "n", "a", "k", "u"])

    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).groupBy(G, "draw") \
        .applyInArrow(solve, f"{G} string, draw int, n int, a binary, k binary, u binary")


def fit_series(series: DataFrame, matrices: DataFrame, season: int) -> DataFrame:
    """``FIT``: prediction by bucket, residual sd and w'w of every series."""
    parts = series.groupBy(G).agg(F.first("parts").alias("parts"))
    dealt = matrices.where("draw = 0").join(parts, G) \
        .select(G, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", "k", "u")

    def fit(key, s, m):
        if not s.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        n, y = s.column("n")[0].as_py(), _rows(s, "y")
        a, u = np.frombuffer(m.column("a")[0].as_py()).reshape(n, n), np.frombuffer(m.column("u")[0].as_py())
        k = np.frombuffer(m.column("k")[0].as_py()).reshape(-1, n)
        x, base, seasons = adjusted(y, n, season)
        own = x[:, :n]
        ax = own @ a
        h = (own * ax).sum(1)
        d = 1 - h
        pred = base + (ax @ k.T - x * h[:, None]) / d[:, None]
        left_out = ax / d[:, None] / (np.diag(a) + ax ** 2 / d[:, None])
        free = n - 1 - max(seasons - 1, 0)
        sigma = np.sqrt((left_out ** 2).sum(1) / free) if free > 0 else np.full(len(y), np.nan)
        post = x[:, n:].sum(1)
        w = u - post[:, None] * ax + ax * ((own @ u - post * h) / d)[:, None]
        out = [s.column(G), s.column(TS), s.column("n"), s.column("d"), s.column("y"), _lists(pred),
               pa.array(sigma, from_pandas=True), pa.array((w ** 2).sum(1))]
        return pa.table([c.cast(t) for c, t in zip(out, types)], names)

    names = [G, TS, "n", "d", "y", "pred", "sigma", "ww"]
    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()),
             pa.float64(), pa.float64()]
    return series.select(G, TS, "n", "d", "y", "part").groupBy(G, "part").cogroup(dealt.groupBy(G, "part")).applyInArrow(fit, FIT)


def strongest(alpha: np.ndarray, x: np.ndarray, norm: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(i, j, coef, score)``: for every row i of ``alpha`` the ``k`` rows j of ``x`` of largest
    score ``|alpha_i x_j'| norm_j``, ties by j; ``own`` is the row to leave out (or -1).

    Products in single precision, of rows scaled to scores of at most 1, rule out all rows
    that miss a lower bound of the k-th score (the k-th of the maxima of disjoint sets
    of rows) by more than twice their error bound; the rest are computed in double
    precision."""
    n, found = x.shape[1], []
    lanes = max(1, min(LANES, len(x) // max(256, 8 * k)))     # rows of x that share one maximum
    width = -(-len(x) // lanes)
    z = np.zeros((width * lanes, n))
    z[:len(x)] = x * (norm / max((norm * norm).max(), 1e-300))[:, None]
    scaled = z.T.astype(np.float32)
    unit = (alpha / np.maximum(np.sqrt((alpha * alpha).sum(1)), 1e-300)[:, None]).astype(np.float32)
    slack = 2 * (n + 8) * np.finfo(np.float32).eps
    step = max(1, CELLS // len(z))

    def keep(i, j, coef):
        score = np.abs(coef) * norm[j]
        order = np.lexsort((j, -score, i))
        i, j, coef, score = i[order], j[order], coef[order], score[order]
        first = np.r_[True, i[1:] != i[:-1]]
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
        found.append(tuple(v[place < k] for v in (i, j, coef, score)))

    for at in range(0, len(alpha), step):
        score = unit[at:at + step] @ scaled
        np.abs(score, out=score)
        me = own[at:at + step]
        score[np.flatnonzero(me >= 0), me[me >= 0]] = -1
        score[:, len(x):] = -1
        score = score.reshape(len(score), lanes, width)
        top = score.max(1)                                      # of rows j, j + width, ...
        floor = np.partition(top, width - k, axis=1)[:, width - k] - slack if k < width else np.zeros(len(top))
        floor = np.maximum(floor, 0)
        i, g = np.nonzero(top >= floor[:, None])
        for piece in range(0, len(i), GATHERED // lanes + 1):
            # whole rows only: a piece ends where its last row does
            ends = [np.searchsorted(i, i[p]) if p < len(i) else len(i) for p in (piece, piece + GATHERED // lanes + 1)]
            r, c = i[slice(*ends)], g[slice(*ends)]
            if not len(r):
                continue
            e, lane = np.nonzero(score[r, :, c] >= floor[r][:, None])
            r, j = r[e], lane * width + c[e]
            if len(r) <= 4 * GATHERED:
                keep(r + at, j, np.einsum("ij,ij->i", alpha[r + at], x[j]))
                continue
            for row in np.unique(r).tolist():
                own_j = j[r == row]
                keep(np.full(len(own_j), at + row), own_j, x[own_j] @ alpha[at + row])
    empty = (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0))
    return tuple(np.concatenate(v) for v in zip(empty, *found))


def peer_draws(series: DataFrame, matrices: DataFrame, targets: DataFrame, season: int, draws: int,
               max_peers: int | None = MAX_PEERS) -> DataFrame:
    """``(group_id, ts_id, draw, peer_ts_id, coef)`` for ``targets(group_id, ts_id)``: the
    ``max_peers`` strongest peers of the fit (all for None, 0 for no draw 0) as draw 0, and
    the non-zero coefficients of the draws.

    One task has a block of targets, a cut of the series and the inverses; the weights
    of the targets are made there, so that only counts travel."""
    t = reuse(series.join(targets.select(G, TS), [G, TS], "left_semi").select(G, TS, "n", "y"))
    wide = sized_broadcast(blocks_of(series, t, TARGETS, PART))
    none = [F.lit(None).cast(k).alias(c) for c, k in (("draw", "int"), ("a", "binary"))]
    left = t.join(wide, G).select(G, dealt(TS, "blocks").alias("block"), every("cuts").alias("cut"), TS, "n", "y", *none)
    made = matrices.where("draw > 0") if max_peers == 0 else matrices
    inverses = made.join(wide, G).select(G, "draw", "a", "n", "cuts", every("blocks").alias("block"))
    left = left.unionByName(inverses.select(
        G, "block", every("cuts").alias("cut"), F.lit(None).cast("string").alias(TS), "n",
        F.lit(None).cast("array<double>").alias("y"), "draw", "a"))
    left = left.toDF(*left.columns)         # column ids of its own: both sides derive from the series
    right = series.join(wide, G).select(G, every("blocks").alias("block"), dealt(TS, "cuts").alias("cut"),
                                        F.col(TS).alias("peer_ts_id"), "n", "y")

    def products(key, l, s):
        out = [pa.table([pa.array([], x) for x in ptypes], pnames)]
        m = l.filter(pa.compute.is_valid(l.column("a"))).sort_by("draw")
        l = l.filter(pa.compute.is_valid(l.column(TS)))
        if not l.num_rows or not s.num_rows:
            return out[0]
        s = s.sort_by("peer_ts_id")
        n = s.column("n")[0].as_py()
        x, own = (np.ascontiguousarray(adjusted(_rows(v, "y"), n, season)[0][:, :n]) for v in (s, l))
        norm, peer = np.sqrt((x * x).sum(1)), s.column("peer_ts_id").combine_chunks()
        target = l.column(TS).combine_chunks()
        at = pa.compute.fill_null(pa.compute.index_in(target, peer), -1).to_numpy(zero_copy_only=False)
        for draw, a in zip(m.column("draw").to_pylist(), m.column("a").to_pylist()):
            ax = own @ np.frombuffer(a).reshape(n, n)
            # 1 - x' A_b x: what is left of the series without its own share
            alpha = ax / (1 - (own * ax).sum(1))[:, None]
            k = MODEL_SIZE if draw else len(peer) if max_peers is None else max_peers
            i, j, coef, score = strongest(alpha, x, norm, at, k)
            if draw:
                i, j, coef, score = (v[score > 0] for v in (i, j, coef, score))
            out.append(pa.table([pa.array([key[0].as_py()] * len(i), pa.string()), target.take(pa.array(i)),
                                 pa.array(np.full(len(i), draw, np.int32)), peer.take(pa.array(j)),
                                 pa.array(coef), pa.array(score)], pnames))
        return pa.concat_tables(out)

    pnames = [G, TS, "draw", "peer_ts_id", "coef", "score"]
    ptypes = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
    found = left.groupBy(G, "block", "cut").cogroup(right.groupBy(G, "block", "cut")) \
        .applyInArrow(products, f"{G} string, {TS} string, draw int, peer_ts_id string, coef double, score double")
    rank = F.row_number().over(Window.partitionBy(G, TS, "draw").orderBy(F.desc("score"), "peer_ts_id"))
    most = F.when(F.col("draw") > 0, F.lit(MODEL_SIZE))
    kept = found.withColumn("rank", rank).where(most.isNull() | (F.col("rank") <= most))
    if max_peers is not None:
        kept = kept.where((F.col("draw") > 0) | (F.col("rank") <= max_peers))
    return kept.select(G, TS, "draw", "peer_ts_id", "coef")


def ridge_models(p: DataFrame, start_date, alpha: float = 0.05, period: str = "month", ridge: float = RIDGE,
                 draws: int = DRAWS, max_peers: int | None = MAX_PEERS) -> Models:
    """Models of all active series; ``coefs`` holds the draws of the deviating ones."""
    z = NormalDist().inv_cdf(1.0 - alpha / 2.0)
    season = SEASONS[check_period(period)]
    rows = reuse(series_rows(p, start_date))
    matrices = reuse(group_matrices(rows, season, ridge, draws))
    fits = reuse(fit_series(rows, matrices, season))
    x = fits.select(G, TS, "n", "sigma", "ww", F.posexplode(F.arrays_zip("d", "y", "pred")).alias("t", "v"))
    x = x.select(G, TS, F.date_from_unix_date("v.d").alias(D), F.col("v.y").alias("response"),
                 F.col("v.pred").alias("point_pred"), "sigma", "n", "ww", (F.col("t") < F.col("n")).alias("is_pre"))
    series = _series_columns(x, z).select(G, TS, D, *SERIES_COLUMNS)
    r = F.col("response") - F.col("point_pred")
    post = x.where(~F.col("is_pre")).groupBy(G, TS).agg(
        F.avg(r).alias("AbsEffect_Average"), F.avg("point_pred").alias("_pa"), F.sum(r).alias("AbsEffect_Cumulative"),
        F.sum("point_pred").alias("_ps"), F.count("*").cast("double").alias("_m"),
        *[F.first(c).alias(c) for c in ("sigma", "n", "ww")])
    m = F.col("_m")
    sd = F.col("sigma") * F.sqrt(m + m * m / F.col("n") + F.col("ww"))
    eff = (post.withColumn("RelEffect_Average", F.try_divide("AbsEffect_Average", "_pa"))
           .withColumn("RelEffect_Cumulative", F.try_divide("AbsEffect_Cumulative", "_ps"))
           .withColumn("p_Cumulative", F.when(F.col("sigma") > 0, 1.0 - norm_cdf(
               F.abs(F.try_divide(F.col("AbsEffect_Cumulative"), sd)))))
           .withColumn("p_Average", F.col("p_Cumulative")))
    effects = reuse(eff.select(G, TS, *EFFECT_COLUMNS))

    def peers(targets: DataFrame, most: int | None = max_peers) -> DataFrame:
        return peer_draws(rows, matrices, targets, season, draws, most)

    values = rows.select(G, F.col(TS).alias("peer_ts_id"), "d", "y")
    deviating = effects.where((F.col("p_Cumulative") < alpha) & (F.col("AbsEffect_Cumulative") != 0))
    return Models(effects, series, peers(deviating), pre_end_table(p, start_date, period), alpha, draws, values, peers)

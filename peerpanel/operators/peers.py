"""Peer design for the per-series models, without forming all pairs.

The reference regresses every series on *all* other active series of its
group, an O(N^2 T) blow-up. Here each target gets

* up to ``max_peers`` individual peers: the series next to it in the
  group's order by pre-period mean count (ties by id) - a contiguous
  window of positions, taken over blocks of positions, so the work is O(N k T),
  a series travels about once and no key is hot;
* one ``(others)`` covariate: the sum of every remaining active series,
  ``group total - target - individual peers``; no series is left out.

With ``N - 1 <= max_peers`` the peers are exactly all other series (the
reference's design) and ``(others)`` is empty and dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..session import sized_broadcast
from .impact import series_arrays
from .prepare import C, D, G, TS, start_param, with_group_params

OTHERS = "(others)"
TARGET = "target"
BLOCK = 1024           # positions of one block


def series_order(rows: DataFrame) -> DataFrame:
    """Position of every active series in its group by pre-period mean
    (ties by id), dealt by range: a group's series, or all those of one mean,
    never meet in one task."""
    s = rows.groupBy(G, TS).agg(F.avg(F.when(F.col("is_pre"), F.col(C))).alias("_pre_mean"))
    s = s.withColumn("_pm", F.coalesce("_pre_mean", F.lit(float("inf"))))
    o = positions(s, [G], ["_pm", TS], "pos")
    n = o.groupBy(G).agg(F.max("pos").cast("int").alias("n_series"))
    return o.join(sized_broadcast(n), G).select(G, TS, F.col("pos").cast("int"), "n_series")


def peer_windows(order: DataFrame, max_peers: int, *values: str) -> DataFrame:
    """``order`` plus ``peers``: an array of ``(peer_pos, peer_ts_id, *values)`` of the window of
    ``max_peers`` positions around each series (clamped at the ends), its own place left out.

    Positions are dealt in blocks of ``BLOCK``, and each block also gets the ``max_peers`` series
    before and after it, so a series travels about once, not once per peer."""
    k = int(max_peers)
    block = F.floor((F.col("pos") - 1) / BLOCK)
    near = F.sequence(F.greatest(F.floor((F.col("pos") - 1 - k) / BLOCK), F.lit(0).cast("long")),
                      F.least(F.floor((F.col("pos") - 1 + k) / BLOCK), F.floor((F.col("n_series") - 1) / BLOCK)))
    x = order.withColumn("_own", block).withColumn("_block", F.explode(near))
    w = Window.partitionBy(G, "_block").orderBy("pos").rowsBetween(-k, k)
    near = F.collect_list(F.struct(F.col("pos").alias("peer_pos"), F.col(TS).alias("peer_ts_id"), *values)).over(w)
    x = x.withColumn("peers", near).where("_own = _block").drop("_own", "_block")
    start = F.greatest(F.lit(1), F.least(F.col("pos") - k // 2, F.col("n_series") - k))
    end = F.least(F.col("n_series"), start + k)
    return x.withColumn("peers", F.filter("peers", lambda p: p["peer_pos"].between(start, end) & (p["peer_pos"] != F.col("pos"))))


def select_peers(rows: DataFrame, max_peers: int = 50, order: DataFrame | None = None) -> DataFrame:
    """``(group_id, ts_id, peer_ts_id, peer_pos)``: the window of
    ``max_peers`` positions around each target (clamped at the ends)."""
    o = order if order is not None else series_order(rows)
    return peer_windows(o, max_peers).select(G, TS, F.explode("peers").alias("p")).select(
        G, TS, "p.peer_ts_id", F.col("p.peer_pos").cast("long").alias("peer_pos"))


def active_rows(p: DataFrame, start_date) -> DataFrame:
    x = with_group_params(p.where(F.col("active")).select(G, TS, D, C), start_param(start_date))
    return x.withColumn("is_pre", F.col(D) <= F.col("start_date")).drop("start_date")


def peer_design(p: DataFrame, start_date, max_peers: int = 50) -> DataFrame:
    """Long model input ``(group_id, ts_id, date, is_pre, peer_ts_id,
    peer_pos, value, tpos)``: the target's own values (``peer_ts_id =
    'target'``, position 0), its individual peers, and ``(others)``
    (position -1); ``tpos`` is the target's position in its group."""
    rows = active_rows(p, start_date)
    # one row per series, its buckets as arrays: windows of peers move series, not dates
    order = series_order(rows).join(series_arrays(rows, F.count_if("is_pre").cast("int").alias("_pre")), [G, TS])
    tot = rows.groupBy(G, D).agg(F.sum(C).alias("_tot"))
    tot = sized_broadcast(tot.groupBy(G).agg(F.array_sort(F.collect_list(F.struct(F.unix_date(D).alias("d"), "_tot")))["_tot"].alias("tot")))
    x = peer_windows(order, max_peers, "y").join(tot, G)
    add = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
    psum = F.aggregate("peers", F.transform("y", lambda v: F.lit(0.0)), lambda s, q: add(s, q["y"]))
    others = F.zip_with(F.zip_with("tot", "y", lambda u, v: u - v), psum, lambda u, v: u - v)
    series = lambda name, pos, y: F.struct(name.alias("peer_ts_id"), pos.cast("int").alias("peer_pos"), y.alias("y"))
    every = F.concat(F.array(series(F.lit(TARGET), F.lit(0), F.col("y")), series(F.lit(OTHERS), F.lit(-1), others)),
                     F.transform("peers", lambda q: series(q["peer_ts_id"], q["peer_pos"], q["y"])))
    x = x.select(G, TS, "pos", "_pre", "d", F.explode(every).alias("q"))
    x = x.select(G, TS, "pos", "_pre", "q.peer_ts_id", "q.peer_pos", F.posexplode(F.arrays_zip("d", "q.y")).alias("t", "v"))
    return x.select(G, TS, F.date_from_unix_date("v.d").alias(D), (F.col("t") < F.col("_pre")).alias("is_pre"),
                    "peer_ts_id", "peer_pos", F.col("v.y").alias("value"), F.col("pos").alias("tpos"))

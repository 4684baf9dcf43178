"""Report tables over the model tables: summary and deviance classes,
per-date classes, series with their model output, peer contributions and
the before/after rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..functions.ranking import avg_ranks, pct_ranks
from ..session import compute_partitions, reuse, sized_broadcast
from .impact import EFFECT_COLUMNS, SERIES_COLUMNS, Models, deal, dealt, every
from .prepare import C, D, G, TS, with_group_params


def model_summary(m: Models) -> DataFrame:
    """Effects plus ``deviance``: over / under when the cumulative effect is
    positive / negative with ``p_Cumulative < alpha``, else average (NULLs
    fall through to average). Sort by ``p_Cumulative`` at the sink."""
    a = F.lit(float(m.alpha))
    eff, p = F.col("AbsEffect_Cumulative"), F.col("p_Cumulative")
    dev = (F.when((eff > 0) & (p < a), "over").when((eff < 0) & (p < a), "under")
           .otherwise("average"))
    return m.effects.select(G, TS, *EFFECT_COLUMNS, dev.alias("deviance"))


def deviance_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy(G, "deviance").agg(F.count(F.lit(1)).alias("timeseries"))


def point_perf(series: DataFrame) -> DataFrame:
    lo, hi = F.col("point_effect_lower"), F.col("point_effect_upper")
    return series.withColumn("point_perf", F.when(lo > 0, "over").when(hi < 0, "under")
                             .otherwise("average"))


def model_summary_timeseries(m: Models) -> DataFrame:
    """Series per (date, group, point class) from the last pre bucket on."""
    s = with_group_params(point_perf(m.series), m.pre_end).where(F.col(D) >= F.col("pre_end"))
    return s.groupBy(D, G, "point_perf").agg(F.count(F.lit(1)).alias("timeseries"))


def model_group_timeseries(m: Models, summary: DataFrame | None = None) -> DataFrame:
    """Every modelled series with its p value and model output by date."""
    summary = summary if summary is not None else model_summary(m)
    return (summary.select(G, TS, "p_Cumulative")
            .join(m.series, [G, TS]).select(G, TS, "p_Cumulative", D, *SERIES_COLUMNS))


def deviance_mean_sd(m: Models, summary: DataFrame | None = None) -> DataFrame:
    """Mean and sample sd of the response per (date, deviance class)."""
    summary = summary if summary is not None else model_summary(m)
    x = m.series.select(G, TS, D, F.col("response").alias(C)).join(
        summary.select(G, TS, "deviance"), [G, TS], "left")
    return x.groupBy(G, D, "deviance").agg(F.avg(C).alias("count_mean"),
                                           F.stddev_samp(C).alias("count_sd"))


# ------------------------------------------------------------------ peers

def peer_coef_stats(coefs: DataFrame, niter: int, burn_fraction: float = 0.1) -> DataFrame:
    """Per (target, peer) over the kept draws (``draw > floor(niter *
    burn_fraction)``). Draws may be stored sparsely (non-zero only):
    ``inclusion_prob`` = share of kept draws with a non-zero coefficient,
    ``coef`` = mean of the non-zero draws (NULL if none),
    ``positive_prob`` = (that mean > 0) as 0/1 - the reference computes it
    from the already-averaged coefficient - ``positive_share`` = the real
    share of positive draws, ``sign`` = 1 / -1 (NULL with no draws)."""
    burn = int(niter * burn_fraction)
    kept = float(niter - burn)
    c = coefs.where(F.col("draw") > burn)
    st = c.groupBy(G, TS, "peer_ts_id").agg(
        (F.count_if(F.col("coef") != 0) / kept).alias("inclusion_prob"),
        F.avg(F.when(F.col("coef") != 0, F.col("coef"))).alias("coef"),
        (F.count_if(F.col("coef") > 0) / kept).alias("positive_share"))
    return _with_sign(st)


def _with_sign(st: DataFrame) -> DataFrame:
    st = st.withColumn("positive_prob", F.when(F.col("coef").isNotNull(),
                                               F.when(F.col("coef") > 0, 1.0).otherwise(0.0)))
    return st.withColumn("sign", F.when(F.col("positive_prob").isNotNull(),
                                        F.when(F.col("positive_prob") > 0.5, 1.0).otherwise(-1.0)))


def peer_contributions(m: Models, summary: DataFrame | None = None,
                       burn_fraction: float = 0.1, deviating_only: bool = True,
                       all_peers: bool = False, digits: int | None = None) -> DataFrame:
    """Peer table for every deviating series (over/under): each peer's
    counts by date, multiplied by the mean non-zero coefficient of the draws where
    there is one, plus the target's standardised response (``ts_id = 'target'``,
    inclusion 1). ``inclusion_rank`` = dense rank of ``-inclusion_prob`` per target.
    Peers are the strongest ones of the fit and all that any draw holds, or with
    ``all_peers`` every other series; rows are not filtered by rank (see
    ``peer_plot_rows``). ``digits`` rounds the doubles."""
    summary = summary if summary is not None else model_summary(m)
    targets = summary.select(G, TS, "deviance")
    if deviating_only:
        targets = targets.where(F.col("deviance") != "average")
    targets = reuse(targets.select(G, TS))
    if all_peers:
        # all are listed anyway: the strongest peers of the fit need not be named
        coefs = reuse(m.peers(targets, 0))
    elif not deviating_only:
        coefs = reuse(m.peers(targets))
    else:
        coefs = reuse(m.coefs.join(targets, [G, TS], "left_semi"))
    stats = peer_coef_stats(coefs, m.niter, burn_fraction)
    if all_peers:
        stats = stats.where("inclusion_prob > 0").select(G, TS, "peer_ts_id", *PAIR_COLUMNS)
    else:
        stats = coefs.select(G, TS, "peer_ts_id").distinct().join(stats, [G, TS, "peer_ts_id"], "left").select(
            G, TS, "peer_ts_id", F.coalesce("inclusion_prob", F.lit(0.0)).alias("inclusion_prob"), "coef",
            F.coalesce("positive_share", F.lit(0.0)).alias("positive_share"), "positive_prob", "sign")
    # one row per pair, and one without a peer for the target itself, is all that is
    # ranked and stored; dates come last, from the arrays of the series
    me = targets.select(G, TS, *[F.lit(v).cast(t).alias(c) for c, t, v in (
        ("peer_ts_id", "string", None), ("inclusion_prob", "double", 1.0),
        *[(c, "double", None) for c in PAIR_COLUMNS[1:]])])
    ranked = reuse(stats.unionByName(me).withColumn("inclusion_rank", F.dense_rank().over(
        Window.partitionBy(G, TS).orderBy(F.col("inclusion_prob").desc()))))
    pairs = ranked.where("peer_ts_id IS NOT NULL").join(m.design, [G, "peer_ts_id"])
    pairs = pairs.withColumn("scale", F.coalesce("coef", F.lit(1.0))).withColumn("shift", F.lit(0.0))
    y, n = F.col("y"), F.size("y")
    mean = F.aggregate(y, F.lit(0.0), lambda s, v: s + v) / n
    sd = F.when(n > 1, F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + (v - F.col("shift")) * (v - F.col("shift"))) / (n - 1)))
    own = ranked.where("peer_ts_id IS NULL").drop("peer_ts_id").join(
        m.design.withColumnRenamed("peer_ts_id", TS), [G, TS]).withColumn("peer_ts_id", F.lit("target"))
    own = own.withColumn("shift", mean).withColumn("scale", F.try_divide(F.lit(1.0), sd))
    columns = [G, TS, "peer_ts_id", *PAIR_COLUMNS, "inclusion_rank", "scale", "shift"]
    rows = pairs.select(*columns, "d", "y").unionByName(own.select(*columns, "d", "y")) \
        .select(*columns, F.explode(F.arrays_zip("d", "y")).alias("v"))
    rows = rows.select(G, F.col(TS).alias("target_ts_id"), F.date_from_unix_date("v.d").alias(D), F.col("peer_ts_id").alias(TS),
                       ((F.col("v.y") - F.col("shift")) * F.col("scale")).alias("scaled_count"), *PAIR_COLUMNS, "inclusion_rank")
    rows = rows if digits is None else round_doubles(rows, digits)
    return _undrawn_rows(ranked, m.design, digits).unionByName(rows) if all_peers else rows


PAIR_COLUMNS = ("inclusion_prob", "coef", "positive_share", "positive_prob", "sign")
TOGETHER = 64          # targets whose rows of one peer are made together


def _undrawn_rows(ranked: DataFrame, design: DataFrame, digits: int | None) -> DataFrame:
    """Rows of every target with all other series that none of its draws holds: their counts as
    they are, and the rank after the last inclusion. ``ranked`` has the pairs with a draw.

    A series travels once, with the few targets to leave out; the targets travel once per cut
    of the series, as ids in lists of equal rank. A peer's rows go by list, date and target, so
    that all values but the target's id come in long runs, and are rounded before they are
    repeated."""
    parts = compute_partitions(ranked.sparkSession)
    t = ranked.groupBy(G, TS).agg((F.max("inclusion_rank") + 1).alias("inclusion_rank"))
    lists = t.groupBy(G, "inclusion_rank").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("lists"))
    t = t.join(sized_broadcast(lists), [G, "inclusion_rank"]).groupBy(G, "inclusion_rank", dealt(TS, "lists").alias("list")) \
        .agg(F.sort_array(F.collect_list(TS)).alias("targets"))
    cuts = sized_broadcast(design.groupBy(G).agg(deal(F.count("*"), 64, F.lit(2048), 128).alias("cuts")))
    t = t.join(cuts, G).select(G, "inclusion_rank", "targets", every("cuts").alias("cut")).repartition(parts, G, "cut")
    drawn = ranked.where("peer_ts_id IS NOT NULL").groupBy(G, "peer_ts_id").agg(F.collect_list(TS).alias("drawn"))
    y = F.col("y") if digits is None else F.transform("y", lambda v: F.round(v, digits))
    s = design.join(drawn, [G, "peer_ts_id"], "left").join(cuts, G).select(
        G, "peer_ts_id", "d", y.alias("y"), dealt("peer_ts_id", "cuts").alias("cut"),
        F.concat(F.coalesce("drawn", F.array().cast("array<string>")), F.array("peer_ts_id")).alias("without"))
    # a merge join hands on one list at a time: rows are not held for all lists of a series
    x = s.repartition(parts, G, "cut").join(t.hint("merge"), [G, "cut"]).select(
        G, "peer_ts_id", "d", "y", "inclusion_rank", F.array_except("targets", "without").alias("targets"))
    x = x.select(G, "peer_ts_id", "inclusion_rank", "targets", F.explode(F.arrays_zip("d", "y")).alias("v"))
    x = x.select(G, "peer_ts_id", "inclusion_rank", "targets", F.date_from_unix_date("v.d").alias(D), F.col("v.y").alias("scaled_count"))
    values = {c: 0.0 if c in ("inclusion_prob", "positive_share") else None for c in PAIR_COLUMNS}
    x = x.select(G, D, "peer_ts_id", "scaled_count", "inclusion_rank", F.explode("targets").alias("target_ts_id"))
    return x.select(G, "target_ts_id", D, F.col("peer_ts_id").alias(TS), "scaled_count",
                    *[F.lit(v).cast("double").alias(c) for c, v in values.items()], "inclusion_rank")


def peer_plot_rows(contrib: DataFrame, max_peers: int = 10, inclusion_thresh: float = 0.01):
    """Plot subset: top ``max_peers`` inclusion ranks above the threshold,
    with ``type`` (target / peers) and ``alpha``, the line weight: the
    standardised inclusion probability (1 for the target) per target."""
    sub = contrib.where(F.col("inclusion_rank").between(1, max_peers)
                        & (F.col("inclusion_prob") > inclusion_thresh))
    is_t = F.col(TS) == "target"
    sub = sub.withColumn("type", F.when(is_t, "target").otherwise("peers"))
    weight = F.when(is_t, F.lit(1.0)).otherwise(F.col("inclusion_prob"))
    # mean and sd come from an aggregate of the targets: the dated rows pass no window
    per = sub.groupBy(G, "target_ts_id").agg(F.avg(weight).alias("_mean"), F.stddev_samp(weight).alias("_sd"))
    return sub.join(sized_broadcast(per), [G, "target_ts_id"]).withColumn(
        "alpha", F.try_divide(weight - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


# ---------------------------------------------------------------- ranking

RANK_COLUMNS = ("count_mean_pctile_rank", "count_mean_rank", "count_smooth_rank",
                "count_smooth_pctile_rank", "model_rank")


def pre_post_stats(p: DataFrame, pre_end: DataFrame, smoothed: DataFrame | None = None) -> DataFrame:
    """Per (series, period) with the strict rule ``date < pre_end -> pre``:
    ``count_mean``, ``count_smooth`` (pre: last smoothed value; post: the
    second, NULL if there is none), ``num_periods`` and their within-period
    percent ranks. Leading zeros are trimmed; inactive series included."""
    from .lowess import lowess_series
    x = with_group_params(smoothed if smoothed is not None else lowess_series(p), pre_end)
    k = F.size(F.filter("d", lambda d: d < F.col("pre_end")))
    n = F.size("d")

    def stats(period, first, rows, smooth):
        total = F.aggregate(F.slice("y", first + 1, rows), F.lit(0.0), lambda s, v: s + v)
        return F.struct(F.lit(period).alias("period"), F.try_divide(total, rows).alias("count_mean"),
                        F.get("ys", smooth).alias("count_smooth"), rows.cast("long").alias("num_periods"))

    st = x.select(G, TS, F.explode(F.array(stats("pre", F.lit(0), k, k - 1), stats("post", k, n - k, k + 1))).alias("s"))
    st = st.select(G, TS, "s.*").where("num_periods > 0")
    part = [G, "period"]
    # exact percent ranks per (group, period) without a one-task sort of
    # all series of a group (see functions/ranking.py)
    st = reuse(st)
    return pct_ranks(st, part, [("count_mean", "count_mean_pctile"),
                                ("count_smooth", "count_smooth_pctile"),
                                ("num_periods", "periods_pctile")])


def model_ts_rank(m: Models, p: DataFrame, summary: DataFrame | None = None,
                  smoothed: DataFrame | None = None) -> DataFrame:
    """Rows ``(group_id, ts_id, date, count, 5 ranks)`` of every series with
    a pre period: ranks (ties averaged, 1 = largest change) of |post - pre|
    of mean count, mean-count percentile, smoothed count and its
    percentile; ``model_rank`` = rank of ``p_Cumulative`` (NULL for series
    without a model)."""
    from .lowess import lowess_series, series_points
    summary = summary if summary is not None else model_summary(m)
    # several branches read the smoothed series: one row each, smoothed once
    sm = smoothed if smoothed is not None else reuse(lowess_series(p))
    st = pre_post_stats(p, m.pre_end, sm)
    vals = ("count_mean", "count_smooth", "num_periods", "count_mean_pctile", "count_smooth_pctile")
    wide = st.groupBy(G, TS).agg(*[
        F.first(F.when(F.col("period") == per, F.col(v)), ignorenulls=True).alias(f"{v}_{per}")
        for v in vals for per in ("pre", "post")])
    metrics = ("count_mean_pctile", "count_mean", "count_smooth", "count_smooth_pctile")
    wide = wide.where(F.col("num_periods_pre") > 0).select(G, TS, F.lit(True).alias("ranked"), *[
        F.abs(F.col(f"{c}_post") - F.col(f"{c}_pre")).alias(f"_a_{c}") for c in metrics])
    # a model's rank counts among all models, also those of series without a pre period
    every = reuse(wide.join(summary.select(G, TS, "p_Cumulative"), [G, TS], "full"))
    ranks = avg_ranks(every, [TS], [G], [(f"_a_{c}", f"{c}_rank", True) for c in metrics]
                      + [("p_Cumulative", "model_rank", False)]).where("ranked").select(G, TS, *RANK_COLUMNS)
    return series_points(sm).select(G, TS, D, C).join(ranks, [G, TS]).select(G, TS, D, C, *RANK_COLUMNS)


# fixed order of the parts of a title
TITLE = ("model_rank", "count_mean_rank", "count_mean_pctile_rank", "count_smooth_rank", "count_smooth_pctile_rank")


def rank_title() -> Column:
    """First five characters of the id and the five ranks; NA where NULL."""
    shown = [F.coalesce(F.regexp_replace(F.col(r).cast("decimal(20,1)").cast("string"), "[.]0$", ""), F.lit("NA"))
             for r in TITLE]
    return F.concat_ws(" ", F.substring(F.col(TS), 1, 5), *shown)


def model_ts_rank_top(ranked: DataFrame, top_timeseries: int = 5) -> DataFrame:
    """Rows of series with any of the five ranks within ``top_timeseries``,
    with their plot ``title``."""
    cond = None
    for r in RANK_COLUMNS:
        c = F.coalesce(F.col(r) <= top_timeseries, F.lit(False))
        cond = c if cond is None else (cond | c)
    return ranked.where(cond).withColumn("title", rank_title())

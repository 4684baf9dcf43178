"""Per-series counterfactual models and the model tables.

Every method returns a :class:`Models` with three flat tables:

* ``effects(group_id, ts_id, AbsEffect_Average, RelEffect_Average,
  AbsEffect_Cumulative, RelEffect_Cumulative, p_Cumulative, p_Average)``
* ``series(group_id, ts_id, date, response, cum_response, point_pred{,_lower,_upper},
  cum_pred{..}, point_effect{..}, cum_effect{..})``
* ``coefs(group_id, ts_id, draw, peer_ts_id, coef)`` of the deviating series (empty for
  ``ratio``)

plus ``pre_end`` (per group, the last bucket on or before the start
date: the report tables' start date), ``alpha``, the number of draws, the peers'
counts ``design(group_id, peer_ts_id, d, y)`` (days and counts as arrays) and ``peers``, which makes the
``coefs`` of other targets.

``method="ratio"``: deterministic leave-one-out peer model, pure
DataFrame. The peer signal of series i is the mean of all *other* active
series of its group, ``(total_t - y_it) / (N - 1)`` - exact "all others"
without forming pairs. It is scaled by the pre-period ratio of sums;
the residual sd of the pre period gives normal intervals and a one-sided
tail probability for the cumulative post effect.

``method="ridge"`` (default): ridge regression on all other series, with
seasons, in closed form (see ``ridge.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_cdf
from ..session import reuse, sized_broadcast
from .prepare import C, D, G, TS, start_param, with_group_params

EFFECT_COLUMNS = ("AbsEffect_Average", "RelEffect_Average", "AbsEffect_Cumulative",
                  "RelEffect_Cumulative", "p_Cumulative", "p_Average")
SERIES_COLUMNS = ("response", "cum_response",
                  "point_pred", "point_pred_lower", "point_pred_upper",
                  "cum_pred", "cum_pred_lower", "cum_pred_upper",
                  "point_effect", "point_effect_lower", "point_effect_upper",
                  "cum_effect", "cum_effect_lower", "cum_effect_upper")
BLOCK = 4096           # targets of one block of products, at most
CUT = 16384            # series of one cut, at most
CUT_CELLS = 1 << 21    # and their counts
COEF_SCHEMA = "group_id string, ts_id string, draw int, peer_ts_id string, coef double"


@dataclass
class Models:
    effects: DataFrame
    series: DataFrame
    coefs: DataFrame
    pre_end: object  # {"pre_end": date} or DataFrame(group_id, pre_end)
    alpha: float
    niter: int = 0
    design: DataFrame | None = None
    peers: Callable[..., DataFrame] | None = None


def model_rows(p: DataFrame, start_date) -> DataFrame:
    """Active series only, with the pre/post flag (``date <= start``) and
    the per-group last pre bucket ``pre_end``."""
    x = with_group_params(p.where(F.col("active")).drop("active"), start_param(start_date))
    x = x.withColumn("is_pre", F.col(D) <= F.col("start_date"))
    return x


def series_arrays(x: DataFrame, *more) -> DataFrame:
    """One row per series: its bucket days ``d`` and counts ``y`` in order, and the
    aggregates ``more``."""
    r = x.groupBy(G, TS).agg(F.array_sort(F.collect_list(F.struct(F.unix_date(D).alias("d"), F.col(C).alias("y")))).alias("r"), *more)
    return r.select("*", F.col("r.d").alias("d"), F.col("r.y").alias("y")).drop("r")


def deal(n, least: int, most, tasks: int):
    """Blocks into which ``n`` rows are dealt: ``tasks`` of them, of ``least`` to ``most`` rows."""
    return F.ceil(n / F.least(most, F.greatest(F.lit(least), F.ceil(n / tasks)))).cast("int")


def blocks_of(series: DataFrame, targets: DataFrame, least: int = 256, least_cut: int = 2048) -> DataFrame:
    """``(group_id, blocks, cuts)``: the blocks of targets and the cuts of series whose
    products are one task each. Both grow to a fixed size, by which the rows that
    travel (series times blocks and targets times cuts) stay few."""
    most = F.greatest(F.lit(256), F.least(F.lit(CUT), F.floor(F.lit(CUT_CELLS) / F.col("_t"))))
    n = series.groupBy(G).agg(F.count("*").alias("_n"), F.max(F.size("y")).alias("_t"))
    t = targets.groupBy(G).agg(F.count("*").alias("_k"))
    return reuse(t.join(n, G).select(G, deal(F.col("_k"), least, F.least(F.lit(BLOCK), most), 4).alias("blocks"),
                                     deal(F.col("_n"), least_cut, most, 16).alias("cuts")))


def every(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def dealt(key: str, n: str):
    return F.pmod(F.xxhash64(F.lit("cut"), F.col(key)), F.col(n)).cast("int")


def pre_end_table(p: DataFrame, start_date, period: str):
    """Per group the last bucket on or before the start date (the bucket
    holding it, since the panel is dense): ``{"pre_end": date}`` for a
    scalar start date, else a ``(group_id, pre_end)`` DataFrame."""
    from .describe import last_pre_bucket

    pe = last_pre_bucket(start_date, period)
    if isinstance(pe, DataFrame):
        return pe.withColumnRenamed("start_date", "pre_end")
    return {"pre_end": pe}


def _series_columns(x: DataFrame, z: float) -> DataFrame:
    """From (response y, prediction pred, residual sd sigma, is_pre) per
    row, build the interval, cumulative and effect columns."""
    y, pred, sig = F.col("response"), F.col("point_pred"), F.col("sigma")
    w = (Window.partitionBy(G, TS).orderBy(D)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    post = ~F.col("is_pre")
    x = (x.withColumn("point_pred_lower", pred - z * sig)
         .withColumn("point_pred_upper", pred + z * sig)
         .withColumn("cum_response", F.sum(y).over(w))
         .withColumn("_m", F.sum(F.when(post, 1).otherwise(0)).over(w))
         .withColumn("cum_pred", F.sum(F.when(post, pred).otherwise(y)).over(w)))
    half = z * sig * F.sqrt(F.col("_m").cast("double"))
    x = (x.withColumn("cum_pred_lower", F.col("cum_pred") - half)
         .withColumn("cum_pred_upper", F.col("cum_pred") + half)
         .withColumn("point_effect", y - pred)
         .withColumn("point_effect_lower", y - F.col("point_pred_upper"))
         .withColumn("point_effect_upper", y - F.col("point_pred_lower"))
         .withColumn("cum_effect", F.col("cum_response") - F.col("cum_pred"))
         .withColumn("cum_effect_lower", F.col("cum_response") - F.col("cum_pred_upper"))
         .withColumn("cum_effect_upper", F.col("cum_response") - F.col("cum_pred_lower")))
    return x


def ratio_models(p: DataFrame, start_date, alpha: float = 0.05, period: str = "month") -> Models:
    """Deterministic leave-one-out counterfactual for every active series."""
    z = NormalDist().inv_cdf(1.0 - alpha / 2.0)
    x = model_rows(p, start_date)
    totals = x.groupBy(G, D).agg(F.sum(C).alias("_tot"), F.count(F.lit(1)).alias("_n"))
    # one row per (group, bucket): bounded by groups x calendar; size-checked
    x = x.join(sized_broadcast(totals), [G, D])
    x = x.withColumn("peer", F.try_divide(F.col("_tot") - F.col(C), (F.col("_n") - 1).cast("double")))
    ws = Window.partitionBy(G, TS)
    pre = F.col("is_pre")
    x = x.withColumn("_ratio", F.try_divide(F.sum(F.when(pre, F.col(C))).over(ws),
                                            F.sum(F.when(pre, F.col("peer"))).over(ws)))
    x = x.withColumn("point_pred", F.col("_ratio") * F.col("peer")).withColumnRenamed(C, "response")
    x = x.withColumn("sigma", F.stddev_samp(F.when(pre, F.col("response") - F.col("point_pred")))
                     .over(ws))
    x = _series_columns(x, z)
    series = x.select(G, TS, D, *SERIES_COLUMNS)
    post = x.where(~F.col("is_pre"))
    eff = post.groupBy(G, TS).agg(
        F.avg(F.col("response") - F.col("point_pred")).alias("AbsEffect_Average"),
        F.avg("point_pred").alias("_pred_avg"),
        F.sum(F.col("response") - F.col("point_pred")).alias("AbsEffect_Cumulative"),
        F.sum("point_pred").alias("_pred_sum"),
        F.first("sigma").alias("_sigma"), F.count(F.lit(1)).alias("_m"))
    zc = F.try_divide(F.col("AbsEffect_Cumulative"), F.col("_sigma") * F.sqrt(F.col("_m").cast("double")))
    eff = (eff.withColumn("RelEffect_Average", F.try_divide(F.col("AbsEffect_Average"), F.col("_pred_avg")))
           .withColumn("RelEffect_Cumulative",
                       F.try_divide(F.col("AbsEffect_Cumulative"), F.col("_pred_sum")))
           .withColumn("p_Cumulative", F.when(F.col("_sigma") > 0, 1.0 - norm_cdf(F.abs(zc))))
           .withColumn("p_Average", F.col("p_Cumulative")))
    effects = eff.select(G, TS, *EFFECT_COLUMNS)
    coefs = p.sparkSession.createDataFrame([], COEF_SCHEMA)
    return Models(effects, series, coefs, pre_end_table(p, start_date, period), alpha)


def fit_models(p: DataFrame, start_date, period: str = "month", alpha: float = 0.05,
               method: str = "ridge", **kw) -> Models:
    """Fit one model per active series: ``ridge`` or ``ratio``."""
    if method == "ridge":
        from .ridge import ridge_models
        return ridge_models(p, start_date, alpha, period, **kw)
    if method == "ratio":
        return ratio_models(p, start_date, alpha, period)
    raise ValueError(f"unknown method {method!r}")

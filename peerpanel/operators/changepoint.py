"""Group-level change point in the mean of the aggregate count series.

The group total per raw date is completed with zero rows on month steps
from the first date (calendar overflow: Jan 31 -> Mar 2/3), then binary
segmentation for a single mean shift runs ``num_cpts`` rounds:

* every round computes, for each segment of each group, the prefix sums
  of ``x`` and ``x^2`` with a window over ``(group, segment)`` and the gain
  of splitting after every position;
* the best split per group (first position on ties) is taken, its gain is
  recorded as ``min(previous record, gain)``, and the segment is cut;
* points are kept up to the last round whose record reaches the penalty.

Segment cost is the unit-variance normal cost ``sum((x - mean)^2)``; the
MBIC form adds ``log(segment length)`` to each segment and uses a penalty
of ``3 log n``. Values are centred by the group mean first (the cost is
shift-invariant and this avoids cancellation). Rows per group are the
number of dates, bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_steps
from ..session import reuse
from .prepare import C, D, G


def group_total_month_complete(panel: DataFrame) -> DataFrame:
    """Group total per date, plus zero rows on month steps from the first
    date that are missing (also on daily data)."""
    agg = panel.groupBy(G, D).agg(F.sum(C).alias(C))
    rng = agg.groupBy(G).agg(F.min(D).alias("d0"), F.max(D).alias("d1"))
    steps = rng.select(G, F.explode(month_steps("d0", "d1")).alias(D))
    return (agg.join(steps, [G, D], "full")
            .select(G, D, F.coalesce(F.col(C), F.lit(0.0)).alias(C)))


def _penalty(penalty, n_col):
    if penalty == "MBIC":
        return 3.0 * F.log(n_col)
    if penalty == "BIC":
        return 2.0 * F.log(n_col)
    return F.lit(float(penalty))


def _split_gains(x: DataFrame, mbic: bool) -> DataFrame:
    """Gain of splitting each segment after each position."""
    ws = Window.partitionBy(G, "seg")
    wc = ws.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sq = F.col("xc") * F.col("xc")
    x = (x.withColumn("s1", F.sum("xc").over(wc)).withColumn("s2", F.sum(sq).over(wc))
         .withColumn("t1", F.sum("xc").over(ws)).withColumn("t2", F.sum(sq).over(ws))
         .withColumn("ns", F.count(F.lit(1)).over(ws)))
    nl = (F.col("i") - F.col("seg") + 1).cast("double")
    nr = F.col("ns") - nl
    t1, s1 = F.col("t1"), F.col("s1")
    cost = F.col("t2") - t1 * t1 / F.col("ns")
    left = F.col("s2") - s1 * s1 / nl
    right = (F.col("t2") - F.col("s2")) - (t1 - s1) * (t1 - s1) / nr
    gain = cost - left - right
    if mbic:
        gain = gain + F.log(F.col("ns")) - F.log(nl) - F.log(nr)
    return x.withColumn("gain", F.when(nr > 0, gain))


def detect_changepoint(panel: DataFrame, num_cpts: int = 1, penalty="MBIC",
                       include_data: bool = False, include_model: bool = False) -> DataFrame:
    """Change points per group: ``group_id, change_date, before_mean,
    after_mean, mean_change, pct_change`` (one row per point; groups with
    none are absent). ``change_date`` is the last date of the left segment;
    the means split the whole completed series at it.

    ``include_data`` adds ``data array<struct<date,count>>`` (the completed
    series), ``include_model`` adds ``gain, penalty, cpt_round``.
    """
    # a row per date and group: stored, so every round plans from the same
    # small table and the raw panel is scanned once
    series = reuse(group_total_month_complete(panel))
    wg = Window.partitionBy(G)
    x = (series.withColumn("i", F.row_number().over(wg.orderBy(D)))
         .withColumn("n", F.count(F.lit(1)).over(wg))
         .withColumn("xc", F.col(C) - F.avg(C).over(wg))
         .withColumn("seg", F.lit(1)))
    x = reuse(x)
    mbic = penalty == "MBIC"
    found = None
    for q in range(1, num_cpts + 1):
        g = _split_gains(x.select(G, D, C, "i", "n", "xc", "seg"), mbic)
        best = reuse(g.where(F.col("gain").isNotNull())
                .groupBy(G).agg(F.max(F.struct(F.col("gain"), (-F.col("i")).alias("ni"))).alias("b"))
                .select(G, F.col("b.gain").alias("gain"), (-F.col("b.ni")).alias("k"),
                        F.lit(q).alias("cpt_round")))
        found = best if found is None else found.unionByName(best)
        if q == num_cpts:
            break
        # cut the chosen segment after k
        kseg = g.join(best.select(G, "k"), G, "left")
        kseg = kseg.withColumn("kseg", F.max(F.when(F.col("i") == F.col("k"), F.col("seg")))
                               .over(Window.partitionBy(G)))
        x = reuse(kseg.select(
            G, D, C, "i", "n", "xc", F.when((F.col("seg") == F.col("kseg")) & (F.col("i") > F.col("k")),
                                            F.col("k") + 1).otherwise(F.col("seg")).alias("seg")))
    wr = Window.partitionBy(G).orderBy("cpt_round").rowsBetween(Window.unboundedPreceding, 0)
    n_per_group = x.groupBy(G).agg(F.first("n").alias("n"))
    found = (found.withColumn("record", F.min("gain").over(wr))
             .join(n_per_group, G)
             .withColumn("penalty", _penalty(penalty, F.col("n"))))
    keep_upto = (found.where(F.col("record") >= F.col("penalty"))
                 .groupBy(G).agg(F.max("cpt_round").alias("last_round")))
    pts = found.join(keep_upto, G).where(F.col("cpt_round") <= F.col("last_round"))
    # means either side of each point, from prefix sums of the raw totals
    wc = Window.partitionBy(G).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    pre = (x.select(G, D, C, "i", "n")
           .withColumn("cum", F.sum(C).over(wc))
           .withColumn("tot", F.sum(C).over(Window.partitionBy(G))))
    out = pts.join(pre, [G, "n"]).where(F.col("i") == F.col("k"))
    out = out.select(
        G, F.col(D).alias("change_date"),
        (F.col("cum") / F.col("k")).alias("before_mean"),
        F.try_divide(F.col("tot") - F.col("cum"), (F.col("n") - F.col("k")).cast("double"))
        .alias("after_mean"), "gain", "penalty", "cpt_round")
    out = (out.withColumn("mean_change", F.col("after_mean") - F.col("before_mean"))
           .withColumn("pct_change", F.try_divide(F.col("mean_change"), F.col("before_mean"))))
    cols = [G, "change_date", "before_mean", "after_mean", "mean_change", "pct_change"]
    if include_model:
        cols += ["gain", "penalty", "cpt_round"]
    out = out.select(*cols)
    if include_data:
        nested = series.groupBy(G).agg(
            F.array_sort(F.collect_list(F.struct(D, C))).alias("data"))
        out = out.join(nested, G)
    return out


def explode_data(cpts: DataFrame) -> DataFrame:
    """Unnest ``data`` of ``detect_changepoint(include_data=True)``."""
    cols = [c for c in cpts.columns if c != "data"]
    return (cpts.select(*cols, F.explode("data").alias("_d"))
            .select(*cols, F.col("_d.date").alias(D), F.col("_d.count").alias(C)))


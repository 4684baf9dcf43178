"""Descriptive tables over a prepared panel: per-date counts and stats,
running distinct active series, and the pre-period quantile series.

Inactive series are included (as in the reference); leading zeros of
every series are trimmed first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import bucket_grid, floor_period
from ..functions.ranking import median_at, pct_rank_col, positions, rank_table, value_at
from ..session import reuse, sized_broadcast
from .prepare import C, D, G, TS, dense_arrays, running_sums, start_param, with_group_params

SUMMARY_COUNT_NAMES = ("count_mean", "count_total", "timeseries_active", "timeseries_total",
                       "timeseries_active_new", "timeseries_inactive_old",
                       "timeseries_active_old")
SUMMARY_STATS_NAMES = ("count_mean", "count_sd", "count_median",
                       "count_log10_mean", "count_log10_sd", "count_log10_median")


def _series_window():
    return (Window.partitionBy(G, TS).orderBy(D)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def trim_leading_zeros(p: DataFrame) -> DataFrame:
    """Drop rows while the running sum of the series (by date) is 0.

    The test is ``running sum != 0``, so with negative counts a later
    zero running sum drops that row too.
    """
    return (p.withColumn("_cum", F.sum(C).over(_series_window()))
            .where(F.col("_cum") != 0).drop("_cum"))


def trimmed_arrays(p: DataFrame, period: str | None = None) -> DataFrame:
    """``(group_id, ts_id, active, d, y)``: dates and counts of each trimmed series, of the rows of a
    prepared panel or (with its ``period``) of ``prepare_series``, whose series need no exchange."""
    if "entries" in p.columns:
        return dense_arrays(p, period, trimmed=True).where(F.size("d") > 0)
    r = F.array_sort(F.collect_list(F.struct(D, C)))
    x = p.groupBy(G, TS).agg(F.first("active").alias("active"), r.alias("entries")).withColumn("_run", running_sums())
    x = x.select(G, TS, "active", F.explode(F.array(F.filter("entries", lambda e, i: F.get("_run", i) != 0))).alias("v"))
    return x.select(G, TS, "active", F.col(f"v.{D}").alias("d"), F.col("v")[C].alias("y")).where(F.size("d") > 0)


def running_distinct_series(s: DataFrame, period: str) -> DataFrame:
    """``running_distinct`` of the trimmed series of ``prepare_series`` from their present buckets alone:
    a series' running sum changes only there, so it holds the dates from a bucket with a sum
    other than 0 up to the next one. Dates held by any series are those where the
    starts up to the date outnumber the ends."""
    x = s.select(G, TS, "d0", "d1", F.arrays_zip(F.col("entries").alias("e"), running_sums().alias("r")).alias("v"))
    held = F.filter("v", lambda v: v["r"] != 0)
    new = F.array_min(F.transform(F.filter(held, lambda v: v["e"][C] > 0), lambda v: v["e"][D]))
    # +1 where the sum leaves 0, -1 where it comes back to it
    was = F.concat(F.array(F.lit(0.0)), F.col("v.r"))
    turns = F.filter(F.zip_with("v", F.slice(was, 1, F.size("v")), lambda v, b: F.struct(
        v["e"][D].alias("at"), F.when((v["r"] != 0) & (b == 0), 1).when((v["r"] == 0) & (b != 0), -1).otherwise(0).alias("turn"),
        F.lit(0).alias("new"))), lambda t: t["turn"] != 0)
    turns = F.when(new.isNotNull(), F.concat(turns, F.array(F.struct(new.alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("new"))))).otherwise(turns)
    counts = x.select(G, F.explode(turns).alias("t")).groupBy(G, F.col("t.at").alias(D)).agg(
        F.sum("t.turn").alias("_turn"), F.sum("t.new").alias("_new"))
    grid = s.select(G, "d0", "d1").distinct().select(G, F.explode(bucket_grid("d0", "d1", period)).alias(D))
    w = Window.partitionBy(G).orderBy(D).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    return (grid.join(counts, [G, D], "left").select(G, D, total("_turn").alias("_held"), total("_new").alias("timeseries_total"))
            .where("_held > 0").drop("_held"))


def last_pre_bucket(start_date, period: str):
    """The last bucket on or before the start date - the ``start_date``
    every report table uses. On a densified panel (every bucket from the
    group's first to last, start date inside that range) it is the bucket
    holding the start date: a literal, or a column of the per-group start
    table; no pass over the data."""
    sp = start_param(start_date)
    if isinstance(sp, DataFrame):
        return sp.select(G, floor_period("start_date", period).alias("start_date"))
    d = sp["start_date"]
    if period == "week":
        d = d - dt.timedelta(days=(d.weekday() + 1) % 7)
    elif period == "month":
        d = d.replace(day=1)
    return d


def _unpivot(df: DataFrame, names) -> DataFrame:
    df = df.select(G, D, *[F.col(n).cast("double").alias(n) for n in names])
    return df.unpivot([G, D], list(names), "name", "value")


def running_distinct(t: DataFrame) -> DataFrame:
    """Per (group, date): series active (count > 0) on that date or any
    earlier date. Computed from each series' first active date (one row
    per series), never by carrying id sets."""
    first = (t.where(F.col(C) > 0).groupBy(G, TS).agg(F.min(D).alias(D))
             .groupBy(G, D).agg(F.count(F.lit(1)).alias("_new")))
    dates = t.select(G, D).distinct()
    w = Window.partitionBy(G).orderBy(D).rowsBetween(Window.unboundedPreceding, 0)
    return (dates.join(first, [G, D], "left")
            .select(G, D, F.sum(F.coalesce("_new", F.lit(0))).over(w)
                    .alias("timeseries_total")))


def summary_count_wide(p: DataFrame) -> DataFrame:
    t = trim_leading_zeros(p)
    # the prepared panel has one row per (group, series, date), so the
    # distinct active ids per date are a plain conditional count
    per_date = t.groupBy(G, D).agg(
        F.avg(C).alias("count_mean"), F.sum(C).alias("count_total"),
        F.count_if(F.col(C) > 0).alias("timeseries_active"))
    total = running_distinct(t)
    w = Window.partitionBy(G).orderBy(D)
    x = per_date.join(total, [G, D])
    x = x.withColumn("timeseries_active_new",
                     F.col("timeseries_total") - F.lag("timeseries_total").over(w))
    x = x.withColumn("timeseries_inactive_old", F.col("timeseries_total") - F.col("timeseries_active"))
    x = x.withColumn("timeseries_active_old",
                     F.col("timeseries_active") - F.col("timeseries_active_new"))
    return x


def desc_summary_count(p: DataFrame) -> DataFrame:
    """Long table ``(group_id, date, name, value)`` of per-date counts."""
    return _unpivot(summary_count_wide(p), SUMMARY_COUNT_NAMES)


def desc_summary_count_plot(long: DataFrame) -> DataFrame:
    """Plot-ready subset: active/inactive split and total count, no
    NULLs, with a facet ``type``."""
    keep = F.col("name").rlike("^timeseries_(in)?active_") | (F.col("name") == "count_total")
    return (long.where(keep & F.col("value").isNotNull())
            .withColumn("type", F.when(F.col("name").startswith("count_"), F.col("name"))
                        .otherwise(F.regexp_extract("name", "(^[^_]*)", 1))))


def desc_summary_stats(p: DataFrame) -> DataFrame:
    """Long table of per-date mean / sample sd / median of the count and
    of ``log10(count + 1)`` (NULL where count + 1 <= 0)."""
    t = reuse(trim_leading_zeros(p).select(G, D, C))
    log = F.when(F.col(C) + 1 > 0, F.log10(F.col(C) + 1))
    wide = t.groupBy(G, D).agg(
        F.avg(C).alias("count_mean"), F.stddev_samp(C).alias("count_sd"),
        F.avg(log).alias("count_log10_mean"), F.stddev_samp(log).alias("count_log10_sd"),
        F.count_if(F.col(C) + 1 <= 0).alias("_low"))
    # exact medians from value frequencies per (group, date): no task holds
    # all values of one date of a large group. log10 keeps the order, so both
    # medians come from one rank table; counts without a logarithm come first
    low = sized_broadcast(wide.select(G, D, "_low"))      # one row per group and bucket
    ranks = rank_table(t, [G, D], C).join(low, [G, D])
    r, ties, n, skip = F.col("_min_rank"), F.col("_ties"), F.col("_n"), F.col("_low")
    lo, hi = median_at(n)
    llo, lhi = (skip + x for x in median_at(n - skip))
    med = ranks.groupBy(G, D).agg(
        ((value_at(lo, r, ties, C) + value_at(hi, r, ties, C)) / 2.0).alias("count_median"),
        ((value_at(llo, r, ties, log) + value_at(lhi, r, ties, log)) / 2.0).alias("count_log10_median"))
    return _unpivot(wide.join(med, [G, D], "left"), SUMMARY_STATS_NAMES)


def _ntile_cells(rows: DataFrame, part, key, tiebreak, n: int, out: str) -> DataFrame:
    """``ntile(n)`` over ``part`` ordered by ``key``, then date, then ``tiebreak``,
    as ``(group_id, date, count, out, _k)``: rows per date, count and bucket.

    A (key, date) cell starts at the rows with a smaller key (rank table) plus
    those of its key on earlier dates (a running sum over at most one row per
    date). Unless one of the n - 1 bucket ends falls into it, the whole cell
    lies in one bucket, so it needs no order inside. The few cells that are cut
    (at most n - 1 per partition) are sorted by range over many tasks: a row's
    place is its range's offset plus its place in the range. No row-level join
    or window has a tie value as its key.
    """
    part = list(part)
    cell = [*part, key, D]
    ranks = rank_table(rows.select(*part, key), part, key, prefix="_q").select(
        *part, key, (F.col("_qmin_rank") - 1).alias("_off"), F.col("_qn").alias("_L"))
    values = reuse(rows.groupBy(*cell, C).agg(F.count(F.lit(1)).alias("_k")))
    sizes = values.groupBy(*cell).agg(F.sum("_k").alias("_c"))
    wdate = Window.partitionBy(*part, key).orderBy(D).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_early", F.coalesce(F.sum("_c").over(wdate), F.lit(0)))
    sizes = reuse(sizes.join(ranks, [*part, key]).select(*cell, "_L", "_c", (F.col("_off") + F.col("_early")).alias("_s")))

    def bucket(r):
        # SQL NTILE: the first L mod n buckets hold one row more
        L = F.col("_L")
        larger, smaller = F.ceil(L / n), F.floor(L / n)
        thr = larger * (L % n)
        return F.when(r <= thr, F.floor((r + larger - 1) / larger)) \
            .otherwise(F.floor((r - thr + smaller - 1) / smaller) + L % n).cast("long")

    first, last = bucket(F.col("_s") + 1), bucket(F.col("_s") + F.col("_c"))
    sizes = sizes.withColumn("_b0", first).withColumn("_b1", last)
    plain = values.join(sizes.where("_b0 = _b1").select(*cell, F.col("_b0").alias(out)), cell) \
        .select(G, D, C, out, "_k")
    # at most n - 1 cut cells per partition
    cut = sized_broadcast(sizes.where("_b0 <> _b1").select(*cell, "_L", "_s"))
    inner = positions(rows.join(cut, cell), cell, tiebreak, "_place").withColumn("_r", F.col("_s") + F.col("_place"))
    inner = inner.select(G, D, C, bucket(F.col("_r")).alias(out)).groupBy(G, D, C, out).agg(F.count(F.lit(1)).alias("_k"))
    return plain.unionByName(inner).groupBy(G, D, C, out).agg(F.sum("_k").alias("_k"))


def desc_quantile_timeseries(p: DataFrame, start_date, n_quantiles: int = 3, bucket: str | None = None) -> DataFrame:
    """Mean within-date percentile of the series in each tercile of
    per-period median count: ``(group_id, date, quantile, mean_percentile)``.

    Period is ``pre`` for ``date <= start_date`` (inclusive rule). The
    tercile is an ``ntile`` over *rows* of the period, ordered by the
    series' median count, ties by date, active flag, series id. ``p`` has the rows of a
    prepared panel, or the series of ``prepare_series`` with their ``bucket`` period.
    """
    x = with_group_params(trimmed_arrays(p, bucket), start_param(start_date))
    # a series is one row up to here; its medians need no window and the tables below
    # read its rows several times without storing them
    k, n = F.size(F.filter("d", lambda d: d <= F.col("start_date"))), F.size("d")

    def part(name, first, size):
        y = F.slice("y", first, size)
        v = F.array_sort(y)
        mid = lambda at: F.get(v, at.cast("int"))
        med = F.when(size > 0, 0.5 * mid(F.floor((size - 1) / 2)) + 0.5 * mid(F.floor(size / 2)))
        return F.struct(F.lit(name).alias("period"), med.alias("med_count"), F.arrays_zip(F.slice("d", first, size).alias("d"), y.alias("y")).alias("v"))

    x = reuse(x.select(G, TS, "active", F.explode(F.array(part("pre", F.lit(1), k), part("post", k + 1, n - k))).alias("s"))
              .select(G, TS, "active", "s.*"))
    t = x.select(G, TS, "active", "period", "med_count", F.explode("v").alias("v")) \
        .select(G, TS, "active", F.col("v.d").alias(D), F.col("v.y").alias(C), "period", "med_count")
    cells = reuse(_ntile_cells(t, [G, "period"], "med_count", ["active", TS], n_quantiles, "quantile"))
    # within-date percent rank from the exact rank table of the counts
    freq = rank_table(t.select(G, D, C), [G, D], C, prefix="_p").select(G, D, C, pct_rank_col("_p").alias("_pr"))
    x = cells.join(freq, [G, D, C])
    return (x.groupBy(G, D, "quantile").agg(
        F.try_divide(F.sum(F.col("_k") * F.col("_pr")),
                     F.sum(F.when(F.col("_pr").isNotNull(), F.col("_k"))).cast("double"))
        .alias("mean_percentile")))

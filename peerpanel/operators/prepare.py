"""Panel preparation: bucket sums, the active flag, densification and the
input checks.

Shuffle plan of ``prepare_panel`` (all keyed by ``group_id`` first):

1. bucket sum on ``(group, series, bucket)`` - partial aggregation on the
   map side, so a hot series collapses to at most one row per bucket per
   input partition before the shuffle;
2. per group one row of counts and date ranges (partial-aggregated), which
   all checks and the grid read;
3. the present buckets of a series meet in one row (bounded by the calendar)
   with its activity; the gaps between them are filled as that row is exploded,
   so the dense rows pass no exchange and a group holding a third of all series
   does not land in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError
from ..functions.calendar import bucket_grid, check_period, floor_period
from ..session import sized_broadcast

G, TS, D, C = "group_id", "ts_id", "date", "count"


def _as_date(x):
    if isinstance(x, dt.datetime):
        return x.date()
    if isinstance(x, dt.date):
        return x
    return dt.date.fromisoformat(str(x))


def with_group_params(df: DataFrame, params) -> DataFrame:
    """Attach per-group parameters.

    ``params`` is a dict of scalars (attached as literals) or a DataFrame
    keyed by ``group_id`` (one row per group, joined after a size check).
    """
    if isinstance(params, DataFrame):
        return df.join(sized_broadcast(params), G)
    for k, v in params.items():
        if isinstance(v, (dt.date, dt.datetime)) or k in ("start_date", "pre_end"):
            df = df.withColumn(k, F.lit(_as_date(v)))
        else:
            df = df.withColumn(k, F.lit(v))
    return df


def start_param(start_date) -> dict | DataFrame:
    """Normalise a start date: a scalar, or a DataFrame with columns
    ``group_id, start_date`` (e.g. the output of ``detect_changepoint``)."""
    if isinstance(start_date, DataFrame):
        cols = start_date.columns
        if "start_date" not in cols and "change_date" in cols:
            start_date = start_date.withColumnRenamed("change_date", "start_date")
        return start_date.select(G, F.col("start_date").cast("date"))
    if start_date is None:
        raise PanelError("start_date is required (use detect_changepoint to find one)")
    return {"start_date": _as_date(start_date)}


def bucket_sum(panel: DataFrame, period: str) -> DataFrame:
    """Sum counts per (group, series, bucket start)."""
    check_period(period)
    return (panel.withColumn(D, floor_period(D, period))
            .groupBy(G, TS, D).agg(F.sum(C).alias(C)))


def bucket_stats(panel: DataFrame, period: str) -> DataFrame:
    """Bucket sums plus, per bucket, the raw row count and first/last raw
    date: everything the checks and default minimums need, so the raw
    panel is scanned once."""
    check_period(period)
    return (panel.withColumn("_raw", F.col(D)).withColumn(D, floor_period(D, period))
            .groupBy(G, TS, D).agg(F.sum(C).alias(C), F.count(F.lit(1)).alias("_n"),
                                   F.min("_raw").alias("_r0"), F.max("_raw").alias("_r1"),
                                   F.count_if(F.col(C).isNull()).alias("_null")))


def _months(buckets: DataFrame) -> DataFrame:
    """Distinct calendar months of the raw dates, per group. A bucket is at
    most a month or a week, so its raw months are those of its first and
    last raw date."""
    m = buckets.select(G, F.explode(F.array(F.trunc("_r0", "MM"), F.trunc("_r1", "MM")))
                       .alias("month"))
    return m.distinct()


def default_periods(panel: DataFrame, start_date, buckets: DataFrame | None = None) -> DataFrame:
    """Per group: ``min_pre_periods = floor(0.5 * #months <= start)`` and
    ``min_post_periods = floor(0.25 * #months > start)``, counting the
    distinct calendar months of the raw dates whatever the period."""
    sp = start_param(start_date)
    if buckets is None:
        m = panel.select(G, F.trunc(D, "MM").alias("month")).distinct()
    else:
        m = _months(buckets)
    m = with_group_params(m, sp)
    return (m.groupBy(G).agg(
        F.floor(F.count_if(F.col("month") <= F.col("start_date")) * 0.5)
        .cast("long").alias("min_pre_periods"),
        F.floor(F.count_if(F.col("month") > F.col("start_date")) * 0.25)
        .cast("long").alias("min_post_periods")))


def run_params(panel: DataFrame, start_date, min_pre_periods=None,
               min_post_periods=None, buckets: DataFrame | None = None):
    """Start date and minimums per group, as literals when all are scalars."""
    sp = start_param(start_date)
    if isinstance(sp, dict) and min_pre_periods is not None and min_post_periods is not None:
        return {**sp, "min_pre_periods": int(min_pre_periods),
                "min_post_periods": int(min_post_periods)}
    params = default_periods(panel, start_date, buckets)
    if min_pre_periods is not None:
        params = params.withColumn("min_pre_periods", F.lit(int(min_pre_periods)).cast("long"))
    if min_post_periods is not None:
        params = params.withColumn("min_post_periods", F.lit(int(min_post_periods)).cast("long"))
    if isinstance(sp, dict):
        params = params.withColumn("start_date", F.lit(sp["start_date"]))
    else:
        params = params.join(sp, G)
    return params


def series_activity(buckets: DataFrame, params, entries: bool = False) -> DataFrame:
    """One row per series: present buckets on/before and after the start
    date and the ``active`` flag (floored bucket vs raw start date); with
    ``entries`` also its present buckets in order, as structs (date, count)."""
    b = with_group_params(buckets, params)
    kept = [F.array_sort(F.collect_list(F.struct(D, C))).alias("entries")] if entries else []
    return (b.groupBy(G, TS).agg(
        F.count_if(F.col(D) <= F.col("start_date")).alias("n_pre"),
        F.count_if(F.col(D) > F.col("start_date")).alias("n_post"),
        F.first("min_pre_periods").alias("min_pre_periods"),
        F.first("min_post_periods").alias("min_post_periods"), *kept)
        .withColumn("active", (F.col("n_pre") >= F.col("min_pre_periods"))
                    & (F.col("n_post") >= F.col("min_post_periods")))
        .drop("min_pre_periods", "min_post_periods"))


def running_sums(entries: str = "entries"):
    """The running sum at each of a series' present buckets."""
    return F.aggregate(entries, F.struct(F.lit(0.0).alias("s"), F.expr("CAST(array() AS array<double>)").alias("r")), lambda a, e: F.struct(
        (a["s"] + e[C]).alias("s"), F.concat(a["r"], F.array(a["s"] + e[C])).alias("r")))["r"]


def dense_arrays(series: DataFrame, period: str, trimmed: bool = False) -> DataFrame:
    """``(group_id, ts_id, active, d, y)``: every bucket of the group's range ``d0`` to ``d1`` and its
    count, missing buckets filled with 0. ``series`` has its present ``entries``: each
    yields its own bucket and zeros up to the next one; with ``trimmed`` only where the
    running sum is not 0."""
    point = lambda d, c: F.struct(d.alias(D), c.alias(C))
    zero = F.lit(0.0)
    until = lambda a, b: F.slice(a, 1, F.greatest(F.size(a) - b, F.lit(0)))
    nexts = F.concat(F.transform(F.slice("entries", 2, F.size("entries")), lambda e: F.struct(e[D].alias("to"), F.lit(1).alias("cut"))),
                     F.array(F.struct(F.col("d1").alias("to"), F.lit(0).alias("cut"))))
    spans = F.zip_with("entries", nexts, lambda e, n: F.struct(e.alias("e"), n["to"].alias("to"), n["cut"].alias("cut")))
    if trimmed:
        spans = F.filter(F.zip_with(spans, running_sums(), lambda s, r: F.when(r != 0, s)), lambda s: s.isNotNull())
    v = F.flatten(F.transform(spans, lambda s: F.transform(
        until(bucket_grid(s["e"][D], s["to"], period), s["cut"]), lambda d: point(d, F.when(d == s["e"][D], s["e"][C]).otherwise(zero)))))
    if not trimmed:
        v = F.concat(F.transform(until(bucket_grid("d0", F.element_at("entries", 1)[D], period), 1), lambda d: point(d, zero)), v)
    # exploding one array of arrays keeps Spark from working it out again for each use
    x = series.select(G, TS, "active", F.explode(F.array(v)).alias("v"))
    return x.select(G, TS, "active", F.col(f"v.{D}").alias("d"), F.col("v")[C].alias("y"))


def densify(series: DataFrame, period: str) -> DataFrame:
    """The rows of ``dense_arrays``, one per series and bucket."""
    return dense_arrays(series, period).select(G, TS, "active", F.explode(F.arrays_zip("d", "y")).alias("v")) \
        .select(G, TS, "active", F.col("v.d").alias(D), F.col("v.y").alias(C))


LISTED = 20  # groups named in one error message


def _named(rows) -> str:
    """Failing groups of an error, at most ``LISTED``; says when there are more."""
    more = " (and more groups)" if len(rows) > LISTED else ""
    return "; ".join(rows[:LISTED]) + more


def check_starts(groups: DataFrame, start: DataFrame) -> None:
    """Every group has exactly one start date, else ``PanelError``."""
    n = start.groupBy(G).agg(F.count(F.lit(1)).alias("n"), F.count("start_date").alias("dates"))
    bad = (groups.select(G).distinct().join(n, G, "left")
           .where(F.col("n").isNull() | (F.col("n") != 1) | (F.col("dates") != 1))
           .orderBy(G).limit(LISTED + 1).collect())
    if bad:
        raise PanelError("start dates: " + _named(
            [f"group {r[G]}: {'none' if not r.n or not r.dates else f'{r.n} rows'}" for r in bad]))


def group_stats(buckets: DataFrame) -> DataFrame:
    """One row per group of ``bucket_stats``: raw rows, first and last raw date and
    bucket, rows without a date or a count."""
    return buckets.groupBy(G).agg(
        F.sum("_n").alias("n_rows"), F.min("_r0").alias("d_min"), F.max("_r1").alias("d_max"),
        F.min(D).alias("d0"), F.max(D).alias("d1"),
        F.sum(F.when(F.col(D).isNull(), F.col("_n")).otherwise(0)).alias("dates"), F.sum("_null").alias("counts"))


def check_nulls(groups: DataFrame) -> None:
    """NULL dates and NULL counts are errors: they would silently vanish or
    turn into zeros in the dense grid."""
    bad = groups.where((F.col("dates") > 0) | (F.col("counts") > 0)).orderBy(G).limit(LISTED + 1).collect()
    if bad:
        raise PanelError(_named([f"group {r[G]}: {r.dates} rows without a date, {r.counts} without a count"
                                 for r in bad]))


def check_inputs(groups: DataFrame, params, min_timeseries: int) -> None:
    """Row-count and start-date range checks from the table of groups; only
    failing groups come back."""
    agg = with_group_params(groups, params).withColumnsRenamed({"min_pre_periods": "min_pre", "min_post_periods": "min_post"})
    need = F.lit(int(min_timeseries)) * (F.col("min_pre") + F.col("min_post"))
    bad = agg.where((F.col("n_rows") < need)
                    | ~F.col("start_date").between(F.col("d_min"), F.col("d_max")))
    rows = bad.orderBy(G).limit(LISTED + 1).collect()
    if rows:
        msgs = []
        for r in rows:
            if r.start_date is None or not (r.d_min <= r.start_date <= r.d_max):
                msgs.append(f"group {r.group_id}: start_date {r.start_date} not within "
                            f"{r.d_min} to {r.d_max}")
            else:
                msgs.append(f"group {r.group_id}: not enough rows {r.n_rows} < "
                            f"{min_timeseries * (r.min_pre + r.min_post)}")
        raise PanelError(_named(msgs))


def check_active(series: DataFrame, min_timeseries: int) -> None:
    bad = (series.groupBy(G).agg(F.count_if("active").alias("n_active"))
           .where(F.col("n_active") < int(min_timeseries)).orderBy(G).limit(LISTED + 1).collect())
    if bad:
        raise PanelError("Does not meet minimum number of timeseries: " + _named(
            [f"group {r.group_id}: {r.n_active} < {min_timeseries}" for r in bad]))


def prepare_panel(panel: DataFrame, start_date, period: str = "month",
                  min_pre_periods: int | None = None, min_post_periods: int | None = None,
                  min_timeseries: int = 30, validate: bool = True) -> DataFrame:
    """Bucketed, densified panel ``(group_id, ts_id, active, date, count)``: ``prepare_series``
    with a row for every bucket."""
    return densify(prepare_series(panel, start_date, period, min_pre_periods, min_post_periods,
                                  min_timeseries, validate), period)


def prepare_series(panel: DataFrame, start_date, period: str = "month",
                   min_pre_periods: int | None = None, min_post_periods: int | None = None,
                   min_timeseries: int = 30, validate: bool = True) -> DataFrame:
    """One row per series ``(group_id, ts_id, active, entries, d0, d1)``: its present buckets in
    order and the first and last bucket of its group.

    Minimums left as None are derived per group from the raw months
    (``default_periods``). With ``validate`` the reference's checks run
    (on the small table of groups) and raise ``PanelError``. The raw panel is
    scanned once: the bucket table (one row per series and bucket) is persisted
    and feeds the checks, the defaults, the active flags and the grid.
    """
    check_period(period)
    stats = bucket_stats(panel, period).persist(StorageLevel.MEMORY_AND_DISK)
    groups = group_stats(stats).persist(StorageLevel.MEMORY_AND_DISK)
    if validate:
        check_nulls(groups)
        if isinstance(start_date, DataFrame):
            check_starts(groups, start_param(start_date))
    params = run_params(panel, start_date, min_pre_periods, min_post_periods, stats)
    if isinstance(params, DataFrame):
        params = sized_broadcast(params)
    if validate:
        check_inputs(groups, params, min_timeseries)
    series = series_activity(stats.select(G, TS, D, C), params, entries=True)
    if validate:
        series = series.persist(StorageLevel.MEMORY_AND_DISK)
        check_active(series, min_timeseries)
    return series.join(sized_broadcast(groups.select(G, "d0", "d1")), G).select(G, TS, "active", "entries", "d0", "d1")

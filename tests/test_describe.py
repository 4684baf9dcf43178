import datetime as dt

from conftest import make_panel
from plain_forms import avg_rank, pct_rank_nonnull
from pyspark.sql import functions as F

from peerpanel.operators import describe as DS

D = dt.date.fromisoformat


def prepared(spark, rows):
    return make_panel(spark, rows).withColumn("active", F.lit(True))


def test_running_distinct_and_new(spark):
    p = prepared(spark, [("a", "2024-01-01", 1), ("b", "2024-01-01", 0), ("b", "2024-01-02", 1),
                         ("a", "2024-01-02", 0), ("a", "2024-01-03", 1), ("b", "2024-01-03", 0)])
    w = DS.summary_count_wide(p).orderBy("date").collect()
    assert [r.timeseries_total for r in w] == [1, 2, 2]
    assert [r.timeseries_active_new for r in w] == [None, 1, 0]
    assert [r.timeseries_active for r in w] == [1, 1, 1]


def test_summary_count_long_keeps_nulls(spark):
    p = prepared(spark, [("a", "2024-01-01", 1), ("a", "2024-01-02", 2)])
    long = DS.desc_summary_count(p)
    assert long.count() == 14
    plot = DS.desc_summary_count_plot(long).collect()
    assert all(r.value is not None for r in plot)
    assert {r.type for r in plot} == {"count_total", "timeseries"}


def test_single_series_per_date_stats(spark):
    p = prepared(spark, [("a", "2024-01-01", 3)])
    got = {r.name: r.value for r in DS.desc_summary_stats(p).collect()}
    assert got["count_sd"] is None and got["count_median"] == 3.0
    q = DS.desc_quantile_timeseries(p, "2024-01-01").first()
    assert q["mean_percentile"] is None


def test_avg_rank_ties_desc(spark):
    df = spark.createDataFrame([("g", 3.0), ("g", 3.0), ("g", 1.0), ("g", None)], "g string, x double")
    got = sorted((r.x is None, r.r) for r in df.select("x", avg_rank("x", ["g"], True).alias("r"))
                 .collect())
    assert got == [(False, 1.5), (False, 1.5), (False, 3.0), (True, None)]


def test_pct_rank_nonnull(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", None), ("h", 5.0)], "g string, x double")
    got = {(r.g, r.x): r.pr for r in df.select("g", "x", pct_rank_nonnull("x", ["g"]).alias("pr"))
           .collect()}
    assert got[("g", 1.0)] == 0.0 and got[("g", 2.0)] == 1.0
    assert got[("g", None)] is None and got[("h", 5.0)] is None


def _ntile_both(spark, p, split):
    from pyspark.sql import Window

    t = DS.trim_leading_zeros(p).withColumn("period", F.when(F.col("date") <= split, "pre").otherwise("post"))
    t = t.withColumn("med_count", F.median("count").over(Window.partitionBy("group_id", "period", "ts_id")))
    fast = DS._ntile_cells(t, ["group_id", "period"], "med_count", ["active", "ts_id"], 3, "q")
    slow = t.withColumn("q", F.ntile(3).over(Window.partitionBy("group_id", "period").orderBy(
        "med_count", "date", "active", "ts_id")))
    key = lambda r: (r.date, r["count"], r.q, r._k)
    want = slow.groupBy("date", "count", "q").agg(F.count("*").alias("_k"))
    assert sorted(map(key, fast.collect())) == sorted(map(key, want.collect()))


def test_quantile_ntile_matches_window(spark):
    """The split ntile equals a plain ntile window (brute force)."""
    rows = [(f"s{i}", f"2024-01-{d:02d}", (i * 7 + d * 3) % 5) for i in range(9) for d in range(1, 8)]
    _ntile_both(spark, prepared(spark, rows), "2024-01-04")


def test_quantile_ntile_with_one_common_median(spark):
    """99 % of the series share one median: its cells are cut by range."""
    rows = [(f"s{i:03d}", f"2024-01-{d:02d}", 5 if i < 198 else i + d) for i in range(200) for d in range(1, 5)]
    _ntile_both(spark, prepared(spark, rows), "2024-01-02")

import datetime as dt

import pytest
from conftest import make_panel
from pyspark.sql import functions as F

from peerpanel.errors import PanelError
from peerpanel.functions.calendar import floor_period, month_steps
from peerpanel.operators import describe as DS
from peerpanel.operators.prepare import bucket_sum, default_periods, prepare_panel

D = dt.date.fromisoformat


def test_sunday_week(spark):
    df = spark.createDataFrame([(D("2024-01-06"),), (D("2024-01-07"),)], "d date")
    got = [r[0] for r in df.select(floor_period("d", "week")).collect()]
    assert got == [D("2023-12-31"), D("2024-01-07")]


def test_month_floor_and_day(spark):
    df = spark.createDataFrame([(D("2024-02-29"),)], "d date")
    r = df.select(floor_period("d", "month"), floor_period("d", "day")).first()
    assert r[0] == D("2024-02-01") and r[1] == D("2024-02-29")


def test_month_overflow_steps(spark):
    df = spark.createDataFrame([(D("2020-01-31"), D("2020-04-30"))], "a date, b date")
    got = df.select(month_steps("a", "b")).first()[0]
    assert got == [D("2020-01-31"), D("2020-03-02"), D("2020-03-31")]


def test_densify_range_and_fill(spark):
    p = make_panel(spark, [("a", "2024-01-05", 1), ("b", "2024-01-09", 2), ("b", "2024-03-01", 4)])
    out = prepare_panel(p, "2024-02-15", "month", 0, 0, 1).orderBy("ts_id", "date").collect()
    got = [(r.ts_id, r.date, r["count"]) for r in out]
    assert got == [("a", D("2024-01-01"), 1.0), ("a", D("2024-02-01"), 0.0),
                   ("a", D("2024-03-01"), 0.0), ("b", D("2024-01-01"), 2.0),
                   ("b", D("2024-02-01"), 0.0), ("b", D("2024-03-01"), 4.0)]


def test_active_boundary_counts_as_pre(spark):
    p = make_panel(spark, [("a", "2024-01-01", 1), ("a", "2024-02-01", 1),
                           ("b", "2024-02-01", 1)])
    out = {r.ts_id: r.active for r in
           prepare_panel(p, "2024-01-01", "month", 1, 1, 1).select("ts_id", "active").distinct()
           .collect()}
    assert out == {"a": True, "b": False}


def test_checks_raise(spark):
    p = make_panel(spark, [("a", "2024-01-01", 1), ("a", "2024-02-01", 1),
                           ("b", "2024-02-01", 1), ("c", "2024-02-01", 1)])
    with pytest.raises(PanelError, match="not within"):
        prepare_panel(p, "2025-01-01", "month", 0, 0, 1)
    with pytest.raises(PanelError, match="minimum number of timeseries"):
        prepare_panel(p, "2024-01-15", "month", 1, 0, 2)
    with pytest.raises(PanelError, match="not enough rows"):
        prepare_panel(p, "2024-01-15", "month", 1, 0, 5)


def test_default_periods_count_months(spark):
    p = make_panel(spark, [("a", f"2024-{m:02d}-10", 1) for m in range(1, 13)])
    r = default_periods(p, "2024-06-30").first()
    assert (r.min_pre_periods, r.min_post_periods) == (3, 1)


def test_bucket_sum(spark):
    p = make_panel(spark, [("a", "2024-01-06", 1), ("a", "2024-01-07", 2), ("a", "2024-01-08", 4)])
    got = sorted((r.date, r["count"]) for r in bucket_sum(p, "week").collect())
    assert got == [(D("2023-12-31"), 1.0), (D("2024-01-07"), 6.0)]


def test_trim_leading_zeros_and_negative(spark):
    p = make_panel(spark, [("a", "2024-01-01", 0), ("a", "2024-01-02", 0), ("a", "2024-01-03", 3),
                           ("a", "2024-01-04", 0), ("b", "2024-01-01", 5), ("b", "2024-01-02", -5),
                           ("b", "2024-01-03", 2)])
    p = p.withColumn("active", F.lit(True))
    got = sorted((r.ts_id, r.date.day, r["count"]) for r in DS.trim_leading_zeros(p).collect())
    assert got == [("a", 3, 3.0), ("a", 4, 0.0), ("b", 1, 5.0), ("b", 3, 2.0)]

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from peerpanel.functions.ranking import avg_ranks, pct_ranks
from plain_forms import avg_rank, pct_rank_nonnull


def test_cell_ranks_equal_window_ranks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in ("a", "b"):
        for i in range(400):
            v = float(rng.integers(0, 7)) if i % 3 else float(rng.normal())
            rows.append((g, f"{g}{i}", None if i % 17 == 0 else v))
    rows.append(("c", "c0", 1.0))
    df = spark.createDataFrame(rows, "g string, id string, x double")
    fast = pct_ranks(avg_ranks(df, ["id"], ["g"], [("x", "ar", True)]), ["g"], [("x", "pr")], ["id"])
    slow = df.select("g", "id", avg_rank("x", ["g"], True).alias("ar2"),
                     pct_rank_nonnull("x", ["g"]).alias("pr2"))
    j = fast.join(slow, ["g", "id"]).collect()
    assert len(j) == len(rows)
    for r in j:
        assert (r.ar is None) == (r.ar2 is None) and (r.ar is None or abs(r.ar - r.ar2) < 1e-9)
        assert (r.pr is None) == (r.pr2 is None) and (r.pr is None or abs(r.pr - r.pr2) < 1e-12)


def test_tie_runs_cross_many_ranges(spark):
    """One value in most rows, in more ranges than one, and several metrics at once."""
    rng = np.random.default_rng(9)
    rows = [("ab"[i % 5 == 0], f"s{i}", 5.0 if i % 4 else float(rng.integers(0, 11)), None if i % 3 else float(i % 2))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id string, x double, y double").repartition(7)
    fast = avg_ranks(df, ["id"], ["g"], [("x", "up", False), ("x", "down", True), ("y", "yr", False)])
    slow = df.select("g", "id", avg_rank("x", ["g"]).alias("up2"), avg_rank("x", ["g"], True).alias("down2"),
                     avg_rank("y", ["g"]).alias("yr2"))
    j = fast.join(slow, ["g", "id"])
    assert j.count() == 3000
    assert j.where("not (up <=> up2 and down <=> down2 and yr <=> yr2)").count() == 0


def test_medians_match_builtin(spark):
    """Counts below or at -1 have no logarithm; both medians from one table."""
    import datetime as dt

    from peerpanel.operators.describe import desc_summary_stats

    rng = np.random.default_rng(4)
    rows = [("g", f"s{i}", True, dt.date(2024, 1, 1 + i % 5), float(rng.integers(-3, 9)) or 1.0) for i in range(203)]
    p = spark.createDataFrame(rows, "group_id string, ts_id string, active boolean, date date, count double")
    got = {(r.date, r.name): r.value for r in desc_summary_stats(p).collect()}
    log = F.when(F.col("count") > -1, F.log10(F.col("count") + 1))
    for r in p.groupBy("date").agg(F.median("count").alias("m"), F.median(log).alias("l")).collect():
        assert abs(got[(r.date, "count_median")] - r.m) < 1e-12
        assert abs(got[(r.date, "count_log10_median")] - r.l) < 1e-12


def test_positions_equal_row_numbers(spark):
    from peerpanel.functions.ranking import positions

    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], float(rng.integers(0, 3)), f"s{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, id string").repartition(5)
    slow = F.row_number().over(Window.partitionBy("g").orderBy("x", "id"))
    j = positions(df, ["g"], ["x", "id"], "p").withColumn("q", slow)
    assert j.count() == 900 and j.where("p <> q").count() == 0


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from peerpanel.session import sized_broadcast

    small = spark.range(50).withColumn("t", F.repeat(F.lit("x"), 1000))
    plan = lambda df: spark.range(50).hint("merge").join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(sized_broadcast(small))
    assert "strategy=broadcast" not in plan(sized_broadcast(small, max_bytes=40_000))
    assert "strategy=broadcast" not in plan(sized_broadcast(small, max_rows=49))
    assert sized_broadcast(small.limit(0)).count() == 0

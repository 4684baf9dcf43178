import glob
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerpanel.errors import PanelError
from peerpanel.operators.prepare import prepare_panel
from peerpanel.plans import pipeline
from peerpanel.plans.pipeline import ts_analysis
from peerpanel.sources import store


def _panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    dates = pd.date_range("2023-01-01", periods=24, freq="MS")
    for g in ("east", "west"):
        for s in range(8):
            for k, d in enumerate(dates):
                base = 40 if k < 12 else 70
                rows.append((g, f"{g}{s}", d.date(), float(rng.poisson(base))))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["group_id", "ts_id", "date", "count"]))


def test_pipeline_detects_start_and_caches(spark):
    data = _panel(spark)
    out_dir = tempfile.mkdtemp(prefix="pp-run-")
    res = ts_analysis(data, start_date=None, period="month", min_timeseries=5, method="ratio",
                      out_dir=out_dir)
    starts = {r.group_id: r.pre_end for r in res["models"].pre_end.collect()}
    assert set(starts) == {"east", "west"}
    summary = res["model_summary"].collect()
    assert len(summary) == 16
    for name in ("model_summary", "desc_summary_stats", "model_ts_rank"):
        assert glob.glob(os.path.join(out_dir, "output", name, "version=*", "group_id=east", "*.csv"))
    # same arguments: both caches are read back, outputs identical
    res2 = ts_analysis(data, start_date=None, period="month", min_timeseries=5, method="ratio",
                       out_dir=out_dir, use_cache=True, gen_output=False)
    a = sorted((r.ts_id, round(r.AbsEffect_Cumulative, 9)) for r in summary)
    b = sorted((r.ts_id, round(r.AbsEffect_Cumulative, 9)) for r in res2["models"].effects.collect())
    assert a == b


def _effects(models):
    return sorted((r.group_id, r.ts_id, round(r.AbsEffect_Cumulative, 9)) for r in models.effects.collect())


RUN = dict(period="month", min_pre_periods=4, min_post_periods=2, min_timeseries=3, method="ratio")


def test_groups_share_a_root_and_caches_follow_their_start(spark):
    data = _panel(spark)
    root = tempfile.mkdtemp(prefix="pp-run-")
    run = lambda g, start, **kw: ts_analysis(
        data.where(data.group_id == g), start_date=spark.createDataFrame([(g, start)], "group_id string, start_date string"),
        out_dir=root, use_cache=True, **RUN, **kw)
    east = run("east", "2023-12-01")
    want = _effects(east["models"])
    prepared = east["prepared_panel"].count()
    west = run("west", "2023-12-01")
    assert {r.group_id for r in west["prepared_panel"].select("group_id").distinct().collect()} == {"west"}
    summary = store.read_output(spark, root, "model_summary")
    assert {r.group_id for r in summary.select("group_id").distinct().collect()} == {"east", "west"}
    # cached, from the shared root, the other group's run in between
    again = run("east", "2023-12-01", gen_output=False)
    assert _effects(again["models"]) == want and again["prepared_panel"].count() == prepared
    # another start date of the same group is another run
    moved = run("east", "2024-03-01", gen_output=False)
    fresh = ts_analysis(data.where("group_id = 'east'"), start_date="2024-03-01", gen_output=False, **RUN)
    assert _effects(moved["models"]) == _effects(fresh["models"]) != want


SINKS = ("desc_summary_count", "desc_summary_stats", "desc_quantile_timeseries", "model_summary",
         "model_summary_timeseries", "model_group_timeseries", "model_ts_peers", "model_ts_rank")


def _plain(rows, cols):
    return sorted(tuple(repr(r[c]) for c in cols) for r in rows)


def _files(root, name, group):
    """Rows of a group's sink in file order."""
    parts = sorted(glob.glob(os.path.join(root, "output", name, "version=*", f"group_id={group}", "*.csv")))
    return pd.concat([pd.read_csv(f, dtype={"ts_id": str, "target_ts_id": str}) for f in parts], ignore_index=True)


def test_all_sinks_read_back_in_order(spark):
    """Contents of the eight sinks, their order, and an empty second run."""
    data = _panel(spark)
    jump = F.when((F.col("ts_id") == "east3") & (F.col("date") > "2023-12-01"), F.col("count") * 4 + 100).otherwise(F.col("count"))
    calm, data = data, data.withColumn("count", jump)
    root = tempfile.mkdtemp(prefix="pp-run-")
    args = {**RUN, "method": "ridge", "sig_p": 1e-3}
    out = ts_analysis(data, start_date="2023-12-01", out_dir=root, **args)
    assert out["model_ts_peers"].where("group_id = 'east'").count() > 0
    for name in SINKS:
        got = store.read_output(spark, root, name)
        assert got.dtypes == out[name].dtypes
        assert _plain(got.collect(), got.columns) == _plain(out[name].collect(), got.columns) != []
    for g in ("east", "west"):
        assert _files(root, "model_summary", g).p_Cumulative.is_monotonic_increasing
        f = _files(root, "model_summary_timeseries", g)
        assert list(zip(f.date, f.point_perf)) == sorted(zip(f.date, f.point_perf))
        f = _files(root, "model_ts_rank", g)
        assert f[["count_mean_pctile_rank", "count_mean_rank", "count_smooth_rank", "count_smooth_pctile_rank"]] \
            .sum(axis=1, skipna=False).dropna().is_monotonic_increasing
    f = _files(root, "model_ts_peers", "east")
    for _, one in f.groupby("target_ts_id"):
        assert one.inclusion_prob.is_monotonic_decreasing and one.inclusion_prob.nunique() > 1
        for _, same in one.groupby("inclusion_prob"):
            assert same.positive_prob.dropna().is_monotonic_decreasing
    # nothing deviates in a second run of one group: its peers are gone, those of the other stay
    before = {r[0]: r[1] for r in store.read_output(spark, root, "model_ts_peers").groupBy("group_id").count().collect()}
    ts_analysis(calm.where("group_id = 'east'"), start_date="2023-12-01", out_dir=root, only=["model_ts_peers"],
                **{**args, "sig_p": 1e-12})
    after = {r[0]: r[1] for r in store.read_output(spark, root, "model_ts_peers").groupBy("group_id").count().collect()}
    assert before["east"] > 0 and after == {g: n for g, n in before.items() if g != "east"}
    assert store.read_output(spark, root, "model_summary").count() == 16     # not part of the second run


@pytest.mark.parametrize("broken", ["data", "commit"])
def test_broken_writes_never_give_a_hit(spark, monkeypatch, broken):
    """A run that breaks off after its data or before its commit leaves the caches
    and sinks as they were; its own arguments are not cached."""
    data = _panel(spark).where("group_id = 'east'")
    root = tempfile.mkdtemp(prefix="pp-run-")
    run = lambda start, **kw: ts_analysis(data, start_date=start, out_dir=root, only=["model_summary"],
                                          **{**RUN, **kw})
    first = run("2023-12-01")
    want, panel = _effects(first["models"]), first["prepared_panel"].count()
    sink = store.read_output(spark, root, "model_summary").collect()
    real, calls = store.save, []

    def breaks(root, tables, args, fmt="parquet"):
        calls.append(root)
        if broken == "data":                # the data of the first table only
            name = next(iter(tables))
            tables[name].write.mode("overwrite").partitionBy("group_id").format(fmt).save(f"{root}/{name}/version=half")
            raise OSError("lost")
        with monkeypatch.context() as m:
            m.setattr(store.time, "time_ns", lambda: 1 / 0)
            real(root, tables, args, fmt)

    with monkeypatch.context() as m:
        m.setattr(store, "save", breaks)
        with pytest.raises((OSError, ZeroDivisionError)):
            run("2024-03-01")
    assert calls
    again = run("2023-12-01", use_cache=True, gen_output=False)
    assert _effects(again["models"]) == want and again["prepared_panel"].count() == panel
    assert store.read_output(spark, root, "model_summary").collect() == sink
    built = []
    real_fit = pipeline.IM.fit_models
    monkeypatch.setattr(pipeline.IM, "fit_models", lambda *a, **k: built.append(1) or real_fit(*a, **k))
    moved = run("2024-03-01", use_cache=True, gen_output=False)
    fresh = ts_analysis(data, start_date="2024-03-01", gen_output=False, **RUN)
    assert _effects(moved["models"]) == _effects(fresh["models"]) != want and len(built) == 2
    run("2024-03-01", use_cache=True, gen_output=False)
    run("2023-12-01", use_cache=True, gen_output=False)            # both versions are still there
    assert len(built) == 2


def test_no_group_vanishes(spark):
    flat = [("flat", f"f{s}", d.date(), 5.0) for s in range(5) for d in pd.date_range("2023-01-01", periods=24, freq="MS")]
    data = _panel(spark).unionByName(spark.createDataFrame(
        pd.DataFrame(flat, columns=["group_id", "ts_id", "date", "count"])))
    out = ts_analysis(data, start_date=None, gen_output=False, **RUN)
    assert [r.group_id for r in out["skipped_groups"].collect()] == ["flat"]
    assert {r.group_id for r in out["models"].effects.select("group_id").distinct().collect()} == {"east", "west"}
    starts = spark.createDataFrame([("east", "2023-12-01"), ("west", "2023-12-01")], "group_id string, start_date string")
    with pytest.raises(PanelError, match="flat"):
        ts_analysis(data, start_date=starts, **RUN)
    with pytest.raises(PanelError, match="east"):
        ts_analysis(_panel(spark), start_date=starts.union(starts), **RUN)


def test_bad_rows_are_errors(spark):
    data = _panel(spark)
    for col in ("date", "count"):
        bad = data.withColumn(col, F.when(F.col("ts_id") != "east1", F.col(col)))
        with pytest.raises(PanelError, match="east"):
            prepare_panel(bad, "2023-12-01", "month", 4, 2, 3)
    with pytest.raises(PanelError, match="group_id"):
        ts_analysis(data, group_id="x", start_date="2023-12-01")

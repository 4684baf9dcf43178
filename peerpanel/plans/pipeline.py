"""End-to-end analysis: change date (if needed) -> prepared panel ->
per-series models -> result tables, for any number of groups at once.

``ts_analysis`` returns a dict of DataFrames; with ``out_dir`` it also
keeps the parquet caches and writes every result table as CSV.
"""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError
from ..operators import changepoint as CP
from ..operators import describe as DS
from ..operators import impact as IM
from ..operators import report as RP
from ..operators.lowess import lowess_series
from ..operators.prepare import G, check_starts, prepare_panel, start_param
from ..operators.ridge import DRAWS
from ..session import reuse
from ..sources import store
from ..sources.panel import panel as to_panel

MODEL_TABLES = ("effects", "series", "coefs")


def resolve_start(p: DataFrame, start_date):
    """``(start, skipped)``: the given start date, or per group the detected
    change date and the groups in which none was found."""
    if start_date is not None:
        return start_date, None
    cpt = CP.detect_changepoint(p, num_cpts=1)
    cpt = reuse(cpt.select(G, F.col("change_date").alias("start_date")))
    if not cpt.limit(1).count():
        raise PanelError("start_date not specified and no change point detected")
    warnings.warn("start_date not specified, using the detected change date per group",
                  stacklevel=3)
    skipped = reuse(p.select(G).distinct().join(cpt, G, "left_anti")
                    .withColumn("reason", F.lit("no change point detected")))
    n = skipped.count()
    if n:
        warnings.warn(f"{n} groups without a change point are left out: see skipped_groups",
                      stacklevel=3)
    return cpt, skipped


def run_groups(p: DataFrame, start) -> DataFrame:
    """``(group_id, start_date)`` of every group of this run."""
    groups, sp = p.select(G).distinct(), start_param(start)
    if isinstance(sp, DataFrame):
        check_starts(groups, sp)
        return groups.join(sp, G)
    return groups.withColumn("start_date", F.lit(sp["start_date"]))


def generate_output(m: IM.Models, p: DataFrame, top_timeseries: int = 5, only=None) -> dict:
    """The result tables, or those named in ``only``. The report start date is,
    per group, the last bucket on or before the analysis start date
    (``m.pre_end``)."""
    start = (m.pre_end.withColumnRenamed("pre_end", "start_date")
             if isinstance(m.pre_end, DataFrame) else m.pre_end["pre_end"])
    kept: dict = {}

    def once(name, build):
        if name not in kept:
            kept[name] = build()
        return kept[name]

    summary = lambda: once("summary", lambda: reuse(RP.model_summary(m)))
    counts = lambda: once("counts", lambda: DS.desc_summary_count(p))
    ranked = lambda: once("ranked", lambda: RP.model_ts_rank(m, p, summary(), reuse(lowess_series(p))))
    peers = lambda: once("peers", lambda: RP.peer_contributions(m, summary()))
    tables = {
        "desc_summary_count": counts,
        "desc_summary_count_plot": lambda: DS.desc_summary_count_plot(counts()),
        "desc_summary_stats": lambda: DS.desc_summary_stats(p),
        "desc_quantile_timeseries": lambda: DS.desc_quantile_timeseries(p, start),
        "model_summary": summary,
        "deviance_counts": lambda: RP.deviance_counts(summary()),
        "model_summary_timeseries": lambda: RP.model_summary_timeseries(m),
        "model_group_timeseries": lambda: RP.model_group_timeseries(m, summary()),
        "deviance_mean_sd": lambda: RP.deviance_mean_sd(m, summary()),
        "model_ts_rank": ranked,
        "model_ts_rank_top": lambda: RP.model_ts_rank_top(ranked(), top_timeseries),
    }
    if m.design is not None:
        tables |= {"model_ts_peers": peers, "model_ts_peers_plot": lambda: RP.peer_plot_rows(peers())}
    return {name: build() for name, build in tables.items() if only is None or name in only}


def stored_models(tables: dict, prepared: DataFrame, start, period: str, sig_p: float, method: str,
                  **model_kw) -> IM.Models:
    """Models from their stored tables."""
    design, niter = None, 0
    if method == "ridge":
        niter = model_kw.get("draws", DRAWS)
        design = IM.series_arrays(IM.model_rows(prepared, start)).withColumnRenamed("ts_id", "peer_ts_id")
    return IM.Models(*(tables[n] for n in MODEL_TABLES), IM.pre_end_table(prepared, start, period), sig_p, niter, design)


def ts_analysis(data: DataFrame, group_id: str | None = None, start_date=None,
                period: str = "month", min_pre_periods: int | None = None,
                min_post_periods: int | None = None, min_timeseries: int = 30,
                sig_p: float = 0.05, method: str = "ridge", out_dir: str | None = None,
                save_model_data: bool = True, save_model: bool = True,
                gen_output: bool = True, use_cache: bool = False,
                top_timeseries: int = 5, only=None, **model_kw) -> dict:
    """Run the whole analysis.

    ``data`` has ``date, ts_id, count`` and optionally ``group_id``; without
    that column all rows form one group named ``group_id`` (default: a run
    id from the clock). ``start_date`` may be a date, a ``(group_id,
    start_date)`` DataFrame, or None to detect one change date per group.
    ``only`` names the result tables to build (default: all).
    Returns ``{"prepared_panel", "models", <result tables>...}``.
    """
    if "group_id" in data.columns:
        if group_id is not None:
            raise PanelError("data has a group_id column: do not pass group_id as well")
        p = to_panel(data, group_id="group_id")
    else:
        gid = group_id if group_id is not None else str(dt.datetime.now().timestamp())
        p = to_panel(data, group_value=str(gid))
    start, skipped = resolve_start(p, start_date)
    if skipped is not None:
        p = p.join(skipped.select(G), G, "left_anti")
    spark = p.sparkSession
    groups = reuse(run_groups(p, start))
    args = store.group_args(groups, dict(period=period, min_pre=min_pre_periods, min_post=min_post_periods,
                                         min_timeseries=min_timeseries))
    prepared = store.cached(
        spark, out_dir and f"{out_dir}/panel", args,
        lambda: {"rows": prepare_panel(p, start, period, min_pre_periods, min_post_periods, min_timeseries)},
        use_cache, save_model_data)["rows"]
    if out_dir is None or not save_model_data:
        prepared = reuse(prepared)
    margs = store.group_args(groups, dict(
        period=period, min_pre=min_pre_periods, min_post=min_post_periods, min_timeseries=min_timeseries,
        sig_p=sig_p, method=method, **{k: str(v) for k, v in model_kw.items()}))
    fitted: list[IM.Models] = []

    def fit():
        fitted.append(IM.fit_models(prepared, start, period, alpha=sig_p, method=method, **model_kw))
        return {name: getattr(fitted[0], name) for name in MODEL_TABLES}

    tables = store.cached(spark, out_dir and f"{out_dir}/models", margs, fit, use_cache, save_model)
    if fitted and (out_dir is None or not save_model):
        m = fitted[0]
    else:
        m = stored_models(tables, prepared, start, period, sig_p, method, **model_kw)
    result = {"prepared_panel": prepared, "models": m}
    if skipped is not None:
        result["skipped_groups"] = skipped
    if gen_output:
        out = generate_output(m, prepared, top_timeseries, only)
        result.update(out)
        if out_dir is not None:
            store.write_outputs(out, out_dir, groups)
    return result

"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables in ``sf_dir`` in full. Double columns
are rounded to 6 places for the comparison with the SQL oracle.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles
from ..session import checkpoint_dir, reuse
from ..operators import changepoint as CP
from ..operators import describe as DS
from ..operators import impact as IM
from ..operators import lowess as LO
from ..operators import peers as PE
from ..operators import report as RP
from ..operators import prepare as PR
from ..sources import panel as SRC
from . import params as P


def raw_panel(spark: SparkSession, sf_dir: str, cfg: dict) -> DataFrame:
    kind = cfg["panel"]
    if kind == "A":
        return SRC.supplier_panel(spark, sf_dir)
    if kind == "A_nation":
        return SRC.supplier_panel(spark, sf_dir, by_nation=True)
    if kind == "B":
        return SRC.user_panel(spark, sf_dir)
    if kind == "C":
        return SRC.customer_panel(spark, sf_dir)
    if kind == "C_segment":
        return SRC.customer_panel(spark, sf_dir, by_segment=True)
    raise KeyError(kind)


def prepared(spark, sf_dir, cfg, validate=True) -> DataFrame:
    """Prepared panel, materialised once: every table below reads it
    several times (as the pipeline does)."""
    return reuse(PR.prepare_panel(raw_panel(spark, sf_dir, cfg), cfg["start"], cfg["period"],
                                  cfg["min_pre"], cfg["min_post"], cfg["min_ts"],
                                  validate=validate))


def prepared_series(spark, sf_dir, cfg) -> DataFrame:
    """The prepared panel with one row per series, materialised once: its size is that of
    the present buckets."""
    return reuse(PR.prepare_series(raw_panel(spark, sf_dir, cfg), cfg["start"], cfg["period"],
                                   cfg["min_pre"], cfg["min_post"], cfg["min_ts"]))


def _bucket_sum(spark, sf_dir, cfg):
    return PR.bucket_sum(raw_panel(spark, sf_dir, cfg), cfg["period"])


def _default_periods(spark, sf_dir, cfg):
    return PR.default_periods(raw_panel(spark, sf_dir, cfg), cfg["start"])


def _active_flag(spark, sf_dir, cfg):
    raw = raw_panel(spark, sf_dir, cfg)
    params = PR.run_params(raw, cfg["start"], cfg["min_pre"], cfg["min_post"])
    return (PR.series_activity(PR.bucket_sum(raw, cfg["period"]), params)
            .select("group_id", "ts_id", "n_pre", "n_post", "active"))


def _prepare(spark, sf_dir, cfg):
    return prepared(spark, sf_dir, cfg)


def _trim(spark, sf_dir, cfg):
    return DS.trim_leading_zeros(prepared(spark, sf_dir, cfg))


def _summary_count(spark, sf_dir, cfg):
    return DS.desc_summary_count(prepared(spark, sf_dir, cfg))


def _summary_count_plot(spark, sf_dir, cfg):
    return DS.desc_summary_count_plot(DS.desc_summary_count(prepared(spark, sf_dir, cfg)))


def _running_distinct(spark, sf_dir, cfg):
    return DS.running_distinct_series(prepared_series(spark, sf_dir, cfg), cfg["period"])


def _summary_stats(spark, sf_dir, cfg):
    return DS.desc_summary_stats(prepared(spark, sf_dir, cfg))


def _quantile_ts(spark, sf_dir, cfg):
    p = prepared_series(spark, sf_dir, cfg)
    return DS.desc_quantile_timeseries(p, DS.last_pre_bucket(cfg["start"], cfg["period"]), bucket=cfg["period"])


def _month_complete(spark, sf_dir, cfg):
    return CP.group_total_month_complete(raw_panel(spark, sf_dir, cfg))


def _changepoint(spark, sf_dir, cfg):
    return CP.detect_changepoint(raw_panel(spark, sf_dir, cfg), num_cpts=1)


def _changepoint_2(spark, sf_dir, cfg):
    return CP.detect_changepoint(raw_panel(spark, sf_dir, cfg), num_cpts=2)


def _changepoint_3(spark, sf_dir, cfg):
    return CP.detect_changepoint(raw_panel(spark, sf_dir, cfg), num_cpts=3, include_model=True)


def _changepoint_nested(spark, sf_dir, cfg):
    return CP.explode_data(CP.detect_changepoint(raw_panel(spark, sf_dir, cfg), include_data=True))


def ratio(spark, sf_dir, cfg):
    p = prepared(spark, sf_dir, cfg)
    return IM.ratio_models(p, cfg["start"], alpha=0.05, period=cfg["period"])


def _ratio_effects(spark, sf_dir, cfg):
    return ratio(spark, sf_dir, cfg).effects


def _ratio_series(spark, sf_dir, cfg):
    return ratio(spark, sf_dir, cfg).series


def _model_summary(spark, sf_dir, cfg):
    return RP.model_summary(ratio(spark, sf_dir, cfg))


def _deviance_counts(spark, sf_dir, cfg):
    return RP.deviance_counts(RP.model_summary(ratio(spark, sf_dir, cfg)))


def _summary_timeseries(spark, sf_dir, cfg):
    return RP.model_summary_timeseries(ratio(spark, sf_dir, cfg))


def _group_timeseries(spark, sf_dir, cfg):
    return RP.model_group_timeseries(ratio(spark, sf_dir, cfg))


def _deviance_mean_sd(spark, sf_dir, cfg):
    return RP.deviance_mean_sd(ratio(spark, sf_dir, cfg))


def _select_peers(spark, sf_dir, cfg):
    p = prepared(spark, sf_dir, cfg)
    return PE.select_peers(PE.active_rows(p, cfg["start"]), P.MAX_PEERS)


def _peer_design(spark, sf_dir, cfg):
    return PE.peer_design(prepared(spark, sf_dir, cfg), cfg["start"], P.MAX_PEERS)


def _standardize(spark, sf_dir, cfg):
    from ..functions.columns import standardize
    s = ratio(spark, sf_dir, cfg).series
    return s.select("group_id", "ts_id", "date",
                    standardize("response", ["group_id", "ts_id"]).alias("scaled_response"))


def _lowess(spark, sf_dir, cfg):
    return LO.lowess_smooth(prepared_series(spark, sf_dir, cfg), period=cfg["period"])


def _pre_post(spark, sf_dir, cfg):
    p = prepared(spark, sf_dir, cfg)
    return RP.pre_post_stats(p, IM.pre_end_table(p, cfg["start"], cfg["period"]))


def _ts_rank(spark, sf_dir, cfg):
    p = prepared(spark, sf_dir, cfg)
    return RP.model_ts_rank(IM.ratio_models(p, cfg["start"], period=cfg["period"]), p)


def _ts_rank_top(spark, sf_dir, cfg):
    return RP.model_ts_rank_top(_ts_rank(spark, sf_dir, cfg), 5)


def ridge(spark, sf_dir, cfg):
    p = prepared(spark, sf_dir, cfg)
    return IM.fit_models(p, cfg["start"], cfg["period"], alpha=0.05)


def _ridge_effects(spark, sf_dir, cfg):
    return RP.model_summary(ridge(spark, sf_dir, cfg))


def _ridge_series(spark, sf_dir, cfg):
    return ridge(spark, sf_dir, cfg).series


def _peer_coef_stats(spark, sf_dir, cfg):
    m = ridge(spark, sf_dir, cfg)
    return RP.peer_coef_stats(m.peers(m.effects), m.niter)


def _ts_peers(spark, sf_dir, cfg):
    # rounded there: its pairs repeat every count once per target
    return RP.peer_contributions(ridge(spark, sf_dir, cfg), all_peers=True, digits=6)


def _ts_peers_deviating(spark, sf_dir, cfg):
    return RP.peer_contributions(ridge(spark, sf_dir, cfg))


def _ts_peers_plot(spark, sf_dir, cfg):
    return RP.peer_plot_rows(_ts_peers_deviating(spark, sf_dir, cfg))


def _ts_analysis(spark, sf_dir, cfg, table="model_summary"):
    from . import pipeline as PL
    out = PL.ts_analysis(raw_panel(spark, sf_dir, cfg), start_date=cfg["start"],
                         period=cfg["period"], min_pre_periods=cfg["min_pre"],
                         min_post_periods=cfg["min_post"], min_timeseries=cfg["min_ts"], only=[table])
    return out[table]


def _stored(spark, sf_dir, cfg):
    """A result table as the CSV sinks hold it, after a second run that reads the
    caches of the first."""
    from ..sources import store
    from . import pipeline as PL
    out_dir = f"{checkpoint_dir(spark) or 'file://' + tempfile.mkdtemp(prefix='panel-')}/stored-{uuid.uuid4().hex}"
    for use_cache in (False, True):
        PL.ts_analysis(raw_panel(spark, sf_dir, cfg), start_date=cfg["start"], period=cfg["period"],
                       min_pre_periods=cfg["min_pre"], min_post_periods=cfg["min_post"], min_timeseries=cfg["min_ts"],
                       only=[cfg["table"]], out_dir=out_dir, use_cache=use_cache, gen_output=use_cache)
    return store.read_output(spark, out_dir, cfg["table"])


def _pipeline_table(spark, sf_dir, cfg):
    return _ts_analysis(spark, sf_dir, cfg, cfg["table"])


BUILDERS = {
    "q_select_peers": _select_peers,
    "q_lowess": _lowess,
    "q_peer_design": _peer_design,
    "q_standardize": _standardize,
    "q_pre_post": _pre_post,
    "q_ts_rank": _ts_rank,
    "q_ts_rank_top": _ts_rank_top,
    "q_ridge_effects": _ridge_effects,
    "q_ridge_series": _ridge_series,
    "q_peer_coef_stats": _peer_coef_stats,
    "q_ts_peers": _ts_peers,
    "q_ts_peers_deviating": _ts_peers_deviating,
    "q_ts_peers_plot": _ts_peers_plot,
    "q_ts_analysis": _ts_analysis,
    "q_pipeline": _pipeline_table,
    "q_stored": _stored,
    "q_ratio_effects": _ratio_effects,
    "q_ratio_series": _ratio_series,
    "q_model_summary": _model_summary,
    "q_deviance_counts": _deviance_counts,
    "q_summary_timeseries": _summary_timeseries,
    "q_group_timeseries": _group_timeseries,
    "q_deviance_mean_sd": _deviance_mean_sd,
    "q_month_complete": _month_complete,
    "q_changepoint": _changepoint,
    "q_changepoint_2": _changepoint_2,
    "q_changepoint_3": _changepoint_3,
    "q_changepoint_nested": _changepoint_nested,
    "q_bucket_sum": _bucket_sum,
    "q_default_periods": _default_periods,
    "q_active_flag": _active_flag,
    "q_prepare": _prepare,
    "q_trim": _trim,
    "q_summary_count": _summary_count,
    "q_summary_count_plot": _summary_count_plot,
    "q_running_distinct": _running_distinct,
    "q_summary_stats": _summary_stats,
    "q_quantile_ts": _quantile_ts,
}


def _rounded(fn, cfg, spark, sf_dir):
    out = fn(spark, sf_dir, cfg)
    return out if fn is _ts_peers else round_doubles(out)


def queries() -> dict:
    out = {}
    for name, (kind, cfg) in P.SQL_QUERIES.items():
        out[name] = partial(_rounded, BUILDERS[kind], cfg)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's main flow on the supplier x month panel: prepare,
    fit the ridge model per supplier, classify (model_summary)."""
    return _ts_analysis(spark, sf_dir, P.PANEL_A)

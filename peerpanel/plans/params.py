"""Panel configurations shared by the Spark queries and their SQL oracles.

Start dates and minimums follow the fixture notes: panel C needs explicit
minimums (its default ones leave no series active).
"""

PANEL_A = {"panel": "A", "period": "month", "start": "1999-12-31",
           "min_pre": None, "min_post": None, "min_ts": 5}
PANEL_A_NATION = {**PANEL_A, "panel": "A_nation", "min_ts": 1}
PANEL_A_DETECTED = {**PANEL_A_NATION, "start": None}
PANEL_B = {"panel": "B", "period": "day", "start": "2024-01-20",
           "min_pre": None, "min_post": None, "min_ts": 5}
PANEL_C = {"panel": "C", "period": "month", "start": "1999-06-30",
           "min_pre": 4, "min_post": 2, "min_ts": 5}
PANEL_C_SEGMENT = {**PANEL_C, "panel": "C_segment", "min_ts": 1}
PANEL_D = {"panel": "C", "period": "week", "start": "1999-06-30",
           "min_pre": 8, "min_post": 4, "min_ts": 5}

MAX_PEERS = 10

# query name -> (oracle builder, panel config)
SQL_QUERIES = {
    "bucket_sum_day": ("q_bucket_sum", PANEL_B),
    "bucket_sum_week": ("q_bucket_sum", PANEL_D),
    "bucket_sum_month": ("q_bucket_sum", PANEL_A),
    "default_periods": ("q_default_periods", PANEL_A),
    "default_periods_by_segment": ("q_default_periods", PANEL_C_SEGMENT),
    "active_flag": ("q_active_flag", PANEL_C),
    "prepare_panel": ("q_prepare", PANEL_C),
    "prepare_panel_day": ("q_prepare", PANEL_B),
    "prepare_panel_week": ("q_prepare", PANEL_D),
    "prepare_panel_supplier": ("q_prepare", PANEL_A),
    "prepare_panel_by_nation": ("q_prepare", PANEL_A_NATION),
    "trim_leading_zeros": ("q_trim", PANEL_C),
    "desc_summary_count": ("q_summary_count", PANEL_C),
    "desc_summary_count_by_segment": ("q_summary_count", PANEL_C_SEGMENT),
    "desc_summary_count_plot": ("q_summary_count_plot", PANEL_C),
    "running_distinct": ("q_running_distinct", PANEL_D),
    "desc_summary_stats": ("q_summary_stats", PANEL_C),
    "desc_summary_stats_supplier": ("q_summary_stats", PANEL_A),
    "desc_quantile_timeseries": ("q_quantile_ts", PANEL_C),
    "desc_quantile_timeseries_supplier": ("q_quantile_ts", PANEL_A),
    "desc_quantile_timeseries_week": ("q_quantile_ts", PANEL_D),
    "group_total_month_complete": ("q_month_complete", PANEL_A),
    "group_total_month_complete_day": ("q_month_complete", PANEL_B),
    "detect_changepoint": ("q_changepoint", PANEL_A),
    "detect_changepoint_orders": ("q_changepoint", PANEL_C),
    "detect_changepoint_by_segment": ("q_changepoint", PANEL_C_SEGMENT),
    "detect_changepoint_nested": ("q_changepoint_nested", PANEL_A),
    "detect_changepoint_2": ("q_changepoint_2", PANEL_A),
    "detect_changepoint_2_day": ("q_changepoint_2", PANEL_B),
    "counterfactual_effects": ("q_ratio_effects", PANEL_A),
    "counterfactual_series": ("q_ratio_series", PANEL_A),
    "model_summary": ("q_model_summary", PANEL_A),
    "model_summary_orders": ("q_model_summary", PANEL_C),
    "model_summary_by_segment": ("q_model_summary", PANEL_C_SEGMENT),
    "deviance_counts": ("q_deviance_counts", PANEL_A),
    "model_summary_timeseries": ("q_summary_timeseries", PANEL_A),
    "model_summary_timeseries_week": ("q_summary_timeseries", PANEL_D),
    "model_group_timeseries": ("q_group_timeseries", PANEL_A),
    "deviance_mean_sd": ("q_deviance_mean_sd", PANEL_A),
    "select_peers": ("q_select_peers", PANEL_A),
    "select_peers_by_segment": ("q_select_peers", PANEL_C_SEGMENT),
    "peer_design": ("q_peer_design", PANEL_A),
    "peer_design_by_segment": ("q_peer_design", PANEL_C_SEGMENT),
    "standardize_response": ("q_standardize", PANEL_A),
    "lowess_smooth": ("q_lowess", PANEL_A),
    "lowess_smooth_orders": ("q_lowess", PANEL_C),
    "lowess_smooth_week": ("q_lowess", PANEL_D),
    "pre_post_stats": ("q_pre_post", PANEL_C),
    "model_ts_rank": ("q_ts_rank", PANEL_A),
    "model_ts_rank_top": ("q_ts_rank_top", PANEL_C),
    "detect_changepoint_3": ("q_changepoint_3", PANEL_A),
    "detect_changepoint_by_nation": ("q_changepoint_2", PANEL_A_NATION),
    "causal_impact": ("q_ridge_effects", PANEL_A_NATION),
    "causal_impact_orders": ("q_ridge_effects", PANEL_C),
    "causal_impact_week": ("q_ridge_effects", PANEL_D),
    "causal_impact_day": ("q_ridge_effects", PANEL_B),
    "causal_impact_series": ("q_ridge_series", PANEL_A_NATION),
    "peer_coef_stats": ("q_peer_coef_stats", PANEL_A_NATION),
    "model_ts_peers": ("q_ts_peers", PANEL_A),
    "model_ts_peers_deviating": ("q_ts_peers_deviating", PANEL_A),
    "model_ts_peers_plot": ("q_ts_peers_plot", PANEL_A),
    "ts_analysis": ("q_ts_analysis", PANEL_A),
    "ts_analysis_detected": ("q_ts_analysis", PANEL_A_DETECTED),
}

# every table of the whole analysis, taken from one ts_analysis run
PIPELINE_TABLES = (
    "prepared_panel", "desc_summary_count", "desc_summary_count_plot", "desc_summary_stats",
    "desc_quantile_timeseries", "deviance_counts", "model_summary_timeseries", "model_group_timeseries",
    "deviance_mean_sd", "model_ts_rank", "model_ts_rank_top", "model_ts_peers", "model_ts_peers_plot")
SQL_QUERIES |= {f"ts_analysis_{t}": ("q_pipeline", {**PANEL_A, "table": t}) for t in PIPELINE_TABLES}
# the eight sinks, written and read back
STORED_TABLES = ("desc_summary_count", "desc_summary_stats", "desc_quantile_timeseries", "model_summary",
                 "model_summary_timeseries", "model_group_timeseries", "model_ts_peers", "model_ts_rank")
SQL_QUERIES |= {f"stored_{t}": ("q_stored", {**PANEL_A, "table": t}) for t in STORED_TABLES}
SQL_QUERIES |= {f"ts_analysis_detected_{t}": ("q_pipeline", {**PANEL_A_DETECTED, "table": t})
                for t in ("prepared_panel", "model_summary_timeseries", "desc_quantile_timeseries")}

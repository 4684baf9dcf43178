"""DuckDB SQL for the registered queries (the correctness oracle).

Each statement reads the driver's views (``lineitem``, ``orders``, ...)
and recomputes the same result as the Spark query of the same name. The
statements are assembled from a few CTE builders below so that the panel
derivation is written once.
"""

from __future__ import annotations

from ..functions.calendar import SEASONS
from ..operators import ridge as RM
from . import params as P

SUMMARY_COUNT_NAMES = ("count_mean", "count_total", "timeseries_active", "timeseries_total",
                       "timeseries_active_new", "timeseries_inactive_old",
                       "timeseries_active_old")
SUMMARY_STATS_NAMES = ("count_mean", "count_sd", "count_median",
                       "count_log10_mean", "count_log10_sd", "count_log10_median")

RAW = {
    "A": ("SELECT 'all' AS group_id, CAST(l_suppkey AS VARCHAR) AS ts_id, "
          "CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS count FROM lineitem"),
    "A_nation": ("SELECT n_name AS group_id, CAST(l_suppkey AS VARCHAR) AS ts_id, "
                 "CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS count "
                 "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
                 "JOIN nation ON s_nationkey = n_nationkey"),
    "B": ("SELECT 'all' AS group_id, CAST(user_id AS VARCHAR) AS ts_id, "
          "CAST(ts AS DATE) AS date, 1.0::DOUBLE AS count FROM events"),
    "C": ("SELECT 'all' AS group_id, CAST(o_custkey AS VARCHAR) AS ts_id, "
          "CAST(o_orderdate AS DATE) AS date, 1.0::DOUBLE AS count FROM orders"),
    "C_segment": ("SELECT c_mktsegment AS group_id, CAST(o_custkey AS VARCHAR) AS ts_id, "
                  "CAST(o_orderdate AS DATE) AS date, 1.0::DOUBLE AS count "
                  "FROM orders JOIN customer ON o_custkey = c_custkey"),
}


def floor_sql(col: str, period: str) -> str:
    if period == "day":
        return col
    if period == "week":
        return f"({col} - CAST(dayofweek({col}) AS INTEGER))"
    return f"CAST(date_trunc('month', {col}) AS DATE)"


def step_sql(period: str) -> str:
    return {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[period]


def d(x: str | None) -> str:
    """A start date; without one, the row's group's change date."""
    if x is None:
        return "(SELECT map(list(group_id), list(change_date)) FROM starts)[group_id]"
    return f"DATE '{x}'"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{n} AS ({q})" for n, q in ctes)
    return f"WITH {body}\n{final}"


def unpivot_sql(table: str, names) -> str:
    """Long (group_id, date, name, value) form keeping NULL values."""
    ns = ", ".join(f"'{n}'" for n in names)
    vs = ", ".join(f"CAST({n} AS DOUBLE)" for n in names)
    return f"SELECT group_id, date, unnest([{ns}]) AS name, unnest([{vs}]) AS value FROM {table}"


def R(sql: str, *doubles: str) -> str:
    """Round the named DOUBLE columns of the result to 6 places (the Spark
    side rounds every double column the same way)."""
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _r"


def prepared_ctes(cfg: dict) -> list[tuple[str, str]]:
    """CTEs ``raw, b, params, s, r, p`` - p is the prepared panel."""
    period, start = cfg["period"], d(cfg["start"])
    ctes = [("raw", RAW[cfg["panel"]])]
    if cfg["start"] is None:          # one detected change date per group
        found = with_(changepoint_ctes(cfg), "SELECT group_id, change_date FROM cp2")
        ctes = [("starts", f"SELECT * FROM ({found}) AS found"),
                ("raw", f"SELECT * FROM ({RAW[cfg['panel']]}) AS all_groups WHERE group_id IN "
                        "(SELECT group_id FROM starts)")]
    ctes += [("b", f"SELECT group_id, ts_id, {floor_sql('date', period)} AS date, "
                   "sum(count) AS count FROM raw GROUP BY ALL")]
    if cfg.get("min_pre") is None:
        ctes.append(("m", "SELECT DISTINCT group_id, CAST(date_trunc('month', date) AS DATE) "
                          "AS month FROM raw"))
        ctes.append(("params", f"SELECT group_id, "
                     f"CAST(floor(count_if(month <= {start}) * 0.5) AS BIGINT) AS min_pre, "
                     f"CAST(floor(count_if(month > {start}) * 0.25) AS BIGINT) AS min_post "
                     "FROM m GROUP BY group_id"))
    else:
        ctes.append(("params", f"SELECT DISTINCT group_id, {int(cfg['min_pre'])} AS min_pre, "
                               f"{int(cfg['min_post'])} AS min_post FROM raw"))
    ctes.append(("s", f"SELECT b.group_id, ts_id, count_if(date <= {start}) AS n_pre, "
                      f"count_if(date > {start}) AS n_post, "
                      f"(count_if(date <= {start}) >= any_value(min_pre) AND "
                      f"count_if(date > {start}) >= any_value(min_post)) AS active "
                      "FROM b JOIN params USING (group_id) GROUP BY b.group_id, ts_id"))
    ctes.append(("r", "SELECT group_id, min(date) AS d0, max(date) AS d1 FROM b GROUP BY group_id"))
    ctes.append(("grid", f"SELECT s.group_id, s.ts_id, s.active, CAST(unnest(generate_series("
                         f"r.d0, r.d1, {step_sql(period)})) AS DATE) AS date "
                         "FROM s JOIN r USING (group_id)"))
    ctes.append(("p", "SELECT grid.group_id, grid.ts_id, grid.active, grid.date, "
                      "coalesce(b.count, 0.0) AS count FROM grid LEFT JOIN b "
                      "USING (group_id, ts_id, date)"))
    return ctes


def trimmed_ctes(cfg: dict) -> list[tuple[str, str]]:
    return prepared_ctes(cfg) + [
        ("tc", "SELECT *, sum(count) OVER (PARTITION BY group_id, ts_id ORDER BY date "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM p"),
        ("t", "SELECT group_id, ts_id, active, date, count FROM tc WHERE cum <> 0"),
    ]


def last_pre_cte(cfg: dict) -> tuple[str, str]:
    return ("sd", f"SELECT group_id, max(date) AS start_date FROM p "
                  f"WHERE date <= {d(cfg['start'])} GROUP BY group_id")


# ---------------------------------------------------------------- queries

def q_bucket_sum(cfg):
    ctes = prepared_ctes(cfg)[:2]
    return R(with_(ctes, "SELECT group_id, ts_id, date, count FROM b"), "count")


def q_default_periods(cfg):
    cfg = {**cfg, "min_pre": None}
    ctes = [c for c in prepared_ctes(cfg) if c[0] in ("raw", "m", "params")]
    return with_(ctes, "SELECT group_id, min_pre AS min_pre_periods, "
                       "min_post AS min_post_periods FROM params")


def q_active_flag(cfg):
    return with_(prepared_ctes(cfg), "SELECT group_id, ts_id, n_pre, n_post, active FROM s")


def q_prepare(cfg):
    return R(with_(prepared_ctes(cfg), "SELECT group_id, ts_id, active, date, count FROM p"),
             "count")


def q_trim(cfg):
    return R(with_(trimmed_ctes(cfg), "SELECT group_id, ts_id, active, date, count FROM t"),
             "count")


def summary_count_ctes(cfg):
    return trimmed_ctes(cfg) + [
        ("pd", "SELECT group_id, date, avg(count) AS count_mean, sum(count) AS count_total, "
               "count_if(count > 0) AS timeseries_active FROM t GROUP BY group_id, date"),
        ("fa", "SELECT group_id, min(date) AS date FROM t WHERE count > 0 GROUP BY group_id, ts_id"),
        ("nw", "SELECT group_id, date, count(*) AS n FROM fa GROUP BY group_id, date"),
        ("tot", "SELECT pd.*, CAST(sum(coalesce(nw.n, 0)) OVER (PARTITION BY pd.group_id "
                "ORDER BY pd.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) "
                "AS timeseries_total FROM pd LEFT JOIN nw USING (group_id, date)"),
        ("w", "SELECT *, timeseries_total - lag(timeseries_total) OVER (PARTITION BY group_id "
              "ORDER BY date) AS timeseries_active_new, timeseries_total - timeseries_active "
              "AS timeseries_inactive_old FROM tot"),
        ("w2", "SELECT *, timeseries_active - timeseries_active_new AS timeseries_active_old "
               "FROM w"),
        ("lng", unpivot_sql("w2", SUMMARY_COUNT_NAMES)),
    ]


def q_summary_count(cfg):
    return R(with_(summary_count_ctes(cfg), "SELECT * FROM lng"), "value")


def q_summary_count_plot(cfg):
    return R(with_(summary_count_ctes(cfg), (
        "SELECT group_id, date, name, value, CASE WHEN starts_with(name, 'count_') THEN name "
        "ELSE regexp_extract(name, '(^[^_]*)', 1) END AS type FROM lng "
        "WHERE (regexp_matches(name, '^timeseries_(in)?active_') OR name = 'count_total') "
        "AND value IS NOT NULL")), "value")


def q_running_distinct(cfg):
    """The set form: distinct ids with a positive count on any date so far."""
    ctes = trimmed_ctes(cfg) + [
        ("dates", "SELECT DISTINCT group_id, date FROM t"),
        ("seen", "SELECT DISTINCT group_id, date, ts_id FROM t WHERE count > 0")]
    return with_(ctes, "SELECT d.group_id, d.date, count(DISTINCT s.ts_id) AS timeseries_total FROM dates d "
                       "LEFT JOIN seen s ON s.group_id = d.group_id AND s.date <= d.date GROUP BY d.group_id, d.date")


def q_summary_stats(cfg):
    ctes = trimmed_ctes(cfg) + [
        ("tl", "SELECT *, CASE WHEN count + 1 > 0 THEN log10(count + 1) END AS count_log10 FROM t"),
        ("wd", "SELECT group_id, date, avg(count) AS count_mean, stddev_samp(count) AS count_sd, "
               "median(count) AS count_median, avg(count_log10) AS count_log10_mean, "
               "stddev_samp(count_log10) AS count_log10_sd, "
               "median(count_log10) AS count_log10_median FROM tl GROUP BY group_id, date"),
    ]
    return R(with_(ctes, unpivot_sql("wd", SUMMARY_STATS_NAMES)), "value")


def q_quantile_ts(cfg, n=3):
    ctes = trimmed_ctes(cfg) + [last_pre_cte(cfg), (
        "tp", "SELECT t.*, CASE WHEN date <= sd.start_date THEN 'pre' ELSE 'post' END AS period "
              "FROM t JOIN sd USING (group_id)"), (
        "tm", "SELECT *, median(count) OVER (PARTITION BY group_id, period, ts_id) AS med_count "
              "FROM tp"), (
        "tq", f"SELECT *, ntile({n}) OVER (PARTITION BY group_id, period ORDER BY med_count, "
              "date, active, ts_id) AS quantile, CASE WHEN count(count) OVER (PARTITION BY "
              "group_id, date) > 1 THEN (rank() OVER (PARTITION BY group_id, date ORDER BY count) "
              "- 1) / (count(count) OVER (PARTITION BY group_id, date) - 1) END AS month_percentile "
              "FROM tm")]
    return R(with_(ctes, "SELECT group_id, date, CAST(quantile AS BIGINT) AS quantile, "
                         "avg(month_percentile) AS mean_percentile FROM tq "
                         "GROUP BY group_id, date, quantile"), "mean_percentile")


def completed_ctes(cfg):
    return [("raw", RAW[cfg["panel"]]),
            ("agg", "SELECT group_id, date, sum(count) AS count FROM raw GROUP BY group_id, date"),
            ("rng", "SELECT group_id, min(date) AS d0, max(date) AS d1 FROM agg GROUP BY group_id"),
            ("ks", "SELECT group_id, d0, d1, unnest(range(0, datediff('month', d0, d1) + 2)) AS k "
                   "FROM rng"),
            ("steps", "SELECT group_id, date FROM (SELECT group_id, d1, CAST(date_trunc('month', d0) "
                      "+ to_months(CAST(k AS INTEGER)) + to_days(CAST(day(d0) AS INTEGER) - 1) AS DATE) "
                      "AS date FROM ks) WHERE date <= d1"),
            ("completed", "SELECT group_id, date, coalesce(agg.count, 0.0) AS count FROM agg "
                          "FULL JOIN steps USING (group_id, date)")]


def q_month_complete(cfg):
    return R(with_(completed_ctes(cfg), "SELECT group_id, date, count FROM completed"), "count")


def changepoint_ctes(cfg):
    return completed_ctes(cfg) + [
        ("x", "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY date) AS i, "
              "count(*) OVER (PARTITION BY group_id) AS n, "
              "count - avg(count) OVER (PARTITION BY group_id) AS xc FROM completed"),
        ("g", "SELECT *, sum(xc) OVER w AS s1, sum(xc * xc) OVER w AS s2, "
              "sum(xc) OVER (PARTITION BY group_id) AS t1, "
              "sum(xc * xc) OVER (PARTITION BY group_id) AS t2, sum(count) OVER w AS cum, "
              "sum(count) OVER (PARTITION BY group_id) AS tot FROM x "
              "WINDOW w AS (PARTITION BY group_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING "
              "AND CURRENT ROW)"),
        ("gg", "SELECT *, (t2 - t1 * t1 / n) - (s2 - s1 * s1 / i) - ((t2 - s2) - (t1 - s1) * "
               "(t1 - s1) / (n - i)) + ln(n) - ln(i) - ln(n - i) AS gain FROM g WHERE i < n"),
        ("best", "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY gain DESC, i) AS rk "
                 "FROM gg"),
        ("cp", "SELECT group_id, date AS change_date, cum / i AS before_mean, "
               "(tot - cum) / (n - i) AS after_mean FROM best WHERE rk = 1 AND gain >= 3 * ln(n)"),
        ("cp2", "SELECT *, after_mean - before_mean AS mean_change, CASE WHEN before_mean <> 0 "
                "THEN (after_mean - before_mean) / before_mean END AS pct_change FROM cp"),
    ]


CP_DOUBLES = ("before_mean", "after_mean", "mean_change", "pct_change")


def q_changepoint_2(cfg):
    """Two rounds: the round-1 split cuts the series in two segments, the
    best split inside either segment is round 2; a round's point is kept if
    the running minimum of the gains reaches the penalty."""
    ctes = changepoint_ctes(cfg) + [
        ("b1", "SELECT group_id, i AS k1, gain AS g1 FROM best WHERE rk = 1"),
        ("x2", "SELECT x.*, CASE WHEN x.i <= b1.k1 THEN 1 ELSE b1.k1 + 1 END AS seg "
               "FROM x JOIN b1 USING (group_id)"),
        ("h2", "SELECT *, sum(xc) OVER w AS s1, sum(xc * xc) OVER w AS s2, "
               "sum(xc) OVER (PARTITION BY group_id, seg) AS t1, "
               "sum(xc * xc) OVER (PARTITION BY group_id, seg) AS t2, "
               "count(*) OVER (PARTITION BY group_id, seg) AS ns FROM x2 "
               "WINDOW w AS (PARTITION BY group_id, seg ORDER BY i ROWS BETWEEN UNBOUNDED "
               "PRECEDING AND CURRENT ROW)"),
        ("hh2", "SELECT *, (t2 - t1 * t1 / ns) - (s2 - s1 * s1 / (i - seg + 1)) - ((t2 - s2) - "
                "(t1 - s1) * (t1 - s1) / (ns - (i - seg + 1))) + ln(ns) - ln(i - seg + 1) "
                "- ln(ns - (i - seg + 1)) AS gain FROM h2 WHERE ns - (i - seg + 1) > 0"),
        ("b2", "SELECT group_id, i AS k2, gain AS g2 FROM (SELECT *, row_number() OVER "
               "(PARTITION BY group_id ORDER BY gain DESC, i) AS rk FROM hh2) WHERE rk = 1"),
        ("pts", "SELECT group_id, k1 AS k, g1 AS rec FROM b1 UNION ALL "
                "SELECT group_id, k2 AS k, least(g1, g2) AS rec FROM b1 JOIN b2 USING (group_id)"),
        ("cp", "SELECT g.group_id, g.date AS change_date, g.cum / g.i AS before_mean, "
               "(g.tot - g.cum) / (g.n - g.i) AS after_mean FROM pts JOIN g "
               "ON pts.group_id = g.group_id AND pts.k = g.i WHERE pts.rec >= 3 * ln(g.n)"),
        ("cp2", "SELECT *, after_mean - before_mean AS mean_change, CASE WHEN before_mean <> 0 "
                "THEN (after_mean - before_mean) / before_mean END AS pct_change FROM cp"),
    ]
    ctes = [c for c in ctes if c[0] not in ("cp", "cp2")][:len(changepoint_ctes(cfg)) - 2] + \
        [c for c in ctes[len(changepoint_ctes(cfg)):]]
    return R(with_(ctes, "SELECT * FROM cp2"), *CP_DOUBLES)


def q_changepoint_3(cfg, rounds=3):
    """Any number of rounds: a round's segments start after the cuts chosen so
    far; its best split is the next cut, its record the least gain so far."""
    ctes = [c for c in changepoint_ctes(cfg) if c[0] in [n for n, _ in completed_ctes(cfg)] + ["x", "g"]]
    cuts, prev = "", "(SELECT DISTINCT group_id FROM x)"
    for q in range(1, rounds + 1):
        seg = "greatest(1" + "".join(f", CASE WHEN x.i > k{j} THEN k{j} + 1 ELSE 1 END" for j in range(1, q)) + ")"
        ctes += [
            (f"y{q}", f"SELECT x.*{cuts}, {seg} AS seg FROM x JOIN {prev} USING (group_id)"),
            (f"h{q}", "SELECT *, sum(xc) OVER w AS s1, sum(xc * xc) OVER w AS s2, sum(xc) OVER a AS t1, "
                      f"sum(xc * xc) OVER a AS t2, count(*) OVER a AS ns FROM y{q} WINDOW a AS (PARTITION BY group_id, seg), "
                      "w AS (PARTITION BY group_id, seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
            (f"r{q}", "SELECT *, (t2 - t1 * t1 / ns) - (s2 - s1 * s1 / (i - seg + 1)) - ((t2 - s2) - (t1 - s1) * "
                      "(t1 - s1) / (ns - (i - seg + 1))) + ln(ns) - ln(i - seg + 1) - ln(ns - (i - seg + 1)) AS gain "
                      f"FROM h{q} WHERE ns - (i - seg + 1) > 0"),
            (f"b{q}", f"SELECT group_id{cuts}, i AS k{q}, gain AS g{q} FROM (SELECT *, row_number() OVER "
                      f"(PARTITION BY group_id ORDER BY gain DESC, i) AS rk FROM r{q}) WHERE rk = 1"),
        ]
        prev, cuts = f"b{q}", cuts + f", k{q}, g{q}"
    pts = " UNION ALL ".join(
        f"SELECT group_id, k{q} AS k, g{q} AS gain, least({', '.join(f'g{j}' for j in range(1, q + 1))}) AS rec, "
        f"{q} AS cpt_round FROM b{q}" for q in range(1, rounds + 1))
    ctes += [
        ("pts", pts),
        ("cp", "SELECT g.group_id, g.date AS change_date, g.cum / g.i AS before_mean, (g.tot - g.cum) / (g.n - g.i) AS "
               "after_mean, pts.gain, 3 * ln(g.n) AS penalty, pts.cpt_round FROM pts JOIN g "
               "ON pts.group_id = g.group_id AND pts.k = g.i WHERE pts.rec >= 3 * ln(g.n)"),
        ("cp2", "SELECT *, after_mean - before_mean AS mean_change, CASE WHEN before_mean <> 0 "
                "THEN (after_mean - before_mean) / before_mean END AS pct_change FROM cp")]
    return R(with_(ctes, "SELECT * FROM cp2"), *CP_DOUBLES, "gain", "penalty")


def q_changepoint(cfg):
    return R(with_(changepoint_ctes(cfg), "SELECT * FROM cp2"), *CP_DOUBLES)


def q_changepoint_nested(cfg):
    return R(with_(changepoint_ctes(cfg), "SELECT cp2.*, completed.date, completed.count "
                                          "FROM cp2 JOIN completed USING (group_id)"),
             *CP_DOUBLES, "count")


# --------------------------------------------------------- ratio model

ALPHA = 0.05
EFFECTS = ("AbsEffect_Average", "RelEffect_Average", "AbsEffect_Cumulative",
           "RelEffect_Cumulative", "p_Cumulative", "p_Average")
SERIES = ("response", "cum_response", "point_pred", "point_pred_lower", "point_pred_upper",
          "cum_pred", "cum_pred_lower", "cum_pred_upper", "point_effect", "point_effect_lower",
          "point_effect_upper", "cum_effect", "cum_effect_lower", "cum_effect_upper")


def z_sql(alpha=ALPHA):
    from statistics import NormalDist
    return f"CAST('{NormalDist().inv_cdf(1.0 - alpha / 2.0)!r}' AS DOUBLE)"


def norm_cdf_sql(x: str) -> str:
    """Same erf approximation as the Spark side (A&S 7.1.26)."""
    ax = f"(abs({x}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {ax}))"
    poly = (f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * "
            f"(-1.453152027 + {t} * 1.061405429)))))")
    erf_abs = f"(1.0 - {poly} * exp(-{ax} * {ax}))"
    return f"(0.5 * (1.0 + CASE WHEN {x} < 0 THEN -{erf_abs} ELSE {erf_abs} END))"


def ratio_ctes(cfg):
    z = z_sql()
    return prepared_ctes(cfg) + [
        ("mr", f"SELECT group_id, ts_id, date, count, date <= {d(cfg['start'])} AS is_pre "
               "FROM p WHERE active"),
        ("tot", "SELECT group_id, date, sum(count) AS tot, count(*) AS n FROM mr GROUP BY ALL"),
        ("x1", "SELECT mr.*, (tot - count) / nullif(CAST(n - 1 AS DOUBLE), 0) AS peer "
               "FROM mr JOIN tot USING (group_id, date)"),
        ("x2", "SELECT *, sum(CASE WHEN is_pre THEN count END) OVER s / "
               "nullif(sum(CASE WHEN is_pre THEN peer END) OVER s, 0) AS ratio FROM x1 "
               "WINDOW s AS (PARTITION BY group_id, ts_id)"),
        ("x3", "SELECT *, ratio * peer AS point_pred, count AS response FROM x2"),
        ("x4", "SELECT *, stddev_samp(CASE WHEN is_pre THEN response - point_pred END) OVER "
               "(PARTITION BY group_id, ts_id) AS sigma FROM x3"),
        ("x5", f"SELECT *, point_pred - {z} * sigma AS point_pred_lower, "
               f"point_pred + {z} * sigma AS point_pred_upper, sum(response) OVER w AS cum_response, "
               "sum(CASE WHEN NOT is_pre THEN 1 ELSE 0 END) OVER w AS m, "
               "sum(CASE WHEN NOT is_pre THEN point_pred ELSE response END) OVER w AS cum_pred "
               "FROM x4 WINDOW w AS (PARTITION BY group_id, ts_id ORDER BY date ROWS BETWEEN "
               "UNBOUNDED PRECEDING AND CURRENT ROW)"),
        ("x6", f"SELECT *, cum_pred - {z} * sigma * sqrt(CAST(m AS DOUBLE)) AS cum_pred_lower, "
               f"cum_pred + {z} * sigma * sqrt(CAST(m AS DOUBLE)) AS cum_pred_upper FROM x5"),
        ("ms", "SELECT group_id, ts_id, date, response, cum_response, point_pred, point_pred_lower, "
               "point_pred_upper, cum_pred, cum_pred_lower, cum_pred_upper, "
               "response - point_pred AS point_effect, response - point_pred_upper AS "
               "point_effect_lower, response - point_pred_lower AS point_effect_upper, "
               "cum_response - cum_pred AS cum_effect, cum_response - cum_pred_upper AS "
               "cum_effect_lower, cum_response - cum_pred_lower AS cum_effect_upper, is_pre FROM x6"),
        ("e1", "SELECT group_id, ts_id, avg(response - point_pred) AS AbsEffect_Average, "
               "avg(point_pred) AS pa, sum(response - point_pred) AS AbsEffect_Cumulative, "
               "sum(point_pred) AS ps, any_value(sigma) AS sigma, count(*) AS m FROM x6 "
               "WHERE NOT is_pre GROUP BY group_id, ts_id"),
        ("e2", "SELECT *, AbsEffect_Cumulative / nullif(sigma * sqrt(CAST(m AS DOUBLE)), 0) AS zc "
               "FROM e1"),
        ("me", "SELECT group_id, ts_id, AbsEffect_Average, AbsEffect_Average / nullif(pa, 0) AS "
               "RelEffect_Average, AbsEffect_Cumulative, AbsEffect_Cumulative / nullif(ps, 0) AS "
               f"RelEffect_Cumulative, CASE WHEN sigma > 0 THEN 1.0 - {norm_cdf_sql('abs(zc)')} END "
               f"AS p_Cumulative, CASE WHEN sigma > 0 THEN 1.0 - {norm_cdf_sql('abs(zc)')} END "
               "AS p_Average FROM e2"),
        ("msum", f"SELECT *, CASE WHEN AbsEffect_Cumulative > 0 AND p_Cumulative < {ALPHA} THEN "
                 f"'over' WHEN AbsEffect_Cumulative < 0 AND p_Cumulative < {ALPHA} THEN 'under' "
                 "ELSE 'average' END AS deviance FROM me"),
        ("pe", f"SELECT group_id, max(date) AS pre_end FROM p WHERE active AND "
               f"date <= {d(cfg['start'])} GROUP BY group_id"),
    ]


def model_ctes(cfg):
    """The model of the configuration: ``ratio`` unless it names another."""
    return ridge_ctes(cfg) if cfg.get("method") == "ridge" else ratio_ctes(cfg)


def q_ratio_effects(cfg):
    return R(with_(ratio_ctes(cfg), "SELECT * FROM me"), *EFFECTS)


def q_ratio_series(cfg):
    return R(with_(ratio_ctes(cfg), "SELECT * EXCLUDE (is_pre) FROM ms"), *SERIES)


def q_model_summary(cfg):
    return R(with_(model_ctes(cfg), "SELECT * FROM msum"), *EFFECTS)


def q_deviance_counts(cfg):
    return with_(model_ctes(cfg), "SELECT group_id, deviance, count(*) AS timeseries FROM msum "
                                  "GROUP BY ALL")


def q_summary_timeseries(cfg):
    return with_(model_ctes(cfg), (
        "SELECT date, group_id, CASE WHEN point_effect_lower > 0 THEN 'over' WHEN "
        "point_effect_upper < 0 THEN 'under' ELSE 'average' END AS point_perf, count(*) AS "
        "timeseries FROM ms JOIN pe USING (group_id) WHERE date >= pre_end GROUP BY ALL"))


def q_group_timeseries(cfg):
    return R(with_(model_ctes(cfg), (
        "SELECT msum.group_id, msum.ts_id, msum.p_Cumulative, ms.* EXCLUDE (group_id, ts_id, "
        "is_pre) FROM msum JOIN ms USING (group_id, ts_id)")), "p_Cumulative", *SERIES)


def q_deviance_mean_sd(cfg):
    return R(with_(model_ctes(cfg), (
        "SELECT ms.group_id, date, deviance, avg(response) AS count_mean, stddev_samp(response) "
        "AS count_sd FROM ms LEFT JOIN msum USING (group_id, ts_id) GROUP BY ALL")),
        "count_mean", "count_sd")


def inverse_ctes(ctes_in: str, name: str) -> list[tuple[str, str]]:
    """Inverses of the positive definite matrices ``m`` (lists of rows) of
    ``(group_id, draw, n, m)`` by Gauss-Jordan steps, one pivot a step:
    ``name(group_id, draw, n, t, s, a)``."""
    step = ("list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = p AND j = p THEN 1 / m[p][p] "
            "WHEN i = p THEN v / m[p][p] WHEN j = p THEN -v / m[p][p] ELSE v - r[p] * m[p][j] / m[p][p] END))")
    return [
        (f"{name}_gj", f"WITH RECURSIVE gj AS (SELECT group_id, draw, n, 1 AS p, m FROM {ctes_in} UNION ALL "
                       f"SELECT group_id, draw, n, p + 1, {step} FROM gj WHERE p <= n) SELECT * FROM gj WHERE p = n + 1"),
        (f"{name}_r", f"SELECT group_id, draw, n, unnest(range(0, n)) AS t, unnest(m) AS r FROM {name}_gj"),
        (name, f"SELECT group_id, draw, n, t, unnest(range(0, n)) AS s, unnest(r) AS a FROM {name}_r")]


def ridge_ctes(cfg):
    """Every series on all others: the group's matrix, its inverse, and the
    downdate of each series; intervals and classes as in the ratio model."""
    kept = dict(ratio_ctes(cfg))
    season, draws = SEASONS[cfg["period"]], RM.DRAWS
    hashed = "(t * 7919 + draw * 104729 + 1)"
    for _ in range(3):
        hashed = f"({hashed} * 48271 % 2147483647)"
    p_value = f"CASE WHEN sigma > 0 THEN 1.0 - {norm_cdf_sql('abs(zc)')} END"
    return prepared_ctes(cfg) + [
        ("mr", kept["mr"]),
        ("q1", f"SELECT *, n // {season} AS cyc, n - n // {season} * {season} AS off FROM (SELECT *, CAST(row_number() OVER "
               "(PARTITION BY group_id, ts_id ORDER BY date) - 1 AS BIGINT) AS t, count(*) FILTER (is_pre) OVER "
               "(PARTITION BY group_id, ts_id) AS n FROM mr) z"),
        ("cm", f"SELECT group_id, ts_id, (t - off) // {season} AS c, any_value(cyc) AS cyc, avg(count) AS m FROM q1 "
               "WHERE cyc >= 2 AND t >= off AND t < n GROUP BY group_id, ts_id, (t - off) // " + str(season)),
        ("sl", f"SELECT group_id, ts_id, avg(m) AS mm, (arg_max(m, c) - arg_min(m, c)) / ((max(cyc) - 1) * {season}) AS slope "
               "FROM cm GROUP BY group_id, ts_id"),
        ("dv", f"SELECT group_id, ts_id, (t - off) % {season} AS k, avg(count) AS sm FROM q1 WHERE cyc >= 2 AND t >= off "
               f"AND t < n GROUP BY group_id, ts_id, (t - off) % {season}"),
        ("q2", f"SELECT q1.*, coalesce(sm - mm - slope * (k - ({season} - 1) / 2.0), 0.0) AS sea FROM q1 LEFT JOIN sl "
               f"USING (group_id, ts_id) LEFT JOIN dv ON dv.group_id = q1.group_id AND dv.ts_id = q1.ts_id "
               f"AND dv.k = ((t - off) % {season} + {season}) % {season}"),
        ("q3", "SELECT *, count - sea - mu AS x, sea + mu AS base FROM (SELECT *, avg(CASE WHEN is_pre THEN count - sea END) "
               "OVER (PARTITION BY group_id, ts_id) AS mu FROM q2) z"),
        ("nn", "SELECT group_id, any_value(n) AS n, any_value(cyc) AS cyc FROM q3 GROUP BY group_id"),
        ("k", "SELECT a.group_id, a.t, b.t AS s, sum(a.x * b.x) AS v FROM q3 a JOIN q3 b ON a.group_id = b.group_id "
              "AND a.ts_id = b.ts_id GROUP BY a.group_id, a.t, b.t"),
        ("lam", f"SELECT group_id, any_value(n) AS n, CASE WHEN sum(v) > 0 THEN {RM.RIDGE} * sum(v) / any_value(n) ELSE 1.0 END "
                "AS lam FROM k JOIN nn USING (group_id) WHERE t = s AND t < n GROUP BY group_id"),
        ("hw", f"SELECT group_id, draw, t, CASE WHEN draw = 0 THEN 1.0 ELSE -ln({hashed} / 2147483647.0) END AS w FROM "
               f"(SELECT group_id, draw, unnest(range(0, n)) AS t FROM (SELECT group_id, n, unnest(range(0, {draws} + 1)) AS draw "
               "FROM nn) y) z"),
        ("wt", "SELECT *, w / avg(w) OVER (PARTITION BY group_id, draw) AS wn FROM hw"),
        ("mrow", "SELECT k.group_id, wt.draw, k.t, any_value(n) AS n, list(v + CASE WHEN k.t = s THEN lam / wn ELSE 0.0 END "
                 "ORDER BY s) AS r FROM k JOIN lam USING (group_id) JOIN wt ON wt.group_id = k.group_id AND wt.t = k.t "
                 "WHERE k.t < n AND s < n GROUP BY k.group_id, wt.draw, k.t"),
        ("mats", "SELECT group_id, draw, any_value(n) AS n, list(r ORDER BY t) AS m FROM mrow GROUP BY group_id, draw"),
        ("mats0", "SELECT * FROM mats WHERE draw = 0"),
        *inverse_ctes("mats0", "ai"),
        ("ax", "SELECT q3.group_id, ts_id, ai.t, sum(a * x) AS ax, any_value(CASE WHEN ai.t = ai.s THEN a END) AS own FROM ai "
               "JOIN q3 ON q3.group_id = ai.group_id AND q3.t = ai.s GROUP BY q3.group_id, ts_id, ai.t"),
        ("uv", "SELECT ai.group_id, ai.t, sum(a * c) AS u FROM ai JOIN (SELECT k.group_id, s, sum(v) AS c FROM k JOIN nn "
               "USING (group_id) WHERE k.t >= n GROUP BY k.group_id, s) z ON z.group_id = ai.group_id AND z.s = ai.s "
               "GROUP BY ai.group_id, ai.t"),
        ("hh", "SELECT ax.group_id, ax.ts_id, sum(x * ax) AS h, sum(x * u) AS xu FROM ax JOIN q3 USING (group_id, ts_id, t) "
               "JOIN uv USING (group_id, t) GROUP BY ax.group_id, ax.ts_id"),
        ("ps_", "SELECT group_id, ts_id, sum(CASE WHEN is_pre THEN 0.0 ELSE x END) AS post FROM q3 GROUP BY group_id, ts_id"),
        ("fit", f"SELECT ax.group_id, ax.ts_id, CASE WHEN any_value(n - 1 - CASE WHEN cyc >= 2 THEN {season} - 1 ELSE 0 END) > 0 "
                "THEN sqrt(sum(power(ax / (1 - h) / (own + ax * ax / (1 - h)), 2)) / any_value(n - 1 - CASE WHEN cyc >= 2 THEN "
                f"{season} - 1 ELSE 0 END)) END AS sigma, sum(power(u - post * ax + ax * (xu - post * h) / (1 - h), 2)) AS ww, "
                "any_value(h) AS h FROM ax JOIN hh USING (group_id, ts_id) JOIN ps_ USING (group_id, ts_id) "
                "JOIN uv ON uv.group_id = ax.group_id AND uv.t = ax.t JOIN nn ON nn.group_id = ax.group_id "
                "GROUP BY ax.group_id, ax.ts_id"),
        ("kax", "SELECT k.group_id, ax.ts_id, k.t, sum(v * ax) AS kx FROM k JOIN ax ON ax.group_id = k.group_id AND ax.t = k.s "
                "GROUP BY k.group_id, ax.ts_id, k.t"),
        ("x4", "SELECT q3.*, base + (kx - x * h) / (1 - h) AS point_pred, count AS response, sigma, ww FROM q3 "
               "JOIN kax USING (group_id, ts_id, t) JOIN fit USING (group_id, ts_id)"),
        ("x5", kept["x5"]), ("x6", kept["x6"]), ("ms", kept["ms"]),
        ("e1", "SELECT group_id, ts_id, avg(response - point_pred) AS AbsEffect_Average, avg(point_pred) AS pa, "
               "sum(response - point_pred) AS AbsEffect_Cumulative, sum(point_pred) AS ps, any_value(sigma) AS sigma, "
               "CAST(count(*) AS DOUBLE) AS m, any_value(n) AS n, any_value(ww) AS ww FROM x6 "
               "WHERE NOT is_pre GROUP BY group_id, ts_id"),
        ("e2", "SELECT *, AbsEffect_Cumulative / nullif(sigma * sqrt(m + m * m / n + ww), 0) AS zc FROM e1"),
        ("me", "SELECT group_id, ts_id, AbsEffect_Average, AbsEffect_Average / nullif(pa, 0) AS "
               "RelEffect_Average, AbsEffect_Cumulative, AbsEffect_Cumulative / nullif(ps, 0) AS "
               f"RelEffect_Cumulative, {p_value} AS p_Cumulative, {p_value} AS p_Average FROM e2"),
        ("msum", kept["msum"]), ("pe", kept["pe"]),
    ]


def draw_ctes(cfg, deviating: bool, most: int | None):
    """Coefficient draws of the targets, their strongest peers, statistics."""
    pick = " WHERE deviance <> 'average'" if deviating else ""
    burn = int(RM.DRAWS * 0.1)
    kept = float(RM.DRAWS - burn)
    few = f"draw > 0 AND rk <= {RM.MODEL_SIZE} AND score > 0" + (f" OR draw = 0 AND rk <= {most}" if most else " OR draw = 0")
    return ridge_ctes(cfg) + [
        ("tg", f"SELECT group_id, ts_id FROM msum{pick}"),
        *inverse_ctes("mats", "ad"),
        ("dx", "SELECT q3.group_id, q3.ts_id, ad.draw, ad.t, sum(a * x) AS ax FROM ad JOIN q3 ON q3.group_id = ad.group_id "
               "AND q3.t = ad.s JOIN tg ON tg.group_id = q3.group_id AND tg.ts_id = q3.ts_id "
               "GROUP BY q3.group_id, q3.ts_id, ad.draw, ad.t"),
        ("dh", "SELECT dx.group_id, dx.ts_id, draw, sum(x * ax) AS h FROM dx JOIN q3 USING (group_id, ts_id, t) "
               "GROUP BY dx.group_id, dx.ts_id, draw"),
        ("pn", "SELECT group_id, ts_id, sqrt(sum(x * x)) AS norm FROM q3 WHERE is_pre GROUP BY group_id, ts_id"),
        ("cf", "SELECT dx.group_id, dx.ts_id, dx.draw, o.ts_id AS peer, sum(o.x * ax) AS b FROM dx JOIN q3 o "
               "ON o.group_id = dx.group_id AND o.t = dx.t AND o.ts_id <> dx.ts_id GROUP BY dx.group_id, dx.ts_id, dx.draw, o.ts_id"),
        ("cg", "SELECT cf.group_id, cf.ts_id, cf.draw, peer, b / (1 - h) AS coef, abs(b / (1 - h)) * norm AS score FROM cf "
               "JOIN dh ON dh.group_id = cf.group_id AND dh.ts_id = cf.ts_id AND dh.draw = cf.draw "
               "JOIN pn ON pn.group_id = cf.group_id AND pn.ts_id = peer"),
        ("co", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, ts_id, draw ORDER BY score DESC, peer) AS rk "
               f"FROM cg) z WHERE {few}"),
        ("cs", f"SELECT group_id, ts_id, peer, count(*) / {kept} AS inclusion_prob, avg(coef) AS coef, "
               f"count(*) FILTER (coef > 0) / {kept} AS positive_share, CASE WHEN avg(coef) > 0 THEN 1.0 ELSE 0.0 END AS "
               "positive_prob, CASE WHEN avg(coef) > 0 THEN 1.0 ELSE -1.0 END AS sign FROM co "
               f"WHERE draw > {burn} AND coef <> 0 GROUP BY group_id, ts_id, peer"),
    ]


def q_ridge_effects(cfg):
    return R(with_(ridge_ctes(cfg), "SELECT * FROM msum"), *EFFECTS)


def q_ts_analysis(cfg):
    return q_ridge_effects(cfg)


def q_pipeline(cfg):
    """A table of the whole analysis; its own query's SQL with the default model."""
    return globals()[PIPELINE_SQL[cfg["table"]]]({**cfg, "method": "ridge"})


def q_stored(cfg):
    return q_pipeline(cfg)


PIPELINE_SQL = {
    "model_summary": "q_ridge_effects",
    "prepared_panel": "q_prepare", "desc_summary_count": "q_summary_count",
    "desc_summary_count_plot": "q_summary_count_plot", "desc_summary_stats": "q_summary_stats",
    "desc_quantile_timeseries": "q_quantile_ts", "deviance_counts": "q_deviance_counts",
    "model_summary_timeseries": "q_summary_timeseries", "model_group_timeseries": "q_group_timeseries",
    "deviance_mean_sd": "q_deviance_mean_sd", "model_ts_rank": "q_ts_rank", "model_ts_rank_top": "q_ts_rank_top",
    "model_ts_peers": "q_ts_peers_deviating", "model_ts_peers_plot": "q_ts_peers_plot",
}


def q_ridge_series(cfg):
    return R(with_(ridge_ctes(cfg), "SELECT * EXCLUDE (is_pre) FROM ms"), *SERIES)


COEF_STATS = ("inclusion_prob", "coef", "positive_share", "positive_prob", "sign")


def q_peer_coef_stats(cfg):
    return R(with_(draw_ctes(cfg, False, RM.MAX_PEERS), "SELECT group_id, ts_id, peer AS peer_ts_id, inclusion_prob, coef, "
                                     "positive_share, positive_prob, sign FROM cs"), *COEF_STATS)


def peer_ctes(cfg, deviating, most=RM.MAX_PEERS):
    """Scaled counts of the peers and the standardised target of each model."""
    return draw_ctes(cfg, deviating, most) + [
        ("des", "SELECT z.group_id, z.ts_id, peer, date, count AS value FROM (SELECT DISTINCT group_id, ts_id, peer FROM co) z "
                "JOIN mr ON mr.group_id = z.group_id AND mr.ts_id = z.peer"),
        ("pr", "SELECT des.group_id, des.ts_id, date, peer, value * coalesce(coef, 1.0) AS scaled_count, "
               "coalesce(inclusion_prob, 0.0) AS inclusion_prob, coef, coalesce(positive_share, 0.0) AS positive_share, "
               "positive_prob, sign FROM des JOIN tg USING (group_id, ts_id) LEFT JOIN cs USING (group_id, ts_id, peer)"),
        ("ty", "SELECT group_id, ts_id, date, 'target' AS peer, (response - avg(response) OVER s) / "
               "nullif(stddev_samp(response) OVER s, 0) AS scaled_count, 1.0 AS inclusion_prob, "
               "CAST(NULL AS DOUBLE) AS coef, CAST(NULL AS DOUBLE) AS positive_share, CAST(NULL AS DOUBLE) AS "
               "positive_prob, CAST(NULL AS DOUBLE) AS sign FROM ms JOIN tg USING (group_id, ts_id) "
               "WINDOW s AS (PARTITION BY group_id, ts_id)"),
        ("pall", "SELECT group_id, ts_id AS target_ts_id, date, peer AS ts_id, * EXCLUDE (group_id, ts_id, date, peer), "
                 "CAST(dense_rank() OVER (PARTITION BY group_id, target_ts_id ORDER BY inclusion_prob DESC) AS INTEGER) "
                 "AS inclusion_rank FROM (SELECT *, ts_id AS target_ts_id FROM "
                 "(SELECT * FROM pr UNION ALL SELECT * FROM ty)) u"),
    ]


PEER_COLUMNS = ("group_id, target_ts_id, date, ts_id, scaled_count, inclusion_prob, coef, positive_share, "
                "positive_prob, sign, inclusion_rank")


def q_ts_peers(cfg, deviating=True, most=None):
    """All peers of the deviating series, or the strongest ones."""
    return R(with_(peer_ctes(cfg, deviating, most), f"SELECT {PEER_COLUMNS} FROM pall"), "scaled_count", *COEF_STATS)


def q_ts_peers_deviating(cfg):
    return q_ts_peers(cfg, True, RM.MAX_PEERS)


def q_ts_peers_plot(cfg):
    ctes = peer_ctes(cfg, True) + [
        ("sub", f"SELECT {PEER_COLUMNS}, CASE WHEN ts_id = 'target' THEN 'target' ELSE 'peers' END AS type, "
                "CASE WHEN ts_id = 'target' THEN 1.0 ELSE inclusion_prob END AS wt FROM pall "
                "WHERE inclusion_rank BETWEEN 1 AND 10 AND inclusion_prob > 0.01")]
    return R(with_(ctes, "SELECT * EXCLUDE (wt), (wt - avg(wt) OVER s) / nullif(stddev_samp(wt) OVER s, 0) AS alpha "
                         "FROM sub WINDOW s AS (PARTITION BY group_id, target_ts_id)"),
             "scaled_count", *COEF_STATS, "alpha")


def select_peers_ctes(cfg, k=P.MAX_PEERS):
    return prepared_ctes(cfg) + [
        ("ar", f"SELECT group_id, ts_id, date, count, date <= {d(cfg['start'])} AS is_pre "
               "FROM p WHERE active"),
        ("so", "SELECT group_id, ts_id, avg(CASE WHEN is_pre THEN count END) AS pm FROM ar "
               "GROUP BY group_id, ts_id"),
        ("o", "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pm NULLS LAST, ts_id) "
              "AS pos, count(*) OVER (PARTITION BY group_id) AS n FROM so"),
        ("o2", f"SELECT *, greatest(1, least(pos - {k // 2}, n - {k})) AS st FROM o"),
        ("t", f"SELECT group_id, ts_id, pos, unnest(range(st, least(n, st + {k}) + 1)) AS peer_pos "
              "FROM o2"),
        ("peers", "SELECT t.group_id, t.ts_id, o.ts_id AS peer_ts_id, "
                  "CAST(t.peer_pos AS BIGINT) AS peer_pos FROM t JOIN o ON "
                  "t.group_id = o.group_id AND t.peer_pos = o.pos WHERE t.peer_pos <> t.pos"),
    ]


def q_select_peers(cfg):
    return with_(select_peers_ctes(cfg), "SELECT * FROM peers")


def q_peer_design(cfg):
    ctes = select_peers_ctes(cfg) + [
        ("pv", "SELECT peers.group_id, peers.ts_id, ar.date, ar.is_pre, peers.peer_ts_id, "
               "peers.peer_pos, ar.count AS value FROM peers JOIN ar ON "
               "peers.group_id = ar.group_id AND peers.peer_ts_id = ar.ts_id"),
        ("psum", "SELECT group_id, ts_id, date, sum(value) AS ps FROM pv GROUP BY ALL"),
        ("gt", "SELECT group_id, date, sum(count) AS tot FROM ar GROUP BY ALL"),
        ("oth", "SELECT ar.group_id, ar.ts_id, ar.date, ar.is_pre, '(others)' AS peer_ts_id, "
                "CAST(-1 AS BIGINT) AS peer_pos, gt.tot - ar.count - coalesce(psum.ps, 0.0) AS value "
                "FROM ar JOIN gt USING (group_id, date) LEFT JOIN psum USING (group_id, ts_id, date)"),
        ("me", "SELECT group_id, ts_id, date, is_pre, 'target' AS peer_ts_id, CAST(0 AS BIGINT) "
               "AS peer_pos, count AS value FROM ar"),
        ("des", "SELECT * FROM me UNION ALL SELECT * FROM pv UNION ALL SELECT * FROM oth"),
    ]
    return R(with_(ctes, "SELECT des.*, CAST(o.pos AS INTEGER) AS tpos FROM des JOIN o "
                         "USING (group_id, ts_id)"), "value")


def q_standardize(cfg):
    return R(with_(model_ctes(cfg), (
        "SELECT group_id, ts_id, date, (response - avg(response) OVER s) / "
        "nullif(stddev_samp(response) OVER s, 0) AS scaled_response FROM ms "
        "WINDOW s AS (PARTITION BY group_id, ts_id)")), "scaled_response")


# --------------------------------------------------------------- LOWESS

def _lowess_pass(k: int, prev: str) -> list[tuple[str, str]]:
    """One fit of every fit point: list positions from 1, the weighted mean and spread
    of the window's positions, the line at i; straight lines between fit points."""
    near = "list_filter(range(greatest(1, i - h), least(n, i + h) + 1), lambda j: abs(i - j) <= 0.999 * h)"
    tri = "CASE WHEN abs(i - j) <= 0.001 * h THEN 1.0 ELSE power(1.0 - power(abs(i - j) / h, 3), 3) END * rw[j]"
    return [
        (f"lo_u{k}", f"SELECT *, {near} AS js FROM (SELECT group_id, ts_id, n, y, rw, i, greatest(i - nl, nl + ns - 1 - i) AS h FROM "
                  "(SELECT *, least(greatest(CAST(ceil((2 * i - ns) / 2.0) AS BIGINT), 1), n - ns + 1) AS nl FROM "
                  f"(SELECT group_id, ts_id, n, ns, y, rw, unnest(pts) AS i FROM {prev} WHERE n > 1) a) b) c"),
        (f"lo_w{k}", f"SELECT group_id, ts_id, n, y, i, js, list_transform(js, lambda j: {tri}) AS w FROM lo_u{k}"),
        (f"lo_s{k}", "SELECT *, list_sum(w) AS sw, list_sum(list_transform(js, lambda j, p: w[p] * j)) / list_sum(w) AS mx, "
                  f"list_sum(list_transform(js, lambda j, p: w[p] * y[j])) / list_sum(w) AS my FROM lo_w{k}"),
        (f"lo_f{k}", "SELECT group_id, ts_id, list(v ORDER BY i) AS f FROM (SELECT group_id, ts_id, i, CASE WHEN sw <= 0 THEN y[i] "
                  "WHEN sqrt(c) > 0.001 * (n - 1) THEN my + (i - mx) * cy / c ELSE my END AS v FROM (SELECT *, "
                  "list_sum(list_transform(js, lambda j, p: w[p] * power(j - mx, 2))) / sw AS c, "
                  f"list_sum(list_transform(js, lambda j, p: w[p] * (j - mx) * y[j])) / sw AS cy FROM lo_s{k}) a) b GROUP BY group_id, ts_id"),
        (f"lo_z{k}", f"SELECT * EXCLUDE (f), CASE WHEN n < 2 OR done THEN ys ELSE list_transform(range(1, n + 1), lambda i: "
                  "f[(i - 1) // step + 1] + CASE WHEN (i - 1) % step = 0 THEN 0.0 ELSE (f[(i - 1) // step + 2] - f[(i - 1) // step + 1]) "
                  "* (i - pts[(i - 1) // step + 1]) / (pts[(i - 1) // step + 2] - pts[(i - 1) // step + 1]) END) END AS fresh "
                  f"FROM {prev} LEFT JOIN lo_f{k} USING (group_id, ts_id)"),
        (f"lo_r{k}", "SELECT *, list_transform(y, lambda v, i: abs(v - fresh[i])) AS res, "
                  "6.0 * list_median(list_transform(y, lambda v, i: abs(v - fresh[i]))) AS cmad "
                  f"FROM lo_z{k}"),
        (f"lo_q{k}", "SELECT group_id, ts_id, active, d, y, n, ns, step, pts, fresh AS ys, done OR cmad < 1e-7 * list_avg(res) AS done, "
                  "list_transform(res, lambda v: CASE WHEN v <= 0.001 * cmad THEN 1.0 WHEN v <= 0.999 * cmad "
                  f"THEN power(1.0 - power(v / cmad, 2), 2) ELSE 0.0 END) AS rw FROM lo_r{k}"),
    ]


def lowess_ctes(cfg):
    ctes = trimmed_ctes(cfg) + [
        ("lx0", "SELECT group_id, ts_id, any_value(active) AS active, list(date ORDER BY date) AS d, list(count ORDER BY date) AS y, "
                "count(*) AS n FROM t GROUP BY group_id, ts_id"),
        ("lx1", "SELECT *, greatest(least(CAST(floor(n / 3.0 + 1e-7) AS BIGINT), n), 2) AS ns, "
                "greatest(CAST(floor(0.01 * (n - 1)) AS BIGINT), 1) AS step FROM lx0"),
        ("lo_q0", "SELECT *, list_distinct(list_concat(range(1, n + 1, step), [n])) AS raw_pts, y AS ys, n < 2 AS done, "
               "list_transform(y, lambda v: 1.0) AS rw FROM lx1"),
        ("lo_p0", "SELECT * EXCLUDE (raw_pts), list_sort(raw_pts) AS pts FROM lo_q0"),
    ]
    prev = "lo_p0"
    for k in range(1, 5):
        ctes += _lowess_pass(k, prev)
        prev = f"lo_q{k}"
    ctes.append(("sm", "SELECT group_id, ts_id, active, unnest(d) AS date, unnest(y) AS count, unnest(ys) AS count_smooth FROM lo_q4"))
    return [c for c in ctes]


def q_lowess(cfg):
    return R(with_(lowess_ctes(cfg), "SELECT * FROM sm"), "count", "count_smooth")


def pre_post_ctes(cfg):
    return lowess_ctes(cfg) + [last_pre_cte(cfg), (
        "pp", "SELECT sm.*, CASE WHEN date < sd.start_date THEN 'pre' ELSE 'post' END AS period, "
              "row_number() OVER (PARTITION BY sm.group_id, ts_id, CASE WHEN date < sd.start_date "
              "THEN 'pre' ELSE 'post' END ORDER BY date) AS k FROM sm JOIN sd USING (group_id)"), (
        "ps", "SELECT group_id, ts_id, period, avg(count) AS count_mean, CASE WHEN period = 'pre' "
              "THEN arg_max(count_smooth, date) ELSE max(CASE WHEN k = 2 THEN count_smooth END) END "
              "AS count_smooth, count(*) AS num_periods FROM pp GROUP BY group_id, ts_id, period"), (
        "pr", "SELECT *, " + ", ".join(
            f"CASE WHEN {v} IS NOT NULL AND count({v}) OVER (PARTITION BY group_id, period) > 1 "
            f"THEN (rank() OVER (PARTITION BY group_id, period ORDER BY {v} NULLS LAST) - 1) / "
            f"(count({v}) OVER (PARTITION BY group_id, period) - 1) END AS {o}"
            for v, o in (("count_mean", "count_mean_pctile"), ("count_smooth", "count_smooth_pctile"),
                         ("num_periods", "periods_pctile"))) + " FROM ps")]


def q_pre_post(cfg):
    return R(with_(pre_post_ctes(cfg), "SELECT * FROM pr"), "count_mean", "count_smooth",
             "count_mean_pctile", "count_smooth_pctile", "periods_pctile")


def _avg_rank_sql(expr: str, part: str, desc: bool) -> str:
    o = "DESC" if desc else "ASC"
    return (f"CASE WHEN {expr} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {expr} "
            f"{o} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {expr}) - 1) / 2.0 END")


def ts_rank_ctes(cfg):
    vals = ("count_mean", "count_smooth", "num_periods", "count_mean_pctile",
            "count_smooth_pctile", "periods_pctile")
    wide = ", ".join(f"any_value(CASE WHEN period = '{per}' THEN {v} END) AS {v}_{per}"
                     for v in vals for per in ("pre", "post"))
    return pre_post_ctes(cfg) + model_ctes(cfg)[len(prepared_ctes(cfg)):] + [
        ("wd", f"SELECT group_id, ts_id, {wide} FROM pr GROUP BY group_id, ts_id"),
        ("wd2", "SELECT *, count_mean_post - count_mean_pre AS count_mean_diff, "
                "count_smooth_post - count_smooth_pre AS count_smooth_diff, "
                "count_mean_pctile_post - count_mean_pctile_pre AS count_mean_pctile_diff, "
                "count_smooth_pctile_post - count_smooth_pctile_pre AS count_smooth_pctile_diff "
                "FROM wd WHERE num_periods_pre > 0"),
        ("rk", "SELECT group_id, ts_id, "
               f"{_avg_rank_sql('abs(count_mean_pctile_diff)', 'group_id', True)} AS count_mean_pctile_rank, "
               f"{_avg_rank_sql('abs(count_mean_diff)', 'group_id', True)} AS count_mean_rank, "
               f"{_avg_rank_sql('abs(count_smooth_diff)', 'group_id', True)} AS count_smooth_rank, "
               f"{_avg_rank_sql('abs(count_smooth_pctile_diff)', 'group_id', True)} "
               "AS count_smooth_pctile_rank FROM wd2"),
        ("mrk", f"SELECT group_id, ts_id, {_avg_rank_sql('p_Cumulative', 'group_id', False)} "
                "AS model_rank FROM msum"),
        ("tr", "SELECT sm.group_id, sm.ts_id, sm.date, sm.count, rk.count_mean_pctile_rank, "
               "rk.count_mean_rank, rk.count_smooth_rank, rk.count_smooth_pctile_rank, mrk.model_rank "
               "FROM sm JOIN rk USING (group_id, ts_id) LEFT JOIN mrk USING (group_id, ts_id)"),
    ]


RANKS = ("count_mean_pctile_rank", "count_mean_rank", "count_smooth_rank",
         "count_smooth_pctile_rank", "model_rank")


def q_ts_rank(cfg):
    return R(with_(ts_rank_ctes(cfg), "SELECT * FROM tr"), "count", *RANKS)


def q_ts_rank_top(cfg, top=5):
    cond = " OR ".join(f"coalesce({r} <= {top}, false)" for r in RANKS)
    show = lambda r: (f"coalesce(regexp_replace(CAST(CAST({r} AS DECIMAL(20, 1)) AS VARCHAR), "  # noqa: E731
                      "'[.]0$', ''), 'NA')")
    order = ("model_rank", "count_mean_rank", "count_mean_pctile_rank", "count_smooth_rank", "count_smooth_pctile_rank")
    title = " || ' ' || ".join(["substr(ts_id, 1, 5)", *map(show, order)])
    return R(with_(ts_rank_ctes(cfg), f"SELECT *, {title} AS title FROM tr WHERE {cond}"), "count", *RANKS)


def build() -> dict[str, str]:
    out = {}
    for name, (kind, cfg) in P.SQL_QUERIES.items():
        out[name] = globals()[kind](cfg)
    return out

import datetime as dt

import numpy as np
import pandas as pd

from peerpanel.operators import report as RP
from peerpanel.operators.lowess import lowess_smooth
from peerpanel.operators.prepare import prepare_panel
from peerpanel.sources.panel import panel


def test_sparse_draw_stats(spark):
    coefs = spark.createDataFrame(
        [("g", "t", 3, "p1", 2.0), ("g", "t", 4, "p1", -1.0)],
        "group_id string, ts_id string, draw int, peer_ts_id string, coef double")
    r = RP.peer_coef_stats(coefs, niter=4, burn_fraction=0.0).first()
    assert (r.inclusion_prob, r.coef, r.positive_prob, r.sign) == (0.5, 0.5, 1.0, 1.0)
    assert r.positive_share == 0.25
    empty = RP.peer_coef_stats(coefs.where("false"), niter=4)
    assert empty.count() == 0


def _smooth_by_polyfit(y, iters=3):
    """The definition with a general least-squares routine: a weighted line
    at every fit point, straight lines between them, bisquare weights."""
    n = len(y)
    x = np.arange(1, n + 1, dtype=float)
    ns = max(min(int(n / 3 + 1e-7), n), 2)
    step = max(1, int(0.01 * (n - 1)))
    at = sorted({*range(0, n, step), n - 1})
    rob = np.ones(n)
    for _ in range(iters + 1):
        fit = []
        for i in at:
            h = np.sort(np.abs(x - x[i]))[ns - 1]
            d = np.abs(x - x[i])
            w = np.where(d <= 0.999 * h, np.where(d <= 0.001 * h, 1, (1 - (d / h) ** 3) ** 3), 0) * rob
            c = np.polyfit(x - x[i], y, 1, w=np.sqrt(w)) if (w > 0).sum() > 1 else [0, y[i]]
            fit.append(c[1])
        ys = np.interp(x, x[at], fit)
        r = np.abs(y - ys)
        m = 6 * np.median(r)
        if m < 1e-7 * r.mean():
            break
        rob = np.where(r <= 0.001 * m, 1, np.where(r <= 0.999 * m, (1 - (r / m) ** 2) ** 2, 0))
    return ys


def _smoothed(spark, series):
    d0 = dt.date(2020, 1, 1)
    rows = [("g", k, True, d0 + dt.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    p = spark.createDataFrame(rows, "group_id string, ts_id string, active boolean, date date, count double")
    out: dict = {}
    for r in lowess_smooth(p).orderBy("date").collect():
        out.setdefault(r.ts_id, []).append(r.count_smooth)
    return out


def test_lowess_equals_weighted_least_squares(spark):
    rng = np.random.default_rng(0)
    series = {str(n): rng.normal(20, 3, n) for n in [5, 30, 101, 250, 420]}     # above 101 points the fit is interpolated
    series["outlier"] = np.where(np.arange(60) == 30, 900.0, series["250"][:60])
    got = _smoothed(spark, series)
    for k, y in series.items():
        assert np.allclose(got[k], _smooth_by_polyfit(y), atol=1e-6), k


def test_lowess_line_is_exact(spark):
    series = {"line": 2.0 * np.arange(40) + 1.0, "flat": np.full(200, 7.0), "one": [3.0], "two": [3.0, 5.0]}
    got = _smoothed(spark, series)
    assert all(np.allclose(got[k], y) for k, y in series.items())


def _injected(spark, seed=143):
    rng = np.random.default_rng(seed)
    d0 = dt.date(2024, 1, 1)
    start = d0 + dt.timedelta(days=45)
    rows = []
    for ts in range(1, 31):
        for k in range(90):
            d = d0 + dt.timedelta(days=k)
            c = float(rng.poisson(50))
            if d > start and ts == 1:
                c = 100.0
            if d > start and ts == 2:
                c = 1.0
            rows.append((str(ts), d, c))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts_id", "date", "count"]))
    return prepare_panel(panel(df), start, "day", min_timeseries=30), start


def test_ratio_model_flags_injected_series(spark):
    from peerpanel.operators.impact import ratio_models

    p, start = _injected(spark)
    s = RP.model_summary(ratio_models(p, start, alpha=0.01, period="day"))
    dev = {r.ts_id: r.deviance for r in s.collect()}
    assert dev["1"] == "over" and dev["2"] == "under"


def test_ridge_model_acceptance(spark):
    """The same example with the default model, and its peer tables."""
    from peerpanel.operators.impact import fit_models

    p, start = _injected(spark)
    m = fit_models(p, start, "day", alpha=0.01)
    dev = {r.ts_id: r.deviance for r in RP.model_summary(m).collect()}
    assert dev["1"] == "over" and dev["2"] == "under"
    assert sum(v == "average" for v in dev.values()) == 28
    peers = RP.peer_contributions(m).cache()
    assert {r.target_ts_id for r in peers.select("target_ts_id").distinct().collect()} == {"1", "2"}
    names = {r.ts_id for r in peers.where("target_ts_id = '1'").select("ts_id").distinct().collect()}
    assert names == {"target", *map(str, range(2, 31))}
    chance = {r[0] for r in peers.where("ts_id <> 'target'").select("inclusion_prob").distinct().collect()}
    assert any(0 < c < 1 for c in chance) and 0.0 in chance
    assert peers.select("inclusion_rank").distinct().count() > 3
    assert 0 < RP.peer_plot_rows(peers).count() < peers.count()
    every = RP.peer_contributions(m, all_peers=True, deviating_only=False)
    assert every.count() == 30 * 30 * 90


def _wide(p, start):
    wide = p.toPandas().pivot(index="date", columns="ts_id", values="count").sort_index()
    return wide, sum(d <= start for d in wide.index)


def _plain_adjusted(y, n, season):
    """Season and mean of one series by plain loops."""
    cycles, s = n // season, np.zeros(len(y))
    if cycles >= 2:
        off = n - cycles * season
        per = [[y[off + c * season + k] for k in range(season)] for c in range(cycles)]
        slope = (np.mean(per[-1]) - np.mean(per[0])) / ((cycles - 1) * season)
        for t in range(len(y)):
            k = (t - off) % season
            s[t] = np.mean([c[k] for c in per]) - np.mean(per) - slope * (k - (season - 1) / 2)
    return y - s - np.mean((y - s)[:n]), s + np.mean((y - s)[:n])


def test_ridge_equals_plain_ridge_on_all_others(spark, monkeypatch):
    """Effects, residual sd, variance and draws against primal ridge regressions,
    one at a time; with small parts, several of them and blocks of targets."""
    import math

    from peerpanel.operators import ridge
    from peerpanel.operators.impact import fit_models

    monkeypatch.setattr(ridge, "PART", 11)
    monkeypatch.setattr(ridge, "TARGETS", 7)
    p, start = _injected(spark)
    m = fit_models(p, start, "day", alpha=0.01, draws=4, max_peers=6)
    wide, n = _wide(p, start)
    parts = {c: _plain_adjusted(wide[c].to_numpy(), n, 7) for c in wide.columns}
    x = {c: v[0] for c, v in parts.items()}
    lam = ridge.RIDGE * sum((v[:n] ** 2).sum() for v in x.values()) / n
    got = {r.ts_id: r for r in m.effects.collect()}
    coefs = m.peers(m.effects).toPandas()

    def betas(c, others, w=None):
        z, w = np.stack([x[o][:n] for o in others], 1), np.ones(n) if w is None else w
        return np.linalg.solve(z.T @ (w[:, None] * z) + lam * np.eye(len(others)), z.T @ (w * x[c][:n]))

    for c in wide.columns:
        others = [o for o in wide.columns if o != c]
        z = np.stack([x[o] for o in others], 1)
        b = betas(c, others)
        res = x[c] - z @ b
        hat = z[:n] @ np.linalg.solve(z[:n].T @ z[:n] + lam * np.eye(len(others)), z[:n].T)
        out = res[:n] / (1 - np.diag(hat))
        sigma = math.sqrt((out ** 2).sum() / (n - 7))
        k = len(res) - n
        w = z[n:].sum(0) @ np.linalg.solve(z[:n].T @ z[:n] + lam * np.eye(len(others)), z[:n].T)
        sd = sigma * math.sqrt(k + k * k / n + w @ w)
        assert abs(got[c].AbsEffect_Cumulative - res[n:].sum()) < 1e-6
        assert abs(got[c].AbsEffect_Average - res[n:].mean()) < 1e-6
        assert abs(got[c].p_Cumulative - 0.5 * math.erfc(abs(res[n:].sum()) / sd / math.sqrt(2))) < 1e-6
        for draw in range(5):
            b = betas(c, others, ridge.draw_weights(n, draw))
            best = sorted(others, key=lambda o: -abs(b[others.index(o)]) * np.linalg.norm(x[o][:n]))[:6 if draw == 0 else 3]
            mine = coefs[(coefs.ts_id == c) & (coefs.draw == draw)]
            assert set(mine.peer_ts_id) == set(best)
            assert all(abs(b[others.index(o)] - v) < 1e-9 for o, v in zip(mine.peer_ts_id, mine.coef))


def test_season_does_not_count_as_effect(spark):
    """A weekly pattern of one series, with a post window of weekend days only."""
    from peerpanel.operators.impact import fit_models

    rng = np.random.default_rng(5)
    d0 = dt.date(2024, 1, 1)
    rows = [(f"s{s}", d0 + dt.timedelta(days=k), float(rng.poisson(100) + (60 if s == 0 and k % 7 >= 5 else 0)))
            for s in range(12) for k in range(61)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts_id", "date", "count"]))
    start = d0 + dt.timedelta(days=53)            # the post window ends on a weekend
    p = prepare_panel(panel(df), start, "day", 4, 2, 3).where(f"date <= '{start}' or date > '{d0 + dt.timedelta(days=53)}'")
    short = p.where(f"date <= '{start}' or date in ('{d0 + dt.timedelta(days=54)}', '{d0 + dt.timedelta(days=55)}')")
    dev = {r.ts_id: r.deviance for r in RP.model_summary(fit_models(short, start, "day", alpha=0.01)).collect()}
    assert dev["s0"] == "average"
    plain = {r.ts_id: r.deviance for r in RP.model_summary(fit_models(short, start, "day", alpha=0.01, method="ratio")).collect()}
    assert plain["s0"] == "over"


def test_flat_and_single_series_have_no_class(spark):
    from peerpanel.operators.impact import fit_models

    rows = [("flat", d.date(), 5.0) for d in pd.date_range("2024-01-01", periods=40)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts_id", "date", "count"]))
    p = prepare_panel(panel(df), dt.date(2024, 1, 25), "day", 4, 2, 1)
    m = fit_models(p, dt.date(2024, 1, 25), "day")
    r = m.effects.first()
    assert r.p_Cumulative is None and abs(r.AbsEffect_Cumulative) < 1e-9
    assert m.coefs.count() == 0 and RP.peer_contributions(m).count() == 0
    assert {x.deviance for x in RP.model_summary(m).collect()} == {"average"}


def test_model_ts_rank_rules(spark):
    """Strict pre rule, second post value, average ties, model rank join."""
    from peerpanel.operators.impact import ratio_models

    p, start = _injected(spark)
    m = ratio_models(p, start, alpha=0.01, period="day")
    st = RP.pre_post_stats(p, m.pre_end).collect()
    pre_end = m.pre_end["pre_end"]
    assert pre_end == start
    n_pre = {r.num_periods for r in st if r.period == "pre"}
    assert n_pre == {45}  # the last pre bucket counts as post under the strict rule
    ranked = RP.model_ts_rank(m, p)
    top = RP.model_ts_rank_top(ranked, 1).select("ts_id").distinct().collect()
    assert {"1", "2"} & {r.ts_id for r in top}


def test_partition_invariance(spark):
    from peerpanel.operators import describe as DS

    p, start = _injected(spark)
    def rows(df):
        return sorted((r.date, r.name, None if r.value is None else round(r.value, 9))
                      for r in df.collect())

    assert rows(DS.desc_summary_stats(p)) == rows(DS.desc_summary_stats(p.repartition(3)))


def test_peer_window_clamps_at_ends(spark):
    from peerpanel.operators.peers import active_rows, select_peers

    rows = []
    for s in range(1, 7):
        for k, d in enumerate(pd.date_range("2024-01-01", periods=4, freq="D")):
            rows.append(("g", f"s{s}", d.date(), True, float(s * 10 + k)))
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["group_id", "ts_id", "date", "active",
                                                          "count"]))
    got = {}
    for r in select_peers(active_rows(p, dt.date(2024, 1, 2)), 2).collect():
        got.setdefault(r.ts_id, set()).add(r.peer_ts_id)
    assert got["s1"] == {"s2", "s3"} and got["s6"] == {"s4", "s5"}
    assert got["s3"] == {"s2", "s4"} and all(len(v) == 2 for v in got.values())

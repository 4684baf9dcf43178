"""Steps whose rows or memory must not grow faster than the input."""

import datetime as dt
import io
from contextlib import redirect_stdout

import numpy as np
from conftest import make_panel

from peerpanel.operators import report as RP
from peerpanel.operators import ridge
from peerpanel.operators.impact import blocks_of, fit_models
from peerpanel.operators.prepare import prepare_panel


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _panel(spark, n=12):
    rng = np.random.default_rng(3)
    d0 = dt.date(2024, 1, 1)
    rows = [(f"s{s}", (d0 + dt.timedelta(days=k)).isoformat(), float(rng.poisson(20) + (40 if s < 2 and k > 40 else 0)))
            for s in range(n) for k in range(60)]
    return prepare_panel(make_panel(spark, rows), d0 + dt.timedelta(days=40), "day", 4, 2, 3), d0 + dt.timedelta(days=40)


def test_strongest_equals_brute_force_with_copies():
    rng = np.random.default_rng(1)
    for n, rows, k, copies in ((59, 3000, 3, 1), (59, 3000, 50, 20), (9, 5, 50, 1), (9, 700, 700, 1)):
        x = np.repeat(rng.poisson(5, (rows // copies, n)) - 5.0, copies, 0)
        alpha, norm, own = rng.normal(size=(40, n)), np.sqrt((x * x).sum(1)), rng.integers(-1, len(x), 40)
        i, j, coef, score = ridge.strongest(alpha, x, norm, own, k)
        for r in range(40):
            c = np.einsum("ij,j->i", x, alpha[r])
            s = np.abs(c) * norm
            if own[r] >= 0:
                s[own[r]] = -1
            best = np.argsort(-s, kind="stable")[:k]
            best = best[s[best] >= 0]
            assert len(j[i == r]) == len(best) and np.allclose(score[i == r], s[best])
            assert np.allclose(np.abs(coef[i == r]) * norm[j[i == r]], s[best])


def test_blocks_grow_to_a_fixed_size(spark):
    """Series travel once per block of targets: 25 blocks for 100,000 targets."""
    df = spark.range(100_000).selectExpr("'g' AS group_id", "id AS ts_id", "array(1D) AS y")
    r = blocks_of(df, df).first()
    assert (r.blocks, r.cuts) == (25, 16)


def test_dated_peer_rows_pass_no_exchange(spark):
    p, start = _panel(spark)
    m = fit_models(p, start, "day", alpha=0.01)
    for df in (RP.peer_contributions(m), RP.peer_contributions(m, all_peers=True)):
        assert df.count() > 0
        # the plan is a tree from the result down: nothing above the explode of the dates
        above = _plan(df).split("explode(arrays_zip")[0]
        assert "Exchange" not in above and "Window" not in above


def test_peer_design_moves_series_not_dates(spark, monkeypatch):
    """Windows over blocks of positions give the plain windows; dates come after the last exchange."""
    from peerpanel.operators import peers as PE

    p, start = _panel(spark, 30)
    monkeypatch.setattr(PE, "BLOCK", 3)
    rows = PE.active_rows(p, start)
    order = PE.series_order(rows)
    pos = {r.ts_id: r.pos for r in order.collect()}
    for k in (2, 5, 8):
        got = {}
        for r in PE.select_peers(rows, k, order).collect():
            assert pos[r.peer_ts_id] == r.peer_pos
            got.setdefault(pos[r.ts_id], []).append(r.peer_pos)
        for at in range(1, 31):
            first = max(1, min(at - k // 2, 30 - k))
            assert sorted(got[at]) == [q for q in range(first, min(30, first + k) + 1) if q != at]
    design = PE.peer_design(p, start, 4)
    assert design.count() == 30 * 6 * 60
    assert "Exchange" not in _plan(design).split("posexplode(arrays_zip")[0]


def test_series_form_equals_rows(spark):
    """Trimmed series, running distinct counts and quantiles from one row per series, with
    negative counts whose running sum comes back to 0, as from the dense rows."""
    from peerpanel.operators import describe as DS
    from peerpanel.operators.prepare import prepare_series

    rng = np.random.default_rng(7)
    d0 = dt.date(2024, 1, 1)
    rows = [(f"s{s}", (d0 + dt.timedelta(days=int(k))).isoformat(), float(c)) for s in range(40)
            for k, c in zip(sorted(rng.choice(np.arange(3, 57), 6, replace=False)), (2, -2, 0, 1, -1, 3) if s % 3 else (0, 1, 0, 2, 5, 1))]
    rows += [("z", d0.isoformat(), 0.0), ("z", (d0 + dt.timedelta(days=59)).isoformat(), 0.0)]
    args = (make_panel(spark, rows), d0 + dt.timedelta(days=30), "day", 0, 0, 1, False)
    p, s = prepare_panel(*args).cache(), prepare_series(*args).cache()
    t = DS.trim_leading_zeros(p)
    want = sorted(map(tuple, t.select("ts_id", "date", "count").collect()))
    for got in (DS.trimmed_arrays(s, "day"), DS.trimmed_arrays(p)):
        assert sorted((r.ts_id, d, y) for r in got.collect() for d, y in zip(r.d, r.y)) == want
    got = DS.running_distinct_series(s, "day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, DS.running_distinct(t).collect()))
    start = d0 + dt.timedelta(days=30)
    a, b = (sorted((*r[:3], round(r[3], 9)) for r in x.collect()) for x in (DS.desc_quantile_timeseries(p, start), DS.desc_quantile_timeseries(s, start, bucket="day")))
    assert a == b and a
    above = _plan(DS.trimmed_arrays(s, "day")).split("InMemory")[0]         # the cached series
    assert "Generate" in above and "Exchange" not in above and "Window" not in above


def test_undrawn_peers_by_date_not_by_target(spark, monkeypatch):
    """Rows of all peers equal plain ones; those no draw holds come by peer and date for several
    targets at once, and no strongest peers of the fit are made only to be listed again."""
    monkeypatch.setattr(RP, "TOGETHER", 5)
    p, start = _panel(spark, 20)
    m = fit_models(p, start, "day", alpha=0.01)
    peers, asked = m.peers, []
    m.peers = lambda *a: asked.append(peers(*a)) or asked[-1]
    got = [r.asDict() for r in RP.peer_contributions(m, deviating_only=False, all_peers=True, digits=6).collect()]
    coefs, burn = {}, 2
    for r in asked[0].collect():
        assert r.draw > 0
        if r.draw > burn:
            coefs.setdefault(r.ts_id, {}).setdefault(r.peer_ts_id, []).append(r.coef)
    y = {r.peer_ts_id: dict(zip(r.d, r.y)) for r in m.design.collect()}
    assert len(got) == len({(r["target_ts_id"], r["ts_id"], r["date"]) for r in got}) == 20 * 20 * 60
    for r in got:
        mine, day = coefs[r["target_ts_id"]], (r["date"] - dt.date(1970, 1, 1)).days
        chances = {round(len(c) / 18, 6) for c in mine.values()} | {1.0}
        c = mine.get(r["ts_id"])
        chance = 1.0 if r["ts_id"] == "target" else round(len(c) / 18, 6) if c else 0.0
        assert r["inclusion_prob"] == chance and r["inclusion_rank"] == 1 + sum(v > chance for v in chances)
        if r["ts_id"] != "target":
            assert abs(r["scaled_count"] - y[r["ts_id"]][day] * (np.mean(c) if c else 1)) < 1e-6
            assert (r["coef"] is None) == (c is None) and (r["sign"] is None) == (c is None)
            assert c or r["positive_share"] == 0
    plain = [(r["ts_id"], r["date"]) for r in got if r["inclusion_prob"] == 0]
    assert sum(a != b for a, b in zip(plain, plain[1:])) < len(plain) * 2 / 3     # all of them, with dates innermost

import datetime as dt
import math

import numpy as np
from conftest import make_panel

from peerpanel.operators.changepoint import detect_changepoint, explode_data


def binseg(x, q):
    """Brute-force binary segmentation (MBIC costs), for the check."""
    x = np.asarray(x, float)
    x = x - x.mean()
    n = len(x)

    def cost(a):
        return float(((a - a.mean()) ** 2).sum()) + math.log(len(a))

    segs, pts, rec = [(0, n)], [], math.inf
    for _ in range(q):
        best = None
        for s, e in segs:
            for k in range(s + 1, e):
                g = cost(x[s:e]) - cost(x[s:k]) - cost(x[k:e])
                if best is None or g > best[0] + 1e-9 or (abs(g - best[0]) <= 1e-9 and k < best[1]):
                    best = (g, k, s, e)
        if best is None:
            break
        rec = min(rec, best[0])
        pts.append((best[1], rec))
        g, k, s, e = best
        segs = [sg for sg in segs if sg != (s, e)] + [(s, k), (k, e)]
    keep = [i for i, (_, r) in enumerate(pts) if r >= 3 * math.log(n)]
    return [pts[i][0] for i in range(max(keep) + 1)] if keep else []


def test_changepoint_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(10, 1, 20), rng.normal(30, 1, 15), rng.normal(5, 1, 25)])
    d0 = dt.date(2024, 1, 1)
    rows = [("a", str(d0 + dt.timedelta(days=i)), v) for i, v in enumerate(vals)]
    # every day present: month-step dates already exist, no completion rows
    p = make_panel(spark, rows)
    got = detect_changepoint(p, num_cpts=3, include_model=True).orderBy("cpt_round").collect()
    want = binseg(vals, 3)
    assert [(r.change_date - d0).days + 1 for r in got] == want
    r = got[0]
    k = want[0]
    assert abs(r.before_mean - vals[:k].mean()) < 1e-9
    assert abs(r.after_mean - vals[k:].mean()) < 1e-9


def test_zero_before_mean_and_nested(spark):
    rows = [("a", f"2024-01-{d:02d}", 0 if d <= 10 else 50) for d in range(1, 21)]
    p = make_panel(spark, rows)
    r = detect_changepoint(p).first()
    assert r.change_date == dt.date(2024, 1, 10)
    assert r.before_mean == 0 and r.pct_change is None
    ex = explode_data(detect_changepoint(p, include_data=True))
    assert ex.count() == 20


def test_no_changepoint(spark):
    rows = [("a", f"2024-01-{d:02d}", 5) for d in range(1, 21)]
    assert detect_changepoint(make_panel(spark, rows)).count() == 0


def test_month_completion_adds_zero_rows(spark):
    from peerpanel.operators.changepoint import group_total_month_complete

    p = make_panel(spark, [("a", "2020-01-31", 1), ("a", "2020-04-30", 1)])
    got = sorted((r.date, r["count"]) for r in group_total_month_complete(p).collect())
    assert got == [(dt.date(2020, 1, 31), 1.0), (dt.date(2020, 3, 2), 0.0),
                   (dt.date(2020, 3, 31), 0.0), (dt.date(2020, 4, 30), 1.0)]

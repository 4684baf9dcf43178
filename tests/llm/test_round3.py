"""Hard negatives, spelling variants and URL filter against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, make_docs, prose

from peerpanel.llm import decontaminate, hard_negatives, langid, queries, spelling, toxicity, url_filter

# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, score double, q string, `x.y` string, row int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "z", "z", 7) for r in rows], VECTORS)


def brute_negatives(rows, k=5, m=10):
    ok = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in rows
          if lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, lab, q) in enumerate(ok):
        if i is None or i % 100:
            continue
        mates = [(sum(x * y for x, y in zip(q, p)), j, l) for b, (j, l, p) in enumerate(ok) if b != a and len(p) == len(q)]
        for ps, pid, _ in sorted([x for x in mates if x[2] == lab], key=order)[:k]:
            fit = sorted([x for x in mates if x[2] != lab and 30 * ps <= 100 * x[0] <= 90 * ps], key=order)[:m]
            out += [(i, pid, n + 1, j, ps, s) for n, (s, j, _) in enumerate(fit)]
    return out


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 12))
    rows = [(i, int(rng.integers(4)), (centre[rng.integers(6)] + 0.3 * rng.normal(size=12)).astype(np.float32).tolist())
            for i in range(700)]
    rows += [rows[200], rows[200], rows[300], (None, 1, rows[5][2]), (800, None, rows[5][2]), (900, 1, None), (1000, 2, []),
             (1100, 1, [None] + rows[5][2][1:]), (1200, 1, [float("nan")] + rows[5][2][1:]), (1300, 1, [0.0] * 12),
             (1400, 3, [1.0, 2.0]), (1401, 3, [1.5, 2.0]), (1402, 2, [0.5, 1.0]), (1500, 1, [float("inf")] + rows[5][2][1:])]
    rows += [(2000 + i, 1, rows[7][2]) for i in range(60)] + [(3000 + i, 2, rows[7][2]) for i in range(60)]     # ties
    got = hard_negatives.hard_negatives(vectors(spark, rows), lambda i: i % 100 == 0, block=16).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_negatives(rows), key=key) and got


def test_hard_negatives_empty(spark):
    assert hard_negatives.hard_negatives(vectors(spark, []), lambda i: i % 100 == 0).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1.0])]), lambda i: i % 100 == 0).collect() == []


def test_hilbert_index_walks_neighbours():
    for dim, bits in ((2, 3), (3, 2), (4, 2)):
        v = np.array(np.meshgrid(*[range(1 << bits)] * dim)).reshape(dim, -1).T
        order = sorted(range(len(v)), key=lambda i: hard_negatives.hilbert(v, bits)[i].tobytes())
        steps = np.abs(np.diff(v[order], axis=0)).sum(1)
        assert (steps == 1).all()


def test_zone_bounds_hold_and_skip():
    rng = np.random.default_rng(1)
    a, q = rng.integers(-90, 90, (40, 8)), rng.integers(-90, 90, (200, 8))
    lo, hi = q.min(0)[None], q.max(0)[None]
    least, most = hard_negatives.zone_bounds(a, lo, hi)
    score = a @ q.T
    assert (least[:, 0] <= score.min(1)).all() and (score.max(1) <= most[:, 0]).all()
    far = {"lo": np.array([[50] * 8, [-60] * 8]), "hi": np.array([[60] * 8, [-50] * 8]),
           "label_lo": np.array([1, 1]), "label_hi": np.array([1, 1])}
    asks = {"q": np.full((1, 8), 10), "label": np.array([1]), "low": np.array([[0]]), "high": np.array([[10**6]]),
            "floor": np.array([[0]])}
    assert hard_negatives.wanted(asks, far, True, False).tolist() == [[True, False]]
    assert not hard_negatives.wanted(asks, far, False, False).any()


def test_products_are_exact():
    a = np.array([[1 << 25, 3, -(1 << 26)]])
    assert hard_negatives.products(a, a).tolist() == [[(1 << 50) + 9 + (1 << 52)]]


# ---------------------------------------------------------------- spelling variants

def brute_words(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", r[1] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_variants(n):
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and edit_one(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    return out


def check_variants(got, n):
    want = brute_variants(n)
    assert {r["word"] for r in got} == set(n) and len(got) == len(n)
    for r in got:
        form, near = want[r["word"]]
        root = r["word"]
        while want[root][0]:
            root = want[root][0]
        assert (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) == (form, root, n[r["word"]], near, n.get(form))


def test_spelling_variants_of_documents(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["égalité", "Égalité", "straße"]
    texts = [" ".join(rng.choice(base).title() for _ in range(400)) for _ in range(80)]
    rows = awkward() + [(100 + i, t + " x" * 3) for i, t in enumerate(texts)] + [(5, texts[0]), (None, texts[1])]
    rows += [(900 + i, "z" * 3000 + f" {'q' * 200}{'ab'[i % 2]}{'q' * 200}") for i in range(8)]
    words = spelling.corpus_words(make_docs(spark, rows))
    n = brute_words(rows)
    assert {r["word"]: r["n"] for r in words.collect()} == n
    check_variants(spelling.spelling_variants(words).collect(), n)
    assert spelling.spelling_variants(spelling.corpus_words(make_docs(spark, []))).collect() == []


@pytest.mark.parametrize("shard, visits", [(7, 5), (64, 1000)])
def test_spelling_variants_in_small_shards(spark, monkeypatch, shard, visits):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "VISITS", visits)
    monkeypatch.setattr(spelling, "TAIL", 4)
    rng = random.Random(shard)
    n = {"".join(rng.choice("abß") for _ in range(rng.randint(5, 8))): rng.randint(3, 90) for _ in range(400)}
    n |= {w + "tail" * 6: c + 5 for w, c in list(n.items())[:60]}
    check_variants(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect(), n)


def test_sorted_list_skips_and_reuses():
    held = spelling.SortedList(sorted(["abcde", "abcdf", "abxde", "zzzzz", "abcdé"]), [1] * 5)
    q, w = held.near(["abcde", "abcdf"], 2)
    assert {(int(a), held.words[b]) for a, b in zip(q, w)} == \
        {(0, "abcdf"), (0, "abxde"), (0, "abcdé"), (1, "abcde"), (1, "abcdé")}
    q, w = held.near(["abcdee", "zabcde"], 2)
    assert {(int(a), held.words[b]) for a, b in zip(q, w)} == {(0, "abcde")}


# ------------------------------------------------------------------------ URL filter

PAGES = "page_id long, url string, host string, purity double, segments string, `x.y` string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1.0, "s", "z") for i, u in urls], PAGES)


URLS = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://"), (5, "http://A.Example.NET"), (6, "http://a.example.net/"),
        (7, "https://Example.net/en/1?q=/de/"), (8, "http://notexample.net/en/1"), (9, "http://x.example.com/de/1#f"),
        (10, "http://x.example.com/DE/1"), (11, "http://x.example.com/de"), (12, "http://y.org/fr/a://b"), (13, "http://net/x"),
        (14, "http://internet/x"), (15, "http://x.net?p=/"), (16, "http://x.org/fr/" + "s/" * 3000), (16, "http://x.org/fr/"),
        (None, "ftp://É.example.net:80/en/"), (18, "http://h.com/" + "a" * 100_000), (19, "://x.net/\n/1")]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    head = re.match(r"([^?#]*)", rest).group(1)
    host, slash, path = head.partition("/")
    host, path = re.sub("[A-Z]", lambda m: m.group().lower(), host), slash + path
    fit = [(r, v) for r, v in queries.URL_RULES if path.startswith(r[r.index("/"):])
           and ("." + host).endswith("." + r[:r.index("/")])]
    return host, path, *max(fit, key=lambda r: len(r[0]), default=(None, None))


def test_url_rules(spark):
    got = url_filter.judge_urls(pages(spark, URLS), queries.URL_RULES).collect()
    assert len(got) == len(URLS)
    want = Counter((i, *brute_rule(u)[:3]) for i, u in URLS)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    for r in got:
        decided = brute_rule("x://" + r["host"] + r["path"])[3] if r["host"] or r["path"] else None
        assert r["verdict"] == (decided or ("block" if r["purity"] >= 0.5 else "allow"))
    assert url_filter.judge_urls(pages(spark, []), queries.URL_RULES).collect() == []


def test_url_templates_learn_from_labels(spark):
    """Spam sections of mixed hosts are rejected, unlabelled slugs of them included."""
    rng = random.Random(8)
    rows, spam = [], {}
    for i in range(4000):
        host = rng.choice(["a.com", "a.com", "b.org", "c.de"])
        part = rng.choice(["news", "shop", "forum", "docs"])
        bad = (host, part) in {("a.com", "shop"), ("a.com", "forum"), ("b.org", "shop")}
        rows.append((i, f"http://{host}/{part}/{rng.choice(['s' + str(rng.random()), str(rng.randint(1, 10**9))])}"))
        spam[i] = bad
    df = pages(spark, rows).withColumn("label", url_filter.F.when(url_filter.F.col("page_id") % 5 == 0, url_filter.F.col("page_id")))
    known = [i for i in spam if spam[i]]
    label = url_filter.F.when(url_filter.F.col("label").isNotNull(), url_filter.F.col("label").isin(known))
    got = url_filter.judge_urls(df, (), label=label).collect()
    assert all((r["verdict"] == "block") == spam[r["page_id"]] for r in got)
    assert {r["template"] for r in got if r["host"] == "a.com"} >= {"/{forum|shop}/{*|{n}}"}
    by = defaultdict(set)
    for r in got:
        by[r["host"]].add(r["template"])
    assert max(map(len, by.values())) <= 6


def test_branches_that_differ_stay_apart(spark):
    rows = [("h", "", 0.1, c, 100, 100, b) for c, b in (("a", 0), ("b", 2), ("c", 60), ("d", 63), ("e", 99))] + \
        [("h", "", 0.1, "f", 10, 0, 0)]
    kids = spark.createDataFrame(rows, "host string, template string, parent double, child string, pages long, labelled long, blocked long")
    got = {r["child"]: r["name"] for r in url_filter._merged(kids, ["host", "template"]).collect()}
    assert got == {"a": "{a|b}", "b": "{a|b}", "c": "{c|d}", "d": "{c|d}", "e": "e", "f": "f"}


# ----------------------------------------------------- repeated rows and equal hashes

def test_repeated_rows_count_once_in_learning(spark, monkeypatch):
    rows = [(1, prose(1, 400), "aa")] * 3000 + [(i, prose(i, 300), "ab"[i % 2]) for i in range(2, 90)]
    docs, seen = make_docs(spark, rows), []
    learn = langid.learn
    monkeypatch.setattr(langid, "learn", lambda spans, *a: seen.append(len(spans)) or learn(spans, *a))
    assert langid.fit(docs, langid.F.lit(True), sample=20) is not None
    assert 20 * 2 <= seen[0] <= 20 * langid.SPANS
    labels = spark.createDataFrame([(r[0], 1, r[0] % 2) for r in rows[2999:]], "doc_id long, quality int, toxic int")
    logistic = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda i, c, y, *a, **k: seen.append(len(y)) or logistic(i, c, y, *a, **k))
    toxicity.fit(docs, labels, toxicity.F.lit(True), sample=50)
    assert seen[1] == 50


def test_words_with_equal_polynomial_hashes_differ(spark):
    bits = "0"
    for _ in range(10):
        bits += bits.translate(str.maketrans("01", "10"))
    a = bits.translate(str.maketrans("01", "ab"))
    b = bits.translate(str.maketrans("01", "ba"))
    docs = make_docs(spark, [(1, a), (2, b), (3, f"x {b} y")])
    for item, hits in ((a, [1]), (b, [2, 3])):
        found = decontaminate.find_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
        assert sorted(r["doc_id"] for r in found.collect() if r["runs"]) == hits


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash of the length alone every word is compared by its bytes."""
    real = decontaminate.prime_hashes
    weak = lambda b, s, e, seed=0: real(b, s, e, seed) if seed else (e - s).astype(np.uint64)
    docs = [(1, "one two six ten"), (2, "one two sax ten"), (3, "six one two")]
    for item, want in (("two six", {1: [(1, 3)]}), ("two", {1: [(1, 2)], 2: [(1, 2)], 3: [(2, 3)]}),
                       ("seven six", {}), ("six", {1: [(2, 3)], 3: [(0, 1)]})):
        monkeypatch.setattr(decontaminate, "prime_hashes", weak)
        block = decontaminate.test_block([("7", item)], 10)
        got = list(decontaminate.scan_texts(decontaminate.pa.array([t for _, t in docs]), block, 10))
        assert {i: r for (i, _), (_, r, _) in zip(docs, got) if r} == want

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import awkward, components, make_docs, prose

from peerpanel.llm import embed_dedup, line_dedup, simhash, suffix_dedup


# ------------------------------------------------------------------ SimHash

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    w = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + w]), 42) for i in range(len(words) - w + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    base = [prose(i, 60) for i in range(12)]
    rows = awkward() + [(100 + 10 * i + j, " ".join(t.split()[:60 - j])) for i, t in enumerate(base) for j in range(4)]
    got = {}
    for r in simhash.simhash_near_duplicates(make_docs(spark, rows)).collect():
        got.setdefault((r["doc_id"], r["fp"] & (1 << 64) - 1), set()).add(r["component_id"])
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = components(len(rows), links)
    low = {}
    for (d, _), c in zip(rows, comp):
        low[c] = min([x for x in (low.get(c), d) if x is not None], default=None)
    assert got == {(d, f): {low[c]} for (d, _), f, c in zip(rows, fps, comp)}
    assert len(set(comp)) < len(rows) - 8


def test_simhash_tiles_and_radius(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 63, 50).astype(np.uint64) for _ in range(4)]
    fp = np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1] ^ flips[2], base ^ flips[3]])
    for radius in (0, 1, 2, 3, 5):
        a, b = simhash._links(fp, np.zeros(len(fp), int), radius)
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        x, y = np.nonzero(near)
        assert (simhash._stars(len(fp), a, b) == simhash._stars(len(fp), x, y)).all()
        assert all(any((int(p) ^ int(q)) & m == 0 for m in simhash.block_masks(radius))
                   for p, q in zip(fp[x].tolist(), fp[y].tolist()))


def test_simhash_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)] + [base ^ 0xFFFF0000FFFF]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.fingerprint_components(df).collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert got == dict(zip(fps, components(len(fps), links)))


def test_simhash_keeps_one(spark):
    docs = make_docs(spark, awkward())
    kept = simhash.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 1, 2 and 3 have no words and join the null row; 4 is twice in the table and has the copy 5; 7 and 8 are equal;
    # one row of each stays
    assert sorted(x for x in ids if x is not None) == [1, 4, 7, 9, 10, 11, 12, 13] and ids.count(None) == 1
    assert simhash.keep_one_per_component(docs.limit(0)).count() == 0


# --------------------------------------------------------------- line dedup

def brute_lines(rows):
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    first, cut = {}, {}
    for o in order:
        lines = o[2].split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if not "".join(w).strip(" \t\r\f\v"):
                continue
            if first.setdefault(w, (o, i)) != (o, i):
                cut.setdefault(o, set()).update(range(i, i + 3))
    return [(d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in cut.get((d is None, d or 0, t or ""), ())))
            for d, t in rows]


def test_line_dedup_against_brute_force(spark):
    line = [prose(i, 5) for i in range(9)]
    rows = awkward() + [
        (50, "\n".join(line)), (51, "\n".join(line[2:7])), (52, "\n".join([line[0], *line[3:8], line[1]])),
        (53, "\n".join(line[:3] * 3)), (54, "\n".join(line[:2])), (55, "\n".join([line[8], "", *line[4:7], ""]))]
    docs = make_docs(spark, rows)
    out = line_dedup.drop_repeated_windows(docs, counts=False)
    assert out.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)
    # equal texts of one doc_id differ only in the order of their hashes
    assert got == sorted(brute_lines(rows), key=key)
    assert line_dedup.drop_repeated_windows(docs.limit(0)).count() == 0
    counted = line_dedup.drop_repeated_windows(docs)            # the counts replace columns of their names
    assert sorted(counted.columns) == sorted(docs.columns) and dict(counted.dtypes)["_n_lines"] == "int"
    assert {(r["doc_id"], r["text"]) for r in counted.collect()} == set(got)


# ------------------------------------------------------------- suffix dedup

def brute_repeats(texts, length):
    c = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = [False] * len(t)
        for i in range(len(t) - length + 1):
            if c[t[i:i + length]] > 1:
                cover[i:i + length] = [True] * length
        spans = sum(x and (i == 0 or not cover[i - 1]) for i, x in enumerate(cover))
        kept = bytes(b for b, x in zip(t, cover) if not x)
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    p = prose(77, 60)
    rows = [(d, t if t is None or len(t) < 9000 else t[:9000]) for d, t in awkward()]
    rows += [(100 + i, prose(200 + i, 20) + p + prose(300 + i, 20)) for i in range(8)]
    rows += [(120, p[:230]), (121, "q" + p[100:299] + "q"), (122, "q" + p[100:300] + "q"), (123, "ab" * 300),
             (124, p[:150] + "é" + p[150:]), (125, "é" * 150)]
    docs = make_docs(spark, rows)
    got = [tuple(r) for r in suffix_dedup.drop_repeats(docs, digest=True).collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 200))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = suffix_dedup.drop_repeats(docs.limit(0)).collect()
    assert kept == []


def test_difference_cover_against_brute_force():
    rng = np.random.default_rng(2)
    for length in (4, 11, 30, 100):
        for _ in range(40):
            got = [rng.choice(list(b"aab"), length + rng.integers(0, 30)).astype(np.uint8).tobytes()
                   for _ in range(rng.integers(1, 8))]
            c = Counter(x[i:i + length] for x in got for i in range(len(x) - length + 1))
            want = [[c[x[i:i + length]] > 1 for i in range(len(x) - length + 1)] for x in got]
            assert [r.tolist() for r in suffix_dedup.repeated_windows(got, length)] == want


def test_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 5000)
    text = np.frombuffer((prose(3, 3000) + "z" * 700).encode(), np.uint8)
    e, _ = suffix_dedup.entries(text, np.array([0, len(text)]), 200, 64)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 21)
    f, _ = suffix_dedup.entries(text, np.array([0, len(text)]), 200, 64)
    at = lambda x: np.concatenate([np.arange(a, a + s + 1) for a, s in zip(x["lo"], x["span"])])
    assert (at(e) == at(f)).all() and (at(e) == np.arange(len(text) - 199)).all()
    assert (np.repeat(e["a"], e["span"] + 1) == np.repeat(f["a"], f["span"] + 1)).all()


# --------------------------------------------------------------- embeddings

def test_embedding_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(50, 12)).astype(np.float32)
    x = np.concatenate([base] + [base[:30] + rng.normal(size=(30, 12)) * s for s in (.1, .25, .4)] + [base[:4]] * 20)
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] * 12, 1), (903, [1.0, None], 1), (904, [], 1),
           (905, [float("inf")] * 12, 1), (906, [1.0] * 3, 1), (907, [2.0] * 3, 1), (907, [2.0] * 3, 1), (None, [2.0] * 3, 1),
           (908, [1e-30, 0.0], 1), (909, [3e30, 0.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    out = embed_dedup.embedding_near_duplicates(df, tile=24, cells=5).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    comp = components(len(x), zip(*np.nonzero(near)))
    for i in range(len(x)):
        assert got[i] == (near[i].sum() - 1, comp[i], comp[i] == i)
    for i in (900, 901, 902, 903, 904, 905):
        assert got[i] == (0, i, True)
    assert got[906] == (3, 906, True) and got[907] == (3, 906, False) and got[None][:2] == (3, 906)
    assert got[908] == (1, 908, True) and got[909] == (1, 908, False)
    assert len(out) == len(rows) + len(odd)
    assert embed_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    u = embed_dedup.unit(rng.normal(size=(200, 33)))
    q, s, e = embed_dedup.quantise(u)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - approx) <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()

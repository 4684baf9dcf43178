import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, make_docs, prose
from pyspark.sql import functions as F

from peerpanel.llm import bpe, decontaminate, langid, license_scan, license_templates, token_output, toxicity
from peerpanel.llm.queries import tokenizer_path


# ---------------------------------------------------------- decontamination

def brute_hits(rows, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = low(t)
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[p:p + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = low(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p:p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= {str(i) for i in wins[x] if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 400])
def test_decontamination_against_brute_force(spark, block):
    items = [(i, prose(500 + i, 30)) for i in range(9)] + [(9, prose(500, 30)), (10, "Théâtre ÉCLAIR"), (11, None), (12, "..."),
                                                          (None, prose(600, 20)), (13, " ".join(["ha"] * 25))]
    w = [t.split() for _, t in items[:9]]
    rows = awkward() + [(100, " ".join(w[0])), (101, "x " + " ".join(w[1][3:13]) + " y " + " ".join(w[2][:12])),
                        (102, " ".join(w[3][:9])), (103, " ".join(w[4][:15] + w[5][:15]).upper()), (104, "théâtre Éclair"),
                        (105, "ThéâTRE ÉCLAIR."), (106, prose(600, 20)), (107, "ha-" * 40), (108, " ".join(["ha"] * 9))]
    docs = make_docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = decontaminate.find_matches(docs, bench, block_bytes=block)
    got = [tuple(r) for r in decontaminate.digest(found).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_hits(rows, items)))
    spans = {r["doc_id"]: {(m["item"], m["start"], m["words"]) for m in r["matches"]} for r in found.collect()}
    assert spans[100] == {("0", 0, 30), ("9", 0, 30)} and ("1", 1, 10) in spans[101] and ("13", 0, 25) in spans[107]
    kept = docs.where(~decontaminate.contaminated(bench, docs["text"], block_bytes=block))
    assert kept.columns == docs.columns and kept.count() == sum(not g[-1] for g in got)
    assert decontaminate.find_matches(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


# ---------------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


BITS = ["a", "b", "the", "ing", "é", "ß", " ", "  ", "\n", "1", "23", "!", "'s", "'ll", "$", "...", "<|endoftext|>",
        "<|endoftext", "\x1c", "日本", "\U0001f642", "_", "\xa0"]


def noise(r, n):
    return "".join(r.choice(BITS) * (r.choice([1, 1, 2, 3, 40, 90, 200]) if r.random() < .3 else 1) for _ in range(n))


def test_long_runs_and_cuts(monkeypatch, reference):
    monkeypatch.setattr(bpe, "LEAF", 24)
    monkeypatch.setattr(bpe, "LONG", re.compile(bpe.LONG.pattern.replace("512", "24")))
    monkeypatch.setattr(bpe, "RUN", bpe.regex.compile(bpe.RUN.pattern.replace("512", "24")))
    v, r = bpe.Vocabulary(tokenizer_path()), random.Random(4)
    for _ in range(400):
        s = noise(r, r.randint(0, 25))
        want = reference.encode(s, add_special_tokens=False).ids
        assert list(v.encode(s)) == want, s
        assert bpe.decode(v, want) == reference.decode(want, skip_special_tokens=False) == s


def test_bpe_against_library(spark, reference):
    r = random.Random(8)
    rows = awkward() + [(100 + i, noise(r, 30)) for i in range(30)] + [(200, "ab" * 3000), (201, " " * 900 + "x"), (202, "9" * 999)]
    docs = make_docs(spark, rows)
    path = tokenizer_path()
    want = sorted(str((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(reference.decode(i, skip_special_tokens=False).encode()).hexdigest()))
                  for d, i in ((d, reference.encode(t or "", add_special_tokens=False).ids) for d, t in rows))
    for piece in (1 << 16, 200):
        out = bpe.encode_documents(docs, path, piece=piece, digest=True).drop("k1", "k2")
        assert sorted(str(tuple(x)) for x in out.collect()) == want
    back = bpe.decode_documents(bpe.encode_documents(docs, path, piece=300), path)
    assert sorted(str((x["doc_id"], x["text"])) for x in back.collect()) == sorted(str((d, t or "")) for d, t in rows)
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


# ----------------------------------------------------------------- toxicity

BAD = ["idiot", "moron", "scumbag", "wretch"]


def toxic_rows():
    r = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        w = prose(1000 + i, 40).split()
        if toxic := i % 4 == 0:
            for k in range(3):
                w.insert(r.randrange(len(w)), BAD[(i // 4 + k) % 4] + r.choice(["", "s", "."]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_of_obfuscated_text(spark):
    rows, labels = toxic_rows()
    odd = {1000: "you 1d10t and m0r0n, you wr3tch", 1001: "an i d i o t, a m.o.r.o.n, a s c u m b a g",
           1002: "idiiiiot $cumbag wreeeetch",
           1003: prose(5, 50), 1004: "costs 10 or 250, see A4 and 3.5"}
    docs = make_docs(spark, rows + list(odd.items()) + [(d, t) for d, t in awkward() if t is None or len(t) < 9000])
    lab = spark.createDataFrame(labels + [(0, 0), (7, None), (None, 1)], "doc_id long, toxic int") \
        .withColumn("text", F.lit("clash"))
    out = toxicity.toxicity(docs, lab, F.col("doc_id") % 3 != 1).collect()
    score = {r["doc_id"]: r["score"] for r in out if r["doc_id"] is not None and (r["doc_id"] >= 15 or r["doc_id"] == 0)}
    truth = dict(labels)
    held = [d for d in truth if d % 3 == 1 and d >= 15]
    assert sum((score[d] >= .7) == truth[d] for d in held) >= .97 * len(held)
    assert all(score[d] >= .7 for d in (1000, 1001, 1002)), score
    assert all(score[d] < .3 for d in (1003, 1004))
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == docs.count()
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert not {r["doc_id"] for r in kept.collect()} & {1000, 1001, 1002}
    # nothing to learn from, and nothing to score
    assert toxicity.drop_toxic(docs, lab.limit(0)).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), lab.limit(0)).count() == 0


def plain_channel():
    text = pa.array([" ".join(f"you are an idiot and a moron, {w} here, stupid pig, the café is on idle " for w in BAD * 9)])
    total = np.zeros(toxicity.NS ** 4, np.int64)
    for _, _, buf, _ in toxicity.slices(text):
        s = toxicity.SYMBOL[toxicity.lowered(buf)]
        s = s[s >= 0]
        s = np.concatenate([[0, 0, 0], s[(s > 0) | (np.concatenate([[1], s[:-1]]) > 0)]])
        code = ((s[:-3] * 28 + s[1:-2]) * 28 + s[2:-1]) * 28 + s[3:]
        total += np.bincount(code, minlength=len(total))
    code = np.flatnonzero(total)
    return toxicity.Channel(toxicity.log_probabilities(code, total[code]))


def words_read(texts, channel):
    """Words of up to eight bytes per text."""
    out = [set() for _ in texts]
    for i, _, buf, off in toxicity.slices(pa.array(texts)):
        for w, n, d in zip(*(x.tolist() for x in toxicity.words_of(buf, off, channel)[:3])):
            out[i + d].add(w.to_bytes(8, "little").rstrip(b"\0").decode("utf-8", "ignore"))
    return out


def test_leet_spacing_and_repetition_together():
    want = {"an i d 1 o t here": "idiot", "you m 0 r 0 n": "moron", "a p 1 g": "pig", "you i-d-1-0-t": "idiot",
            "an  i  d  i  o  t": "idiot", "st u p i d": "stupid", "an iddiot": "idiot", "a m o r 0 0 n": "moron",
            "a m  0 0 r.r o  n": "moron", "an 1 d d i 0 o t": "idiot", "the cafféé": "café", "you m.0.r.0.n!": "moron"}
    for text, got in zip(want, words_read(list(want), plain_channel())):
        assert want[text] in got, (text, got)


def test_words_do_not_depend_on_the_next_text():
    channel = plain_channel()
    texts = ["you i d i o t", "next text", "", "p i g", "a$", "$b", "1d10t", "", "o i d i o t", "x0", "0", "m o r", "o n", ""]
    alone = [words_read([t], channel)[0] for t in texts]
    assert words_read(texts, channel) == alone and "idiot" in alone[0] and "pig" in alone[3]


def test_long_words_are_told_apart_beyond_eight_bytes():
    plain, toxic = "сообщество", "сообщивший"           # the first eight bytes agree
    y = np.arange(200) % 2
    texts = [f"{prose(i, 5)} {(plain, toxic)[k]}" for i, k in enumerate(y)]
    _, _, buf, off = next(toxicity.slices(pa.array(texts)))
    packed, size, text, whole = toxicity.words_of(buf, off, plain_channel())
    got = [(text[r], c) for r, c in toxicity.feature_codes(packed, size, whole)]
    of = {}
    for rows, codes in got:
        for i, c in zip(rows.tolist(), codes.tolist()):
            of.setdefault(c, set()).add(i)
    telling = [c for c, i in of.items() if i == set(np.flatnonzero(y).tolist())]
    assert telling
    m = toxicity.Model(plain_channel().logp, np.array(telling[:1], np.uint64), np.array([5.0]), -2.0)
    assert ((m.scores(pa.array(texts)) > .7) == y).all()


def test_viterbi_takes_the_best_path():
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(28), (28, 28, 28))).astype(np.float32)

    def brute(token):
        best = (-1e9, "")
        def walk(options, state, score, text):
            nonlocal best
            if not options:
                end = score + (float(logp[(*state, 0)]) if state[2] else 0)
                best = max(best, (end, text), key=lambda x: x[0])
                return
            for letters, cost in options[0]:
                if not letters or letters == " " and state[2] == 0:
                    walk(options[1:], state, score - cost, text)
                else:
                    y = toxicity._symbol(letters)
                    walk(options[1:], (state[1], state[2], y), score - cost + float(logp[(*state, y)]), text + letters)
        walk(toxicity.lattice(token), (0, 0, 0), 0.0, "")
        return best[1]

    for token in ("1d10t", "i d i o t", "a$$", "m00n", "xx-yy", "aaab", "4!1"):
        assert toxicity.viterbi(token, logp) == brute(token)


# -------------------------------------------------------------- language ID

def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    k, step, start = 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [1, 2, 5, 7]
    score = rng.normal(size=(sum(sizes), k))
    doc = np.repeat(np.arange(4), sizes)
    old, langid.BLOCK = langid.BLOCK, 3
    got = langid.marginals(score, doc, step, start)
    langid.BLOCK = old
    at = 0
    for n in sizes:
        from itertools import product
        p = np.zeros((n, k))
        for y in product(range(k), repeat=n):
            first = np.log((np.exp(start) @ np.exp(step))[y[0]])
            s = first + sum(score[at + i, c] for i, c in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:]))
            for i, c in enumerate(y):
                p[i, c] += np.exp(s)
        assert np.allclose(got[at:at + n], p / p.sum(1, keepdims=True))
        at += n


def test_language_held_out_accuracy(spark):
    sounds = {"aa": ["ba", "ko", "ti", "lu"], "bb": ["sch", "erk", "ung", "ver"], "cc": ["é", "oi", "que", "ment"]}
    r, rows = random.Random(2), []
    for i in range(240):
        lang = list(sounds)[i % 3]
        rows.append((i, " ".join("".join(r.choices(sounds[lang], k=r.randint(2, 4))) for _ in range(r.randint(3, 60))), lang))
    odd = [(d, t, None) for d, t in awkward()] + [(900, "12 + 3 = 15"), (901, "***")]
    docs = make_docs(spark, rows + [(d + 1000 if d is not None else None, t) for d, t, *_ in odd])
    out = langid.identify(docs, F.col("doc_id") % 4 != 2).collect()
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    held = [x for x in rows if x[0] % 4 == 2]
    assert sum(pred[d][0] == lang for d, _, lang in held) >= .97 * len(held)
    for d in (1001, 1002, 1003, 1900, 1901):
        assert pred[d] == ("und", 0.0)
    assert pred[1010][0] != "und" and pred[1007][0] != "und" and len(out) == len(rows) + len(odd)
    assert all(0 <= s <= 1 for _, s in pred.values())
    assert {r["lang_pred"] for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_words_are_labelled_in_mixed_text():
    r = random.Random(1)
    one = ["".join(r.choices(["ba", "ko", "ti"], k=3)) for _ in range(400)]
    two = ["".join(r.choices(["sch", "erk", "ung"], k=3)) for _ in range(400)]
    spans = [(y, " ".join(w[i:i + 20]).encode() + b" ") for y, w in enumerate((one, two)) for i in range(0, 400, 20)]
    field = langid.learn(spans, ["x", "y"], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), rounds=6)
    mixed = " ".join(one[:15] + two[:15] + one[20:30])
    _, _, buf, off = next(langid.slices(pa.array([mixed])))
    b, s, e, d, h = langid.words(buf, off)
    p = langid.marginals(field.emissions(b, s, e, h).astype(float), d, field.step, field.start)
    assert (p.argmax(1) == [0] * 15 + [1] * 15 + [0] * 10).mean() >= .95


# ------------------------------------------------------------------ licences

def notice(name):
    """The first long notice of a licence."""
    return next(t for n, t, _ in license_templates.NOTICES if n == name and len(t) > 60)


def wrapped(text, width=60, mark=" * "):
    import textwrap
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licences_and_inheritance(spark):
    files = [("a/LICENSE", "MIT License\n\nCopyright someone\n\n" + license_templates._MIT + "\n\n" + license_templates._MIT_END),
             ("a/x.py", "print"), ("a/b/c/y.py", None),
             ("a/b/LICENSE.txt", notice("GPL-3.0")), ("a/b/z.py", ""), ("a/own.py", "# Licensed under CC BY-NC 4.0.\ncode"),
             ("other/q.py", "the license is not here"), ("COPYING", notice("MPL-2.0")), ("top.py", "x"), (None, "text"),
             ("two/LICENSE", license_templates._MIT), ("two/COPYING", notice("Apache-2.0")), ("two/f", prose(1, 30_000)),
             ("a/x.py", "print"), ("a/big.py", prose(2, 200) + "\n" + license_templates._BSD + "\n" + prose(3, 200))]
    df = spark.createDataFrame(files, "path string, text string").withColumn("licence", F.lit("clash")) \
        .withColumn("a b", F.monotonically_increasing_id())
    out = license_scan.license_scan(df, keep=("a b",)).collect()
    got = {r["path"]: (r["own"], r["licence"], r["from_dir"]) for r in out}
    assert len(out) == len(files) == len({r["a b"] for r in out})
    assert got["a/LICENSE"][0] == "MIT" and got["a/x.py"] == (None, "MIT", "a")
    assert got["a/b/c/y.py"] == (None, "GPL-3.0", "a/b") and got["a/b/z.py"] == (None, "GPL-3.0", "a/b")
    assert got["a/own.py"] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None) and got["a/big.py"][0] == "BSD-3-Clause"
    assert got["other/q.py"] == (None, "MPL-2.0", "") and got["top.py"] == (None, "MPL-2.0", "")
    assert got["two/f"] == (None, "Apache-2.0", "two") and got[None] == (None, None, None)
    assert license_scan.license_scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.license_scan(df, keep=("licence",))


def test_versions_tags_denials_and_wrapped_notices(spark):
    t = license_templates
    full = lambda *parts: "Copyright (c) 2020 Some One\n\n" + "\n\n".join(wrapped(p, 70, "") for p in parts)
    want = [
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 3", "LGPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This is not licensed under the Apache License", None), ("This is not licensed under the Apache License, version 2.0.", None),
        ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("# SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"),
        ("To the extent possible under law, the author has waived all copyright and\nrelated or neighboring rights to this work.",
         "CC0-1.0"),
        ("the Free Software Foundation; either version 2 of the License, or", "GPL-2.0"),
        (wrapped(t._GNU.format("General Public License", 2)), "GPL-2.0"),
        (wrapped(t._GNU.format("Affero General Public License", 3)), "AGPL-3.0"),
        (wrapped(t._GNU.format("Lesser General Public License", "2.1")), "LGPL-2.1"),
        ("code\n" + wrapped("This software is distributed under the terms of the Mozilla Public License version 2.0", 40), "MPL-2.0"),
        ("The licence of this house is old.", None), (None, None), ("", None),
        ("License", None), ("see the license", None), ("Licensed under something", None)]
    whole = [(full(t._BSD + t._BSD_2, t._BSD_END), "BSD-2-Clause"), (full(t._BSD + t._BSD_2, t._BSD_3, t._BSD_END), "BSD-3-Clause"),
             (full("MIT License", t._MIT, t._MIT_END), "MIT"), (full("ISC License", t._ISC, t._ISC_END), "ISC")]
    fill = [(f"f{i}", prose(i, 60) + "\nthe data of the thing and was not this work in software to") for i in range(300)]
    rows = [(f"w{i}", x) for i, (x, _) in enumerate(want)] + [(f"d{i}/LICENSE", x) for i, (x, _) in enumerate(whole)] + fill
    got = {r["path"]: r["own"] for r in license_scan.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    wrong = [(x, n, got[f"w{i}"]) for i, (x, n) in enumerate(want) if got[f"w{i}"] != n]
    wrong += [(x, n, got[f"d{i}/LICENSE"]) for i, (x, n) in enumerate(whole) if got[f"d{i}/LICENSE"] != n]
    assert not wrong, wrong
    assert not any(got[p] for p, _ in fill)


def test_cosine_against_plain_vectors(spark):
    """Every passage of every text against every template, df of every term."""
    import math
    from itertools import groupby
    templates = license_scan.TEMPLATES
    texts = [prose(i, 20) + "\nthe data of the thing and was" for i in range(60)] + [
        "The data was released under the MIT License.", "The thing of the and was released under the MIT License.",
        "zyx the wvu released under the MIT License.", "the the the\nReleased under the MIT License. " + prose(3, 4),
        "Released under\nthe GNU General\nPublic License, version 3\n--\nLicensed under the\n \nApache License, Version 2.0"]
    texts += [wrapped(x + " and " + prose(9, k % 5)) for k, (_, x, _) in enumerate(templates) if k % 9 == 0]
    names = [f"f{i}" for i in range(len(texts))] + ["LICENSE", "f0"]
    texts += ["of the data: " + notice("MIT") + "\nand the thing was", texts[0]]
    term = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    df, n = {}, len(texts) + 1                                      # one null text
    for t in texts:
        for w in set(term(t)):
            df[w] = df.get(w, 0) + 1
    vec = lambda t: {w: term(t).count(w) * math.log((n + 1) / (df.get(w, 0) + 1)) for w in set(term(t))}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, vec(u), norm(vec(u)), set(need)) for name, u, need in templates]

    def licence(passage):
        v, best = vec(passage), (-1.0, "")
        for name, u, m, need in vectors:
            if need <= set(v) and m > 0:
                dot = round(sum(x * u.get(w, 0) for w, x in v.items()) / m, 9)
                best = max(best, (dot, name), key=lambda b: b[0])
        cos = round(best[0] / norm(v), 9) if best[1] and norm(v) else 0.0
        return (cos, best[1]) if cos >= license_scan.THRESHOLD else None

    want = []
    for path, t in zip(names, texts):
        found = []
        for some, para in groupby(t.split("\n"), lambda line: bool(term(line))):
            para = list(para)
            for size in {1, 2, 3, len(para)} if some else ():
                found += [licence("\n".join(para[i:i + size])) for i in range(len(para) - size + 1)]
        own = licence(t) if path == "LICENSE" else None
        own = own or min((x for x in found if x), key=lambda x: (-x[0], x[1]), default=(0.0, None))
        want.append((path, own[1], round(min(1.0, own[0]), 7)))
    rows = spark.createDataFrame(list(zip(names, texts)) + [(None, None)], "path string, text string")
    got = sorted(((r["path"], r["own"], round(r["score"], 7)) for r in license_scan.license_scan(rows).collect()), key=str)
    assert got == sorted(want + [(None, None, 0.0)], key=str)
    assert len({o for _, o, _ in got}) > 15


# -------------------------------------------------------------- token shards

def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        a = token_output.permute(np.arange(n), n, 5)
        assert sorted(a.tolist()) == list(range(n))
        assert (token_output.permute(a, n, 5, inverse=True) == np.arange(n)).all()
    assert (token_output.permute(np.arange(1000), 1000, 5) != token_output.permute(np.arange(1000), 1000, 6)).mean() > .9


def test_shards_hold_every_sequence_in_order(spark, reference, tmp_path):
    rows = [(d, t if t is None or len(t) < 9000 else t[:9000]) for d, t in awkward()] + [(100 + i, prose(i, 90)) for i in range(40)]
    docs = make_docs(spark, rows).coalesce(3)
    root = f"file://{tmp_path}/shards"
    out = token_output.write_shards(docs, tokenizer_path(), root, key=9, length=32, shard=64).orderBy("shard").collect()
    seqs = []
    for _, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [50256]
        ids += [50256] * (-len(ids) % 32)
        seqs += [tuple(ids[i:i + 32]) for i in range(0, len(ids), 32)]
    assert sum(r["n_slots"] for r in out) == len(seqs)
    assert [r["first_slot"] for r in out] == [64 * i for i in range(len(out))]
    data = b""
    for r in out:
        raw = (tmp_path / "shards" / r["file"]).read_bytes()
        assert len(raw) == r["n_bytes"] == r["n_slots"] * 64 and hashlib.sha256(raw).hexdigest() == r["sha256"]
        data += raw
    got = np.frombuffer(data, "<u2").reshape(-1, 32)
    assert sorted(map(tuple, got.tolist())) == sorted(seqs)
    part = token_output.read_slots(spark, root, 50, 140, length=32, shard=64).orderBy("slot").collect()
    assert [r["slot"] for r in part] == list(range(50, 140)) and [r["ids"] for r in part] == got[50:140].tolist()
    empty = token_output.write_shards(docs.limit(0), tokenizer_path(), f"file://{tmp_path}/none", key=9)
    assert empty.count() == 0


def test_slots_follow_the_permutation(spark, reference, tmp_path):
    """Slot of the i-th sequence against a plain walk of the keyed Feistel network."""
    long = (1, prose(1, 20_000))
    rows = [long, (2, None), (3, ""), (4, prose(4, 40)), (4, prose(4, 40)), (5, "a" * 30_000)] + \
        [(10 + i, prose(i, 30)) for i in range(30)]
    docs = make_docs(spark, rows).coalesce(1)
    key, root = 123, f"file://{tmp_path}/shards"
    out = token_output.write_shards(docs, tokenizer_path(), root, key=key, length=32, shard=128)
    seqs = []
    for _, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [50256]
        ids += [50256] * (-len(ids) % 32)
        seqs += [ids[i:i + 32] for i in range(0, len(ids), 32)]
    n, word = len(seqs), (1 << 64) - 1

    def mixed(h):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & word
        h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & word
        return h ^ h >> 32

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = [mixed(((i + 1) * 0x9E3779B97F4A7C15 + key) & word) for i in range(token_output.ROUNDS)]

    def slot(x):
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for k in keys:
                left, right = right, left ^ mixed((right + k) & word) & (1 << half) - 1
            x = left << half | right
            if x < n:
                return x

    want = dict((slot(i), s) for i, s in enumerate(seqs))
    assert len(want) == n == out.agg(F.sum("n_slots")).first()[0]
    got = token_output.read_slots(spark, root, 0, n, length=32, shard=128).collect()
    assert {r["slot"]: r["ids"] for r in got} == want


def test_licence_query_keeps_every_document(spark, tmp_path):
    from peerpanel.llm.queries import op7_license_scan
    rows = awkward() + [(20, "Released under the MIT License."), (30, None), (None, "SPDX-License-Identifier: ISC")]
    docs = make_docs(spark, rows).withColumn("source", F.when(F.col("doc_id") != 3, F.lit("s")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op7_license_scan(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    assert all(r["path"] for r in out)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[20]["own"] == "MIT" and by[20]["path"] == "s/LICENSE-20" and by[30]["licence"] == "MIT"
    assert by[3]["path"] == "none/3.txt" and by[3]["licence"] is None and by[7]["from_dir"] == "s"


def test_scratch_folder(spark):
    from types import SimpleNamespace

    from peerpanel.llm import common

    def session(master, conf=None, checkpoint=None):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: conf), sparkContext=context)

    assert common.scratch_dir(session("spark://host:7077", "hdfs:/x")) == "hdfs:/x"
    assert common.scratch_dir(session("yarn", None, "hdfs:/y")) == "hdfs:/y"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.scratch_dir(session(master))
    assert common.scratch_dir(session("local[4]")) == common.scratch_dir(session("local[4]"))

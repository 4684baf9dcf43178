"""Language ID with a linear-chain conditional random field over words.

Words are runs of a-z (after lower-casing A-Z) and non-ASCII bytes. A word's
features are its affixes (first and last one to four bytes), its byte trigrams
with word ends, both hashed, and one flag per language lexicon. Lexicons come
from word counts over all learning documents. Weights and label transitions are
learned by gradient steps on the sequence likelihood, from at most ``SAMPLE``
distinct documents and ``SPANS`` evenly spaced spans of each, of ``SPAN`` words and at
most ``SPAN_BYTES`` bytes (a text without spaces is one word, of which a span is the
first ``SPAN_BYTES`` bytes: these bound learning alone, predictions read whole texts);
spans of different languages are strung together, so the transitions learn to switch.

Whole texts are labelled word by word: forward and backward messages cross
blocks of ``BLOCK`` words as products of transfer matrices, so a batch of texts
of any length is a few array operations. A document's language is the one with
the most expected words, its score their share.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is everything when nothing can be learned; ties go to the language that
sorts first; equal rows get equal results; an empty table gives an empty
result; columns other than id and text (and lang in learning) are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textbytes import LOWER, mix, runs, slices, span_hashes

SAMPLE = 3_000       # documents that the weights may be learned from
SPANS, SPAN, SPAN_BYTES = 12, 24, 24 * 48
LEXICON = 4_000      # words per language
BITS = 17
BLOCK = 64
U = np.uint64
UND = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def words(buf: np.ndarray, off: np.ndarray):
    """``(bytes, start, end, text, hash)`` of every word of a slice."""
    b = LOWER[buf]
    if len(b) > 1:                            # Latin-1 capitals
        cap = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][cap] += 0x20
    s, e, d = runs(_LETTER[b], off)
    return b, s, e, d, span_hashes(b, s, e)


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code + U(kind << 40)) >> U(64 - BITS)).astype(np.int64)


def word_features(b, s, e) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affixes and trigrams: ``(feature, word)`` pairs, word ascending."""
    n = e - s
    feats, who = [], []
    first = np.zeros(len(s), np.uint64)
    last = np.zeros(len(s), np.uint64)
    for k in range(4):
        r = np.flatnonzero(n > k)
        first[r] = first[r] << U(8) | b[s[r] + k]
        last[r] |= b[e[r] - 1 - k].astype(np.uint64) << U(8 * k)
        feats += [_bucket(first[r], 1 + k), _bucket(last[r], 5 + k)]
        who += [r, r]
    row = np.repeat(np.arange(len(s)), n)
    i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = s[row] + i
    left = np.where(i > 0, b[np.maximum(at - 1, 0)], 0).astype(np.uint64)
    right = np.where(i < n[row] - 1, b[np.minimum(at + 1, len(b) - 1)], 0).astype(np.uint64)
    feats.append(_bucket(left << U(16) | b[at].astype(np.uint64) << U(8) | right, 9))
    who.append(row)
    f, w = np.concatenate(feats), np.concatenate(who)
    o = np.argsort(w, kind="stable")
    return f[o], w[o]


class Field:
    """Weights: hashed features x labels, lexicon flags, transitions; starts are uniform."""

    def __init__(self, labels, lexicon, table, flags, step, start):
        self.labels, self.lexicon = labels, lexicon          # lexicon: ascending hashes, label of each
        self.table, self.flags, self.step, self.start = table, flags, step, start

    def emissions(self, b, s, e, h) -> np.ndarray:
        """(words, labels) scores; each distinct word is scored once."""
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        f, w = word_features(b, s[first], e[first])
        cut = np.searchsorted(w, np.arange(len(u)))
        score = np.add.reduceat(self.table[f], cut, axis=0)
        keys, label = self.lexicon
        if len(keys):
            i = np.searchsorted(keys, u)
            i[i == len(keys)] = 0
            hit = keys[i] == u
            score[hit] += self.flags[label[i[hit]]]
        return score[inv]


def marginals(score: np.ndarray, doc: np.ndarray, step: np.ndarray, start: np.ndarray):
    """Label probabilities per word by forward-backward inside each document;
    ``doc`` is ascending."""
    n, k = score.shape
    size = np.bincount(doc)
    size = size[size > 0]
    begin = np.cumsum(size) - size
    pos = np.arange(n) - np.repeat(begin, size)
    per = -(-size // BLOCK)
    first = np.cumsum(per) - per
    seg = np.repeat(first, size) + pos // BLOCK
    m = int(per.sum())
    emit = np.zeros((BLOCK, m, k))
    used = np.zeros((BLOCK, m), bool)
    emit[pos % BLOCK, seg] = np.exp(score - score.max(1, keepdims=True))
    used[pos % BLOCK, seg] = True
    trans = np.exp(step - step.max())
    eye = np.eye(k)
    product = np.broadcast_to(eye, (m, k, k)).copy()
    for t in range(BLOCK):
        go = used[t]
        x = product[go] @ trans * emit[t, go][:, None, :]
        product[go] = x / x.sum((1, 2), keepdims=True)
    # messages at block borders, all documents side by side
    alpha, beta = np.ones((m, k)), np.ones((m, k))
    alpha[first] = np.exp(start - start.max())
    for j in range(1, int(per.max()) if m else 0):
        at = first[per > j] + j
        x = np.einsum("nk,nkl->nl", alpha[at - 1], product[at - 1])
        alpha[at] = x / x.sum(1, keepdims=True)
    for j in range((int(per.max()) if m else 0) - 2, -1, -1):
        at = first[per > j + 1] + j
        x = np.einsum("nkl,nl->nk", product[at + 1], beta[at + 1])
        beta[at] = x / x.sum(1, keepdims=True)
    ahead = np.zeros((BLOCK, m, k))
    a = alpha
    for t in range(BLOCK):
        x = a @ trans * emit[t]
        a = np.where(used[t][:, None], x / np.maximum(x.sum(1, keepdims=True), 1e-300), a)
        ahead[t] = a
    back = np.zeros((BLOCK, m, k))
    c = beta
    for t in range(BLOCK - 1, -1, -1):
        back[t] = c
        x = (emit[t] * c) @ trans.T
        c = np.where(used[t][:, None], x / np.maximum(x.sum(1, keepdims=True), 1e-300), c)
    p = (ahead * back)[pos % BLOCK, seg]
    return p / p.sum(1, keepdims=True)


def learn(spans, labels: list[str], lexicon, rounds: int = 4, seed: int = 7) -> Field:
    """Gradient steps on strings of spans. ``spans``: (label, bytes) each."""
    k = len(labels)
    field = Field(labels, lexicon, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k), np.float32),
                  np.zeros((k, k)), np.zeros(k))
    rng = np.random.default_rng(seed)
    g_table = np.full((1 << BITS, k), 1e-4, np.float32)
    g_flags, g_step = np.full((k, k), 1e-4), np.full((k, k), 1e-4)
    keys, owner = lexicon
    for r in range(rounds):
        order = rng.permutation(len(spans))
        for i in range(0, len(order), 3000):
            pick = order[i:i + 3000]
            # strings of three spans: half of one language, half at random
            half = np.array(sorted(pick[:len(pick) // 2], key=lambda x: spans[x][0]), int)
            pick = np.concatenate([half, pick[len(pick) // 2:]]).astype(int)
            raw = [spans[x][1] for x in pick]
            ends = np.cumsum([len(x) for x in raw])
            buf = np.frombuffer(b"".join(raw), np.uint8)
            b, s, e, d, h = words(buf, np.concatenate([[0], ends]))
            if not len(s):
                continue
            y = np.array([spans[x][0] for x in pick])[d]
            text = d // 3
            f, w = word_features(b, s, e)
            score = np.add.reduceat(field.table[f], np.searchsorted(w, np.arange(len(s))), axis=0).astype(float)
            lex = np.full(len(s), -1)
            if len(keys):
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                lex = np.where(keys[at] == h, owner[at], -1)
                score[lex >= 0] += field.flags[lex[lex >= 0]]
            p = marginals(score, text, field.step, field.start)
            diff = p.copy()
            diff[np.arange(len(y)), y] -= 1
            for c in range(k):
                g = np.bincount(f, diff[w, c], 1 << BITS).astype(np.float32)
                g_table[:, c] += g * g
                field.table[:, c] -= 0.2 * g / np.sqrt(g_table[:, c])
            if (lex >= 0).any():
                g = np.stack([np.bincount(lex[lex >= 0], diff[lex >= 0, c], k) for c in range(k)], 1)
                g_flags += g * g
                field.flags -= (0.2 * g / np.sqrt(g_flags)).astype(np.float32)
            # transitions: expected minus seen label pairs
            same = np.flatnonzero(text[1:] == text[:-1])
            pair = p[same][:, :, None] * np.exp(field.step)[None] * np.exp(
                score[same + 1] - score[same + 1].max(1, keepdims=True))[:, None, :]
            pair *= (p[same + 1] / np.maximum(pair.sum(1), 1e-300))[:, None, :]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[same], y[same + 1]), 1)
            g = pair.sum(0) - seen
            g_step += g * g
            field.step -= 0.2 * g / np.sqrt(g_step)
    return field


def lexicons(docs: DataFrame, labels: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of each language that are mostly its own, from
    counts over all of ``docs(text, lang)``."""
    index = {x: i for i, x in enumerate(labels)}

    def count(batches):
        for b in batches:
            lang = np.array([index[x] for x in b.column(1).to_pylist()], np.int64)
            for i, j, buf, off in slices(b.column(0), 1 << 23):
                _, _, _, d, h = words(buf, off)
                for y in np.unique(lang[i:j]):
                    u, n = np.unique(h[lang[i:j][d] == y], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array(np.full(len(u), y, np.int32)), pa.array(n.astype(np.int64))],
                        ["w", "y", "n"])

    each = docs.mapInArrow(count, "w long, y int, n long")
    per = each.groupBy("w").agg(*[F.sum(F.when(F.col("y") == i, F.col("n"))).alias(f"n{i}") for i in range(len(labels))])
    n = [F.coalesce(f"n{i}", F.lit(0)) for i in range(len(labels))]
    total = sum(n[1:], n[0])
    keys, owner = [], []
    per = per.select("w", *[x.alias(f"n{i}") for i, x in enumerate(n)], total.alias("t")).where("t >= 3")
    best = F.greatest(*[F.col(f"n{i}") for i in range(len(labels))], F.lit(0))
    y = sum((F.when(F.col(f"n{i}") == best, i).otherwise(0) for i in range(1, len(labels))), F.lit(0))
    own = stored(per.where(best >= 0.9 * F.col("t")).select("w", best.alias("n"), y.alias("y")), "langid-words")
    for i in range(len(labels)):                              # at most `size` rows each
        for r in own.where(F.col("y") == i).orderBy(F.desc("n"), "w").limit(size).collect():
            keys.append(r["w"])
            owner.append(i)
    keys = np.array(keys, np.int64).view(np.uint64)
    o = np.argsort(keys)
    return keys[o], np.array(owner, np.int64)[o]


def fit(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang",
        id_col: str = "doc_id", sample: int = SAMPLE, lexicon: int = LEXICON) -> Field | None:
    known = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    labels = sorted(r[0] for r in known.select("lang").distinct().collect())        # one row per language
    if not labels:
        return None
    index = {x: i for i, x in enumerate(labels)}
    keys = lexicons(known.select("text", "lang"), labels, lexicon)
    order = F.xxhash64("id", "text")
    edge = known.select(order.alias("o")).distinct().orderBy("o").limit(sample).agg(F.max("o")).first()[0]

    def spans(batches):
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = text.encode().split()
                n = min(SPANS, max(1, len(w) // SPAN))
                got = [b" ".join(w[i * len(w) // n:i * len(w) // n + SPAN])[:SPAN_BYTES] + b" " for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([index[lang]] * n, pa.int32()), pa.array(got, pa.binary())],
                                                 ["y", "s"])

    # repeated rows count once: at most `sample` documents
    some = known.where(order <= F.lit(edge)).groupBy(order.alias("o")).agg(F.min(F.struct("text", "lang")).alias("d"))
    rows = some.select("d.text", "d.lang").mapInArrow(spans, "y int, s binary")
    got = rows.orderBy("y", "s").collect()                     # at most sample * SPANS spans
    return learn([(r["y"], bytes(r["s"])) for r in got], labels, keys)


def predict(field: Field | None, col: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and share of expected words of every text."""
    out, share = [UND] * len(col), np.zeros(len(col))
    if field is None:
        return out, share
    k = len(field.labels)
    for i, j, buf, off in slices(col):
        b, s, e, d, h = words(buf, off)
        if not len(s):
            continue
        p = marginals(field.emissions(b, s, e, h).astype(float), d, field.step, field.start)
        total = np.stack([np.bincount(d, p[:, c], j - i) for c in range(k)], 1)
        plain = np.bincount(d, (b[s] < 128) | (np.maximum.reduceat(b, s) < 128), j - i) > 0
        for x in np.flatnonzero(total.sum(1) > 0).tolist():
            if plain[x] or any(ch.isalpha() for ch in col[i + x].as_py()):
                best = int(total[x].argmax())
                out[i + x], share[i + x] = field.labels[best], min(1.0, total[x, best] / total[x].sum())
    return out, share


def identify(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row of ``docs``."""
    field = fit(docs, may_learn, text_col, lang_col, id_col)
    bc = docs.sparkSession.sparkContext.broadcast(None if field is None else vars(field))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        f = None if bc.value is None else Field(**bc.value)
        for b in batches:
            lang, share = predict(f, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(share)],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double")

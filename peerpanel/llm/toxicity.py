"""Toxicity of obfuscated text: noisy-channel restoration, then a learned score.

1. A character 4-gram model is counted over all documents (28 symbols: a-z, any
   other letter, boundary), so its table is at most 28^4 cells at any size.
2. Tokens that may be obfuscated (leet signs inside a word, a letter twice running,
   letters or signs spelled one by one with the short fragments beside them) become
   lattices: a leet sign may stand for each letter it resembles or be noise, a
   repeated letter may collapse, also if signs or separators stand for it or between,
   a run of separators may vanish or stay a boundary. Viterbi under the character model
   finds the likeliest reading. Plain tokens have a single path and are left.
3. Prefixes of 4 to 8 bytes and whole words of plain and restored words
   are features of a logistic regression, learned from at most ``SAMPLE``
   labelled documents taken in hash order; every document is then scored over
   its whole text.

Defined results: null and empty texts get the score of a text without evidence;
repeated rows get equal scores; contradicting labels of one document count as
toxic; without any labelled document, or with labels of one kind only, the
score is the smoothed base rate; an empty table gives an empty result; columns
other than id and text are never read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textbytes import BYTE, LOWER, mix, runs, slices, span_hashes

SAMPLE = 12_000      # labelled documents that the classifier may learn from
FEATURES = 3_000     # features of the regression
THRESHOLD = 0.7
U = np.uint64
NS = 28              # symbols of the character model

# fixed values: letters that a sign may stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
FRAGMENT = 4         # characters of a piece beside a spelled-out word
COST_LEET, COST_NOISE, COST_REPEAT, COST_JOIN = 1.0, 4.0, 0.5, 0.7


# ---------------------------------------------------------------- characters

def _symbols() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[97:123] = np.arange(1, 27)
    t[0xC0:] = 27
    t[0x80:0xC0] = -1          # continuation bytes are part of the letter before
    return t


SYMBOL = _symbols()


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters, byte by byte."""
    b = LOWER[buf]
    if len(b) > 1:
        cap = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][cap] += 0x20
    return b


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(code, n)`` of all character 4-grams of all texts."""
    def scan(batches):
        total = np.zeros(NS ** 4, np.int64)
        for b in batches:
            for _, _, buf, off in slices(b.column(0)):
                ends = np.zeros(len(buf) + 1, bool)
                ends[off] = True
                s = SYMBOL[lowered(buf)]
                s = np.insert(s, np.flatnonzero(ends), 0)
                s = s[s >= 0]
                s = s[(s > 0) | (np.concatenate([[1], s[:-1]]) > 0)]     # one boundary between words
                s = np.concatenate([[0, 0, 0], s])
                total += np.bincount(((s[:-3] * NS + s[1:-2]) * NS + s[2:-1]) * NS + s[3:], minlength=NS ** 4)
        code = np.flatnonzero(total)
        for i in range(0, len(code), 50_000):
            c = code[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(total[c])], ["code", "n"])

    return docs.select(text_col).mapInArrow(scan, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_probabilities(code: np.ndarray, n: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log p(symbol | three symbols before), shorter contexts interpolated."""
    c = np.zeros(NS ** 4)
    c[code] = n
    c = c.reshape(NS, NS, NS, NS)
    p = np.full(NS, 1.0 / NS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        k = c.sum(axis=axes)
        p = (k + weight * p) / (k.sum(-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per character its readings ``(letters, cost)``; "" is dropped, " " a boundary."""
    out, before, gap = [], set(), False
    for ch in token:
        if ch.isalpha() or ch in LEET:
            sign = not ch.isalpha()
            options = [(x, COST_LEET) for x in LEET[ch]] + [("", COST_NOISE), (" ", 0.0)] if sign else [(ch, 0.0)]
            may_be = set(LEET[ch]) if sign else {ch}
            if may_be & before:
                options.append(("", COST_REPEAT))
            before, gap = may_be, False
        else:
            options = [("", 0.0 if gap else COST_JOIN), (" ", 0.0)]    # a run of separators joins at one cost
            gap = True
        out.append(options)
    return out


def _symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else 27


def viterbi(token: str, logp: np.ndarray) -> str:
    """Likeliest reading of the token; states are the last three symbols."""
    best = {(0, 0, 0): (0.0, None)}
    for options in lattice(token):
        new: dict = {}
        for state, (score, path) in best.items():
            for letters, cost in options:
                if not letters or letters == " " and state[2] == 0:
                    to, value, back = state, score - cost, path
                else:
                    y = _symbol(letters)
                    to = (state[1], state[2], y)
                    value, back = score - cost + float(logp[(*state, y)]), (path, letters)
                if to not in new or value > new[to][0]:
                    new[to] = (value, back)
        best = new
    path = max(((s + float(logp[(*st, 0)]) if st[2] else s, p) for st, (s, p) in best.items()),
               key=lambda x: x[0])[1]
    letters = []
    while path:
        path, ch = path
        letters.append(ch)
    return "".join(reversed(letters))


_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def obfuscated(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans ``(start, end, text)`` of tokens and spelled-out words to restore."""
    b = np.insert(b, np.repeat(off[1:-1], 2), 32)      # no mask looks into the next text
    off = off + 2 * np.minimum(np.arange(len(off)), max(0, len(off) - 2))
    n = len(b)
    letter = ((b >= 97) & (b <= 122)) | (b >= 0x80)
    pad = np.zeros(n + 8, bool)

    def at(mask, d):                      # mask shifted: value at i + d
        pad[:] = False
        pad[4:n + 4] = mask
        return pad[4 + d:n + 4 + d].copy()

    leet = _LEET[b]
    sign = leet & (at(letter, -1) & (at(letter, 1) | at(leet, 1) & at(letter, 2)) | at(letter, 1) & ~at(letter, -1))
    tail = leet & (b != 33) & (b != 124) & (b != 43) & at(letter, -1) & ~at(leet, 2) & ~at(letter, 1)
    same = np.zeros(n, bool)
    same[1:] = (b[1:] == b[:-1]) & letter[1:] & (b[1:] < 0x80)
    two = (b[:-3] >= 0xC3) & (b[:-3] < 0xE0)                              # letters of two bytes
    same[3:] |= two & (b[2:-1] == b[:-3]) & (b[3:] == b[1:-2])
    s, e, d = runs(~_SPACE[b], off)
    odd = np.concatenate([[0], np.cumsum(sign | tail | same)])
    pick = odd[e] > odd[s]
    cs, ce, cd = chains(b, off, letter, leet)
    d = np.concatenate([d[pick], cd])
    return np.concatenate([s[pick], cs]) - 2 * d, np.concatenate([e[pick], ce]) - 2 * d, d


def chains(b, off, letter, leet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words spelled in pieces: two single letters or signs side by side, with
    all pieces of one character that go on from them and a fragment of up to four
    characters before and after; three pieces and a letter at least. The pieces of
    one character are a span of their own too."""
    s, e, d = runs(letter | leet, off)
    heads = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    size = heads[e] - heads[s]
    beside = d[1:] == d[:-1]
    single = size == 1
    pair = single[1:] & single[:-1] & beside
    core = np.zeros(len(s), bool)
    core[1:] |= pair
    core[:-1] |= pair
    member = core.copy()
    member[1:] |= (size[1:] <= FRAGMENT) & core[:-1] & beside
    member[:-1] |= (size[:-1] <= FRAGMENT) & core[1:] & beside
    letters = np.concatenate([[0], np.cumsum(letter)])
    cut = np.searchsorted(d, np.arange(len(off)))
    spans = []
    for mask in (member, core):
        x, y, _ = runs(mask, cut)
        x, y = x[y - x >= 3], y[y - x >= 3] - 1
        ok = letters[e[y]] > letters[s[x]]
        spans.append(np.stack([s[x[ok]], e[y[ok]], d[x[ok]]]))
    return tuple(np.unique(np.concatenate(spans, axis=1), axis=1))


# ------------------------------------------------------------------ features

def word_codes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First eight bytes of each word as one number, the word lengths, and the hash of
    each word of more than eight bytes (else 0)."""
    size = e - s
    packed = np.zeros(len(s), np.uint64)
    for j in range(8):
        has = size > j
        packed[has] |= b[s[has] + j].astype(np.uint64) << U(8 * j)
    whole = np.zeros(len(s), np.uint64)
    long = size > 8
    whole[long] = span_hashes(b, s[long], e[long])
    return packed, size, whole


def feature_codes(packed: np.ndarray, size: np.ndarray, whole: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, codes)`` per kind: prefixes of 4 to 8 bytes, whole words."""
    out = []
    for k in range(4, 9):
        r = np.flatnonzero(size >= k)
        out.append((r, packed[r] & U((1 << 8 * k) - 1)))
    r = np.flatnonzero(size <= 8)
    out.append((r, mix(packed[r] + BYTE[0])))
    r = np.flatnonzero(size > 8)
    out.append((r, whole[r]))
    return out


@dataclass
class Channel:
    """The character model of one worker, with its readings so far."""

    logp: np.ndarray

    def __post_init__(self):
        self.read = lru_cache(1 << 16)(lambda token: viterbi(token, self.logp))


_CHANNELS: dict[bytes, Channel] = {}


def channel_of(logp: np.ndarray) -> Channel:
    """The worker's channel of this character model; its readings serve later tasks."""
    key = hashlib.sha256(logp.tobytes()).digest()
    if key not in _CHANNELS:
        _CHANNELS.clear()
        _CHANNELS[key] = Channel(logp)
    return _CHANNELS[key]


def words_of(buf: np.ndarray, off: np.ndarray, channel: Channel) -> tuple[np.ndarray, ...]:
    """``(packed, size, text, whole)`` of all plain and restored words."""
    b = lowered(buf)
    s, e, d = runs(((b >= 97) & (b <= 122)) | (b >= 0x80), off)
    packed, size, whole = word_codes(b, s, e)
    os_, oe, od = obfuscated(b, off)
    if not len(os_):
        return packed, size, d, whole
    # each distinct token of the slice is read once; signs at its ends that stand for
    # nothing are boundaries in every reading
    inner = _LEET[b] | ((b >= 97) & (b <= 122)) | (b >= 0x80)
    at = np.flatnonzero(inner)
    os_, oe = at[np.searchsorted(at, os_)], at[np.searchsorted(at, oe) - 1] + 1
    _, first, token = np.unique(span_hashes(b, os_, oe), return_index=True, return_inverse=True)
    extra, many = [], np.zeros(len(first), np.int64)
    for k, (x, y) in enumerate(zip(os_[first].tolist(), oe[first].tolist())):
        ws = [w.encode() for w in channel.read(b[x:y].tobytes().decode("utf-8", "ignore")).split(" ") if w]
        extra += ws
        many[k] = len(ws)
    if not extra:
        return packed, size, d, whole
    ends = np.cumsum([len(w) for w in extra])
    p2, n2, w2 = word_codes(np.frombuffer(b"".join(extra), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    n = many[token]
    word = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - (np.cumsum(many) - many)[token], n)
    return (np.concatenate([packed, p2[word]]), np.concatenate([size, n2[word]]), np.concatenate([d, np.repeat(od, n)]),
            np.concatenate([whole, w2[word]]))


@dataclass
class Model:
    logp: np.ndarray
    codes: np.ndarray        # ascending
    weights: np.ndarray
    bias: float

    def hits(self, packed, size, text, whole) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(text, feature)`` that occur."""
        seen = []
        gate = np.zeros(1 << 16, bool)
        gate[(mix(self.codes & U(0xFFFFFFFF)) >> U(48)).astype(np.int64)] = True
        likely = gate[(mix(packed & U(0xFFFFFFFF)) >> U(48)).astype(np.int64)] | (size <= 8)
        gate[:] = False
        gate[(self.codes >> U(48)).astype(np.int64)] = True
        likely |= gate[(whole >> U(48)).astype(np.int64)]
        packed, size, text, whole = packed[likely], size[likely], text[likely], whole[likely]
        for r, c in feature_codes(packed, size, whole):
            i = np.searchsorted(self.codes, c)
            i[i == len(self.codes)] = 0
            ok = np.flatnonzero(self.codes[i] == c) if len(self.codes) else np.zeros(0, int)
            seen.append(text[r[ok]] * len(self.codes) + i[ok])
        both = np.unique(np.concatenate(seen))
        return both // max(1, len(self.codes)), both % max(1, len(self.codes))

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        channel = channel_of(self.logp)
        for i, j, buf, off in slices(col):
            t, f = self.hits(*words_of(buf, off, channel))
            out[i:j] = np.bincount(t, self.weights[f], j - i)[:j - i] if len(t) else 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, m: int, l2: float = 0.01,
             rounds: int = 800) -> tuple[np.ndarray, float]:
    """L2 logistic regression on 0/1 features given as (row, column) pairs."""
    n = max(1, len(y))
    rate = np.clip(y.mean() if len(y) else 0.0, 1 / (n + 2), 1 - 1 / (n + 2))
    w, bias = np.zeros(m), float(np.log(rate / (1 - rate)))
    g2, gb = np.full(m, 1e-8), 1e-8
    for _ in range(rounds if 0 < y.sum() < n else 0):
        z = bias + np.bincount(rows, w[cols], n)
        d = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(cols, d[rows], m) + l2 * w
        g2 += g * g
        gb += d.sum() ** 2
        w -= 0.5 * g / np.sqrt(g2)
        bias -= 0.5 * d.sum() / np.sqrt(gb)
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Character model over all ``docs``; regression on labelled documents for
    which ``learn`` (a condition on the id column) holds."""
    cells = char_counts(docs, text_col).toPandas()                  # at most 28^4 rows
    logp = log_probabilities(cells["code"].to_numpy(), cells["n"].to_numpy())
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids, and one row of each: only texts of repeated ids are moved
    rows_of = docs.select(F.col(id_col).alias("doc_id")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    known = stored(known.join(rows_of, "doc_id", "left"), "toxicity-known")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    base = texts.where("n = 1").select("text", "y").union(
        texts.where("n > 1").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"))
    bc = docs.sparkSession.sparkContext.broadcast(logp)

    def count(batches):
        codes, pos, neg = [], [], []
        channel = channel_of(bc.value)
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, off in slices(b.column(0)):
                packed, size, text, whole = words_of(buf, off, channel)
                c = [(text[r], c) for r, c in feature_codes(packed, size, whole)]
                t, c = np.concatenate([x[0] for x in c]), np.concatenate([x[1] for x in c])
                o = np.lexsort((c, t))
                t, c = t[o], c[o]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
                t, c = t[new], c[new]
                u, inv = np.unique(c, return_inverse=True)
                hot = np.bincount(inv, y[i:j][t], len(u))
                codes.append(u)
                pos.append(hot.astype(np.int64))
                neg.append(np.bincount(inv, minlength=len(u)) - pos[-1])
        for u, p, q in zip(codes, pos, neg):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(p), pa.array(q)],
                                             ["code", "pos", "neg"])

    tally = base.mapInArrow(count, "code long, pos long, neg long") \
        .groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3")
    n = known.agg(F.count("*"), F.sum("y")).first()
    n_pos, n_neg = int(n[1] or 0), int(n[0] - (n[1] or 0))
    # how far the presence of a feature raises the odds, from the lower end of its rate
    odds = F.log((F.col("pos") - F.sqrt("pos")) / F.lit(n_pos + 1)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1))
    top = tally.withColumn("odds", odds).where("odds > 0.7") \
        .orderBy(F.desc(F.col("odds") * F.col("pos")), "code").limit(features).toPandas()
    codes = np.sort(top["code"].to_numpy(np.int64).view(np.uint64)) if len(top) else np.zeros(0, np.uint64)
    draft = docs.sparkSession.sparkContext.broadcast(codes)

    def rows(batches):
        m = Model(bc.value, draft.value, np.zeros(0), 0.0)
        channel = channel_of(m.logp)
        for b in batches:
            for i, j, buf, off in slices(b.column(0)):
                t, f = m.hits(*words_of(buf, off, channel))
                cut = np.searchsorted(t, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(f.astype(np.int32))),
                     b.column(1).slice(i, j - i)], ["f", "y"])

    data = base.mapInArrow(rows, "f array<int>, y int").toPandas()       # one row per sampled document
    size = data["f"].str.len().to_numpy(np.int64) if len(data) else np.zeros(0, np.int64)
    cols = np.concatenate(data["f"].to_list()).astype(np.int64) if size.sum() else np.zeros(0, np.int64)
    w, bias = logistic(np.repeat(np.arange(len(data)), size), cols,
                       data["y"].to_numpy(float) if len(data) else np.zeros(0), len(codes))
    return Model(logp, codes, w, bias)


def scorer(spark, model: Model):
    """A column function: text -> score."""
    bc = spark.sparkContext.broadcast((model.logp, model.codes, model.weights, model.bias))

    @F.arrow_udf("double")
    def toxic_score(text: pa.Array) -> pa.Array:
        return pa.array(Model(*bc.value).scores(text))

    return toxic_score


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``."""
    model = fit(docs, labels, F.lit(True) if learn is None else learn, id_col, text_col, label_col)
    return docs.select(F.col(id_col).alias("doc_id"),
                       scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None,
               threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, all columns as they are."""
    model = fit(docs, labels, F.lit(True) if learn is None else learn)
    return docs.where(scorer(docs.sparkSession, model)(docs["text"]) < threshold)

"""Benchmark decontamination with suffix arrays over the training text.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.
A test window is ``window`` consecutive words of an item; an item of fewer
words, but not none, is one window. A training word inside any occurrence of a
window is hit.

The training text is cut into shards (slices of a partition of about ``SHARD`` bytes). Words become
numbers of the test vocabulary (0: not in it); positions at which a match could
start form the shard's suffix array, ordered by their next ``window`` words.
Every test suffix is searched in it by bisection, once from below and once from
above, so each hit range gives all locations; hits on one diagonal join to the
longest verbatim matches. Words are numbered by hash; the bytes of every hit word
are compared with the test word's. Nothing is shuffled: shards are independent.

The test side is broadcast in blocks of at most ``BLOCK_BYTES`` of text, as
many as its measured size asks for. Equal items are searched once.

Defined results: null and empty texts have no words; items without words match
nothing; equal items all count; items without an id are searched but not
listed; repeated rows get equal results; an empty table on either side gives
no hits; other columns are never read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys
from .textbytes import LOWER, prime_hashes, runs, slices

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD = 1 << 19            # bytes of training text in one suffix array
U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(buf: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """``(hash, text, start, end, bytes)`` of every word of a slice."""
    b = LOWER[buf]
    s, e, d = runs(_WORD[b], off)
    return prime_hashes(b, s, e, seed), d, s, e, b


def vocabulary(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Hashes of all words with their texts, the sorted distinct hashes, and the bytes
    and ends of the words that have them. No two words share a hash: the next seed is
    taken until that holds."""
    for seed in range(100):
        h, d, spelt = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], {}
        for i, _, buf, off in slices(texts, SHARD):
            x, y, s, e, b = words(buf, off, seed)
            h.append(x)
            d.append(y + i)
            for k, u, v in zip(x.tolist(), s.tolist(), e.tolist()):
                spelt.setdefault(k, set()).add(b[u:v].tobytes())
        if all(len(w) == 1 for w in spelt.values()):
            vocab = np.array(sorted(spelt), np.uint64)
            raw = [next(iter(spelt[k])) for k in vocab.tolist()]
            ends = np.cumsum([0, *map(len, raw)])
            return seed, np.concatenate(h), np.concatenate(d), vocab, np.frombuffer(b"".join(raw), np.uint8), ends
    raise RuntimeError("words share hashes under every seed")


def test_block(items: list[tuple[str | None, str | None]], window: int) -> dict:
    """Vocabulary, word pairs and distinct windows of one block of items."""
    seed, h, d, vocab, raw, ends = vocabulary(pa.array([t for _, t in items], pa.large_string()))
    word = np.searchsorted(vocab, h) + 1
    cut = np.searchsorted(d, np.arange(len(items) + 1))
    classes: dict[bytes, list] = {}
    for i, (item, _) in enumerate(items):
        if cut[i + 1] > cut[i]:
            classes.setdefault(word[cut[i]:cut[i + 1]].astype(">u4").tobytes(), []).append(item)
    pairs = [np.zeros(0, np.int64)]
    sizes: dict[int, list] = {}
    for c, key in enumerate(classes):
        w = np.frombuffer(key, ">u4").astype(np.int64)
        pairs.append(w[:-1] * (len(vocab) + 1) + w[1:])
        n = min(window, len(w))
        for p in range(len(w) - n + 1):
            sizes.setdefault(n, []).append((key[4 * p:4 * (p + n)], c, p))
    wins = {}
    for n, rows in sizes.items():
        keys, at = np.unique(np.array([np.frombuffer(r[0], np.uint8) for r in rows]), axis=0, return_inverse=True)
        order = np.argsort(at, kind="stable")
        wins[n] = (keys, np.searchsorted(at[order], np.arange(len(keys) + 1)),
                   np.array([rows[i][1] for i in order]), np.array([rows[i][2] for i in order]))
    return {"seed": seed, "vocab": vocab, "raw": raw, "ends": ends, "pairs": np.unique(np.concatenate(pairs)), "windows": wins, "items": list(classes.values())}


def suffix_array(word: np.ndarray, doc: np.ndarray, block: dict, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a test window could start, in order of their next
    ``window`` words, and those words as sortable bytes."""
    n = len(word)
    v = len(block["vocab"]) + 1
    pair = np.zeros(n, bool)
    if n > 1 and len(block["pairs"]):
        code = word[:-1] * v + word[1:]
        both = np.flatnonzero((word[:-1] > 0) & (word[1:] > 0) & (doc[:-1] == doc[1:]))
        i = np.searchsorted(block["pairs"], code[both])
        i[i == len(block["pairs"])] = 0
        pair[both] = block["pairs"][i] == code[both]
    stop = np.where(pair, n, np.arange(n))
    length = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n) + 1 if n else np.zeros(0, int)
    at = np.flatnonzero((word > 0) & (length >= min(block["windows"])))
    keys = np.zeros((len(at), window), ">u4")
    for j in range(window):
        ok = length[at] > j
        keys[ok, j] = word[at[ok] + j]
    flat = keys.view(f"S{4 * window}").ravel()
    order = np.argsort(flat, kind="stable")
    return at[order], flat[order]


def search(word: np.ndarray, doc: np.ndarray, block: dict, window: int) -> tuple[np.ndarray, ...]:
    """All occurrences ``(position, item class, position in item, words)``."""
    out = [np.zeros((4, 0), np.int64)]
    if not block["windows"] or not len(word):
        return tuple(out[0])
    at, keys = suffix_array(word, doc, block, window)
    for n, (test, cut, cls, pos) in block["windows"].items():
        low = np.zeros((len(test), 4 * window), np.uint8)
        low[:, :4 * n] = test
        high = low.copy()
        high[:, 4 * n:] = 255
        lo = np.searchsorted(keys, low.view(f"S{4 * window}").ravel(), "left")
        hi = np.searchsorted(keys, high.view(f"S{4 * window}").ravel(), "right")
        hit = np.flatnonzero(hi > lo)
        for t in hit.tolist():
            where, which = at[lo[t]:hi[t]], np.arange(cut[t], cut[t + 1])
            p, w = np.repeat(where, len(which)), np.tile(which, len(where))
            out.append(np.stack([p, cls[w], pos[w], np.full(len(p), n)]))
    return tuple(np.concatenate(out, axis=1))


def unequal(word, p, n, ws, we, low, block) -> np.ndarray:
    """Hit words whose bytes differ from those of the test word with their hash."""
    level = np.zeros(len(word) + 1, np.int64)
    np.add.at(level, p, 1)
    np.add.at(level, p + n, -1)
    at = np.flatnonzero(np.cumsum(level)[:-1] > 0)
    first, size = block["ends"][word[at] - 1], np.diff(block["ends"])[word[at] - 1]
    same = size == we[at] - ws[at]
    i, m = at[same], size[same]
    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    differ = low[np.repeat(ws[i], m) + step] != block["raw"][np.repeat(first[same], m) + step]
    return np.concatenate([at[~same], np.unique(np.repeat(i, m)[differ])])


def longest(p, cls, pos, n, doc) -> tuple[np.ndarray, ...]:
    """Join windows on one diagonal to maximal matches ``(start, class, words)``."""
    o = np.lexsort((p, p - pos, cls, doc[p]))
    p, cls, pos, n = p[o], cls[o], pos[o], n[o]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(cls) != 0) | (np.diff(p - pos) != 0) | (np.diff(doc[p]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return p[first], cls[first], p[last] + n[last] - p[first]


def scan_texts(col: pa.Array, block: dict, window: int):
    """Per text: words, merged hit runs and matches ``(item, start, words)``."""
    for i, j, buf, off in slices(col, SHARD):
        h, doc, ws, we, low = words(buf, off, block["seed"])
        k = np.searchsorted(block["vocab"], h)
        k[k == len(block["vocab"])] = 0
        word = np.where(block["vocab"][k] == h, k + 1, 0) if len(block["vocab"]) else np.zeros(len(h), int)
        count = np.bincount(doc, minlength=j - i)
        start = np.cumsum(count) - count
        p, cls, pos, n = search(word, doc, block, window)
        while len(p) and len(other := unequal(word, p, n, ws, we, low, block)):
            word[other] = 0                      # another word with the hash of a test word
            p, cls, pos, n = search(word, doc, block, window)
        hits: dict[int, tuple[list, list]] = {}
        if len(p):
            level = np.zeros(len(word) + 1, np.int64)
            np.add.at(level, p, 1)
            np.add.at(level, p + n, -1)
            s, e, t = runs(np.cumsum(level)[:-1] > 0, np.append(start, len(word)))
            t = doc[s]
            for a, b, x in zip(s.tolist(), e.tolist(), t.tolist()):
                hits.setdefault(x, ([], []))[0].append((a - int(start[x]), b - int(start[x])))
            for a, c, m in zip(*(x.tolist() for x in longest(p, cls, pos, n, doc))):
                x = int(doc[a])
                for item in block["items"][c]:
                    hits[x][1].append((item, a - int(start[x]), m))
        for x in range(j - i):
            r, m = hits.get(x, ([], []))
            yield int(count[x]), r, m


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Broadcast test blocks; each holds about ``block_bytes`` of text at most."""
    b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    size = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    out = []
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        out.append(b.sparkSession.sparkContext.broadcast(test_block([(r["i"], r["t"]) for r in rows], window)))
    return out


RUNS = "array<struct<s: int, e: int>>"
FOUND = "array<struct<item: string, start: int, words: int>>"


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, runs, matches)`` per row: merged runs of hit words and
    the longest matches with their locations, word positions from 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    k1, k2 = row_keys(id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, k1 long, k2 long, n_words long, runs {RUNS}, matches {FOUND}"
    types = [pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])),
             pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))]

    def one(block):
        def scan(batches):
            for b in batches:
                got = list(scan_texts(b.column(3), block.value, window))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array([g[0] for g in got], pa.int64()),
                     pa.array([[{"s": s, "e": e} for s, e in g[1]] for g in got], types[0]),
                     pa.array([[{"item": i, "start": s, "words": m} for i, s, m in g[2]] for g in got], types[1])],
                    ["doc_id", "k1", "k2", "n_words", "runs", "matches"])
        return base.mapInArrow(scan, schema)

    blocks = _blocks(benchmark, item_col, item_text, window, block_bytes)
    out = one(blocks[0])
    if len(blocks) > 1:
        rest = one(blocks[1])
        for b in blocks[2:]:
            rest = rest.union(one(b))
        more = rest.where(F.size("runs") > 0).groupBy("k1", "k2").agg(
            F.array_distinct(F.flatten(F.collect_list("runs"))).alias("r2"),
            F.array_distinct(F.flatten(F.collect_list("matches"))).alias("m2"))
        empty = F.expr(f"cast(array() as {RUNS})"), F.expr(f"cast(array() as {FOUND})")
        out = out.join(more, ["k1", "k2"], "left").select(
            "doc_id", "k1", "k2", "n_words", F.concat("runs", F.coalesce("r2", empty[0])).alias("runs"),
            F.concat("matches", F.coalesce("m2", empty[1])).alias("matches"))
    merged = F.aggregate(                     # runs in order, touching ones joined
        F.array_sort("runs"), F.expr(f"cast(array() as {RUNS})"),
        lambda a, r: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= r["s"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                                F.try_element_at(a, F.lit(-1))["s"].alias("s"),
                                F.greatest(F.try_element_at(a, F.lit(-1))["e"], r["e"]).alias("e")))))
        .otherwise(F.concat(a, F.array(r))))
    return out.select("doc_id", "n_words", (merged if len(blocks) > 1 else F.col("runs")).alias("runs"), "matches")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the items' hash from ``find_matches``."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]),
                                                   lambda i: i.isNotNull())))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("i")) \
        .select("doc_id", "n_words", "n_hit", F.size("i").cast("long").alias("n_items"),
                F.sha2(F.array_join("i", ","), 256).alias("items_sha256"),
                (F.col("n_hit") > 0).alias("contaminated"))


def contaminated(benchmark: DataFrame, text: Column, item_col: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Column:
    """Whether a text has a hit word."""
    def one(block):
        @F.arrow_udf("boolean")
        def affected(t: pa.Array) -> pa.Array:
            return pa.array([bool(r) for _, r, _ in scan_texts(t, block.value, window)], pa.bool_())
        return affected(text)

    cond = F.lit(False)
    for b in _blocks(benchmark, item_col, item_text, window, block_bytes):
        cond = cond | one(b)
    return cond


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without a hit word, all columns as they are."""
    return docs.where(~contaminated(benchmark, docs["text"], window=window))

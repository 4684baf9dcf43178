"""Repeated byte strings: anchored shards, then difference-cover suffix sorting.

A byte goes if a ``min_bytes`` string around it also starts anywhere else. Every
window of that length is assigned to its anchor: the ``GRAM``-byte string in it
with the smallest hash, leftmost on ties. Equal windows have equal anchors at
equal offsets, so anchors split the work without loss:

1. One scan writes, per text, its runs of windows with one anchor: the anchor's
   hash, a second hash of the run's whole context, place and length.
2. Anchors that occur once hold no repeat. Runs of other anchors are grouped into
   classes of equal context; in a class of two or more every window repeats.
3. Where an anchor has several classes, some of a single run, one context per
   class goes to the anchor's shard. A shard is suffix-sorted by difference
   cover: triples at positions 1 and 2 mod 3 are sorted and named, the names
   sorted recursively (names stand for 3, 9, 27, 81, 243 bytes, so the depth is
   bounded), the remaining suffixes merged in by (byte, rank) keys; neighbours
   in that order are compared on their first ``min_bytes`` bytes.
4. Covered windows return to their texts as byte runs, which are merged and cut.

Sums and minima are pre-aggregated before each shuffle; joins on a hot anchor or
class are plain equi-joins that the engine may split. An anchor with over
``HOT`` classes is dealt window by window, by content, so no task
holds an unbounded group. Two bitmaps of fixed size keep unique anchors and
untouched texts out of the shuffles; a false positive costs time, no result.

Defined results: null is empty; texts below ``min_bytes`` bytes stay whole;
matches never cross texts; repeated rows are copies of each other; rows that
agree in id and text get the same result; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .textbytes import BYTE, GOLD, mix, runs, slices

MIN_BYTES = 200
GRAM = 64
HOT = 20_000         # classes of one anchor in one shard group
SLICE = 1 << 19      # bytes of text scanned at once: some twelve arrays of 8 bytes each
SHARD_BYTES = 1 << 19
BITMAP = 27          # log2 of the bits of a bitmap: 16 MB
U = np.uint64
BASE2 = 0xD6E8FEB86659FD93
ENTRY = np.dtype([("a", "<u8"), ("c", "<u8"), ("lo", "<u4"), ("span", "<u2")])


class Prefix:
    """Prefix sums of a polynomial hash over one buffer: any span in one step."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up = np.cumprod(np.full(n + 1, base, np.uint64))
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sum[1:])
        self.down = np.cumprod(np.full(n + 1, pow(base, -1, 1 << 64), np.uint64))

    def span(self, s, e):
        return (self.sum[e] - self.sum[s]) * self.down[s]


def entries(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``(ENTRY rows, text index)`` of a slice, in order; longer texts in chunks."""
    if len(buf) > SLICE + length:
        out = []
        for s in range(0, len(buf) - length + 1, SLICE):
            e, _ = entries(buf[s:s + SLICE + length - 1], np.array([0, min(len(buf) - s, SLICE + length - 1)]), length, gram)
            e["lo"] += s
            out.append(e)
        e = np.concatenate(out)
        return e, np.zeros(len(e), np.int64)
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, ENTRY), np.zeros(0, np.int64)
    p = Prefix(BYTE[buf], GOLD)
    at = np.arange(len(buf) - gram + 1)
    key = mix(p.span(at, at + gram))
    packed = key >> U(24) << U(24) | at.astype(np.uint64)         # ties: leftmost
    w, m, cur = length - gram + 1, 1, packed
    while m * 2 <= w:
        cur = np.minimum(cur[:-m], cur[m:])
        m *= 2
    if m < w:
        cur = np.minimum(cur[:m - w], cur[w - m:])
    anchor = (cur & U((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    s = np.flatnonzero(text[:n] == text[length - 1:length - 1 + n])
    if not len(s):
        return np.zeros(0, ENTRY), np.zeros(0, np.int64)
    a = anchor[s]
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    f = np.flatnonzero(new)
    lo, hi, a = s[f], s[np.append(f[1:], len(s)) - 1], a[f]
    q = Prefix(mix(BYTE + U(1))[buf] | U(1), BASE2)
    shape = (hi - lo).astype(np.uint64) << U(32) | (a - lo).astype(np.uint64)
    out = np.zeros(len(f), ENTRY)
    out["a"], out["c"] = key[a], mix(q.span(lo, hi + length) + mix(shape + U(1)))
    out["lo"], out["span"] = lo - off[text[lo]], hi - lo
    return out, text[lo]


# ------------------------------------------------------- difference cover

def _names(code: np.ndarray) -> tuple[np.ndarray, int]:
    u, inv = np.unique(code, return_inverse=True)
    return inv.astype(np.int64) + 1, len(u)


def suffix_ranks(x: np.ndarray, depth: int) -> np.ndarray:
    """Number of suffixes of ``x`` (symbols from 1) that are smaller, for every
    position; suffixes that agree in 3^(depth + 1) symbols may tie."""
    n = len(x)
    if n < 3:
        order = sorted(range(n), key=lambda i: x[i:].tolist())
        r = np.zeros(n, np.int64)
        r[order] = np.arange(n)
        return r
    bits = max(1, int(x.max()).bit_length())
    if bits > 20:                                                 # pack small names
        x, top = _names(x)
        bits = max(1, top.bit_length())
    v = np.concatenate([x, np.zeros(4, x.dtype)]).astype(np.uint64)
    s1, s2 = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([s1, s2])
    if bits <= 21:
        code = v[sample] << U(2 * bits) | v[sample + 1] << U(bits) | v[sample + 2]
    else:
        pair, _ = _names(v[sample] << U(32) | v[sample + 1])
        code = pair.astype(np.uint64) << U(32) | v[sample + 2]
    name, distinct = _names(code)
    rank = np.zeros(n + 4, np.int64)
    if distinct == len(name) or depth == 0:
        rank[sample] = name
    else:
        r = suffix_ranks(np.concatenate([name[:len(s1)] + 1, [1], name[len(s1):] + 1]), depth - 1)
        rank[s1], rank[s2] = r[:len(s1)] + 1, r[len(s1) + 1:] + 1
    s0 = np.arange(0, n, 3)
    top = U(int(rank.max()).bit_length())

    def key1(p):                                                  # (symbol, rank of the next)
        return v[p] << top | rank[p + 1].astype(np.uint64)

    second, _ = _names(np.concatenate([v[s0] << U(bits) | v[s0 + 1], v[s2] << U(bits) | v[s2 + 1]]))
    k0, k1 = key1(s0), key1(s1)
    j0 = second[:len(s0)].astype(np.uint64) << top | rank[s0 + 2].astype(np.uint64)   # (two symbols, rank)
    j2 = second[len(s0):].astype(np.uint64) << top | rank[s2 + 2].astype(np.uint64)
    o0, o1, p0, p2 = np.sort(k0), np.sort(k1), np.sort(j0), np.sort(j2)
    known = np.sort(rank[sample])
    out = np.empty(n, np.int64)
    out[s0] = np.searchsorted(o0, k0) + np.searchsorted(o1, k0) + np.searchsorted(p2, j0)
    out[s1] = np.searchsorted(known, rank[s1]) + np.searchsorted(o0, k1)
    out[s2] = np.searchsorted(known, rank[s2]) + np.searchsorted(p0, j2)
    return out


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Per context, which of its windows also start elsewhere in the list."""
    size = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    first = np.cumsum(size) - size
    x = text.astype(np.int64) + 2
    x[first + size - 1] = 1
    count = size - length
    start = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    depth = 0
    while 3 ** (depth + 1) < length:
        depth += 1
    order = start[np.argsort(suffix_ranks(x, depth)[start], kind="stable")]
    again = np.zeros(len(text), bool)
    for i in range(0, len(order) - 1, 1 << 14):
        a, b = order[i:i + (1 << 14)], order[i + 1:i + (1 << 14) + 1]
        a = a[:len(b)]
        same = np.ones(len(a), bool)
        for k in range(0, length, 25):                            # most neighbours differ early
            live = np.flatnonzero(same)
            if not len(live):
                break
            step = np.arange(k, min(k + 25, length))
            same[live] = (text[a[live, None] + step] == text[b[live, None] + step]).all(1)
        again[a[same]] = again[b[same]] = True
    return [again[f:f + c] for f, c in zip(first.tolist(), count.tolist())]


# ------------------------------------------------------------------- jobs

def _bitmap(hashes: DataFrame, col: str) -> np.ndarray:
    """Bits of the hashes' last ``BITMAP`` bits; at most 2^(BITMAP - 6) rows come
    to the driver."""
    low = F.col(col).bitwiseAND(F.lit((1 << BITMAP) - 1))
    rows = hashes.select(F.shiftright(low, 6).alias("w"), low.bitwiseAND(F.lit(63)).cast("int").alias("b")) \
        .selectExpr("w", "shiftleft(1L, b) as m").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & U((1 << BITMAP) - 1)
    return (bitmap[(low >> U(6)).astype(np.int64)] >> (low & U(63)) & U(1)).astype(bool)


def _spread(blob: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) // ENTRY.itemsize for x in blob], np.int64)
    return np.frombuffer(b"".join(blob), ENTRY), np.repeat(np.arange(len(blob)), size)


def _pieces(b: pa.RecordBatch, limit: int = 1 << 23):
    """Slices of a batch with about ``limit`` bytes of its last column."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False))])
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, size[i] + limit, "right")) - 1)
        yield b.slice(i, j - i)
        i = j


def covered_runs(base: DataFrame, length: int, gram: int) -> DataFrame:
    """``(doc_id, k, runs)`` of ``base(doc_id, k, text)`` where windows repeat:
    unmerged byte runs [s, e)."""
    spark = base.sparkSession
    n = partitions(spark)
    kind = base.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for b in batches:
            for i, j, buf, off in slices(b.column(2), SLICE):
                e, text = entries(buf, off, length, gram)
                cut = np.searchsorted(text, np.arange(j - i + 1))
                blob = [e[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                                                  pa.array(blob, pa.binary())], ["doc_id", "k", "e"])

    table = stored(base.mapInArrow(scan, f"doc_id {kind}, k long, e binary").where(F.octet_length("e") > 0), "runs")

    def tally(batches):
        for b in batches:
            for s in _pieces(b):
                a, c = np.unique(_spread(s.column(0).to_pylist())[0]["a"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.astype(np.int64))], ["a", "n"])

    often = table.select("e").mapInArrow(tally, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    seen = spark.sparkContext.broadcast(_bitmap(often, "a"))

    def candidates(batches):
        for b in batches:
            for s in _pieces(b):
                e, row = _spread(s.column(2).to_pylist())
                keep = np.flatnonzero(_in(seen.value, e["a"]))
                e, row = e[keep], row[keep]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(row)), s.column(1).take(pa.array(row)),
                     pa.array(e["a"].copy().view(np.int64)), pa.array(e["c"].copy().view(np.int64)),
                     pa.array(e["lo"].astype(np.int64) << 16 | e["span"])], ["doc_id", "k", "a", "c", "at"])

    cand = table.mapInArrow(candidates, f"doc_id {kind}, k long, a long, c long, at long")
    # first() of fixed-width columns of one row: any run of the class stands for it
    cls = cand.groupBy("a", "c").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"),
                                     F.first("k").alias("k"), F.first("at").alias("at"))
    cls = stored(cls, "classes")
    group = cls.groupBy("a").agg(F.count("*").alias("classes"), F.sum((F.col("n") == 1).cast("long")).alias("single")) \
        .where("classes > 1 and single > 0").drop("single")
    open_ = cls.join(group, "a")
    whole = cand.join(cls.where("n > 1").select("a", "c"), ["a", "c"], "left_semi") \
        .select("doc_id", "k", F.shiftright("at", 16).alias("s"),
                (F.shiftright("at", 16) + F.col("at").bitwiseAND(F.lit(65535)) + length).alias("e"))

    # contexts of the open classes, cut from their texts
    want = open_.groupBy("doc_id", "k").agg(F.collect_list(F.struct("a", "c", "n", "at", "classes")).alias("w"))
    want = stored(want, "wanted")
    needed = spark.sparkContext.broadcast(_bitmap(want, "k"))
    texts = _pack(base, needed)

    def cut(batches):
        for b in batches:
            for s in _pieces(b, 1 << 22):
                rows = []
                for r in s.to_pylist():
                    data = _unpack(r["z"])
                    for w in r["w"]:
                        lo, span = w["at"] >> 16, w["at"] & 65535
                        ctx = data[lo:lo + span + length]
                        if w["classes"] <= HOT:
                            rows.append((w["a"], 0, w["c"], w["n"], r["doc_id"], r["k"], lo, ctx))
                            continue
                        for i in range(span + 1):                 # window by window
                            one = ctx[i:i + length]               # equal windows meet by content
                            part = hash_bytes(one) % (-(-w["classes"] // HOT) * length) + 1
                            rows.append((w["a"], part, w["c"], w["n"], r["doc_id"], r["k"], lo + i, one))
                cols = list(zip(*rows)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], b.schema.field("doc_id").type),
                     pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.binary())],
                    ["a", "part", "c", "n", "doc_id", "k", "lo", "ctx"])

    same = texts["doc_id"].eqNullSafe(want["doc_id"]) & (texts["k"] == want["k"])
    ctx = texts.join(want, same).select(want["doc_id"], want["k"], "w", "z") \
        .mapInArrow(cut, f"a long, part long, c long, n long, doc_id {kind}, k long, lo long, ctx binary")

    def sort_shards(batches):
        held, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                if size > SHARD_BYTES and (held[-1]["a"], held[-1]["part"]) != (r["a"], r["part"]):
                    yield from emit(held, b.schema)
                    held, size = [], 0
                held.append(r)
                size += len(r["ctx"])
        if held:
            yield from emit(held, b.schema)

    def emit(rows, schema):
        got = repeated_windows([r["ctx"] for r in rows], length)
        out = []
        for r, again in zip(rows, got):
            if r["n"] == 1 and again.any():
                s, e, _ = runs(again, np.array([0, len(again)]))
                out += [(r["doc_id"], r["k"], r["lo"] + x, r["lo"] + y - 1 + length) for x, y in zip(s.tolist(), e.tolist())]
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in cols[1:])],
            ["doc_id", "k", "s", "e"])

    part = ctx.repartition(n, "a", "part").sortWithinPartitions("a", "part") \
        .mapInArrow(sort_shards, f"doc_id {kind}, k long, s long, e long")
    return whole.union(part).groupBy("doc_id", "k").agg(F.collect_list(F.struct("s", "e")).alias("runs"))


def hash_bytes(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _pack(base: DataFrame, bitmap) -> DataFrame:
    """``(doc_id, k, z)``: compressed bytes of the texts whose key is in the bitmap."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            keep = np.flatnonzero(_in(bitmap.value, b.column(1).to_numpy().view(np.uint64)))
            for i in range(0, len(keep), 512):
                t = b.take(pa.array(keep[i:i + 512]))
                z = [pack.compress((x or "").encode()) for x in t.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(z, pa.binary())], ["doc_id", "k", "z"])

    return base.mapInArrow(scan, f"doc_id {kind}, k long, z binary")


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def merge_runs(rows) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES,
                 gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row, ``kept`` the
    remaining bytes; with ``digest`` their SHA-256 as ``kept_sha256``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0null")),
                                                                 text).alias("k"), text.alias("text"))
    found = stored(covered_runs(base, min_bytes, min(gram, min_bytes)), "covered")
    touched = spark.sparkContext.broadcast(_bitmap(found, "k"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, " + \
        ("kept_sha256 string" if digest else "kept binary")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]

    def result(ids, rows):
        n = [len(d) for d, _ in rows]
        gone = [sum(e - s for s, e in r) for _, r in rows]
        kept = []
        for d, r in rows:
            at, keep = 0, []
            for s, e in r:
                keep.append(d[at:s])
                at = e
            kept.append(b"".join([*keep, d[at:]]) if r else d)
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                           pa.array([len(r) for _, r in rows], pa.int64()), last], names)

    def untouched(batches):
        for b in batches:
            keep = np.flatnonzero(~_in(touched.value, b.column(1).to_numpy().view(np.uint64)))
            for i in range(0, len(keep), 512):
                t = b.take(pa.array(keep[i:i + 512]))
                yield result(t.column(0), [((x or "").encode(), []) for x in t.column(2).to_pylist()])

    def cut(batches):
        for b in batches:
            for s in _pieces(b, 1 << 22):
                rows = [(_unpack(r["z"]), merge_runs((x["s"], x["e"]) for x in r["runs"] or [])) for r in s.to_pylist()]
                yield result(s.column(0), rows)

    texts = _pack(base, touched)
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["k"] == found["k"])
    joined = texts.join(found, same, "left").select(texts["doc_id"], "runs", "z")
    return base.mapInArrow(untouched, schema).union(joined.mapInArrow(cut, schema))

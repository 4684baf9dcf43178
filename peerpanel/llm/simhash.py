"""SimHash near-duplicates with bit-sliced comparison.

A text's words are its maximal runs of characters other than ASCII white
space, ASCII letters lower-cased. Every shingle of ``width`` consecutive words
(space-joined, repeats included; a shorter text is one shingle) is hashed with
XXH64, seed 42; fingerprint bit i is set if it is set in over half the hashes.
Texts link when their fingerprints differ in at most ``radius`` bits.

Candidates are exact: the 64 bits are cut into ``radius + 2`` blocks, two of
which must agree if at most ``radius`` bits differ, so fingerprints are brought
together by every pair of blocks. Equal fingerprints are merged first, so a
group of copies is one entry whatever its size. Buckets of over ``TILE``
entries are cut into tiles and every pair of tiles is compared by its own key;
a task emits a star per component it sees, never the pairs.

Inside a bucket up to 64 fingerprints form one word per bit plane. A query
fingerprint is compared with the whole word by XOR; the differing bits are
added into vertical counters with carry-save steps, and (word, query) entries
whose lanes have all exceeded the radius are abandoned.

Defined results: null and empty texts and texts of white space only have
fingerprint zero and link like any other; equal rows get equal results; an
empty table gives an empty result; columns other than the id and text are
neither read nor touched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, stored

TILE = 2048          # fingerprints per tile of a large bucket
CHUNK = 1 << 15      # (word, query) entries compared at once
U = np.uint64
ONES = U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    w = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - w + 1]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[w - 1:].tolist())),
                    np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = 3, *also: str) -> DataFrame:
    """``(doc_id, *also, fp)``, one row per row of ``docs``; fp is a signed long."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *also)]
    names = ["doc_id", *also, "fp"]

    def scan(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], names)

    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, [*kinds, "long"]))
    return docs.select(F.col(text_col), F.col(id_col).alias("doc_id"), *also).mapInArrow(scan, schema)


def block_masks(radius: int) -> list[int]:
    """One mask per pair of the ``radius + 2`` blocks of bits."""
    cuts = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def bit_planes(slots: np.ndarray) -> np.ndarray:
    """(words, 64 slots) fingerprints -> (64 bits, words): lane j of plane b is
    bit b of slot j."""
    n = len(slots)
    bits = np.unpackbits(slots.view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(np.ascontiguousarray(planes).view(np.uint64).reshape(n, 64).T)


def within_radius(planes: np.ndarray, lanes: np.ndarray, word: np.ndarray, query: np.ndarray,
                  radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries (word, query): ``(entry index, lane mask)`` of the lanes of
    ``lanes[word]`` at most ``radius`` bits from the query."""
    digits = max(1, radius.bit_length())
    offset = (1 << digits) - 1 - radius         # counters overflow exactly beyond the radius
    at = np.arange(len(word))
    count = [np.full(len(word), ONES if offset >> d & 1 else U(0)) for d in range(digits)]
    over = np.zeros(len(word), np.uint64)
    for bit in range(64):
        carry = planes[bit][word] ^ (U(0) - (query >> U(bit) & U(1)))
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if bit % 8 == 7:
            live = (over & lanes[word]) != lanes[word]
            if not live.all():
                at, word, query, over = at[live], word[live], query[live], over[live]
                count = [c[live] for c in count]
            if not len(at):
                break
    return at, ~over & lanes[word]


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the links inside each group of ascending ``group`` numbers."""
    n = len(fp)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(head, n))
    words = -(-size // 64)
    first = np.cumsum(words) - words
    pos = np.arange(n) - np.repeat(head, size)
    word_of = np.repeat(first, size) + pos // 64
    slots = np.zeros((int(words.sum()), 64), np.uint64)
    slots[word_of, pos % 64] = fp
    filled = np.bincount(word_of, minlength=len(slots)).astype(np.uint64)
    lanes = np.where(filled == 64, ONES, (U(1) << (filled % U(64))) - U(1))
    row_at = np.full((len(slots), 64), -1, np.int64)
    row_at[word_of, pos % 64] = np.arange(n)
    planes = np.concatenate([bit_planes(slots[i:i + 2048]) for i in range(0, len(slots), 2048)], axis=1)
    # every row queries the words of its group from its own word on
    last = np.repeat(first + words, size)
    per = last - word_of
    a_all, b_all = [], []
    cuts = np.searchsorted(np.cumsum(per), np.arange(CHUNK, int(per.sum()) + CHUNK, CHUNK), "left") + 1
    lo = 0
    for hi in np.unique(np.minimum(cuts, n)):
        rows = np.arange(lo, hi)
        lo = int(hi)
        k = per[rows]
        if not len(rows) or not k.sum():
            continue
        q = np.repeat(rows, k)
        w = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(word_of[rows], k)
        at, mask = within_radius(planes, lanes, w, fp[q], radius)
        hit = np.flatnonzero(mask)
        if not len(hit):
            continue
        lane = np.unpackbits(mask[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        e, j = np.nonzero(lane)
        a, b = q[at[hit[e]]], row_at[w[at[hit[e]]], j]
        keep = a < b
        a, b = a[keep], b[keep]
        if len(a) > n:                       # fold links into stars as they come
            r = _stars(n, a, b)
            a = np.flatnonzero(r != np.arange(n))
            b = r[a]
        a_all.append(a)
        b_all.append(b)
    if not a_all:
        z = np.zeros(0, np.int64)
        return z, z
    r = _stars(n, np.concatenate(a_all), np.concatenate(b_all))
    a = np.flatnonzero(r != np.arange(n))
    return a, r[a]


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Stars ``(a, b)`` of fingerprints from ``(t, k, i, j, fp)`` rows dealt and
    sorted by (t, k, i, j)."""
    def scan(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 1 << 16:
                continue
            cut = _last_head(held)
            if cut:
                yield from emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from emit(held)

    def _keys(t):
        return np.stack([t.column(c).to_numpy() for c in ("t", "k", "i", "j")])

    def _last_head(t):
        k = _keys(t)
        new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0))
        return int(new[-1]) + 1 if len(new) else 0

    def emit(t):
        k = _keys(t)
        group = np.concatenate([[0], np.cumsum((k[:, 1:] != k[:, :-1]).any(0))])
        keep = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(keep):
            return
        fp = t.column("fp").to_numpy()[keep]
        a, b = _links(fp.view(np.uint64), group[keep], radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    return rows.mapInArrow(scan, "a long, b long")


def fingerprint_components(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``(doc_id, fp)`` -> ``(fp, component_id)``: the smallest doc_id reachable."""
    n = partitions(fps.sparkSession)
    rep = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    masks = F.array(*[F.lit(np.uint64(m).astype(np.int64).item()) for m in block_masks(radius)])
    keyed = rep.select("fp", F.posexplode(masks).alias("t", "m")) \
        .select("t", F.col("m").bitwiseAND(F.col("fp")).alias("k"), "fp")
    big = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > TILE) \
        .select("t", "k", F.ceil(F.col("n") / TILE).cast("int").alias("nt"))
    tiled = keyed.join(big, ["t", "k"], "left").withColumn("nt", F.coalesce("nt", F.lit(1)))
    dealt = tiled.withColumn("own", F.expr("cast(pmod(xxhash64(fp), nt) as int)")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nt") - 1))) \
        .select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = dealt.repartition(n, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    comp = components(bucket_links(dealt, radius))
    named = rep.join(comp, rep.fp == comp.node, "left") \
        .select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    return named.join(named.groupBy("c").agg(F.min("rep").alias("component_id")), "c") \
        .select("fp", "component_id")


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            width: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``; ids of any ordered type."""
    fps = stored(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    return fps.join(fingerprint_components(fps, radius), "fp", "left") \
        .select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` per component: that of the smallest doc_id (then of the
    smallest text hash). Of rows that repeat this doc_id and text, the smallest in
    order of all columns stays. A row without a doc_id stays only where no row of
    its component has one."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    marks = stored(fingerprints(docs.select("doc_id", "text", h.alias("h")), "doc_id", "text", width, "h"),
                   "simhash-fp")
    comp = fingerprint_components(marks.select("doc_id", "fp"), radius)
    first = marks.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("copies")).join(comp, "fp").groupBy("component_id") \
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "copies")).alias("m"))
    first = stored(first.select(F.col("m.doc_id").alias("_d"), F.col("m.h").alias("_h"), F.col("m.copies").alias("_copies")),
                   "simhash-first")
    same = lambda f: docs["doc_id"].eqNullSafe(f["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == f["_h"])
    single, many = first.where("_copies = 1"), first.where("_copies > 1")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.join(many, same(many), "left_semi") \
        .groupBy(F.col("doc_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).agg(F.min(row).alias("_row"))
    return docs.join(single, same(single), "left_semi").union(again.select("_row.*"))

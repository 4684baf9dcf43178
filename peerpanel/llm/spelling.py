"""Groups of spelling variants: words one edit apart, by dynamic programming over
sorted vocabulary lists.

Words are counted over the whole corpus, then near pairs (exactly one inserted,
deleted or replaced code point) are found by scanning sorted lists. Two words one
edit apart agree before and after the edit, so with m the shorter length they share
the first or the last m // 2 code points. Hence two passes, over the words and over
the reversed words: the list is sorted by (length, word) and cut by range into
shards of about ``SHARD`` words (at most ``SHARDS``, whose ends are broadcast), and
every word visits the shards that overlap its prefix in the lists of its own and the
next smaller length. Pairs that share the prefix belong to the first pass.

A shard is scanned level by level. A state is a query word, a range of list words
that share a prefix, and the three cells around the diagonal of the edit matrix
after that prefix. One step splits every range at the adjacent longest common
prefixes (LCPs) that end there, reuses the range's cells for each part and extends
them by one row; a range whose cells all exceed one edit is skipped with all words
below it. Nothing is compared pair by pair and no group of words meets in one task
as a whole: shards have a bounded size, and queries of a crowded shard are dealt to
several copies of it.

A word's form is its near word with the largest count (ties: smallest in code-point
order) if that is at least ``ratio`` times its own; counts at least double along a
chain of forms, so roots settle in a few rounds of pointer jumping.

Defined results: a null text has no words; a null id counts as empty in the damage
hash; repeated rows count again; an empty table gives no rows; words of any length
are compared in full; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([a-zÀ-ÿ]+)"      # after lower-casing A-Z
SHARD = 32_768        # list words of a shard
SHARDS = 4_096        # shards of a pass
VISITS = 131_072      # queries of one copy of a shard
STEP = 4_096          # queries scanned together
KEY = 64              # code points of a shard's end that are kept
TAIL = 64             # single words are finished in one comparison beyond this
LAST = "\U0010ffff"
PAIRS = "word string, other string, other_n long"


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 5, min_n: int = 3,
                 damage: int = 97) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters of at least ``min_len`` code points
    with at least ``min_n`` occurrences. Where ``damage`` divides the crc32 h of
    ``<id>:<run>``, the run loses its code point ``h % length`` first."""
    run = F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(RUN), F.lit(1))).alias("run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run) \
        .where(F.length("run") >= min_len).withColumn("h", F.crc32(F.concat("id", F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")
    return runs.select(word).where(F.length("word") >= min_len).groupBy("word").agg(F.count("*").alias("n")) \
        .where(F.col("n") >= min_n)


def points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of equal length."""
    return np.where((a == b).all(1), a.shape[1], (a != b).argmax(1)) if a.shape[1] else np.zeros(len(a), int)


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether ``b``, as long as ``a`` or one longer, is one edit away."""
    differ = np.flatnonzero(a != b[:len(a)])
    i = int(differ[0]) if len(differ) else len(a)
    if len(a) == len(b):
        return i < len(a) and bool((a[i + 1:] == b[i + 1:]).all())
    return bool((a[i:] == b[i + 1:]).all())


class SortedList:
    """Sorted distinct words of one length with the LCPs of neighbours."""

    def __init__(self, words: list[str], ns: list[int]):
        self.words, self.n, self.length = words, np.array(ns, np.int64), len(words[0])
        self.chars = points(words, self.length)
        self.lcp = np.r_[-1, shared(self.chars[1:], self.chars[:-1])]

    def near(self, queries: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, list word) of pairs one edit apart that share their first
        ``k`` code points; queries have one length, that of the list or one more."""
        size, longer = self.length, len(queries[0]) - self.length
        a = np.array([bisect_left(self.words, q[:k]) for q in queries])
        b = np.array([bisect_right(self.words, q[:k] + LAST) for q in queries])
        chars = np.pad(points(queries, size + longer), ((0, 0), (1, 2)))    # column d + 1 holds code point d; 0 is none
        of = np.flatnonzero(a < b)
        a, b = a[of], b[of]
        # edit distances of the list prefix to the query prefixes of d - 1, d, d + 1 code points
        x, y, z = np.full(len(of), 1 if k else 9), np.zeros(len(of), int), np.ones(len(of), int)
        for d in range(k, size):
            if size - d > TAIL and len(a) and (b - a).max() == 1:
                ok = [one_edit(self.chars[i], chars[q, 1:1 + size + longer]) for i, q in zip(a, of)]
                return of[ok], a[ok]
            start = np.flatnonzero(self.lcp <= d)           # where prefixes of d + 1 code points begin
            lo, hi = np.searchsorted(start, a), np.searchsorted(start, b)
            n = hi - lo
            up = np.repeat(np.arange(len(a)), n)
            at = np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n) + lo[up]
            end = np.r_[start, len(self.words)][at + 1]
            a, b, of = start[at], end, of[up]
            c, q = self.chars[a, d], chars[of]
            x1 = np.minimum(y[up] + 1, x[up] + (q[:, d] != c))
            y1 = np.minimum(np.minimum(y[up] + (q[:, d + 1] != c), z[up] + 1), x1 + 1)
            z1 = np.minimum(z[up] + (q[:, d + 2] != c), y1 + 1) if d + 2 <= size + longer else np.full(len(up), 9)
            go = np.minimum(np.minimum(x1, y1), z1) <= 1
            a, b, of, x, y, z = a[go], b[go], of[go], x1[go], y1[go], z1[go]
        ok = (z if longer else y) == 1
        return of[ok], a[ok]


def scan(lists: dict[int, SortedList], queries: list[tuple[str, int]], reverse: bool):
    """Near pairs of one shard as columns (word, other, n of other)."""
    word, other, n = [], [], []
    by_length: dict[int, list] = {}
    for q in queries:
        by_length.setdefault(len(q[0]), []).append(q)
    for length, some in by_length.items():
        for size in (length, length - 1):
            if size not in lists:
                continue
            held, k = lists[size], size // 2
            for i in range(0, len(some), STEP):
                part = some[i:i + STEP]
                qi, wi = held.near([q for q, _ in part], k)
                for q, w in zip(qi.tolist(), wi.tolist()):
                    (u, nu), v = part[q], held.words[w]
                    if reverse:
                        if u[len(u) - k:] == v[size - k:]:
                            continue                        # found by their prefix
                        u, v = u[::-1], v[::-1]
                    word.append(u)
                    other.append(v)
                    n.append(int(held.n[w]))
                    if size < length:                       # equal lengths are found from both sides
                        word.append(v)
                        other.append(u)
                        n.append(nu)
    return word, other, n


def _pass(words: DataFrame, total: int, reverse: bool) -> DataFrame:
    """Near pairs found by prefix, or with ``reverse`` by suffix alone."""
    spark = words.sparkSession
    key = F.reverse("word") if reverse else F.col("word")
    count = max(1, min(SHARDS, math.ceil(total / SHARD)))
    ordered = stored(words.select(F.length("word").alias("size"), key.alias("key"), "n")
                     .repartitionByRange(count, "size", "key").withColumn("shard", F.spark_partition_id()), "spell-sorted")
    ends = ordered.groupBy("shard").agg(F.min(F.struct("size", F.substring("key", 1, KEY).alias("key"))).alias("a"),
                                        F.max(F.struct("size", F.substring("key", 1, KEY).alias("key"))).alias("b")) \
        .orderBy("shard").collect()                                               # at most SHARDS rows
    table = spark.sparkContext.broadcast(([r["shard"] for r in ends], [(r["a"]["size"], r["a"]["key"]) for r in ends],
                                          [(r["b"]["size"], r["b"]["key"] + LAST) for r in ends]))

    def deal(batches):
        shards, first, last = table.value
        seen = {}
        for b in batches:
            rows, to = [], []
            for i, key in enumerate(b.column(1).to_pylist()):
                visits = set()
                for size in (len(key), len(key) - 1):
                    want = (size, key[:size // 2])
                    if want not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        # shards whose last word may reach the prefix and whose first does not pass it
                        seen[want] = range(bisect_left(last, want), bisect_right(first, (size, want[1] + LAST)))
                    visits.update(seen[want])
                rows += [i] * len(visits)
                to += [shards[s] for s in visits]
            part = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *part.columns[:3]], ["shard", "size", "key", "n"])

    visits = stored(ordered.select("size", "key", "n").mapInArrow(deal, "shard int, size int, key string, n long"), "spell-visits")
    copies = spark.createDataFrame(
        [(r["shard"], math.ceil(r["count"] / VISITS)) for r in visits.groupBy("shard").count().collect()],
        "shard int, copies int")                                                  # at most SHARDS rows
    copies = F.broadcast(copies)
    lists = ordered.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
                                                 F.lit(False).alias("asks"), "size", "key", "n")
    asks = visits.join(copies, "shard").select("shard", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int").alias("copy"),
                                               F.lit(True).alias("asks"), "size", "key", "n")

    def compare(batches):
        at, held, lists, queries = None, {}, None, []

        def out():
            nonlocal lists
            if lists is None:
                lists = {s: SortedList(w, n) for s, (w, n) in held.items()}
            found = scan(lists, queries, reverse)
            queries.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()),
                                               pa.array(found[2], pa.int64())], ["word", "other", "other_n"])

        for b in batches:
            for shard, copy, ask, size, key, n in zip(*(c.to_pylist() for c in b.columns)):
                if at != (shard, copy):
                    if queries:
                        yield out()
                    at, held, lists = (shard, copy), {}, None
                if ask:
                    queries.append((key, n))
                    if len(queries) >= 4 * STEP:
                        yield out()
                else:
                    w = held.setdefault(size, ([], []))
                    w[0].append(key)
                    w[1].append(n)
        if queries:
            yield out()

    return lists.union(asks).repartition(max(partitions(spark), count), "shard", "copy") \
        .sortWithinPartitions("shard", "copy", "asks", "size", "key").mapInArrow(compare, PAIRS)


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, other, other_n)``: every ordered pair of words one edit apart, once."""
    total = words.count()
    return _pass(words, total, False).union(_pass(words, total, True))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form, from ``(word, form)``: pointer jumping."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = stored(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"),
                                                           F.col("far").isNotNull().alias("moved")), "spell-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each distinct word of ``(word, n)``."""
    words = stored(words.select("word", "n"), "spell-words")
    best: Column = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.n") >= ratio * F.col("n")
    named = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.form")).alias("form"),
        F.when(has, -F.col("best.n")).alias("form_n")), "spell-forms")
    return named.join(roots(named.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Hard negatives from embeddings, through Hilbert-ordered blocks with zone maps.

Vectors become integers (``floor(scale * x)``), so scores are exact. Candidates are
sorted by (label, Hilbert index of the vector) with a range partitioning and cut
into Parquet blocks of ``BLOCK`` vectors, each with a zone map: minimum and maximum
of every dimension and of the label. Blocks of one partition, a part, are searched
together; parts belong to at most ``PIECES`` pieces, whose own zones are the only broadcast.

For an anchor a and a zone [lo, hi], interval arithmetic bounds every score inside:
``a+ . lo + a- . hi <= score <= a+ . hi + a- . lo`` (a+ and a- the positive and
negative parts). A search asks, per anchor, for the best k scores inside each of its
windows [low, high]; ``floor`` is a score that k rows are known to reach. A block
is read for an anchor only if, for some window, its upper bound reaches the floor
and its lower bound does not pass the window, tested on pieces, then on blocks.

1. Positives: one window without ends over blocks that may hold the label. The floor
   is the k-th best score in the anchor's own block.
2. Negatives: one window per positive over blocks that hold another label. The floor
   comes from a first search in the most promising block of every part.

Anchors travel in packed groups to the parts of the pieces they ask for, not to every
block: a task reads the blocks of a part, then the groups as they come. It keeps the best
rows of the anchors it has seen, raises their floors as it goes and passes them on
when it holds ``HELD`` of them. Nothing is capped: ties beyond k are cut by id.

As Parquet, groups of anchors take far less than in memory. Joins therefore never leave
it to Spark's estimate, which goes by the files, whether a side passes the driver.

Defined results: rows with a null label, a null or empty vector, a null or
non-finite component, or one beyond ``LIMIT`` after scaling (its products would not
fit 64 bits) take no part; only rows of the anchor's vector length are its
candidates; repeated rows are different rows, so an anchor's copy can be its
positive; a null id is no anchor and sorts last among ties; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored

BLOCK = 1024          # vectors of a block
PIECES = 1024         # zones that are broadcast
GROUP = 128           # anchors that travel together
BITS = 2              # Hilbert curve: bits of each dimension
LIMIT = 1 << 26
HELD = 1 << 18        # results a task holds before it passes them on
NO_ID = (1 << 63) - 1
FAR = 1 << 62            # beyond every score

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "a long, w int, score long, id long, row long"
ANCHOR = "a long, id long, label long, q binary, low array<long>, high array<long>, floor array<long>"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of ``n`` rows for jobs run inside: rows hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hilbert(v: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``v`` (values below ``2 ** bits``), as bytes in
    big-endian order: Gray code per level with the reflections and exchanges of the
    levels above undone, then the bits of all dimensions interleaved."""
    x = [v[:, i].astype(np.uint32) for i in range(v.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> np.uint32(level)) & np.uint32(1), flip ^ np.uint32((1 << level) - 1), flip)
    planes = [((c ^ flip) >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1) for c in x]
    return np.packbits(np.stack(planes, 1).astype(np.uint8), axis=1)


def _ints(col, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:                                  # every partial sum is an exact double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def zone_bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with any vector of each zone, one off
    for sums beyond exact doubles."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    lo, hi = lo.astype(np.float64), hi.astype(np.float64)
    slack = 1e-9 * (np.abs(a).max(initial=0) * float(max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))) * a.shape[1])
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


def wanted(anchors: dict, zones: dict, same: bool, best: bool) -> np.ndarray:
    """Which anchors must read which zones; ``best``: the one of the highest bound."""
    least, most = zone_bounds(anchors["q"], zones["lo"], zones["hi"])
    label, first, last = anchors["label"][:, None], zones["label_lo"][None, :], zones["label_hi"][None, :]
    ok = (first <= label) & (label <= last) if same else (first < label) | (label < last)
    inside = np.zeros_like(ok)
    for w in range(anchors["low"].shape[1]):
        inside |= (most >= anchors["floor"][:, w, None]) & (least <= anchors["high"][:, w, None])
    ok &= inside
    if best:
        top = np.where(ok, most, -np.inf).argmax(1)
        ok &= np.arange(ok.shape[1])[None, :] == top[:, None]
    return ok


def top_k(key: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of every key: higher scores, then smaller ids."""
    order = np.lexsort((row, ident, -score, key))
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    rank = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
    return order[rank < k]


class Best:
    """The best rows of the anchors that a task has seen, with their floors."""

    def __init__(self, k: int, windows: int):
        self.k, self.windows = k, windows
        self.clear()

    def clear(self):
        self.slot, self.names = {}, []
        self.floor = np.zeros((0, self.windows), np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]
        self.parts, self.held = [], 0

    def floors(self, anchors: dict) -> tuple[np.ndarray, np.ndarray]:
        new = [a for a in anchors["a"].tolist() if a not in self.slot]
        for a in new:
            self.slot[a] = len(self.names)
            self.names.append(a)
        if new:
            self.floor = np.concatenate([self.floor, np.full((len(new), self.windows), -FAR)])
        at = np.array([self.slot[a] for a in anchors["a"].tolist()])
        return at, np.maximum(self.floor[at], anchors["floor"])

    def add(self, anchors: dict, block: dict, same: bool) -> None:
        at, floor = self.floors(anchors)
        score = products(anchors["q"], block["q"])
        i, j = np.nonzero(score >= floor.min(1)[:, None])       # few reach a floor: the rest is tested on those
        score = score[i, j]
        alike = anchors["label"][i] == block["label"][j]
        ok = alike & (anchors["a"][i] != block["row"][j]) if same else ~alike
        i, j, score = i[ok], j[ok], score[ok]
        for w in range(self.windows):
            fit = (score >= floor[i, w]) & (score <= anchors["high"][i, w])
            if fit.any():
                part = [at[i[fit]] * self.windows + w, score[fit], block["id"][j[fit]], block["row"][j[fit]]]
                keep = top_k(*part, self.k)
                self.parts.append([x[keep] for x in part])
                self.held += len(keep)
        if self.held > max(1 << 14, len(self.rows[0])):
            self.settle()

    def settle(self) -> None:
        rows = [np.concatenate([x, *(p[c] for p in self.parts)]) for c, x in enumerate(self.rows)]
        keep = top_k(*rows, self.k)
        self.rows, self.parts, self.held = [x[keep] for x in rows], [], 0
        key = self.rows[0]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        count = np.diff(np.r_[start, len(key)])
        full = start[count == self.k]
        self.floor.reshape(-1)[key[full]] = self.rows[1][full + self.k - 1]

    def batch(self):
        self.settle()
        key, score, ident, row = self.rows
        names = np.array(self.names, np.int64)
        out = pa.RecordBatch.from_arrays(
            [pa.array(names[key // self.windows] if len(key) else key), pa.array((key % self.windows).astype(np.int32)),
             pa.array(score), pa.array(ident), pa.array(row)], ["a", "w", "score", "id", "row"])
        self.clear()
        return out


def _pack(anchors: dict, some: np.ndarray) -> tuple:
    return tuple(np.ascontiguousarray(anchors[c][some]).tobytes() for c in ("a", "label", "q", "low", "high", "floor"))


PACKED = "anchors binary, labels binary, q binary, low binary, high binary, floors binary"


def _unpack(row: dict, dim: int) -> dict:
    a = np.frombuffer(row["anchors"], "<i8")
    out = {"a": a, "label": np.frombuffer(row["labels"], "<i8"), "q": _matrix(row["q"], dim)}
    return out | {k: np.frombuffer(row[c], "<i8").reshape(len(a), -1)
                  for k, c in (("low", "low"), ("high", "high"), ("floor", "floors"))}


def _groups(batches, dim: int):
    """Anchor rows in groups of at most ``GROUP``."""
    for b in batches:
        for i in range(0, b.num_rows, GROUP):
            s = b.slice(i, GROUP)
            windows = len(s.column(4)[0])
            yield {"a": s.column(0).to_numpy(), "label": s.column(2).to_numpy(),
                   "q": np.concatenate([_matrix(x.as_py(), dim) for x in s.column(3)]),
                   **{k: s.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, windows)
                      for k, c in (("low", 4), ("high", 5), ("floor", 6))}}


class Blocks:
    """The candidate blocks of one vector length, their zone maps and anchors."""

    def __init__(self, rows: DataFrame, dim: int, n: int, k: int, block: int = BLOCK):
        self.spark, self.dim = rows.sparkSession, dim
        self.parts = max(1, min(math.ceil(n / block), max(partitions(self.spark), math.ceil(n / (64 * block)))))
        self.share = math.ceil(self.parts / PIECES)         # parts of a piece
        self.blocks = stored(self._ordered(rows).mapInArrow(
            self._packer(block), "block long, n int, label_lo long, label_hi long, row binary, id binary, label binary, "
            "anchor binary, q binary, lo array<int>, hi array<int>"), "negatives-blocks")
        self._zones()
        with arrow_rows(self.spark, 16):
            self.anchors = stored(self.blocks.select("row", "id", "label", "anchor", "q").mapInArrow(
                self._seeder(k), ANCHOR), "negatives-anchors")

    def _ordered(self, rows: DataFrame) -> DataFrame:
        dim, bits = self.dim, BITS

        def ends(batches):
            for b in batches:
                if b.num_rows:
                    q = _ints(b.column(0), dim)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(q.min(0)),
                                                      pa.array(q.max(0))], ["d", "lo", "hi"])

        span = rows.select("q").mapInArrow(ends, "d int, lo int, hi int").groupBy("d") \
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").collect()       # one row per dimension
        lo = np.array([r["lo"] for r in span], np.int64)
        width = np.array([r["hi"] - r["lo"] + 1 for r in span], np.int64)

        def index(batches):
            for b in batches:
                cell = ((_ints(b.column(4), dim) - lo) << bits) // width
                h = hilbert(cell, bits)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in h], pa.binary())],
                                                 ["row", "id", "label", "anchor", "q", "curve"])

        order = ["label", "curve", "id", "row"]
        return rows.mapInArrow(index, "row long, id long, label long, anchor boolean, q array<int>, curve binary") \
            .repartitionByRange(self.parts, *order).sortWithinPartitions(*order).drop("curve")

    def _packer(self, block: int):
        dim = self.dim

        def pack(batches):
            first = TaskContext.get().partitionId() << 32
            seq, held, kept = 0, [], 0

            def cut(t):
                q, label = _ints(t.column(4), dim), t.column(2).to_numpy()
                raw = [t.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)]
                arrays = [[first | seq], [t.num_rows], [label.min()], [label.max()],
                          *([np.ascontiguousarray(x, "<i8").tobytes()] for x in raw),
                          [t.column(3).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
                          [np.ascontiguousarray(q, "<i4").tobytes()], [q.min(0).tolist()], [q.max(0).tolist()]]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5, *[pa.list_(pa.int32())] * 2]
                return pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(arrays, types)],
                    ["block", "n", "label_lo", "label_hi", "row", "id", "label", "anchor", "q", "lo", "hi"])

            for b in batches:
                held.append(b)
                kept += b.num_rows
                while kept >= block:
                    t = pa.Table.from_batches(held).combine_chunks()
                    yield cut(t.slice(0, block).combine_chunks().to_batches()[0])
                    seq, kept = seq + 1, kept - block
                    held = t.slice(block).to_batches()
            if kept:
                yield cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

        return pack

    def _zones(self) -> None:
        """The zones of the pieces."""
        dim, piece = self.dim, F.floor(F.shiftright("block", 32) / self.share).cast("long").alias("piece")
        ends = self.blocks.select(piece, "label_lo", "label_hi", F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "e")) \
            .groupBy("piece", "d").agg(F.min("label_lo").alias("label_lo"), F.max("label_hi").alias("label_hi"),
                                       F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi")) \
            .groupBy("piece").agg(F.min("label_lo").alias("label_lo"), F.max("label_hi").alias("label_hi"),
                                  F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))).alias("e")) \
            .select("piece", "label_lo", "label_hi", "e.lo", "e.hi").toArrow()      # at most PIECES rows, 4 bytes a bound
        self.zones = self.spark.sparkContext.broadcast(
            {c: ends.column(c).to_numpy() for c in ("piece", "label_lo", "label_hi")}
            | {c: _ints(ends.column(c).combine_chunks(), dim) for c in ("lo", "hi")} if ends.num_rows else None)

    def _seeder(self, k: int):
        dim = self.dim

        def seeds(batches):
            for b in batches:
                for r in b.to_pylist():
                    at = np.flatnonzero(np.frombuffer(r["anchor"], np.uint8))
                    if not len(at):
                        continue
                    row, ident, label = (np.frombuffer(r[c], "<i8") for c in ("row", "id", "label"))
                    q = _matrix(r["q"], dim)
                    score = products(q[at], q)
                    alike = label[at][:, None] == label[None, :]
                    alike[np.arange(len(at)), at] = False
                    score[~alike] = -FAR
                    floor = -np.sort(-score, axis=1)[:, k - 1] if len(label) >= k else -FAR
                    one = lambda v: pa.array([[x] for x in np.broadcast_to(v, len(at)).tolist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[at]), pa.array(ident[at]), pa.array(label[at]),
                         pa.array([x.tobytes() for x in q[at]], pa.binary()), one(-FAR), one(FAR), one(floor)],
                        ["a", "id", "label", "q", "low", "high", "floor"])

        return seeds

    def search(self, anchors: DataFrame, k: int, windows: int, same: bool, best: bool = False) -> DataFrame:
        """``FOUND``: the best ``k`` rows in each window of every anchor. With ``best``
        only one block per part is read (a bound for the full search)."""
        dim, zones, names = self.dim, self.zones, ["piece", "anchors", "labels", "q", "low", "high", "floors"]

        def to_pieces(batches):
            if (z := zones.value) is None:
                return
            for g in _groups(batches, dim):
                ok = wanted(g, z, same, False)
                for p in np.flatnonzero(ok.any(0)).tolist():
                    cols = [[int(z["piece"][p])], *([x] for x in _pack(g, ok[:, p]))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(cols, [pa.int64(), *[pa.binary()] * 6])], names)

        def read(batches):
            kept, part, blocks, z = Best(k, windows), None, [], None
            for b in batches:
                for r in b.to_pylist():
                    if r["part"] != part:
                        part, blocks, z = r["part"], [], None
                    if not r["asks"]:
                        blocks.append({"row": np.frombuffer(r["anchors"], "<i8"), "label": np.frombuffer(r["labels"], "<i8"),
                                       "id": np.frombuffer(r["floors"], "<i8"), "q": _matrix(r["q"], dim)})
                        continue
                    if not blocks:
                        continue
                    if z is None:
                        z = {c: np.stack([end(x[f]) for x in blocks]) for c, f, end in (
                            ("lo", "q", lambda v: v.min(0)), ("hi", "q", lambda v: v.max(0)),
                            ("label_lo", "label", np.min), ("label_hi", "label", np.max))}
                    g = _unpack(r, dim)
                    ok = wanted(g | {"floor": kept.floors(g)[1]}, z, same, best)
                    for p in np.flatnonzero(ok.any(0)).tolist():
                        kept.add({c: v[ok[:, p]] for c, v in g.items()}, blocks[p], same)
                    if len(kept.rows[0]) > HELD or len(kept.names) > HELD:
                        yield kept.batch()
            yield kept.batch()

        share, none = self.share, F.lit(None).cast("binary")
        # a part's blocks come before the groups that ask for them
        cells = self.blocks.select(F.shiftright("block", 32).alias("part"), F.lit(False).alias("asks"), F.col("row").alias("anchors"),
                                   F.col("label").alias("labels"), "q", none.alias("low"), none.alias("high"), F.col("id").alias("floors"))
        with arrow_rows(self.spark, GROUP):
            asked = anchors.select("a", "id", "label", "q", "low", "high", "floor").mapInArrow(to_pieces, f"piece long, {PACKED}") \
                .withColumn("part", F.explode(F.sequence(F.col("piece") * share, F.col("piece") * share + share - 1))) \
                .select("part", F.lit(True).alias("asks"), *names[1:])
            # few parts: so many tasks that two parts seldom meet in one
            tasks = self.parts * 4 if self.parts < 128 else self.parts
            found = stored(cells.unionByName(asked).repartition(tasks, "part").sortWithinPartitions("part", "asks")
                           .mapInArrow(read, FOUND), "negatives-found")
        rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for whose id ``is_anchor`` holds. Each has its ``positives``
    best other rows of its label; for each of these the ``negatives`` best rows of other
    labels with ``low * positive_score <= 100 * score <= high * positive_score``.
    Higher scores come first, then smaller ids."""
    spark = vectors.sparkSession
    v = F.col("v")
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    bad = v.isNull() | (F.size("v") < 1) | F.col("label").isNull() | F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * F.lit(float(scale)) > float(LIMIT)))
    rows = stored(base.where(~F.coalesce(bad, F.lit(True))).select(
        F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", F.coalesce(is_anchor(F.col("id")), F.lit(False)).alias("anchor"),
        scaled.cast("array<int>").alias("q")).select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")
    out = None
    for r in rows.groupBy(F.size("q").alias("d")).count().collect():              # one row per vector length
        part = _of_length(rows.where(F.size("q") == r["d"]), r["d"], r["count"], positives, negatives, low, high, block)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], OUT) if out is None else out


def _of_length(rows: DataFrame, dim: int, n: int, positives: int, negatives: int, low: int, high: int,
               block: int) -> DataFrame:
    cells = Blocks(rows, dim, n, positives, block)
    pos = stored(cells.search(cells.anchors, positives, 1, True)
                 .select("a", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                 "negatives-positives")
    # an anchor's windows in the order of its positives; one without a positive asks for nothing
    ends = pos.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    share = lambda per: F.transform("p", lambda x: x["positive_score"] * per)
    down = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    fill = lambda c, far: F.slice(F.concat(c, F.array_repeat(F.lit(far), positives)), 1, positives)
    asks = cells.anchors.drop("low", "high", "floor").join(ends.hint("merge"), "a").select(
        "a", "id", "label", "q",
        fill(F.transform(share(low), lambda x: -down(-x)), FAR).alias("low"),
        fill(F.transform(share(high), down), -FAR).alias("high"))
    asks = stored(asks.withColumn("floor", F.col("low")), "negatives-windows")
    first = cells.search(asks, negatives, positives, False, best=True).where(F.col("rank") == negatives) \
        .groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
    asks = asks.join(first.hint("merge"), "a", "left").withColumn("floor", F.transform(
        "low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("known", i), F.lit(-FAR))))).drop("known")
    neg = cells.search(stored(asks, "negatives-floors"), negatives, positives, False) \
        .select("a", (F.col("w") + 1).alias("w"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return neg.join(pos.hint("merge"), ["a", "w"]).join(cells.anchors.select("a", F.col("id").alias("anchor_id")).hint("merge"), "a") \
        .where((F.col("positive_score") * low <= F.col("negative_score") * 100)
               & (F.col("negative_score") * 100 <= F.col("positive_score") * high)) \
        .select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"),
                "positive_score", "negative_score")

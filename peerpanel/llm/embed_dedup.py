"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors u are quantised per vector to s*q, q int8, with the residual norm
e = |u - s*q| computed exactly. Then |u.v - s_u s_v q_u.q_v| <= e_u + e_v +
e_u e_v, so a tile product over the int8 codes tells which pairs may reach the
threshold; only those are computed again in double precision from the vectors
themselves.

Equal vectors are merged first. Each distinct vector has one home tile of about
``TILE`` vectors and visits the tiles after it; tiles belong to cells around at
most ``CELLS`` centres (a bounded sample), and a vector passes by a cell if its
angle to the centre exceeds the cell's radius plus the threshold angle, which
loses no pair. A task holds one home tile and streams its visitors, so no task
holds an unbounded group, and it emits sums of links and a star per component
it sees, never the pairs.

Defined results: vectors that are null, empty or zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link; equal
rows are different vectors that link with each other; a null id gets results
but never names a component that has another; an empty table gives an empty
result; other columns (labels) are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, stored
from .simhash import _stars

TILE = 4096
CELLS = 1024
CHUNK = 1024         # visitors multiplied at once
PAIRS = 1 << 16      # pairs recomputed at once


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, scale, residual norm)`` of unit rows; codes are int8 values."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None])
    e = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1)) + 1e-12
    return q.astype(np.int8), scale, e


def tile_links(h: np.ndarray, v: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``h``, row of ``v``) of unit vectors with cosine of at least
    the threshold; ``same`` keeps one order of pairs inside one tile."""
    (qh, sh, eh), (qv, sv, ev) = quantise(h), quantise(v)
    kind = np.float32 if h.shape[1] * 127 * 127 < 1 << 24 else np.float64     # products stay exact
    near = (qh.astype(kind) @ qv.astype(kind).T).astype(np.float64)
    near *= sh[:, None] * sv[None, :]
    near += eh[:, None] + ev[None, :] + eh[:, None] * ev[None, :] + 1e-9
    a, b = np.nonzero(near >= threshold)
    if same:
        keep = a < b
        a, b = a[keep], b[keep]
    ok = np.zeros(len(a), bool)
    for i in range(0, len(a), PAIRS):
        s = slice(i, i + PAIRS)
        ok[s] = np.einsum("ij,ij->i", h[a[s]], v[b[s]]) >= threshold
    return a[ok], b[ok]


def _matrix(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _summary(a, b, na, nb, ca, cb):
    """Link sums per node and a star per component of one product."""
    if not len(a):
        return None
    node, inv = np.unique(np.concatenate([na[a], nb[b]]), return_inverse=True)
    links = np.bincount(inv, np.concatenate([cb[b], ca[a]]), len(node)).astype(np.int64)
    root = _stars(len(node), inv[:len(a)], inv[len(a):])
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[root])],
                                      ["node", "links", "other"])


def _links_of_dim(classes: DataFrame, dim: int, n: int, threshold: float, tile: int, cells: int) -> DataFrame:
    """``(node, links, other)`` of the distinct vectors of one length."""
    spark, kind = classes.sparkSession, classes.schema["v"].dataType.simpleString()
    k = max(1, min(cells, math.ceil(n / tile)))
    picked = classes.orderBy(F.xxhash64("v"), "node").limit(k).select("v").collect()       # at most CELLS rows
    centre = unit(np.array([r["v"] for r in picked], np.float64))
    bc = spark.sparkContext.broadcast(centre)

    def home(batches):
        for b in batches:
            dot = np.clip(unit(_matrix(b.column(2), dim)) @ bc.value.T, -1, 1)
            at = dot.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(at.astype(np.int32)), pa.array(np.arccos(dot[np.arange(len(at)), at]))],
                ["node", "n", "v", "cell", "angle"])

    homed = stored(classes.mapInArrow(home, f"node long, n long, v {kind}, cell int, angle double"), "embed-home")
    stat = {r["cell"]: (r["c"], r["r"]) for r in
            homed.groupBy("cell").agg(F.count("*").alias("c"), F.max("angle").alias("r")).collect()}
    radius = np.array([stat[c][1] if c in stat else -10.0 for c in range(k)])
    tiles = [math.ceil(stat[c][0] / tile) if c in stat else 0 for c in range(k)]
    first = np.cumsum([0, *tiles])
    reach = math.acos(threshold) + 1e-6
    lay = spark.sparkContext.broadcast((radius, np.array(tiles), first))

    def deal(batches):
        radius, tiles, first = lay.value
        for b in batches:
            node, cell = b.column(0).to_numpy(), b.column(3).to_numpy()
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            own = first[cell] + (mixed % tiles[cell].astype(np.uint64)).astype(np.int64)
            angle = np.arccos(np.clip(unit(_matrix(b.column(2), dim)) @ bc.value.T, -1, 1))
            allowed = angle <= radius[None, :] + reach
            rows, at = [np.arange(len(node))], [own]
            for c in range(len(tiles)):
                for t in range(first[c], first[c + 1]):
                    go = np.flatnonzero((own < t) & allowed[:, c])
                    rows.append(go)
                    at.append(np.full(len(go), t))
            rows, at = np.concatenate(rows), np.concatenate(at)
            for i in range(0, len(rows), 1 << 14):
                r, t = rows[i:i + (1 << 14)], at[i:i + (1 << 14)]
                part = b.take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.astype(np.int32)), pa.array(own[r] != t), *part.columns[:3]],
                    ["tile", "visits", "node", "n", "v"])

    def multiply(batches):
        at, h, hn, hc = None, None, None, None
        for b in batches:
            t = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
            for x, y in zip(cut, cut[1:]):
                part = b.slice(x, y - x)
                if at != t[x]:
                    at, h = int(t[x]), np.zeros((0, dim))
                    hn = hc = np.zeros(0, np.int64)
                visits = part.column(1).to_numpy(zero_copy_only=False)
                v, vn = unit(_matrix(part.column(4), dim)), part.column(2).to_numpy()
                vc = part.column(3).to_numpy()
                own = ~visits                      # homes come before visitors
                for i in range(0, int(own.sum()), CHUNK):
                    c, cn, cc = v[own][i:i + CHUNK], vn[own][i:i + CHUNK], vc[own][i:i + CHUNK]
                    if (s := _summary(*tile_links(c, c, threshold, True), cn, cn, cc, cc)) is not None:
                        yield s
                    if len(h) and (s := _summary(*tile_links(h, c, threshold, False), hn, cn, hc, cc)) is not None:
                        yield s
                    h, hn, hc = np.concatenate([h, c]), np.concatenate([hn, cn]), np.concatenate([hc, cc])
                for i in range(0, int(visits.sum()), CHUNK):
                    c, cn, cc = v[visits][i:i + CHUNK], vn[visits][i:i + CHUNK], vc[visits][i:i + CHUNK]
                    if (s := _summary(*tile_links(h, c, threshold, False), hn, cn, hc, cc)) is not None:
                        yield s

    dealt = homed.mapInArrow(deal, f"tile int, visits boolean, node long, n long, v {kind}") \
        .repartition(max(partitions(spark), int(first[-1])), "tile").sortWithinPartitions("tile", "visits")
    return dealt.mapInArrow(multiply, "node long, links long, other long")


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                              threshold: float = 0.9, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``."""
    v = F.col("v")
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        | ~F.exists(v, lambda x: x != 0)
    # single-precision vectors travel as such; all arithmetic is in double precision
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    h = F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("2"), F.reverse("v")).alias("h2")
    good = base.where(~F.coalesce(bad, F.lit(True)))
    classes = stored(good.groupBy(*h).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
                     .withColumn("node", F.monotonically_increasing_id()), "embed-classes")
    spark = vectors.sparkSession
    found = None
    for r in classes.groupBy(F.size("v").alias("d")).count().collect():        # one row per vector length
        part = _links_of_dim(classes.where(F.size("v") == r["d"]).select("node", "n", "v"), r["d"], r["count"],
                             threshold, tile, cells)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, other long")
    found = stored(found, "embed-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("h1", "h2", "rep", "n", "node").join(links, "node", "left").join(comp, "node", "left") \
        .withColumn("c", F.coalesce("component", "node"))
    small = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(small, "c").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                                          "component_id")
    out = good.select("vec_id", *h).join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = base.where(F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

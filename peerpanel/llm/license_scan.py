"""License scan: TF-IDF cosine to templates, then inheritance along paths.

Terms are lower-case runs of a-z, 0-9 and non-ASCII characters. The weight of a
term is ln((N + 1) / (df + 1)), df counted over all N files, for every term alike. A
passage is a line with terms, each run of 2 or of 3 such lines without a line between
that has none, a whole paragraph of such lines, or the whole text of a licence file (by
name). Its sparse vector holds term count times weight. A passage's licence is that of
the template with the highest cosine among those whose required terms it holds, ties
(to 9 digits) going to the name that sorts first; none if that template denies a licence or the
cosine is below the threshold. A file's own licence is that of its whole text, if that
is a passage with one, else that of its best passage. Word order does not count, so a
short line of a name's words and little else is taken for the name.

Paragraphs without all required terms of any template are ruled out inside the scan, as
are passages by a bound without the terms of no template. The rest are stored with
their terms; the df of those terms is counted in one
more pass over the files and joined to them for the exact cosine. A licence file in a directory
covers the files below it: files without a licence of their own inherit from
the nearest ancestor that has one, found by joining their ancestor directories
with the directories' licences (a few rows per directory, summed before the
join). A directory with several goes by the licence most of its licence files
carry, then the name that sorts first.

Defined results: null and empty texts have no passage and may inherit; a null
path neither gives nor inherits; repeated rows get equal results; an empty
table gives an empty result; columns named in ``keep`` pass untouched, others are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .license_templates import TEMPLATES
from .textbytes import LOWER, runs, slices, span_hashes

THRESHOLD = 0.6
WINDOWS = (2, 3)     # lines that a wrapped sentence may take
SALTS = 32           # parts of a directory's files
SLOTS = 20           # bits of a term's hash in the filter of the df pass
PARAGRAPHS = 8192    # paragraphs tested for required terms at a time
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|copyright|unlicense|notice)([.\-_][^/]*)?$"
U = np.uint64
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, text)`` of every term."""
    b = LOWER[buf]
    s, e, d = runs(_TERM[b], off)
    return span_hashes(b, s, e), s, d


def _hashes(text: str) -> np.ndarray:
    return terms(*next(slices(pa.array([text])))[2:])[0]


def vocabulary(templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending term hashes, (templates, terms) counts and required terms."""
    got = [_hashes(t) for _, t, _ in templates]
    vocab = np.unique(np.concatenate(got))
    counts = np.stack([np.bincount(np.searchsorted(vocab, g), minlength=len(vocab)) for g in got])
    need = np.zeros(counts.shape, bool)
    for k, (_, _, keys) in enumerate(templates):
        need[k, np.searchsorted(vocab, _hashes(" ".join(keys)))] = True
    return vocab, counts, need


def _lookup(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = np.searchsorted(vocab, h)
    i[i == len(vocab)] = 0
    return np.where(vocab[i] == h, i, -1)


def holding(term, group, n_groups, need):
    """Groups of terms that hold all required terms of some template."""
    sets = np.unique(need, axis=0)
    cols = np.flatnonzero(sets.any(0))
    at = np.full(need.shape[1] + 1, -1)
    at[cols] = np.arange(len(cols))
    col = at[term]                                        # a term of no template is -1, the last entry
    hit = np.flatnonzero(col >= 0)
    key = np.unique(group[hit] * len(cols) + col[hit])
    g, c = key // len(cols), key % len(cols)
    size = sets.sum(1)
    some = np.flatnonzero(np.bincount(g, minlength=n_groups) >= size.min())
    out = np.zeros(n_groups, bool)
    weight = sets[:, cols].astype(np.float32).T
    for i in range(0, len(some), PARAGRAPHS):
        part = some[i:i + PARAGRAPHS]
        lo, hi = np.searchsorted(g, [part[0], part[-1] + 1])
        inside = np.isin(g[lo:hi], part)
        held = np.zeros((len(part), len(cols)), np.float32)
        held[np.searchsorted(part, g[lo:hi][inside]), c[lo:hi][inside]] = 1
        out[part] = (held @ weight == size).any(1)
    return out


def near_passages(h, term, passage, n_passages, counts, need, idf, gives, threshold):
    """Passages that may have a licence: ``(passage, template, dot, inside, (passage,
    term hash, count) of their terms of no template)``; the dot product with their
    template is divided by its norm, ``inside`` is the squared norm of the template terms."""
    none = np.zeros(0, np.int64)
    empty = none, none, np.zeros(0), np.zeros(0), (none, np.zeros(0, np.uint64), none)
    ok = holding(term, passage, n_passages, need)[passage]
    h, term, passage = h[ok], term[ok], passage[ok]
    hit = np.flatnonzero(term >= 0)
    if not len(hit):
        return empty
    w = counts * idf
    norm = np.sqrt((w * w).sum(1))
    m = counts.shape[1]
    key, tf = np.unique(passage[hit] * m + term[hit], return_counts=True)
    p, t = key // m, key % m
    x = tf * idf[t]
    some, row = np.unique(p, return_inverse=True)
    inside = np.bincount(row, x * x, len(some))
    size = need.sum(1)
    top, best = np.full(len(some), -1), np.full(len(some), -1.0)
    for k in np.flatnonzero(norm > 0):
        full = np.bincount(row, need[k][t], len(some)) == size[k]
        if full.any():
            dot = np.where(full, np.round(np.bincount(row, x * w[k][t], len(some)) / norm[k], 9), -1.0)
            up = dot > best
            top[up], best[up] = k, dot[up]
    near = np.flatnonzero((top >= 0) & gives[top] & (best >= (threshold - 1e-6) * np.sqrt(inside)))
    if not len(near):
        return empty
    out = np.flatnonzero((term < 0) & np.isin(passage, some[near]))
    u, v = np.unique(h[out], return_inverse=True)
    key, n = np.unique(passage[out] * max(1, len(u)) + v, return_counts=True)
    return some[near], top[near], best[near], inside[near], (key // max(1, len(u)), u[key % max(1, len(u))], n)


def document_frequency(files: DataFrame, text_col: str, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """Files that hold each template term, and the number of files."""
    def scan(batches):
        df = np.zeros(len(vocab) + 1, np.int64)
        for b in batches:
            for i, j, buf, off in slices(b.column(0)):
                h, _, d = terms(buf, off)
                t = _lookup(vocab, h)
                hit = t >= 0
                df[:-1] += np.bincount(np.unique(d[hit] * len(vocab) + t[hit]) % len(vocab), minlength=len(vocab))
                df[-1] += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df), dtype=np.int32)), pa.array(df)], ["t", "n"])

    rows = files.select(text_col).mapInArrow(scan, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocab) + 1, np.int64)                       # one row per template term
    for r in rows:
        df[r["t"]] = r["n"]
    return df[:-1], int(df[-1])


def passages(buf, off, h, s, d, term, named, need):
    """Passages of a slice as ``(terms, passage of each, text of each passage, whole)``:
    lines, windows and paragraphs that may match, then the whole texts of licence files."""
    if not len(s):
        return
    at = np.cumsum(buf == 10)[s] + d                     # lines never span texts
    u, line = np.unique(at, return_inverse=True)
    owner = np.zeros(len(u), np.int64)
    owner[line] = d
    new = np.ones(len(u), bool)
    new[1:] = (np.diff(u) > 1) | (np.diff(owner) > 0)
    para = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(u)) - 1
    kept = np.flatnonzero(holding(term, para[line], len(first), need)[para[line]])
    if len(kept):
        at = line[kept]
        yield kept, at, owner, False
        for size in WINDOWS:
            start = np.concatenate([at - o for o in range(size)])
            of = np.tile(para[at], size)
            ok = (start >= first[of]) & (start + size - 1 <= last[of])
            yield np.tile(kept, size)[ok], start[ok], owner, False
        long = (last > first)[para[at]]
        yield kept[long], para[at][long], owner[first], False
    if named.any():
        of = np.flatnonzero(named[d])
        yield of, d[of], np.arange(len(off) - 1), True


def term_frequency(files: DataFrame, text_col: str, needed: DataFrame) -> DataFrame:
    """``(term, df)``: files that hold each term hash of ``needed``. A filter of fixed
    size keeps most other terms out of the shuffle."""
    slot = F.shiftrightunsigned("term", 64 - SLOTS).cast("int")
    slots = needed.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)   # at most 2^SLOTS
    mask = np.zeros(1 << SLOTS, bool)
    mask[slots] = True
    bc = files.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def scan(batches):
        wanted = np.unpackbits(bc.value).astype(bool)
        for b in batches:
            for _, _, buf, off in slices(b.column(0)):
                h, _, d = terms(buf, off)
                ok = wanted[(h >> U(64 - SLOTS)).astype(np.int64)]
                h, d = h[ok], d[ok]
                o = np.lexsort((d, h))
                h, d = h[o], d[o]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                u, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return files.select(text_col).mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("df")) \
        .join(needed, "term", "left_semi")


NEAR = "array<struct<own: string, dot: double, inside: double, whole: boolean, terms: array<bigint>, counts: array<bigint>>>"


def own_licences(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=None,
                 threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, own, score)`` and the columns ``keep`` per row of ``files``."""
    templates = sorted(templates or TEMPLATES)
    vocab, counts, need = vocabulary(templates)
    df, n = document_frequency(files, text_col, vocab)
    idf = np.log((n + 1) / (df + 1))
    names = [t[0] for t in templates]
    gives = np.array([bool(x) for x in names])
    whole = F.coalesce(F.col(path_col).rlike(LICENCE_NAME), F.lit(False))

    def scan(batches):
        row = (TaskContext.get().partitionId() << 40)
        for b in batches:
            near = [[] for _ in range(b.num_rows)]
            named = b.column(2).to_numpy(zero_copy_only=False)
            for i, j, buf, off in slices(b.column(1)):
                h, s, d = terms(buf, off)
                term = _lookup(vocab, h)
                for at, passage, owner, full in passages(buf, off, h, s, d, term, named[i:j], need):
                    who, top, dot, inside, (p, t, c) = near_passages(h[at], term[at], passage, len(owner), counts, need,
                                                                     idf, gives, threshold)
                    t = t.view(np.int64)
                    lo, hi = np.searchsorted(p, who), np.searchsorted(p, who, "right")
                    for k, x in enumerate(who.tolist()):
                        near[i + int(owner[x])].append({
                            "own": names[top[k]], "dot": float(dot[k]), "inside": float(inside[k]), "whole": full,
                            "terms": t[lo[k]:hi[k]].tolist(), "counts": c[lo[k]:hi[k]].tolist()})
            ids = np.arange(row, row + b.num_rows, dtype=np.int64)
            row += b.num_rows
            kind = pa.list_(pa.struct([("own", pa.string()), ("dot", pa.float64()), ("inside", pa.float64()),
                                       ("whole", pa.bool_()), ("terms", pa.list_(pa.int64())),
                                       ("counts", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), pa.array(near, kind), b.column(3)],
                                             ["row", "path", "near", "kept"])

    # row numbers are written once, so both readers see the same ones
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    source = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), whole.alias("named"), kept.alias("kept"))
    rows = stored(source.mapInArrow(scan, f"row long, path string, near {NEAR}, kept {source.schema['kept'].dataType.simpleString()}"),
                  "licence-passages")
    each = rows.where(F.size("near") > 0).select("row", F.posexplode("near").alias("k", "p")).select("row", "k", "p.*")
    tf = each.select("row", "k", F.explode(F.arrays_zip("terms", "counts")).alias("t")) \
        .select("row", "k", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
    df = stored(term_frequency(files, text_col, tf.select("term").distinct()), "licence-terms")
    x = F.col("tf") * F.log(F.lit(float(n + 1)) / (F.col("df") + 1))
    outside = tf.join(df, "term").groupBy("row", "k").agg(F.sum(x * x).alias("outside"))
    cos = F.round(F.try_divide("dot", F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0)))), 9)
    best = each.join(outside, ["row", "k"], "left").withColumn("score", F.least(F.lit(1.0), cos)) \
        .where(F.col("score") >= threshold).groupBy("row") \
        .agg(F.min_by(F.struct("own", "score"), F.struct(~F.col("whole"), -F.col("score"), "own")).alias("b"))
    return rows.select("row", "path", "kept").join(best, "row", "left").select(
        "path", "b.own", F.coalesce("b.score", F.lit(0.0)).alias("score"),
        *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)])


def _parent(path) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def inherit(found: DataFrame, gives: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``licence`` and ``from_dir`` to ``(path, own, score)``; rows for which
    ``gives`` holds are licence files of their directory."""
    dirs = found.where(gives & F.col("own").isNotNull() & F.col("path").isNotNull()) \
        .groupBy(_parent("path").alias("dir"), "own").count() \
        .groupBy("dir").agg(F.min_by("own", F.struct(-F.col("count"), "own")).alias("licence"))
    # the ancestors of each distinct directory, not of each file
    need = found.where(F.col("own").isNull() & F.col("path").isNotNull()).select(_parent("path").alias("home")).distinct()
    parts = F.split("home", "/")
    up = need.select("home", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")) \
        .withColumn("dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")) \
        .where((F.col("home") != "") | (F.col("depth") == 0))
    near = up.join(dirs, "dir").groupBy("home").agg(F.max_by(F.struct("licence", "dir"), "depth").alias("n")) \
        .select("home", F.col("n.licence").alias("up"), F.col("n.dir").alias("from_dir"))
    # a directory may hold a third of all files: its files are salted, its one row copied
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = found.withColumn("home", F.when(F.col("own").isNull(), _parent("path"))).withColumn("salt", salt) \
        .join(near, ["home", "salt"], "left")
    return out.select("path", "own", "score", F.coalesce("own", "up").alias("licence"), "from_dir", *[f"`{c}`" for c in keep])


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=None,
                 threshold: float = THRESHOLD, gives: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, own, score, licence, from_dir)`` and the columns ``keep`` (of other
    names) per row of ``files``. By default licence files are told by name."""
    clash = {"path", "own", "score", "licence", "from_dir", "home", "salt", "up"} & set(keep)
    if clash:
        raise ValueError(f"keep names columns of the result or its joins: {sorted(clash)}")
    found = stored(own_licences(files, path_col, text_col, templates, threshold, keep), "licences")
    return inherit(found, F.col("path").rlike(LICENCE_NAME) if gives is None else gives, keep)

"""Line dedup over windows of three consecutive lines.

Every window of three lines (split at newline) is hashed to 128 bits and
counted over all documents. Its first occurrence, in order of (doc_id, text
hash, position), stays; the lines of every later occurrence go, overlapping
occurrences merged into runs first. Windows are judged on the input, not on
what is left. All of it is built-in functions: the first occurrence is a
mergeable minimum, so a passage in a third of all documents is pre-aggregated
before the shuffle, and the join back is an ordinary equi-join that the engine
may split on a hot hash.

Defined results: null text is empty; texts of fewer than three lines have no
window and stay as they are; windows of blank lines only (ASCII white space)
are not counted; a document whose lines all go keeps its row with empty text;
rows that agree in doc_id and text are one document and get the same result; a
null doc_id comes after all others; an empty table gives an empty result;
other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import row_keys

KEY = ["_k1", "_k2"]


def _lines(text_col: str):
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def line_windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(_k1, _k2, o, pos, h1, h2)``: one row per window, o orders documents."""
    k1, k2 = row_keys(id_col, text_col)
    base = docs.select(k1.alias("_k1"), k2.alias("_k2"),
                       F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("d")).alias("o"),
                       _lines(text_col).alias("l")).where(F.size("l") >= width)
    win = base.select(*KEY, "o", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("l") - (width - 1)), lambda i: F.slice("l", i, F.lit(width)))).alias("pos", "w"))
    win = win.where(F.array_join("w", "").rlike(r"[^ \t\r\f\x0B]"))
    return win.select(*KEY, "o", "pos", F.xxhash64("w").alias("h1"),
                      F.xxhash64(F.lit("2"), F.reverse("w")).alias("h2"))


def covered_runs(windows: DataFrame, width: int) -> DataFrame:
    """``(_k1, _k2, runs)``: merged [from, to) line runs of later occurrences."""
    at = F.struct("o", *KEY, "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")) \
        .where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(at != F.col("first")).select(*KEY, "pos").distinct()
    w = W.partitionBy(*KEY).orderBy("pos")
    later = later.withColumn("new", (F.col("pos") - F.lag("pos", 1, -width - 1).over(w) > width).cast("int"))
    later = later.withColumn("run", F.sum("new").over(w))
    run = later.groupBy(*KEY, "run").agg(F.min("pos").alias("s"), (F.max("pos") + width).alias("e"))
    return run.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_runs"))


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          width: int = 3, counts: bool = True) -> DataFrame:
    """``docs`` with repeated windows cut from the text; ``counts`` adds
    ``_n_lines`` and ``_n_removed`` in place of columns that have these names."""
    k1, k2 = row_keys(id_col, text_col)
    names = [c for c in docs.columns if not counts or c.lower() not in ("_n_lines", "_n_removed")]
    runs = covered_runs(line_windows(docs, id_col, text_col, width), width)
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), k1.alias("_k1"), k2.alias("_k2")) \
        .join(runs, KEY, "left")
    both = both.withColumn("_l", _lines(f"_row.{text_col}"))
    gap = lambda j: F.slice(  # noqa: E731  lines between run j - 1 and run j
        "_l", F.when(j == 0, 0).otherwise(F.element_at("_runs", j)["e"]) + 1,
        F.when(j == F.size("_runs"), F.size("_l")).otherwise(F.element_at("_runs", j + 1)["s"])
        - F.when(j == 0, 0).otherwise(F.element_at("_runs", j)["e"]))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_runs")), gap)), "\n")
    cut = F.aggregate("_runs", F.lit(0), lambda a, r: a + r["e"] - r["s"])
    text = F.when(F.col("_runs").isNull(), F.coalesce(F.col("_row")[text_col], F.lit(""))).otherwise(kept)
    cols = [(text if c == text_col else F.col("_row")[c]).alias(c) for c in names]
    if counts:
        cols += [F.size("_l").alias("_n_lines"), F.when(F.col("_runs").isNull(), 0).otherwise(cut).alias("_n_removed")]
    return both.select(*cols)

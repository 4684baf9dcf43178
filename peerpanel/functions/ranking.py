"""Exact ranks inside large partitions without sorting a partition in one
task: ranks of rows by range partitioning (``avg_ranks``, ``pct_ranks``,
``positions``), and rank tables of values, from which medians and cells are read.

``rank_table`` gives, for every distinct non-NULL key, its ``min_rank``
(1 + number of smaller keys in the partition), ``ties`` (rows with the
same key) and ``n`` (non-NULL rows in the partition):

1. a value-frequency table ``(partition, key) -> count`` collapses ties, so a
   heavy tie value is one row;
2. its rows are dealt by range of (partition, key), so the ranges follow the
   data: a task holds about total / ranges values whatever the size of a partition;
3. inside a range a running sum gives the rows before each value; the offsets of
   ranges are a running sum over the small table of ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse, sized_broadcast


def _offsets(x: DataFrame, part: list[str], rows) -> DataFrame:
    """``(part..., _pid, _before, _total)`` of rows dealt by range: the rows in
    earlier ranges of the partition and in all of them."""
    early = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return x.groupBy(*part, "_pid").agg(rows.alias("_rows")) \
        .withColumn("_before", F.coalesce(F.sum("_rows").over(early), F.lit(0))) \
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy(*part))).drop("_rows")


def rank_table(df: DataFrame, part: Sequence[str], key: str, descending: bool = False,
               prefix: str = "_") -> DataFrame:
    """One row per (partition, distinct non-NULL key): ``key``,
    ``{prefix}min_rank``, ``{prefix}ties``, ``{prefix}n``."""
    part, ties = list(part), f"{prefix}ties"
    freq = df.select(*part, (-F.col(key) if descending else F.col(key)).alias("_k")).where("_k IS NOT NULL") \
        .groupBy(*part, "_k").agg(F.count(F.lit(1)).alias(ties))
    x = reuse(freq.repartitionByRange(*part, "_k").withColumn("_pid", F.spark_partition_id()))
    own = Window.partitionBy(*part, "_pid").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized_broadcast(_offsets(x, part, F.sum(ties)))          # one row per partition and range
    return x.withColumn("_place", F.coalesce(F.sum(ties).over(own), F.lit(0))).join(ranges, [*part, "_pid"]).select(
        *part, (-F.col("_k") if descending else F.col("_k")).alias(key), ties, F.col("_total").alias(f"{prefix}n"),
        (F.col("_before") + F.col("_place") + 1).alias(f"{prefix}min_rank"))


def avg_rank_col(prefix: str = "_") -> Column:
    """Rank with ties averaged, from ``rank_table`` columns."""
    return (F.col(f"{prefix}min_rank") + (F.col(f"{prefix}ties") - 1) / 2.0).cast("double")


def pct_rank_col(prefix: str = "_") -> Column:
    """(min_rank - 1) / (n - 1); NULL for NULL keys and n <= 1."""
    return F.when(F.col(f"{prefix}n") > 1,
                  (F.col(f"{prefix}min_rank") - 1) / (F.col(f"{prefix}n") - 1).cast("double"))


def median_at(n: Column) -> tuple[Column, Column]:
    """The two middle positions of ``n`` ordered values."""
    return F.floor((n + 1) / 2), F.ceil((n + 1) / 2)


def value_at(position: Column, min_rank: Column, ties: Column, key) -> Column:
    """Aggregate over a rank table: the value at a position."""
    v = F.col(key) if isinstance(key, str) else key
    return F.max(F.when((min_rank <= position) & (position < min_rank + ties), v))


def _stacked(df: DataFrame, ids: Sequence[str], part: Sequence[str], specs) -> DataFrame:
    """``(part..., ids..., out columns)``: all keys ranked in one pass. ``specs``: (key,
    out, descending, rank column from ``_min_rank``, ``_ties`` and ``_n``).

    Rows ``(part, metric, key)`` are dealt by range, so a partition or a tie value is
    spread over many tasks. Inside a range a row's rank is its place; the rows of
    earlier ranges are added. A run of ties can cross the borders of ranges only as
    the first or the last run of a range: those runs, two a range, are summed up and
    carried over. The table of ranges joins on (part, metric, range); no join has a
    value as its key.
    """
    part, ids = list(part), list(ids)
    group = [*part, "_metric"]
    rows = df.select(*part, *ids, F.explode(F.array(*[
        F.struct(F.lit(out).alias("_metric"), ((-F.col(key)) if desc else F.col(key)).cast("double").alias("_key"))
        for key, out, desc, _ in specs])).alias("_x")).select(*part, *ids, "_x._metric", "_x._key").where("_key IS NOT NULL")
    rows = reuse(rows.repartitionByRange(*group, "_key", *ids).withColumn("_pid", F.spark_partition_id()))
    own = Window.partitionBy(*group, "_pid")
    rows = rows.withColumn("_place", F.rank().over(own.orderBy("_key")) - 1) \
        .withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*group, "_pid", "_key")))
    early = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*group, "_pid").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"),
        F.min_by("_same", "_key").alias("_lo_n"), F.max_by("_same", "_key").alias("_hi_n"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(early), F.lit(0))) \
        .withColumn("_n", F.sum("_rows").over(Window.partitionBy(*group)))
    first = F.struct(F.col("_lo").alias("k"), F.col("_lo_n").alias("c"), F.col("_before").alias("s"))
    last = F.struct(F.col("_hi").alias("k"), F.col("_hi_n").alias("c"), (F.col("_before") + F.col("_rows") - F.col("_hi_n")).alias("s"))
    runs = ranges.select(*group, "_pid", "_before", "_n", F.explode(F.when(
        F.col("_lo") == F.col("_hi"), F.array(first)).otherwise(F.array(first, last))).alias("_r"))
    run = Window.partitionBy(*group, "_r.k")
    runs = runs.withColumn("_run", F.struct(F.col("_r.k").alias("k"), F.sum("_r.c").over(run).alias("ties"),
                                            F.min("_r.s").over(run).alias("start")))
    ranges = runs.groupBy(*group, "_pid").agg(F.first("_before").alias("_before"), F.first("_n").alias("_n"),
                                              F.min("_run").alias("_first"), F.max("_run").alias("_last"))
    x = rows.join(sized_broadcast(ranges), [*group, "_pid"])          # one row per range
    edge = lambda f, other: F.when(F.col("_key") == F.col("_first.k"), F.col(f"_first.{f}")) \
        .when(F.col("_key") == F.col("_last.k"), F.col(f"_last.{f}")).otherwise(other)
    x = x.select(*part, *ids, "_metric", "_n", edge("ties", F.col("_same")).alias("_ties"),
                 (edge("start", F.col("_before") + F.col("_place")) + 1).alias("_min_rank"))
    return x.groupBy(*part, *ids).agg(*[
        F.max(F.when(F.col("_metric") == out, rank)).alias(out) for _, out, _, rank in specs])


def positions(df: DataFrame, part: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` plus the position 1..N in its partition by ``order`` (a total
    order). Rows are dealt by range of (partition, order) over many tasks; a
    position is the rows in earlier ranges plus the place in the range, so
    neither a large partition nor a tie value meets in one task."""
    part, order = list(part), list(order)
    x = reuse(df.repartitionByRange(*part, *order).withColumn("_pid", F.spark_partition_id()))
    before = _offsets(x, part, F.count(F.lit(1))).drop("_total")
    place = F.row_number().over(Window.partitionBy(*part, "_pid").orderBy(*order))
    return x.join(before, [*part, "_pid"]).withColumn(out, F.col("_before") + place).drop("_pid", "_before")


def avg_ranks(df: DataFrame, ids: Sequence[str], part: Sequence[str], specs) -> DataFrame:
    """``df`` plus one averaged-ties rank column per ``(key, out,
    descending)`` in ``specs`` (NULL for NULL keys); ``ids`` tells the rows of
    a partition apart."""
    ranks = _stacked(df, ids, part, [(k, o, d, avg_rank_col()) for k, o, d in specs])
    return df.join(ranks, [*part, *ids], "left")


def pct_ranks(df: DataFrame, part: Sequence[str], specs, ids: Sequence[str] = ("ts_id",)) -> DataFrame:
    """``df`` plus one percent-rank column per ``(key, out)``: (min_rank -
    1) / (n - 1) over non-NULL keys; NULL for NULL keys and n <= 1."""
    ranks = _stacked(df, ids, part, [(k, o, False, pct_rank_col()) for k, o in specs])
    return df.join(ranks, [*part, *ids], "left")

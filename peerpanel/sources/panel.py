"""Panel source: any DataFrame with a date, a series id and a count,
plus the panels derived from the driver tables used by tests and bench.

Canonical schema: ``group_id string, ts_id string, date date, count double``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PanelError



def panel(df: DataFrame, date: str = "date", ts_id: str = "ts_id",
          count: str = "count", group_id: str | None = None,
          group_value: str = "all") -> DataFrame:
    """Validate and cast a long table into the canonical panel.

    ``group_id`` names a column holding the group; without it every row
    is put in one group named ``group_value``.
    """
    want = {date: "date", ts_id: "ts_id", count: "count"}
    missing = [c for c in want if c not in df.columns]
    if group_id is not None and group_id not in df.columns:
        missing.append(group_id)
    if missing:
        raise PanelError(f"Missing columns in panel data: {missing}")
    g = F.col(group_id).cast("string") if group_id else F.lit(group_value)
    return df.select(
        g.alias("group_id"),
        F.col(ts_id).cast("string").alias("ts_id"),
        F.col(date).cast("date").alias("date"),
        F.col(count).cast("double").alias("count"),
    )


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_panel(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    """Panel A: shipped quantity per supplier and ship date."""
    li = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    if not by_nation:
        return panel(li, "l_shipdate", "l_suppkey", "l_quantity")
    sup = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    dim = sup.join(nat, sup.s_nationkey == nat.n_nationkey).select("s_suppkey", "n_name")
    li = li.join(dim, li.l_suppkey == dim.s_suppkey)
    return panel(li, "l_shipdate", "l_suppkey", "l_quantity", group_id="n_name")


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel B: events per user and timestamp (one per row)."""
    ev = _read(spark, sf_dir, "events").select("user_id", "ts").withColumn("one", F.lit(1.0))
    return panel(ev, "ts", "user_id", "one")


def customer_panel(spark: SparkSession, sf_dir: str, by_segment: bool = False) -> DataFrame:
    """Panel C/D: orders per customer and order date (one per row)."""
    o = (_read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
         .withColumn("one", F.lit(1.0)))
    if not by_segment:
        return panel(o, "o_orderdate", "o_custkey", "one")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = o.join(c, o.o_custkey == c.c_custkey)
    return panel(o, "o_orderdate", "o_custkey", "one", group_id="c_mktsegment")

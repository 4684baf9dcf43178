"""Helpers shared by the text operators: tables in the shared folder, row
keys and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}     # temporary folder by local application


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is
    unset, a local session gets a temporary folder, which leaves the session's settings
    alone; on a cluster that is an error, as executors would not share the folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    sc = spark.sparkContext
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="llm-")
    return _LOCAL[sc.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_keys(*cols: str) -> tuple[Column, Column]:
    """128-bit key of a row's ``cols``, never null. Rows that agree in all of
    them share it and get the same result."""
    c = [F.coalesce(F.col(x).cast("string"), F.lit("\0null")) for x in cols]
    return F.xxhash64(*c), F.xxhash64(F.lit("2"), *reversed(c))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` -> ``(node, component)`` with the
    smallest node of each component; nodes without an edge are absent.

    Alternating large-star and small-star rounds: every round links each node
    to the smallest of its neighbours, so long chains fold in a logarithmic
    number of rounds. The edge table is written once per round.
    """
    e = stored(edges.select("a", "b").where("a <> b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(x: DataFrame):
        r = x.agg(F.count("*").alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())

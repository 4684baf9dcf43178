"""Session helpers: building a session for tests/bench, reuse of
intermediate results, and size-checked broadcasting."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables with at most this many rows and bytes may be broadcast after their
# size has been measured. Beyond either the join stays a shuffle join and AQE
# (skew join, runtime broadcast) takes over.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20


def build_session(master: str | None = None, app: str = "peerpanel",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark.

    On a cluster, users bring their own session; nothing in the library
    depends on these settings except that AQE is expected to be on.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions",
                str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        spark.sparkContext.setCheckpointDir(d)
    return d


def reuse(df: DataFrame) -> DataFrame:
    """Materialise a result that several later jobs read.

    With a shared checkpoint folder configured the lineage is cut with a
    reliable checkpoint (survives executor loss without recomputing the
    upstream plan). Without one we only persist to memory+disk, which is
    still recomputable from lineage if an executor is lost.
    """
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for compute-heavy grouped Python stages: their input is
    small, so AQE would coalesce it into a few tasks; a fixed hash
    repartition keeps every core busy."""
    sp = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(spark.sparkContext.defaultParallelism * 4, sp)


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it is proven small: its rows are counted and their
    bytes measured as JSON text plus 16 a column, in one pass.

    Used for group-level tables (one row per group or per group x bucket)
    whose size does not grow with the number of series or rows. Above the
    bound the plain DataFrame is returned so the join is planned as a
    shuffle join with AQE skew handling.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    width = F.length(F.to_json(F.struct("*"))) + 16 * len(df.columns)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df

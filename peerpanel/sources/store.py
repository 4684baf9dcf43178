"""Versioned tables under one output root: the caches of the prepared panel and the
model tables (parquet) and the sinks of the result tables (CSV).

Layout (shared storage on a cluster):

    <root>/panel/rows/version=<v>/group_id=<g>/part-*.parquet
    <root>/models/{effects,series,coefs}/version=<v>/group_id=<g>/part-*.parquet
    <root>/output/<table>/version=<v>/group_id=<g>/part-*.csv
    <root>/{panel,models,output}/commits/part-*.parquet

A write goes to a new version folder that nothing refers to yet. Only when all its
tables are complete, one small commit file names, for every group of the run, the
version, the hash of its arguments (its start date among them) and the tables with
their schemas. Versions are never changed afterwards, so a write that breaks off at
any point leaves the earlier state in force, and a group whose new table is empty
has no rows any more.

A cache is used where every group of the run has a commit with the same arguments;
the newest such commit counts. A result table of a group is that of its newest
commit that holds the table. Runs of different groups share a root.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import PanelError

# sink sort orders (the reference writes each table sorted this way)
SINK_ORDER = {
    "rows": ["active", "ts_id", "date"],
    "prepared_panel": ["active", "ts_id", "date"],
    "model_summary": ["p_Cumulative", "ts_id"],
    "model_summary_timeseries": ["date", "point_perf"],
    "model_ts_peers": ["target_ts_id", "-inclusion_prob", "-positive_prob", "ts_id", "date"],
    "model_ts_rank": ["count_mean_pctile_rank + count_mean_rank + count_smooth_rank "
                      "+ count_smooth_pctile_rank", "ts_id", "date"],
}

COMMIT = "group_id string, args string, version string, at long, tables map<string,string>"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def group_args(groups: DataFrame, args: dict) -> DataFrame:
    """``(group_id, args)``: hash of the arguments with each group's own start date."""
    doc = json.dumps(args, sort_keys=True, default=str)
    return groups.select("group_id", F.sha2(F.concat(
        F.lit(doc + " start "), F.coalesce(F.col("start_date").cast("string"), F.lit("-"))), 256).alias("args"))


def save(root: str, tables: dict[str, DataFrame], args: DataFrame, fmt: str = "parquet") -> str:
    """Write ``tables`` as a new version for the groups of ``args`` and commit it.
    Sorting is a range partitioned global sort, so one large group is split over
    many tasks and its files keep the order."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        if name in SINK_ORDER:
            df = df.orderBy("group_id", *[F.expr(o).asc_nulls_last() for o in SINK_ORDER[name]])
        w = df.write.mode("overwrite").partitionBy("group_id")
        (w.option("header", True) if fmt == "csv" else w).format(fmt).save(f"{root}/{name}/version={version}")
    schemas = [x for name, df in tables.items() for x in (F.lit(name), F.lit(df.schema.json()))]
    (args.select("group_id", "args", F.lit(version).alias("version"), F.lit(time.time_ns()).alias("at"),
                 F.create_map(*schemas).alias("tables"))
     .coalesce(1).write.mode("append").parquet(f"{root}/commits"))          # one file: all or nothing
    return version


def _commits(spark: SparkSession, root: str) -> DataFrame:
    if not _exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(f"{root}/commits")


def _newest(commits: DataFrame) -> DataFrame:
    return commits.groupBy("group_id").agg(F.max_by(F.struct("version", "tables"), F.struct("at", "version")).alias("c")) \
        .select("group_id", "c.version", "c.tables")


def find(spark: SparkSession, root: str, args: DataFrame) -> DataFrame | None:
    """``(group_id, version, tables)`` of the newest commits with these arguments, or
    None unless every group of ``args`` has one."""
    found = _newest(_commits(spark, root).join(args, ["group_id", "args"], "left_semi"))
    missing = args.join(found, "group_id", "left_anti").limit(1).count()
    return None if missing else found


def load(spark: SparkSession, root: str, name: str, found: DataFrame, fmt: str = "parquet") -> DataFrame | None:
    """Table ``name`` of the versions in ``found``, read with its stored schema so that
    ids are never re-typed by partition inference."""
    table = F.try_element_at("tables", F.lit(name))
    found = found.where(table.isNotNull())
    used = found.select("version", table.alias("schema")).distinct().collect()     # one row per run still in force
    if not used:
        return None
    schema = StructType.fromJson(json.loads(used[-1]["schema"]))
    if any(StructType.fromJson(json.loads(r["schema"])).simpleString() != schema.simpleString() for r in used):
        raise PanelError(f"{name}: the stored versions have different columns")
    full = StructType([StructField(f.name, f.dataType) for f in schema.fields] + [StructField("version", StringType())])
    r = spark.read.schema(full).option("basePath", f"{root}/{name}")
    r = r.option("header", True) if fmt == "csv" else r
    df = r.format(fmt).load([f"{root}/{name}/version={r['version']}" for r in used])
    return df.join(found.select("group_id", "version"), ["group_id", "version"], "left_semi").select(*schema.names)


def cached(spark: SparkSession, root: str | None, args: DataFrame, build, use_cache: bool, keep: bool) -> dict[str, DataFrame]:
    """Tables of ``build()``: read from ``root`` if every group was stored with the same
    arguments, else built (and stored when ``keep``, which also cuts their lineage)."""
    found = find(spark, root, args) if root is not None and use_cache else None
    if found is None:
        tables = build()
        if root is None or not keep:
            return tables
        version = save(root, tables, args)
        found = _commits(spark, root).where(F.col("version") == version).select("group_id", "version", "tables")
    names = found.select(F.map_keys("tables").alias("k")).first()
    return {name: load(spark, root, name, found) for name in (names["k"] if names else [])}


def write_outputs(outputs: dict, out_dir: str, groups: DataFrame) -> None:
    """Write the result tables of the run's ``groups`` as CSV and commit them together."""
    tables = {name: df for name, df in outputs.items() if df is not None}
    save(f"{out_dir}/output", tables, groups.select("group_id", F.lit("").alias("args")), "csv")


def read_output(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The result table ``name`` of all groups under ``out_dir``."""
    commits = _commits(spark, f"{out_dir}/output")
    commits = commits.where(F.map_contains_key("tables", F.lit(name)))
    df = load(spark, f"{out_dir}/output", name, _newest(commits), "csv")
    if df is None:
        raise PanelError(f"no table {name} under {out_dir}")
    return df

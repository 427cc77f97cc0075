"""File sources and sinks (S6-S10) and the scratch-folder helper."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.session import checkpoint_dir

FEATURES_SCHEMA = "count int, unique_events int, label int"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/nightjar-out/{name}-{uuid.uuid4().hex[:12]}"


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """Session-feature CSV with a header and a declared schema."""
    return spark.read.schema(FEATURES_SCHEMA).option("header", True).csv(path)


def write_features_csv(df: DataFrame, path: str) -> None:
    df.select(F.col("session_count").cast("int").alias("count"),
              F.col("session_unique").cast("int").alias("unique_events"),
              F.col("label").cast("int").alias("label")).write.mode("overwrite").option("header", True).csv(path)


def read_scenario(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """Attack scenario file (YAML list of steps with ``action`` and
    ``mitre_technique``) -> (chain, step_no, action, technique). Lines are read
    with the text source; a step begins at each ``- action:`` item; a step
    without an action is ``UnknownAction``."""
    lines = spark.read.text(path).withColumn("_f", F.input_file_name()).withColumn(
        "_n", F.monotonically_increasing_id())
    name = F.regexp_extract("value", r"^name:\s*(\S.*?)\s*$", 1)
    is_step = F.col("value").rlike(r"^\s*-\s+(action|description|mitre_technique)\s*:")
    action = F.regexp_extract("value", r"^\s*-?\s*action:\s*(\S.*?)\s*$", 1)
    tech = F.regexp_extract("value", r"^\s*-?\s*mitre_technique:\s*(\S.*?)\s*$", 1)
    from pyspark.sql import Window
    w = Window.partitionBy("_f").orderBy("_n")
    x = lines.select("_f", "_n", name.alias("name"), is_step.alias("start"), action.alias("action"),
                     tech.alias("technique"))
    x = x.withColumn("step_no", F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = x.filter(F.col("name") != "").groupBy("_f").agg(F.first("name").alias("chain"))
    steps = (x.filter(F.col("step_no") > 0).groupBy("_f", "step_no")
             .agg(F.max(F.when(F.col("action") != "", F.col("action"))).alias("action"),
                  F.max(F.when(F.col("technique") != "", F.col("technique"))).alias("technique")))
    out = steps.join(names, "_f", "left").select(
        F.coalesce(F.lit(chain), F.col("chain")).alias("chain"), F.col("step_no").cast("int"),
        F.coalesce("action", F.lit("UnknownAction")).alias("action"), "technique")
    return out


def read_nodelink(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node-link graph JSON -> (vertices(id, type), edges(src, dst, type, ts))."""
    g = spark.read.option("multiLine", True).json(path)
    node_t = g.schema["nodes"].dataType.elementType
    link_t = g.schema["links"].dataType.elementType
    nodes = g.select(F.explode("nodes").alias("n"))
    v = nodes.select(F.col("n.id").cast("string").alias("id"),
                     (F.col("n.type") if "type" in node_t.fieldNames() else F.lit(None)).cast("string").alias("type"))
    links = g.select(F.explode("links").alias("l"))
    e = links.select(F.col("l.source").cast("string").alias("src"), F.col("l.target").cast("string").alias("dst"),
                     (F.col("l.type") if "type" in link_t.fieldNames() else F.lit(None)).cast("string").alias("type"),
                     (F.col("l.ts") if "ts" in link_t.fieldNames() else F.lit(None)).cast("string").alias("ts"))
    return v, e


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """S8 sink: the graph store as two parquet tables (scales; no single document)."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def append_snapshots(snaps: DataFrame, path: str) -> None:
    """Append config snapshots (source, snapshot_ts, content) as JSON lines,
    partitioned by source."""
    snaps.write.mode("append").partitionBy("source").json(path)


def latest_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """S9 read side: the latest snapshot per source (partial aggregate)."""
    s = spark.read.schema("snapshot_ts timestamp_ntz, content string, source string").json(path)
    return s.groupBy("source").agg(F.max(F.struct("snapshot_ts", "content")).alias("m")).select(
        "source", "m.snapshot_ts", "m.content")


def write_table(df: DataFrame, path: str, partition_by: str | None = None, day_col: str | None = None,
                run_id: str | None = None) -> None:
    """Events / alerts table sink (parquet, optionally partitioned by day).
    With ``run_id`` the rows go to that run's own partitions, which a repeated
    run replaces; without it rows are appended."""
    if day_col:
        df = df.withColumn("day", F.to_date(day_col))
        partition_by = "day"
    parts = [partition_by] if partition_by else []
    if run_id is None:
        w = df.write.mode("append")
    else:
        df, parts = df.withColumn("run_id", F.lit(run_id)), ["run_id", *parts]
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*parts) if parts else w).parquet(path)

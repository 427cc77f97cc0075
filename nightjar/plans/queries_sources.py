"""Source / sink round-trip queries (S1-S3, S6, S8-S10) over data derived from
the driver tables and written to a fresh folder under the checkpoint dir."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import graph as G
from nightjar.operators import mapping as M
from nightjar.operators import sessions
from nightjar.plans import detect as D
from nightjar.plans.catalog import register
from nightjar.plans.fixtures import cloudtrail_json, order_snapshots, sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, with_
from nightjar.sources import files as FS
from nightjar.sources import json_flex as JF
from nightjar.sources.tables import table


@register("read_events_flex", None)
def q_read_flex(spark, sf):
    """CloudTrail documents in one folder of mixed shapes (NDJSON, batches
    of {"Records": [...]} and arrays that span lines), read back with the
    shape-detecting reader and mapped (P1)."""
    docs = cloudtrail_json(sec_events(spark, sf))
    base = FS.scratch_path(spark, "ct")
    kind = F.pmod(F.hash("value"), F.lit(3))
    docs.filter(kind == 0).select("value").write.mode("append").text(f"{base}/in")
    JF.write_records_docs(docs.filter(kind == 1), "value", f"{base}/in", mode="append")
    # One array per file, an element per line, of a bounded number of elements.
    arrays = 1 + docs.count() // (3 * JF.RECORDS_PER_DOCUMENT)
    pretty = docs.filter(kind == 2).groupBy(F.pmod(F.xxhash64("value"), F.lit(arrays)).alias("c")).agg(
        F.concat(F.lit("[\n"), F.concat_ws(",\n", F.collect_list("value")), F.lit("\n]")).alias("value"))
    pretty.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(f"{base}/in")
    return M.map_cloudtrail(JF.read_events_flex(spark, f"{base}/in"))


def _register_flex_oracle():
    from nightjar.plans import catalog
    from nightjar.plans import queries_mapping  # noqa: F401  (defines map_cloudtrail oracle)
    catalog.ORACLE["read_events_flex"] = catalog.ORACLE["map_cloudtrail"]


_register_flex_oracle()


@register("features_csv", with_(DETECT) + """
SELECT CAST(session_count AS INTEGER) AS count, CAST(session_unique AS INTEGER) AS unique_events,
       CAST(detected AS INTEGER) AS label FROM det""")
def q_features_csv(spark, sf):
    """Session features written as CSV and scanned back with a declared schema."""
    d = D.detect(sec_events(spark, sf), ti_table(spark)).select(
        "session_count", "session_unique", F.col("detected").cast("int").alias("label"))
    path = FS.scratch_path(spark, "features")
    FS.write_features_csv(d, path)
    return FS.read_features_csv(spark, path)


@register("graph_store", None)
def q_graph_store(spark, sf):
    """Graph store round trip (vertices/edges parquet)."""
    e = G.build_edges(sec_events(spark, sf))
    v = G.build_vertices(e)
    path = FS.scratch_path(spark, "graph")
    FS.write_graph(v, e, path)
    return FS.read_graph(spark, path)[1]


def _register_graph_oracle():
    from nightjar.plans import catalog
    from nightjar.plans import queries_graph  # noqa: F401
    catalog.ORACLE["graph_store"] = catalog.ORACLE["graph_edges"]


_register_graph_oracle()


@register("snapshot_store", """
WITH o AS (
  SELECT n_name AS source, date_trunc('month', o_orderdate) AS snapshot_ts
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
),
snap AS (SELECT source, snapshot_ts, count(*) AS cnt FROM o GROUP BY 1, 2)
SELECT source, max(snapshot_ts) AS snapshot_ts, CAST(arg_max(cnt, snapshot_ts) AS VARCHAR) AS orders FROM snap
GROUP BY 1""")
def q_snapshot_store(spark, sf):
    """Snapshots appended as JSON partitioned by source; latest per source."""
    s = order_snapshots(table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation"))
    path = FS.scratch_path(spark, "snapshots")
    FS.append_snapshots(s, path)
    latest = FS.latest_snapshots(spark, path)
    return latest.select("source", "snapshot_ts", F.get_json_object("content", "$.orders").alias("orders"))


@register("alerts_sink", with_(DETECT) + """
SELECT CAST(ts AS DATE) AS day, count(*) AS n_alerts FROM det WHERE detected GROUP BY 1""")
def q_alerts_sink(spark, sf):
    """Alerts appended to a day-partitioned parquet table and read back."""
    a = D.alerts(D.detect(sec_events(spark, sf), ti_table(spark)))
    path = FS.scratch_path(spark, "alerts")
    for _ in range(2):      # a repeated run replaces its own rows
        FS.write_table(a, path, day_col="ts", run_id="first")
    back = spark.read.parquet(path)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n_alerts"))


@register("scenario_steps", """
SELECT n_name AS chain, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS INTEGER) AS step_no,
       CASE WHEN s_suppkey % 7 = 0 THEN 'UnknownAction' ELSE 'Act' || s_suppkey END AS action,
       CASE WHEN s_suppkey % 3 = 0 THEN 'T' || (1000 + s_suppkey) END AS technique
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def q_scenario_steps(spark, sf):
    """Scenario files (one per nation, a step per supplier) written and read back."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    action = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("  - description: step "), k)).otherwise(
        F.concat(F.lit("  - action: Act"), k))
    technique = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("\n    mitre_technique: T"), (F.col("s_suppkey") + 1000)
                                                             .cast("string"))).otherwise(F.lit(""))
    files = (s.join(F.broadcast(n), "n_nationkey").groupBy("n_name")
             .agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(action, technique).alias("line")))).alias("x"))
             .select(F.concat(F.lit("name: "), "n_name", F.lit("\nchain:\n"),
                              F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("value")))
    path = FS.scratch_path(spark, "scenarios")
    files.write.option("maxRecordsPerFile", 1).text(path)
    return FS.read_scenario(spark, path)


@register("graph_nodelink", """
SELECT 'c' || c_custkey AS src, n_name AS dst, 'lives_in' AS type FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def q_graph_nodelink(spark, sf):
    """Node-link documents (of a nation and a bounded number of its customers)
    written and read back as edges."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
                                            F.col("c_nationkey").alias("n_nationkey"))
    chunk = F.pmod(F.xxhash64("id"), F.lit(1 + c.count() // (25 * JF.RECORDS_PER_DOCUMENT))).alias("c")
    docs = (c.join(F.broadcast(n), "n_nationkey").groupBy("n_name", chunk).agg(F.collect_list("id").alias("ids"))
            .select(F.to_json(F.struct(
                F.concat(F.array(F.struct(F.col("n_name").alias("id"), F.lit("nation").alias("type"))),
                         F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit("customer").alias("type")))).alias("nodes"),
                F.transform("ids", lambda i: F.struct(i.alias("source"), F.col("n_name").alias("target"),
                                                      F.lit("lives_in").alias("type"))).alias("links"))).alias("value")))
    path = FS.scratch_path(spark, "nodelink")
    docs.write.option("maxRecordsPerFile", 1).text(path)
    return FS.read_nodelink(spark, path)[1].select("src", "dst", "type")

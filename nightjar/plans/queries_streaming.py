"""Streaming queries (X1-X7, S4, S5, A1): each runs an availableNow stream over
files in arrival order, derived from the driver tables, and returns its sink as
a batch frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.plans import catalog
from nightjar.plans import detect as D
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import order_snapshots, sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, RULE_CASE, SEC_EVENTS, with_
from nightjar.sources import message_log as ML
from nightjar.sources.tables import table
from nightjar.streaming import models as MS
from nightjar.streaming import pipeline as P

WATERMARK = "2 days"
GAP = "6 hours"
#: Rows that arrive after the watermark has passed them: windows must not count them.
_ON_TIME = """
ontime AS (SELECT * FROM {src} WHERE NOT (event_id % 50 = 0 AND ts < (SELECT max(ts) FROM sec) - INTERVAL 5 DAY))"""


def _source(spark, sf, name, **arrivals):
    ev = sec_events(spark, sf)
    base = P.stream_dir(spark, name)
    files = P.write_arrivals(ev, f"{base}/in", **arrivals)
    return P.read_stream(spark, f"{base}/in", ev.schema, files), base


_STATELESS = with_(SEC_EVENTS) + f""",
sl AS (
  SELECT sec.*, NULL AS prev_login_region, coalesce(ti.ip_reputation, 0.0::DOUBLE) AS ti_score,
         CASE WHEN event_type IN ('IAMPolicyChange','EC2StartInstances') THEN 'high'
              WHEN event_type = 'AuthFailure' THEN 'medium' ELSE 'low' END AS severity_hint
  FROM sec LEFT JOIN (SELECT '9.10.11.12' AS ip, 0.9::DOUBLE AS ip_reputation) ti ON sec.source_ip = ti.ip
),
sr AS (SELECT *, {RULE_CASE} AS rule_score FROM sl),
sd AS (SELECT *, greatest(0.4::DOUBLE * rule_score + 0.15::DOUBLE * ti_score, rule_score, ti_score) AS final_score
       FROM sr)"""


@register("stream_normalize", _STATELESS + """
SELECT event_id, severity_hint, round(ti_score, 6) AS ti_score, round(rule_score, 6) AS rule_score,
       round(final_score, 6) AS final_score, final_score > 0.7 AS detected FROM sd""")
def q_stream_normalize(spark, sf):
    """Normalize -> TI -> rules -> fuse as one streaming query (files in
    arrival order, late rows included); the sink equals the batch result."""
    src, base = _source(spark, sf, "x1", late=True)
    out = P.stateless_detect(src, ti_table(spark)).select(
        "event_id", "severity_hint", "ti_score", "rule_score", "final_score", "detected")
    P.run_available_now(out, f"{base}/out")
    return rounded(spark.read.parquet(f"{base}/out/data"))


@register("stream_detect", with_(DETECT) + """
SELECT event_id, entity_id, session_count, session_unique, prev_login_region, round(ti_score, 6) AS ti_score,
       round(rule_score, 6) AS rule_score, round(fused_score, 6) AS fused_score,
       round(final_score, 6) AS final_score, detected FROM det""")
def q_stream_detect(spark, sf):
    """X2 + R17: every event scored against live per-entity session state
    (on RocksDB, for groups of entities); equals the batch chain."""
    src, base = _source(spark, sf, "detect")
    out = P.stateful_detect(src, ti_table(spark)).select(
        "event_id", "entity_id", "session_count", "session_unique", "prev_login_region", "ti_score", "rule_score",
        "fused_score", "final_score", "detected")
    P.run_available_now(out, f"{base}/out", rocksdb=True)
    return rounded(spark.read.parquet(f"{base}/out/data"))


def stream_records(spark, sf):
    """Models fitted on the stored events and saved as a version, then the events
    as a stream, scored batch by batch: all detection records."""
    src, base = _source(spark, sf, "models")
    MS.save_models(MS.fit_models(sec_events(spark, sf)), f"{base}/models", 1)
    rows = P.session_events(src, last_n=MS.LAST_N)
    P.run_available_now(rows, f"{base}/out", rocksdb=True, foreach_batch=MS.model_writer(
        f"{base}/models", f"{base}/state", f"{base}/records", ti_table(spark)))
    return spark.read.parquet(f"{base}/records").drop("batch_id")


@register("stream_detect_models", None)
def q_stream_detect_models(spark, sf):
    """X1 + R17 with every component: session and last types from keyed state,
    sequence, online and graph scores (the forest's, and what follows from it,
    isn't SQL and is tested apart)."""
    return rounded(stream_records(spark, sf).select(
        "event_id", "session_count", "session_unique", "prev_login_region", "ti_score", "rule_score", "seq_score",
        "online_score", "corr_score"))


@register("stream_session", with_(SEC_EVENTS) + """
SELECT entity_id, count(*) AS session_count, count(DISTINCT event_type) AS session_unique,
       max(ts) AS last_ts FROM sec GROUP BY 1""")
def q_stream_session(spark, sf):
    """Per-entity session totals from keyed state, late rows included."""
    src, base = _source(spark, sf, "x2", late=True)
    st = P.session_events(src.select("event_id", "entity_id", "event_type", "region", "ts"))
    path = f"{base}/out/data"
    P.run_available_now(st, f"{base}/out", foreach_batch=P.idempotent_batch_writer(path), rocksdb=True)
    return spark.read.parquet(path).groupBy("entity_id").agg(
        F.max("session_count").alias("session_count"), F.max("session_unique").alias("session_unique"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"))


@register("stream_session_window", with_(SEC_EVENTS, _ON_TIME.format(src="sec")) + """,
g1 AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) IS NULL
                   OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id))
                      >= 21600000000 THEN 1 ELSE 0 END AS brk FROM ontime),
g2 AS (SELECT *, sum(brk) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS sno FROM g1)
SELECT entity_id, count(*) AS n_events, min(ts) AS session_start, max(ts) AS session_last FROM g2
GROUP BY entity_id, sno""")
def q_stream_session_window(spark, sf):
    """Gap session windows (6 h), emitted once the watermark (2 days) has
    passed them; rows later than that are dropped."""
    src, base = _source(spark, sf, "x3", late=True, flush=True)
    agg = (src.withWatermark("ts", WATERMARK)
           .groupBy("entity_id", F.session_window("ts", GAP).alias("s"))
           .agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("session_start"),
                F.max("ts").alias("session_last")))
    P.run_available_now(agg, f"{base}/out")
    back = spark.read.parquet(f"{base}/out/data")
    return back.select("entity_id", "n_events", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                       F.col("session_last").cast("timestamp_ntz").alias("session_last"))


def _alert_rate(spark, sf, name: str, *window: str):
    src, base = _source(spark, sf, name, late=True, flush=True)
    a = P.stateless_detect(src.withWatermark("ts", WATERMARK), ti_table(spark)).filter("detected")
    agg = a.groupBy(F.window("ts", *window).alias("w")).agg(F.count(F.lit(1)).alias("n_alerts"))
    P.run_available_now(agg, f"{base}/out")
    back = spark.read.parquet(f"{base}/out/data")
    return back.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_alerts")


_RATE = _STATELESS + "," + _ON_TIME.format(src="sd")


@register("stream_alert_rate", _RATE + """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_alerts FROM ontime WHERE final_score > 0.7 GROUP BY 1""")
def q_stream_alert_rate(spark, sf):
    """Tumbling 1-hour alert counts, emitted behind the watermark."""
    return _alert_rate(spark, sf, "x4", "1 hour")


@register("stream_alert_rate_sliding", _RATE + """,
b AS (SELECT date_trunc('hour', ts) + (minute(ts) // 15) * INTERVAL 15 MINUTE AS q FROM ontime WHERE final_score > 0.7)
SELECT q - k * INTERVAL 15 MINUTE AS window_start, count(*) AS n_alerts
FROM b CROSS JOIN (SELECT range AS k FROM range(4)) r GROUP BY 1""")
def q_stream_alert_rate_sliding(spark, sf):
    """Sliding 1-hour windows every 15 minutes."""
    return _alert_rate(spark, sf, "x4s", "1 hour", "15 minutes")


@register("stream_dedup", with_(SEC_EVENTS) + "\nSELECT event_id, entity_id, event_type FROM sec")
def q_stream_dedup(spark, sf):
    """Duplicate deliveries removed with dropDuplicatesWithinWatermark."""
    src, base = _source(spark, sf, "x5", duplicates=True)
    d = src.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
    P.run_available_now(d.select("event_id", "entity_id", "event_type"), f"{base}/out")
    return spark.read.parquet(f"{base}/out/data")


@register("stream_alerts", _STATELESS + """
SELECT event_id, round(final_score, 6) AS final_score FROM sd WHERE final_score > 0.7""")
def q_stream_alerts(spark, sf):
    """Alert sink through foreachBatch with a batch-id guard (replays overwrite)."""
    src, base = _source(spark, sf, "x6", late=True)
    a = P.stateless_detect(src, ti_table(spark)).filter("detected").select("event_id", "final_score")
    path = f"{base}/out/data"
    P.run_available_now(a, f"{base}/out", foreach_batch=P.idempotent_batch_writer(path))
    return rounded(spark.read.parquet(path).select("event_id", "final_score"))


@register("stream_upsert", None)
def q_stream_upsert(spark, sf):
    """A1 as a stream: records delivered in three rounds of versions, merged by a
    bucketed upsert sink; equals the batch upsert."""
    from nightjar.plans import queries_reports as QR
    records = QR.deliveries(spark, sf).checkpoint()
    base = P.stream_dir(spark, "upsert")
    files = spark.sparkContext.defaultParallelism
    for g in range(3):
        records.filter(F.pmod(F.xxhash64("id", QR.UPSERT_VERSION), F.lit(3)) == g).repartition(files).write.mode(
            "append").parquet(f"{base}/in")
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    P.run_available_now(stream, f"{base}/out", foreach_batch=P.upsert_writer(
        f"{base}/table", "id", QR.UPSERT_IDENTITY, QR.UPSERT_VERSION))
    return rounded(P.read_upserted(spark, f"{base}/table", "id"))


@register("stream_messages", with_(SEC_EVENTS) + """
SELECT CAST(event_id AS VARCHAR) AS key, event_id, entity_id, event_type, source_ip, ts,
       CASE WHEN event_type IN ('IAMPolicyChange','EC2StartInstances') THEN 'high'
            WHEN event_type = 'AuthFailure' THEN 'medium' ELSE 'low' END AS severity_hint FROM sec""")
def q_stream_messages(spark, sf):
    """S4 -> P5 -> S5: JSON messages are read, normalised and sent on as JSON
    (files stand in for the bus; the format is a parameter)."""
    ev = sec_events(spark, sf).select("event_id", "entity_id", "event_type", "source_ip", "ts")
    base = P.stream_dir(spark, "bus")
    P.to_messages(ev, "event_id").select("value").write.text(f"{base}/in")
    raw = P.message_stream(spark, {"path": f"{base}/in"}, fmt="text")
    good, _ = P.parse_messages(raw, ev.schema)
    out = P.to_messages(D.normalize(good), "event_id")
    P.write_messages(out, f"{base}/out", {"path": f"{base}/out/data"}, fmt="parquet")
    schema = "event_id long, entity_id string, event_type string, source_ip string, ts timestamp_ntz, severity_hint string"
    back = spark.read.parquet(f"{base}/out/data").select("key", F.from_json("value", schema, P.JSON_TIMES).alias("r"))
    return back.select("key", "r.*")


@register("stream_log", with_(SEC_EVENTS) + """
SELECT event_id, entity_id, event_type, source_ip, ts,
       CASE WHEN event_type IN ('IAMPolicyChange','EC2StartInstances') THEN 'high'
            WHEN event_type = 'AuthFailure' THEN 'medium' ELSE 'low' END AS severity_hint FROM sec""")
def q_stream_log(spark, sf):
    """S5 -> S4 -> X5: events go to a partitioned message log as JSON, some twice;
    a stream reads the log, removes the duplicates and normalises."""
    spark.dataSource.register(ML.MessageLog)
    src, base = _source(spark, sf, "log", duplicates=True)
    cols = ["event_id", "entity_id", "event_type", "source_ip", "ts"]
    sent = P.to_messages(src.select(*cols).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "entity_id")
    P.run_available_now(sent, f"{base}/sent", fmt="message_log", options={"path": f"{base}/topic", "writer": "events"})
    raw = P.message_stream(spark, {"path": f"{base}/topic", "startingOffsets": "earliest"}, fmt="message_log")
    good, _ = P.parse_messages(raw, sec_events(spark, sf).select(*cols).schema)
    # The log is read in one batch here: duplicates may lie any time apart.
    once = D.normalize(good.dropDuplicates(["event_id"]))
    P.run_available_now(once, f"{base}/out")
    return spark.read.parquet(f"{base}/out/data")


@register("stream_drift", None)
def q_stream_drift(spark, sf):
    """Snapshot watcher as a file stream; each micro-batch is diffed against
    the latest snapshots kept from earlier batches (D1-D3 in foreachBatch)."""
    snaps = order_snapshots(table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation"))
    base = P.stream_dir(spark, "x7")
    files = spark.sparkContext.defaultParallelism
    staged = snaps.withColumn("y", F.year("snapshot_ts").cast("int")).checkpoint()
    low, high = staged.agg(F.min("y"), F.max("y")).first()
    for y in range(low or 0, (high or -1) + 1, 2):      # files arrive in time order
        staged.filter(F.col("y").between(y, y + 1)).drop("y").repartition(files).write.mode("append").json(f"{base}/in")
    schema = "source string, snapshot_ts timestamp_ntz, content string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(f"{base}/in")
    P.run_available_now(stream, f"{base}/out", foreach_batch=P.drift_watcher(f"{base}/records", f"{base}/latest"))
    return spark.read.parquet(f"{base}/records").drop("batch_id")


def _register_shared_oracles():
    from nightjar.plans import queries_drift, queries_graph, queries_models, queries_reports, queries_sequences  # noqa: F401
    sql = catalog.ORACLE
    catalog.ORACLE["stream_detect_models"] = f"""
SELECT d.event_id, d.session_count, d.session_unique, d.prev_login_region, d.ti_score, d.rule_score, s.seq_score,
       o.hst_score AS online_score, c.corr_score
FROM ({sql["stream_detect"]}) d JOIN ({sql["seq_surprise"]}) s USING (event_id)
JOIN ({sql["hst_running_score"]}) o USING (event_id) JOIN ({sql["correlation"]}) c ON c.entity_id = d.entity_id"""
    catalog.ORACLE["stream_drift"] = catalog.ORACLE["drift_records"]
    catalog.ORACLE["stream_upsert"] = catalog.ORACLE["event_upsert"]


_register_shared_oracles()

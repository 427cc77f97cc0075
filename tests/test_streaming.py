"""Streams that stop and start again, replayed batches, messages that do not parse."""

import datetime as dt

from pyspark.sql import functions as F

from nightjar.operators import drift as DR
from nightjar.operators.reports import event_upsert
from nightjar.plans.detect import detect
from nightjar.plans.fixtures import sec_events, ti_table
from nightjar.streaming import pipeline as P

T0 = dt.datetime(2024, 1, 1)


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_stateful_detection_goes_on_after_a_restart(spark, sf):
    """Half of the events, stop, the other half: the state of the first run is used."""
    ev = sec_events(spark, sf).filter("event_id % 4 = 0")
    base = P.stream_dir(spark, "restart")
    middle = ev.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    cols = ("event_id", "session_count", "session_unique", "prev_login_region", "detected")
    for late_half in (False, True):
        part = ev.filter((F.col("ts") > F.lit(middle)) if late_half else (F.col("ts") <= F.lit(middle)))
        part.repartition(2).write.mode("append").parquet(f"{base}/in")
        stream = P.read_stream(spark, f"{base}/in", ev.schema, 2)
        P.run_available_now(P.stateful_detect(stream, ti_table(spark)).select(*cols), f"{base}/out", rocksdb=True,
                            state_partitions=2)
    assert as_set(spark.read.parquet(f"{base}/out/data"), *cols) == as_set(detect(ev, ti_table(spark)), *cols)


def test_drift_watcher_restarts_and_replays(spark):
    rows = [(s, T0 + dt.timedelta(days=d), f'{{"n": {d // 2}, "s": "{s}"}}') for s in ("a", "b") for d in range(6)]
    snaps = spark.createDataFrame(rows, "source string, snapshot_ts timestamp_ntz, content string")
    base = P.stream_dir(spark, "watch")
    parts = [snaps.filter(F.day("snapshot_ts").between(d, d + 1)) for d in (1, 3, 5)]
    for i, part in enumerate(parts):
        # A new writer each time, as after a restart; every batch comes twice, as after a failure.
        P.drift_watcher(f"{base}/records", f"{base}/state")(part, i)
        P.drift_watcher(f"{base}/records", f"{base}/state")(part, i)
    cols = ("drift_id", "source", "prev_ts", "snapshot_ts", "changed", "n_changes")
    got = spark.read.parquet(f"{base}/records")
    want = DR.drift_records(snaps, DR.config_diff(snaps))
    assert got.count() == want.count() == 10
    assert as_set(got, *cols) == as_set(want, *cols)


def test_upsert_sink_replays_and_ties(spark):
    rows = [(i % 7, f"s{i % 3}", i % 5, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, source string, ver long, score double")
    base = P.stream_dir(spark, "ups")
    for i in range(3):
        part = df.filter(F.pmod(F.col("score").cast("long"), F.lit(3)) == i)
        for _ in range(2):
            P.upsert_writer(base, "id", ["source"], "ver", buckets=4)(part, i)
    cols = ("id", "source", "ver", "score")
    assert as_set(P.read_upserted(spark, base, "id"), *cols) == as_set(event_upsert(df, "id", ["source"], "ver"), *cols)


def test_messages_keep_what_does_not_parse(spark):
    schema = spark.createDataFrame([], "id long, name string, ts timestamp_ntz").schema
    sent = spark.createDataFrame([(1, "x", T0.replace(microsecond=7)), (2, None, None)], schema)
    raw = P.to_messages(sent, "id").select("value").unionByName(
        spark.createDataFrame([("not json",), ('{"id": "text"}',), ("",), (None,)], "value string"))
    good, bad = P.parse_messages(raw, schema)
    assert as_set(good, "id", "name", "ts") == {(1, "x", T0.replace(microsecond=7)), (2, None, None)}
    assert {r["value"] for r in bad.collect()} == {"not json", '{"id": "text"}', "", None}


def test_events_without_time_are_delivered(spark, sf):
    ev = sec_events(spark, sf).limit(50).withColumn("ts", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    base = P.stream_dir(spark, "nulls")
    P.write_arrivals(ev, f"{base}/in", late=True)
    assert spark.read.parquet(f"{base}/in").count() == ev.count()

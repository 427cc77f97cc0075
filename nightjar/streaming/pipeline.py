"""Structured Streaming forms of the pipeline (X1-X7), Kafka messages
and the streaming upsert (A1).

Sources and sinks take the format as a parameter (``kafka`` in production; the
connector is not on this classpath, so the queries read and write files), run
with ``trigger(availableNow=True)`` so they end, and write below the shared
checkpoint folder; the query helpers return the sink as a batch DataFrame so it
can be compared with the batch operators. Event time is cast NTZ -> TIMESTAMP
under a UTC session zone, because watermarks need TIMESTAMP.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from nightjar.functions import rules as R
from nightjar.operators.enrich import ti_enrich
from nightjar.session import ensure_utc
from nightjar.sources.files import scratch_path

N_TIME_SLICES = 4
LATE_BY = dt.timedelta(days=5)      # late rows are at least this much older than the last event
FLUSH_AFTER = dt.timedelta(days=30)
FLUSH_ID = -1
#: Microseconds survive the way through JSON.
JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- sources and sinks ---------------------------------------------------------------

def write_arrivals(events: DataFrame, path: str, duplicates: bool = False, late: bool = False,
                   flush: bool = False) -> int:
    """Write events as files in arrival order: four time ranges, the last day,
    then what comes late (every 50th event older than ``LATE_BY`` before the
    end) and a repeat of every 20th event, and a far later event that lets all
    windows close. Rows without a time arrive first. Returns the number of files
    per arrival. (Spark drops late rows by the watermark of the batch before, so
    the last day sets it before the late rows come.)"""
    spark = events.sparkSession
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    n = N_TIME_SLICES
    if low is None:
        slice_of = F.lit(0)
    else:
        share = F.timestamp_diff("SECOND", F.lit(low), F.col("ts")) * n / (int((high - low).total_seconds()) + 1)
        slice_of = F.when(F.col("ts") >= F.lit(high - dt.timedelta(days=1)), F.lit(n)).otherwise(
            F.coalesce(F.floor(share), F.lit(0)))
    cut = F.lit(None if high is None else high - LATE_BY)
    is_late = F.coalesce((F.col("event_id") % 50 == 0) & (F.col("ts") < cut), F.lit(False)) if late else F.lit(False)
    staged = f"{path}-staged"
    events.withColumn("_g", F.when(is_late, F.lit(n + 1)).otherwise(slice_of).cast("int")).write.partitionBy("_g").parquet(staged)
    back = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("_g", T.IntegerType())])).parquet(staged)
    files = spark.sparkContext.defaultParallelism
    for g in range(n + 2):
        part = back.filter(F.col("_g") == g).drop("_g")
        if g == n + 1 and duplicates:
            part = part.unionByName(events.filter(F.col("event_id") % 20 == 0))
        if g <= n or duplicates or late:
            part.repartition(files).write.mode("append").parquet(path)
    if flush and high is not None:
        row = {"event_id": F.lit(FLUSH_ID), "ts": F.lit(high + FLUSH_AFTER), "entity_id": F.lit("flush")}
        one = spark.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
        one.write.mode("append").parquet(path)
    return files


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1, fmt: str = "parquet") -> DataFrame:
    ensure_utc(spark)
    s = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def message_stream(spark: SparkSession, options: dict[str, str], fmt: str = "kafka") -> DataFrame:
    """Raw messages (``value`` string). ``options`` are the source's own, for
    Kafka ``kafka.bootstrap.servers``, ``subscribe``, ``startingOffsets`` and
    ``maxOffsetsPerTrigger``; for text files ``path``."""
    raw = spark.readStream.format(fmt).options(**options).load()
    return raw.withColumn("value", F.col("value").cast("string"))


def parse_messages(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON message values -> (rows of ``schema``, bad messages). A message
    is bad if it is no JSON object; nothing is dropped."""
    opts = JSON_TIMES | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = raw.withColumn("r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), opts))
    good = F.col("r._bad").isNull() & F.col("r").isNotNull()
    return (parsed.filter(good).select(*[F.col(f"r.`{n}`").alias(n) for n in schema.names]),
            parsed.filter(~F.coalesce(good, F.lit(False))).select("value"))


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """Rows -> (key, value) messages; nulls are left out of the JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns), JSON_TIMES).alias("value"))


def write_messages(messages: DataFrame, sink: str, options: dict[str, str] | None = None, fmt: str = "kafka") -> None:
    """Send messages; for Kafka ``options`` has the servers and the topic."""
    run_available_now(messages, sink, fmt=fmt, options=options)


def run_available_now(df: DataFrame, sink: str, output_mode: str = "append",
                      fmt: str = "parquet", foreach_batch: Callable | None = None,
                      state_partitions: int | None = None, options: dict[str, str] | None = None,
                      rocksdb: bool = False) -> None:
    """Run a stream to completion (availableNow) into ``sink``; its checkpoint is
    in ``sink`` too, so running it again goes on where it stopped.

    The number of state-store partitions is fixed when a stream's checkpoint is
    created; it is set from the cluster's default parallelism (not the batch
    shuffle setting) for this query only and the session value is restored.
    """
    spark = df.sparkSession
    conf = {"spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism)}
    if rocksdb:
        conf["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        w = df.writeStream.option("checkpointLocation", f"{sink}/_checkpoint").outputMode(output_mode)
        if foreach_batch is not None:
            w = w.foreachBatch(foreach_batch)
        else:
            w = w.format(fmt).options(**({"path": f"{sink}/data"} if options is None else options))
        q = w.trigger(availableNow=True).start()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ---- X1: stages ----------------------------------------------------------------------

def fuse(df: DataFrame) -> DataFrame:
    """Fusion, final score and decision on a frame with rule and TI scores."""
    for c in ("ueba_score", "seq_score", "online_score", "corr_score"):
        df = df.withColumn(c, F.lit(0.0))
    df = df.withColumn("fused_score", R.weighted_fusion())
    df = df.withColumn("final_score", R.final_score("fused_score", "rule_score", "ueba_score", "seq_score",
                                                    "ti_score", "online_score", "corr_score"))
    return df.withColumn("detected", F.col("final_score") > F.lit(R.DEFAULT_THRESHOLD))


def stateless_detect(ev: DataFrame, ti: DataFrame) -> DataFrame:
    """X1 stages: normalize -> TI (stream-static join) -> rules -> fused/label.
    Session-dependent inputs are absent (travel off), as in a stateless stage."""
    df = ev.withColumn("severity_hint", R.severity_hint("event_type"))
    df = ti_enrich(df, ti, "source_ip")
    df = df.withColumn("prev_login_region", F.lit(None).cast("string"))
    return fuse(df.withColumn("rule_score", R.rule_score(travel=False)))


# ---- X2: per-entity session state, event by event -------------------------------------

_SESSION_FIELDS = [T.StructField("session_count", T.LongType()), T.StructField("session_unique", T.LongType()),
                   T.StructField("prev_login_region", T.StringType())]


#: Entities share this many groups of state, by hash. Fixed for the life of a stream's checkpoint.
STATE_GROUPS = 1_024


def _session_step(key: str, columns: list[str], ttl_ms: int | None, last_n: int | None = None):
    """State of the entities of one group: by entity the running count, the event
    types seen, the last login's region, with ``last_n`` the last types (of that
    length at most) and with a TTL the time of the last write."""

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: rest for k, *rest in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if ttl_ms else 0
        if ttl_ms:
            held = {k: v for k, v in held.items() if now - v[4] < ttl_ms}
        if not state.hasTimedOut:
            # Arrow batches of one group in one micro-batch, in event-time order.
            pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
            seen: dict = {}
            counts, uniques, previous, lasts = [], [], [], []
            for k, etype, where in zip(pdf[key].tolist(), pdf["event_type"].tolist(), pdf["region"].tolist()):
                k = None if k != k else k
                etype = "UnknownEvent" if etype is None or etype != etype else etype
                own = held.get(k)
                if own is None:
                    own = held[k] = [0, [], None, [], now]
                known = seen.get(k)
                if known is None:
                    known = seen[k] = set(own[1])
                    own[4] = now
                if etype not in known:
                    known.add(etype)
                    own[1].append(etype)
                own[0] += 1
                if last_n:
                    own[3] = [*own[3][1 - last_n:], etype] if last_n > 1 else [etype]
                    lasts.append(own[3])
                login = "consolelogin" in etype.lower()
                counts.append(own[0])
                uniques.append(len(own[1]))
                previous.append(own[2] if login else None)
                if login:
                    own[2] = where if where == where else None
            out = pdf[columns].copy()
            out["session_count"], out["session_unique"] = counts, uniques
            out["prev_login_region"] = pd.Series(previous, index=out.index, dtype=object)
            if last_n:
                out["last_events"] = pd.Series(lasts, index=out.index, dtype=object)
            yield out
        if not held:
            state.remove()
            return
        state.update((json.dumps([(k, *v) for k, v in held.items()]),))
        if ttl_ms:
            state.setTimeoutDuration(max(1, ttl_ms - (now - min(v[4] for v in held.values()))))

    return step


def session_events(ev: DataFrame, key: str = "entity_id", ttl_ms: int | None = None, last_n: int | None = None,
                   groups: int = STATE_GROUPS) -> DataFrame:
    """Every event with its entity's live counters (W1, W3, W5), from keyed
    state, and with ``last_n`` its last types up to this one (W4, ``last_events``).
    ``ttl_ms`` lets the state of idle entities expire.

    A call into Python costs as much as thousands of rows, so state is kept for
    ``groups`` groups of entities, not for each. ``key`` is text or an integer."""
    columns = ev.columns
    last = [T.StructField("last_events", T.ArrayType(T.StringType()))] if last_n else []
    schema = T.StructType([*ev.schema.fields, *_SESSION_FIELDS, *last])
    return ev.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("_group").applyInPandasWithState(
        _session_step(key, columns, ttl_ms, last_n), outputStructType=schema, stateStructType="entities string",
        outputMode="append", timeoutConf="ProcessingTimeTimeout" if ttl_ms else "NoTimeout")


def stateful_detect(ev: DataFrame, ti: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The per-event detection chain on a stream: live session state, then
    normalize -> TI -> rules (impossible travel included) -> fused/label."""
    df = session_events(ev, ttl_ms=ttl_ms).withColumn("severity_hint", R.severity_hint("event_type"))
    df = ti_enrich(df, ti, "source_ip")
    return fuse(df.withColumn("rule_score", R.rule_score(travel=True)))


# ---- X6: idempotent foreachBatch sinks -------------------------------------------------

def idempotent_batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch overwrites its own ``batch_id`` partition, so a replayed
    batch (after a failure) replaces rather than duplicates its output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


def previous_version(spark: SparkSession, path: str, batch_id: int | None = None) -> int | None:
    """The newest complete version (before ``batch_id``). Reading by number, not
    "the latest", makes a replayed batch see what it saw the first time."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    found = sorted((int(n[2:]) for n in names if n.startswith("v=")), reverse=True)
    done = (v for v in found if (batch_id is None or v < batch_id)
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/_SUCCESS")))
    return next(done, None)


def upsert_writer(path: str, key: str, identity_cols, version_col: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A1 as a foreachBatch sink: a batch is appended under its own number, a row
    per key with its first and last version, in ``buckets`` files by key. A
    replay writes the same folder again. What is current is decided on reading
    (``read_upserted``): identity columns from the first write, the others from
    the latest."""
    write = idempotent_batch_writer(path)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in (key, *identity_cols)]
        order = F.struct(F.col(version_col).alias("v"), F.xxhash64(*batch.columns).alias("h"))
        rows = batch.select(key, F.struct(order.alias("o"), F.struct(*identity_cols).alias("x")).alias("first"),
                            F.struct(order.alias("o"), F.struct(*rest).alias("x")).alias("last"))
        write(rows.groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last")).repartition(buckets, key), batch_id)

    return on_batch


def read_upserted(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The current rows of a table written by ``upsert_writer``: one partial
    aggregate over all batches."""
    rows = spark.read.parquet(path).groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return rows.select(key, "first.x.*", "last.x.*")


# ---- X7: snapshot watcher ---------------------------------------------------------------

def drift_watcher(records_path: str, state_path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch of snapshots is diffed in time order, its first ones
    against the latest snapshot per source of the batches before (D1-D3).
    State and output are written under the batch's number, so a restart goes on
    from them and a replayed batch repeats exactly."""
    from nightjar.operators import drift as DR

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cur = batch
        before = previous_version(spark, state_path, batch_id)
        if before is not None:
            cur = spark.read.parquet(f"{state_path}/v={before}").unionByName(batch)
        recs = DR.drift_records(cur, DR.config_diff(cur)).join(
            batch.select("source", "snapshot_ts"), ["source", "snapshot_ts"], "left_semi")
        idempotent_batch_writer(records_path)(recs, batch_id)
        latest = cur.groupBy("source").agg(F.max(F.struct("snapshot_ts", "content")).alias("m")).select(
            "source", "m.snapshot_ts", "m.content")
        latest.write.mode("overwrite").parquet(f"{state_path}/v={batch_id}")

    return on_batch


def stream_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}")

"""Per-entity session and window features.

Skew: a single entity may hold a third of all events. Plain
``Window.partitionBy(entity)`` would then put that third into one task, so the
running features are computed *bucketed*: rows are split by (entity, time
bucket), running values are computed inside each bucket, and the contribution
of earlier buckets is added from a small per-(entity, bucket) summary (one row
per bucket, so even a hot entity's summary is only #buckets rows). This is the
classic two-level prefix scan, written with joins, aggregates and windows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.functions.columns import epoch_us, time_bucket
from nightjar.session import checkpoint_dir

MAX_BROADCAST_KEYS = 500_000    # busy keys up to which their few bytes each are sent to all tasks
NO_TIME = -(1 << 40)            # bucket of rows without a time, before all others
MAX_BUCKET_ROWS = 1_000_000     # rows of a key and bucket beyond which the key's buckets are cut finer
MAX_KEY_ROWS = 100_000          # rows of a key up to which its last types are listed in one task
DEFAULT_BUCKET_SECONDS = 3600
_B = "_bucket"


def busy_parts(ev: DataFrame, key: str, ts: str, bucket_seconds: int, max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows in one bucket, and how many parts
    (``_parts``) each of their buckets is cut into. At most (rows / max_rows) keys."""
    return (ev.groupBy(key, time_bucket(ts, bucket_seconds).alias(_B)).count().where(F.col("count") > max_rows)
            .groupBy(key).agg(F.expr(f"cast((max(count) + {max_rows - 1}) div {max_rows} as long)").alias("_parts")))


def busy_keys(ev: DataFrame, key: str, ts: str, bucket_seconds: int, max_rows: int) -> dict:
    """``busy_parts`` as a dictionary."""
    return {r[key]: r["_parts"] for r in busy_parts(ev, key, ts, bucket_seconds, max_rows).collect()}


def bucketed(ev: DataFrame, key: str, ts: str, bucket_seconds: int, busy: DataFrame | None) -> DataFrame:
    """``ev`` with its bucket number: time ranges of ``bucket_seconds``, cut
    finer for the keys in ``busy`` so that a busy key's bucket stays a small task.
    Rows without a time are the first bucket."""
    base = F.coalesce(time_bucket(ts, bucket_seconds), F.lit(NO_TIME))
    if busy is None:
        return ev.withColumn(_B, base)
    width = F.lit(bucket_seconds * 1_000_000)
    own = F.coalesce("_parts", F.lit(1))
    inside = epoch_us(F.col(ts)) - base * width
    part = F.when(F.col(ts).isNull(), F.lit(NO_TIME)).otherwise(base * own + F.floor(inside * own / width).cast("bigint"))
    return ev.join(busy, key, "left").withColumn(_B, part).drop("_parts")


def _with_bucket(ev: DataFrame, key: str, ts: str, bucket_seconds: int) -> DataFrame:
    # One hash exchange on (key, bucket); every later window/aggregate in this
    # module partitions by a superset of it and so reuses the exchange.
    return ev.withColumn(_B, time_bucket(ts, bucket_seconds)).repartition(key, _B)


def session_running(ev: DataFrame, key: str = "entity_id", ts: str = "ts", tie: str = "event_id",
                    type_col: str = "event_type", login_type: str = "consolelogin",
                    region_col: str | None = "region",
                    bucket_seconds: int = DEFAULT_BUCKET_SECONDS, max_bucket_rows: int | None = MAX_BUCKET_ROWS) -> DataFrame:
    """W1 + W3 + W5: running session counters with no expiry.

    Adds ``session_count`` (events so far, inclusive), ``session_unique``
    (distinct ``type_col`` so far) and, when ``region_col`` is given,
    ``prev_login_region`` (region of the entity's previous login event; a
    login with a null region resets it, like the reference's session field).
    Order is ``(ts, tie)``; ``tie`` identifies a row.

    Plan: two scans and one full-size shuffle (rows by (entity, bucket)). The
    other scan feeds one partial aggregate per (entity, bucket, type); first
    occurrences, counts and last logins per bucket and the carry from earlier
    buckets all follow from it. With ``max_bucket_rows`` the buckets of busier
    entities are cut finer, by counts taken from the data first.
    """
    busy = None
    if max_bucket_rows:
        checkpoint_dir(ev.sparkSession)
        busy = busy_parts(ev, key, ts, bucket_seconds, max_bucket_rows)
        if busy.isEmpty():
            busy = None
        else:
            busy = busy.checkpoint()
            busy = F.broadcast(busy) if busy.count() <= MAX_BROADCAST_KEYS else busy
    etype = F.coalesce(F.col(type_col), F.lit("UnknownEvent"))
    is_login = F.lower(F.col(type_col)).contains(login_type)
    ev0 = bucketed(ev, key, ts, bucket_seconds, busy).withColumn("_etype", etype)

    # Per (entity, bucket, type): events, first row, last login.
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(F.struct(ts, tie)).alias("_f")]
    if region_col:
        aggs.append(F.max(F.when(is_login, F.struct(ts, tie, F.col(region_col).alias("r")))).alias("_last_login"))
    small = ev0.groupBy(key, _B, "_etype").agg(*aggs)
    # The type's first bucket; its first row there is the entity's first of the type.
    new = F.row_number().over(Window.partitionBy(key, "_etype").orderBy(_B)) == 1
    small = small.withColumn("_new", new)
    sums = [F.sum("_n").alias("_n"), F.collect_list(F.when(F.col("_new"), F.col(f"_f.{tie}"))).alias("_firsts")]
    if region_col:
        sums.append(F.max("_last_login").alias("_last_login"))
    summary = small.groupBy(key, _B).agg(*sums)
    w_prev = Window.partitionBy(key).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_on"),
            F.coalesce(F.sum(F.size("_firsts")).over(w_prev), F.lit(0)).alias("_ou"), "_firsts"]
    if region_col:
        offs.append(F.last("_last_login", ignorenulls=True).over(w_prev).alias("_carry"))
    summary = summary.select(key, _B, *offs)

    # Row level: the one big shuffle, then the join and the windows inside (entity, bucket).
    out = ev0.repartition(key, _B).join(summary, [key, _B], "left")
    first = F.coalesce(F.array_contains("_firsts", F.col(tie)), F.lit(False)).cast("int")
    w_run = Window.partitionBy(key, _B).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (out.withColumn("session_count", (F.count(F.lit(1)).over(w_run) + F.col("_on")).cast("bigint"))
           .withColumn("session_unique", (F.sum(first).over(w_run) + F.col("_ou")).cast("bigint")))
    if region_col:
        # The previous login of the bucket: the last login row before this one.
        login = F.when(is_login, F.struct(F.col(region_col).alias("r")))
        before = w_run.rowsBetween(Window.unboundedPreceding, -1)
        prev = F.coalesce(F.last(login, ignorenulls=True).over(before), F.struct(F.col("_carry.r").alias("r")))
        # _carry null (no earlier login) -> struct(null) -> null region: same result.
        out = out.withColumn("prev_login_region", F.when(is_login, prev.getField("r"))).drop("_carry")
    return out.drop(_B, "_etype", "_firsts", "_on", "_ou")


def last_n_events(ev: DataFrame, n: int = 40, key: str = "entity_id", ts: str = "ts",
                  tie: str = "event_id", type_col: str = "event_type",
                  bucket_seconds: int = DEFAULT_BUCKET_SECONDS, max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """The entity's last ``n`` event types up to and including this row.

    An entity of at most ``max_key_rows`` rows is one bucket. Busier ones are
    bucketed by time like in ``session_running``; the carry from earlier buckets
    is the tail of at most ``n-1`` types per bucket (bounded state per entity).
    Rows of no entity are bucketed, too, and nothing is carried between their
    buckets. A bucket of few rows would cost a carried list for each of them.
    """
    m = n - 1
    checkpoint_dir(ev.sparkSession)
    busy = ev.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max_key_rows).select(key).checkpoint()
    n_busy = busy.count()
    evb = ev.withColumn("_etype", F.coalesce(F.col(type_col), F.lit("UnknownEvent")))
    cut = F.col(key).isNull()
    if n_busy:
        busy = busy.withColumn("_busy", F.lit(True))
        evb = evb.join(F.broadcast(busy) if n_busy <= MAX_BROADCAST_KEYS else busy, key, "left")
        cut = cut | F.col("_busy").isNotNull()
    evb = evb.withColumn(_B, F.when(cut, time_bucket(ts, bucket_seconds)).otherwise(0)).drop("_busy").repartition(key, _B)
    newest = Window.partitionBy(key, _B).orderBy(F.col(ts).desc(), F.col(tie).desc())
    tails = (evb.withColumn("_rdesc", F.row_number().over(newest)).filter(F.col("_rdesc") <= m)
             .groupBy(key, _B)
             .agg(F.sort_array(F.collect_list(F.struct(ts, tie, "_etype"))).alias("_t"))
             .select(key, _B, F.transform("_t", lambda s: s["_etype"]).alias("_tail")))
    w_prev = Window.partitionBy(key).orderBy(_B).rowsBetween(-m, -1)
    carry = tails.select(key, _B, F.flatten(F.collect_list("_tail").over(w_prev)).alias("_carry"))
    carry = carry.withColumn("_carry", F.slice("_carry", F.greatest(F.size("_carry") - F.lit(m - 1), F.lit(1)), F.lit(m)))
    w_local = Window.partitionBy(key, _B).orderBy(ts, tie)
    evb = evb.withColumn("_local", F.collect_list("_etype").over(w_local.rowsBetween(-m, 0)))
    # The carry's lists shrink to little in a shuffle: by its size there it would be broadcast.
    out = evb.join(carry.hint("merge"), [key, _B], "left")
    full = F.concat(F.coalesce(F.col("_carry"), F.array().cast("array<string>")), F.col("_local"))
    out = out.withColumn("last_events", F.slice(full, F.greatest(F.size(full) - F.lit(m), F.lit(1)),
                                                 F.lit(n)))
    return out.drop(_B, "_etype", "_local", "_carry")


def gap_sessions(ev: DataFrame, gap_seconds: int = 900, key: str = "entity_id", ts: str = "ts",
                 type_col: str = "event_type", tie: str = "event_id",
                 bucket_seconds: int = 86400) -> DataFrame:
    """Sessions closed after ``gap_seconds`` without events (one row per session).

    Not ``session_window`` (its batch plan sorts all of an entity's rows in one
    task): a row starts a session when the previous row of the entity is at
    least ``gap_seconds`` earlier. The previous row comes from a lag inside the
    (entity, bucket) partition, or for a bucket's first row from the last
    timestamp of the previous non-empty bucket (a one-row-per-bucket summary).
    Each row's session start is the last break at or before it, carried across
    buckets the same way; sessions are then a partial aggregate.
    """
    ev0 = ev.select(key, ts, tie, type_col).withColumn(_B, time_bucket(ts, bucket_seconds))
    w_b = Window.partitionBy(key).orderBy(_B)
    last_ts = (ev0.groupBy(key, _B).agg(F.max(ts).alias("_last"))
               .select(key, _B, F.lag("_last").over(w_b).alias("_prev_last")))
    evb = ev0.repartition(key, _B).join(last_ts, [key, _B], "left")
    w = Window.partitionBy(key, _B).orderBy(ts, tie)
    prev = F.coalesce(F.lag(ts).over(w), F.col("_prev_last"))
    gap_us = F.timestamp_diff("MICROSECOND", prev, F.col(ts))
    evb = evb.withColumn("_brk", prev.isNull() | (gap_us >= F.lit(gap_seconds * 1_000_000)))
    evb = evb.withColumn("_start_local", F.last(F.when(F.col("_brk"), F.col(ts)), ignorenulls=True)
                         .over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    brk_sum = (evb.groupBy(key, _B).agg(F.max(F.when(F.col("_brk"), F.col(ts))).alias("_lb"))
               .select(key, _B, F.last("_lb", ignorenulls=True).over(
                   w_b.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_start")))
    rows = evb.join(brk_sum, [key, _B], "left").withColumn(
        "_session", F.coalesce("_start_local", "_carry_start"))
    return (rows.groupBy(key, "_session")
            .agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(type_col).alias("n_types"),
                 F.min(ts).alias("session_start"), F.max(ts).alias("session_last"))
            .drop("_session"))


def latest_per_entity(ev: DataFrame, as_of, ttl_seconds: int = 3600,
                      keys=("entity_type", "entity_id"), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest event per key among events in ``[as_of - ttl, as_of]``.

    ``max(struct(ts, tie, ...))`` is a partial aggregate, so a hot key is
    pre-combined map-side before the shuffle.
    """
    as_of = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, F.Column) else as_of
    others = [c for c in ev.columns if c not in (*keys, ts, tie)]
    live = ev.filter((F.col(ts) <= as_of) & (F.col(ts) >= as_of - F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
    return (live.groupBy(*keys).agg(F.max(F.struct(ts, tie, *others)).alias("_m"))
            .select(*keys, "_m.*"))

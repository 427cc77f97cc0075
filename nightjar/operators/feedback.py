"""Analyst feedback, response and federated-weight operators (F1-F8).

F1/F2 fold feedback into a clamped threshold: each step is ``t -> min(hi,
max(lo, t + d))``. Such steps compose into a step of the same form, so the
fold is an associative scan: time-range partitions are summarised in
parallel (one (D, L, H) triple each), the driver combines one row per
partition into each partition's starting threshold, and a second parallel
pass emits the per-feedback history. Thresholds are kept in integer
hundredths so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.functions.joins import values_table
from nightjar.operators.asof import as_of
from nightjar.session import checkpoint_dir, partitions_for

# ---- fixed values ------------------------------------------------------------------
START_T, LO_T, HI_T, STEP_T = 70, 10, 99, 1         # hundredths
ACTIONS = ("notify", "collect_forensics", "isolate_host")
EPSILON = 0.1
DEFAULT_FUSION = {"rule": 0.4, "ueba": 0.25, "seq": 0.2, "ti": 0.15}
NORM_EPS = 1e-6
# --------------------------------------------------------------------------------------


def _compose(a, b):
    """Step ``a`` then step ``b``; each is (d, lo, hi) meaning clamp(t + d, lo, hi)."""
    d1, l1, h1 = a
    d2, l2, h2 = b
    return d1 + d2, min(max(l1 + d2, l2), h2), min(max(h1 + d2, l2), h2)


def _apply(step, t):
    d, lo, hi = step
    return min(max(t + d, lo), hi)


def _steps(labels: np.ndarray):
    d = np.where(labels == "problem", -STEP_T, STEP_T)
    return d


def _prefixes(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each step, the composed clamp of all steps up to it: an inclusive
    scan in log2(n) vector passes."""
    d = d.astype(np.int64).copy()
    lo, hi = np.full(len(d), LO_T, np.int64), np.full(len(d), HI_T, np.int64)
    span = 1
    while span < len(d):
        lo2 = np.clip(lo[:-span] + d[span:], lo[span:], hi[span:])
        hi2 = np.clip(hi[:-span] + d[span:], lo[span:], hi[span:])
        d[span:] = d[span:] + d[:-span]
        lo[span:], hi[span:] = lo2, hi2
        span *= 2
    return d, lo, hi


def _scan(d: np.ndarray, t0: int) -> np.ndarray:
    """Thresholds after each step of one batch, starting from t0."""
    total, lo, hi = _prefixes(d)
    return np.clip(t0 + total, lo, hi)


def _prepare(fb: DataFrame, ts: str, tie: str, partitions: int | None) -> DataFrame:
    spark = fb.sparkSession
    checkpoint_dir(spark)
    n = partitions or partitions_for(fb, rows=fb.count())
    ordered = fb.select(ts, tie, "label").repartitionByRange(n, ts, tie).sortWithinPartitions(ts, tie)
    # Reliable checkpoint pins the partitioning for both passes and survives
    # executor loss.
    return ordered.withColumn("_pid", F.spark_partition_id()).checkpoint()


def _summaries(fb: DataFrame) -> list:
    """(pid, composed clamp, rows) of each partition in time order: one row per partition."""
    def summarise(it):
        acc, pid, n = None, None, 0
        for pdf in it:
            if len(pdf):
                d, lo, hi = _prefixes(_steps(pdf["label"].to_numpy()))
                own = (int(d[-1]), int(lo[-1]), int(hi[-1]))
                acc = own if acc is None else _compose(acc, own)
                pid, n = int(pdf["_pid"].iloc[0]), n + len(pdf)
        if acc is not None:
            yield pd.DataFrame({"_pid": [pid], "d": [acc[0]], "lo": [acc[1]], "hi": [acc[2]], "n": [n]})

    return sorted(fb.mapInPandas(summarise, "_pid int, d long, lo long, hi long, n long").collect())


def threshold_history(feedback: DataFrame, ts: str = "ts", tie: str = "event_id",
                      partitions: int | None = None) -> DataFrame:
    """(ts, event_id, label, new_threshold) after each feedback, in time order."""
    fb = _prepare(feedback, ts, tie, partitions)
    start, t = {}, START_T
    for r in _summaries(fb):
        start[r["_pid"]] = t
        t = _apply((r["d"], r["lo"], r["hi"]), t)
    bstart = fb.sparkSession.sparkContext.broadcast(start)

    def emit(it):
        t = None
        for pdf in it:
            if len(pdf) == 0:
                continue
            if t is None:
                t = bstart.value[int(pdf["_pid"].iloc[0])]
            hist = _scan(_steps(pdf["label"].to_numpy()), t)
            t = int(hist[-1])
            yield pd.DataFrame({ts: pdf[ts], tie: pdf[tie], "label": pdf["label"],
                                "new_threshold": hist / 100.0})

    schema = f"{ts} timestamp_ntz, {tie} long, label string, new_threshold double"
    return fb.mapInPandas(emit, schema)


def threshold_value(feedback: DataFrame, ts: str = "ts", tie: str = "event_id") -> tuple[float, int]:
    """F1 as numbers: the threshold after all feedback and the feedback count,
    from the partitions' summaries alone."""
    t, n = START_T, 0
    for r in _summaries(_prepare(feedback, ts, tie, None)):
        t, n = _apply((r["d"], r["lo"], r["hi"]), t), n + r["n"]
    return t / 100.0, n


def threshold_final(feedback: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """the threshold after all feedback (one row) and the feedback count."""
    threshold, n = threshold_value(feedback, ts, tie)
    return feedback.sparkSession.range(1).select(F.lit(threshold).alias("threshold"),
                                                 F.lit(n).cast("bigint").alias("n_feedback"))


def action_values(outcomes: DataFrame, action: str = "action", reward: str = "reward") -> DataFrame:
    """incremental-mean action values with N starting at 1: Q = sum(r) / (k + 1).
    Every action appears (unseen -> 0)."""
    spark = outcomes.sparkSession
    acts = values_table(spark, [(a, i) for i, a in enumerate(ACTIONS)], "action string, action_order int")
    q = outcomes.groupBy(F.col(action).alias("action")).agg(F.sum(reward).alias("_s"), F.count(F.lit(1)).alias("_k"))
    return (acts.join(q, "action", "left")
            .select("action", "action_order", F.coalesce("_k", F.lit(0)).alias("n_updates"),
                    F.coalesce(F.col("_s") / (F.col("_k") + 1), F.lit(0.0)).alias("q_value")))


def greedy_action(values: DataFrame) -> DataFrame:
    """F4 (exploit part): argmax Q, ties to the first action in the fixed order."""
    return values.agg(F.max(F.struct("q_value", -F.col("action_order"), "action")).alias("m")).select(
        F.col("m.action").alias("greedy_action"), F.col("m.q_value").alias("q_value"))


def explore_hash(key, seed: int) -> F.Column:
    """Seeded uniform-ish integer in [0, 2^32) from md5 (same value in any engine)."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10) \
        .cast("bigint")


def choose_actions(events: DataFrame, values: DataFrame, key: str = "event_id", seed: int = 42,
                   epsilon: float = EPSILON) -> DataFrame:
    """epsilon-greedy choice per event; exploration decided by a seeded hash."""
    g = greedy_action(values).select("greedy_action")
    h = explore_hash(key, seed)
    explore = (h % 1000) < int(epsilon * 1000)
    rnd = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), ((F.floor(h / 1000) % len(ACTIONS)) + 1).cast("int"))
    # the greedy action is a one-row aggregate: a scalar subquery, not a join
    greedy = g.scalar()
    return events.select(key, explore.alias("explored"), F.when(explore, rnd).otherwise(greedy).alias("action"))


def response_actions(alerts: DataFrame, playbook: DataFrame, ts: str = "alert_ts") -> DataFrame:
    """F5 (re-aimed SOAR): alerts x playbook (severity, identifier prefix -> action),
    one action per entity, hour and action (first alert kept)."""
    a = alerts.withColumn("_prefix", F.split("identifier_type", ":")[0])
    j = a.join(playbook, (a.severity == playbook.pb_severity) & (a._prefix == playbook.pb_prefix))
    hour = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))
    return (j.groupBy("entity_id", hour.alias("hour_start"), "response")
            .agg(F.min(F.struct(ts, "event_id")).alias("_f"), F.count(F.lit(1)).alias("n_alerts"))
            .select("entity_id", "hour_start", "response", F.col("_f.event_id").alias("first_event_id"),
                    "n_alerts"))


def federated_mean(updates: DataFrame, client: str = "client_id", weights: str = "weights",
                   ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """latest update per client; clients whose latest vector is empty are
    skipped; mean by dimension. Returns (dim, weight) rows."""
    latest = updates.groupBy(client).agg(F.max_by(weights, F.struct(ts, tie)).alias("w"))
    latest = latest.filter(F.size("w") > 0)
    return (latest.select(client, F.posexplode("w").alias("dim", "x"))
            .groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("weight")))


def federated_weights(mean: DataFrame) -> DataFrame:
    """min-max scale (1e-6 guard), first four dims -> rule/ueba/seq/ti,
    defaults for missing dims, normalised to sum 1 (sum 0 keeps zeros)."""
    st = mean.agg(F.min("weight").alias("mn"), F.max("weight").alias("mx"), F.count(F.lit(1)).alias("n"))
    mn, mx = st.select("mn").scalar(), st.select("mx").scalar()
    scaled = mean.withColumn("s", (F.col("weight") - mn) / (mx - mn + F.lit(NORM_EPS)))
    names = ("rule", "ueba", "seq", "ti")
    row = scaled.agg(*[F.max(F.when(F.col("dim") == i, F.col("s"))).alias(f"_{n}") for i, n in enumerate(names)],
                     F.count(F.lit(1)).alias("_n"))
    cols = [F.coalesce(F.col(f"_{n}"), F.lit(DEFAULT_FUSION[n])).alias(n) for n in names]
    row = row.select(*cols, "_n")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    denom = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return row.filter(F.col("_n") > 0).select(*[(F.col(n) / denom).alias(f"w_{n}") for n in names])


def _fusion_weights(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """F7 for many means at once: sums and client counts by dimension -> four weights a row."""
    with np.errstate(invalid="ignore"):
        mean = np.where(n > 0, total / n, np.nan)
    none = (n == 0).all(axis=1)
    mean[none] = 0.0
    low, high = np.nanmin(mean, axis=1, keepdims=True), np.nanmax(mean, axis=1, keepdims=True)
    scaled = (mean - low) / (high - low + NORM_EPS)
    out = np.empty((len(total), 4))
    for i, default in enumerate(DEFAULT_FUSION.values()):
        out[:, i] = np.where(n[:, i] > 0, scaled[:, i], default) if i < total.shape[1] else default
    whole = out.sum(axis=1, keepdims=True)
    out = out / np.where(whole == 0, 1.0, whole)
    out[none] = list(DEFAULT_FUSION.values())
    return out


def weights_history(updates: DataFrame, client: str = "client_id", weights: str = "weights",
                    ts: str = "ts", tie: str = "event_id", partitions: int | None = None) -> DataFrame:
    """F6 and F7 over time: (ts, event_id, w_rule, w_ueba, w_seq, w_ti) after
    each update, in time order.

    An update replaces its client's previous vector (an as-of join of the
    updates with themselves), so the sums and counts by dimension are running
    totals of differences: partitions in time order are summarised to one row
    each, carried on the driver, and a second pass emits the history. While no
    client has a vector, the default weights hold.
    """
    spark = updates.sparkSession
    checkpoint_dir(spark)
    u = updates.select(client, ts, tie, F.coalesce(F.transform(weights, lambda x: x.cast("double")),
                                                   F.array().cast("array<double>")).alias("new"))
    u = u.where(F.col(ts).isNotNull())
    u = as_of(u, u.select(client, ts, tie, F.col("new").alias("old")), ["old"], on=(ts, tie), by=(client,),
              inclusive=False, partitions=partitions)
    n = partitions or partitions_for(u, rows=u.count())
    ordered = u.select(ts, tie, "new", "old").repartitionByRange(n, ts, tie).sortWithinPartitions(ts, tie)
    ordered = ordered.withColumn("_pid", F.spark_partition_id()).checkpoint()
    dims = max(4, ordered.agg(F.max(F.size("new"))).first()[0] or 0)

    def differences(pdf) -> tuple[np.ndarray, np.ndarray]:
        total, count = np.zeros((len(pdf), dims)), np.zeros((len(pdf), dims), dtype=np.int64)
        for sign, column in ((1, "new"), (-1, "old")):
            for i, v in enumerate(pdf[column]):
                if v is not None:
                    total[i, :len(v)] += sign * np.asarray(v, dtype=float)
                    count[i, :len(v)] += sign
        return total, count

    def summarise(it):
        total, count, pid = np.zeros(dims), np.zeros(dims, dtype=np.int64), None
        for pdf in it:
            if len(pdf):
                t, c = differences(pdf)
                total, count, pid = total + t.sum(axis=0), count + c.sum(axis=0), int(pdf["_pid"].iloc[0])
        if pid is not None:
            yield pd.DataFrame({"_pid": [pid], "total": [total], "n": [count]})

    start, total, count = {}, np.zeros(dims), np.zeros(dims, dtype=np.int64)
    for r in sorted(ordered.mapInPandas(summarise, "_pid int, total array<double>, n array<long>").collect()):
        start[r["_pid"]] = total, count
        total, count = total + np.array(r["total"]), count + np.array(r["n"])
    shared = spark.sparkContext.broadcast(start)

    def emit(it):
        total = None
        for pdf in it:
            if not len(pdf):
                continue
            if total is None:
                total, count = shared.value[int(pdf["_pid"].iloc[0])]
            t, c = differences(pdf)
            t, c = np.cumsum(t, axis=0) + total, np.cumsum(c, axis=0) + count
            total, count = t[-1], c[-1]
            w = _fusion_weights(t, c)
            yield pd.DataFrame({ts: pdf[ts], tie: pdf[tie], **{f"w_{name}": w[:, i] for i, name in enumerate(DEFAULT_FUSION)}})

    types = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = f"{ts} {types[ts]}, {tie} {types[tie]}, " + ", ".join(f"w_{name} double" for name in DEFAULT_FUSION)
    return ordered.mapInPandas(emit, schema)


def feedback_agreement(feedback: DataFrame, detections: DataFrame, key: str = "event_id",
                       ts: str = "feedback_ts") -> DataFrame:
    """F8: latest feedback per event joined to the detection label; agreement by label."""
    latest = feedback.groupBy(key).agg(F.max_by("feedback_label", F.struct(ts, "analyst")).alias("feedback_label"))
    j = latest.join(detections.select(key, "label"), key, "left")
    return (j.groupBy("feedback_label")
            .agg(F.count(F.lit(1)).alias("n_feedback"),
                 F.sum((F.col("feedback_label") == F.col("label")).cast("int")).cast("bigint").alias("n_agree"))
            .withColumn("agreement", F.col("n_agree") / F.col("n_feedback")))

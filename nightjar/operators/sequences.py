"""Event-sequence operators.

Per-entity ordering work is bucketed by time (see ``sessions``) so a hot
entity is spread over many tasks; the next step that chain matching needs
comes from a window inside (entity, day) plus a carry from later days, not from
a range join that would pair every start with every candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar.functions.columns import epoch_us, time_bucket
from nightjar.functions.joins import bounded_broadcast, values_table
from nightjar.session import checkpoint_dir

# ---- fixed values ------------------------------------------------------------------
EVENT_VOCAB = ["ConsoleLogin", "S3GetObject", "EC2StartInstances", "IAMPolicyChange", "AuthFailure",
               "ProcessStart", "MaliciousAction", "RunInstances", "CreateUser", "AttachRolePolicy"]
MALICIOUS = "MaliciousAction"
PHISH_CHAIN = [("PhishingClick", "T1566"), ("CredentialHarvest", "T1552"), ("ConsoleLogin", "T1078"),
               ("PrivilegeEscalation", "T1068"), ("DataExfil", "T1041")]
# --------------------------------------------------------------------------------------


def vocab_map() -> Column:
    return F.create_map(*[x for i, e in enumerate(EVENT_VOCAB) for x in (F.lit(e), F.lit(i + 1))])


def encode(types: Column) -> Column:
    """Q1 on one value: vocabulary id 1..10, unknown -> 0."""
    return F.coalesce(F.element_at(vocab_map(), types), F.lit(0))


def encode_list(types: Column) -> Column:
    """Q1 on a list of types."""
    m = vocab_map()
    return F.transform(types, lambda t: F.coalesce(F.element_at(m, t), F.lit(0)))


UNKNOWN = "UnknownEvent"


def with_previous(ev: DataFrame, key: str = "entity_id", ts: str = "ts", tie: str = "event_id",
                  type_col: str = "event_type", bucket_seconds: int = 3600) -> DataFrame:
    """``ev`` with its type (null: UnknownEvent) as ``cur_type`` and the entity's
    previous one as ``prev_type``: a lag inside (entity, time bucket), and for a
    bucket's first row the last type of the entity's previous bucket."""
    ev = ev.withColumn("cur_type", F.coalesce(F.col(type_col), F.lit(UNKNOWN))).withColumn(
        "_b", time_bucket(ts, bucket_seconds))
    last = ev.groupBy(key, "_b").agg(F.max(F.struct(ts, tie, "cur_type")).alias("_l"))
    last = last.select(key, "_b", F.lag("_l.cur_type").over(Window.partitionBy(key).orderBy("_b")).alias("_before"))
    w = Window.partitionBy(key, "_b").orderBy(ts, tie)
    return (ev.repartition(key, "_b").join(last, [key, "_b"], "left")
            .withColumn("prev_type", F.coalesce(F.lag("cur_type").over(w), F.col("_before"))).drop("_before"))


def transition_table(seq: DataFrame, prev: str = "prev_type", cur: str = "cur_type") -> DataFrame:
    """Laplace-smoothed first-order transition probabilities p(cur | prev).

    Counts are partial aggregates (a hot transition is pre-counted map-side);
    the vocabulary is what occurs as ``cur``.
    """
    counts = seq.groupBy(prev, cur).agg(F.count(F.lit(1)).alias("c"))
    v = counts.select(cur).distinct().agg(F.count(F.lit(1))).scalar()
    t = counts.filter(F.col(prev).isNotNull())
    from_n = t.groupBy(prev).agg(F.sum("c").alias("cp"))
    return t.join(from_n, prev).select(prev, cur, ((F.col("c") + 1) / (F.col("cp") + v)).alias("p"))


def sequence_surprise(ev: DataFrame, n: int = 40, key: str = "entity_id", ts: str = "ts", tie: str = "event_id",
                      type_col: str = "event_type", bucket_seconds: int = 3600) -> DataFrame:
    """Q2 (re-aimed): per event the mean -log p over the transitions inside the
    entity's last ``n`` events, mapped to [0, 1) by 1 - 1/(1 + x); no
    transition -> 0. ``malicious`` tells whether the event type MaliciousAction
    is among these events.

    One row per event all the way: the probability joins each (previous,
    current) row, a window sums the last n - 1 values inside (entity, bucket),
    and a bucket's first rows add what is missing from the previous buckets'
    tails (their last n - 1 values).
    """
    m = n - 1
    checkpoint_dir(ev.sparkSession)
    # Narrow rows, written once: the transition table and the windows both read them.
    rows = with_previous(ev, key, ts, tie, type_col, bucket_seconds).select(
        key, ts, tie, "_b", "prev_type", "cur_type").checkpoint()
    table = transition_table(rows)
    rows = rows.join(bounded_broadcast(table), ["prev_type", "cur_type"], "left").select(
        key, ts, tie, "_b", (-F.log("p")).alias("_x"), (F.col("cur_type") == MALICIOUS).cast("int").alias("_m"))
    group = Window.partitionBy(key, "_b")
    w = group.orderBy(ts, tie)
    rows = (rows.withColumn("_rn", F.row_number().over(w))
            .withColumn("_back", F.count(F.lit(1)).over(group) - F.col("_rn"))
            .withColumn("_s", F.sum("_x").over(w.rowsBetween(-(m - 1), 0)))
            .withColumn("_c", F.count("_x").over(w.rowsBetween(-(m - 1), 0)))
            .withColumn("_bad", F.max("_m").over(w.rowsBetween(-m, 0))))
    # The last m values of each bucket, newest first; then those of all earlier buckets.
    tail = (rows.filter(F.col("_back") < m).groupBy(key, "_b")
            .agg(F.sort_array(F.collect_list(F.struct("_back", "_x", "_m"))).alias("_t")))
    earlier = Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(1, m)
    carry = tail.select(key, "_b", F.slice(F.flatten(F.collect_list("_t").over(earlier)), 1, m).alias("_t"))
    # The tails shrink to little in a shuffle: by their size there they would be broadcast.
    rows = rows.join(carry.hint("merge"), [key, "_b"], "left")

    def missing(width: int, zero, step) -> Column:
        """What the previous buckets' tails add for a window of ``width`` rows."""
        take = F.least(F.greatest(F.lit(width) - F.col("_rn"), F.lit(0)), F.size("_t")).cast("int")
        return F.coalesce(F.aggregate(F.slice("_t", F.lit(1), take), zero, step), zero)

    zero_sum, zero = F.lit(0.0), F.lit(0).cast("bigint")
    total = F.coalesce(F.col("_s"), zero_sum) + missing(m, zero_sum, lambda a, x: a + F.coalesce(x["_x"], F.lit(0.0)))
    count = F.col("_c") + missing(m, zero, lambda a, x: a + x["_x"].isNotNull().cast("bigint"))
    bad = missing(n, zero, lambda a, x: F.greatest(a, x["_m"].cast("bigint")))
    mean = F.when(count > 0, total / count)
    out = rows.select(tie, mean.alias("mean_surprise"), (F.greatest(F.col("_bad"), bad) > 0).alias("malicious"))
    return out.withColumn("seq_score", F.coalesce(F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("mean_surprise")),
                                                  F.lit(0.0)))


def list_surprise(rows: DataFrame, table: DataFrame, row: str, types: str = "last_events") -> DataFrame:
    """Q2 for given transitions: (``row``, ``seq_score``) from each row's list of
    last types, its newest last. ``row`` identifies a row; lists are short, and
    only their pairs meet the table."""
    n = F.size(types)
    pairs = rows.where(n > 1).select(row, F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        F.get(types, i - 1).alias("prev_type"), F.get(types, i).alias("cur_type")))).alias("p")).select(row, "p.*")
    mean = (pairs.join(bounded_broadcast(table), ["prev_type", "cur_type"]).groupBy(row)
            .agg(F.avg(-F.log("p")).alias("mean")))
    return mean.select(row, (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("mean"))).alias("seq_score"))


def chain_match(events: DataFrame, chain: list[str], key: str = "user_id", type_col: str = "event_type",
                limit_seconds: int = 3 * 86400, tie: str = "event_id", bucket_seconds: int = 86400) -> DataFrame:
    """Q4 (re-aimed): per entity, the longest prefix of ``chain`` that occurs in
    order with at most ``limit_seconds`` between consecutive steps. Every
    occurrence of the first step is a start and each further step is the
    earliest later one; the best start is the deepest, then the earliest.

    One pass per step, backwards: a row of step i takes how far the next row of
    step i + 1 gets. That row comes from a window inside (entity, time bucket),
    or from the first one of the entity's next bucket that has any. Only rows
    of chain steps are kept, dealt once and checkpointed per pass.
    """
    spark = events.sparkSession
    checkpoint_dir(spark)
    n = len(chain)
    steps = values_table(spark, [(i + 1, s) for i, s in enumerate(chain)], "step int, step_type string")
    rows = (events.filter(F.col(type_col).isin(*chain)).join(F.broadcast(steps), F.col(type_col) == F.col("step_type"))
            .select(key, "ts", tie, "step", (-epoch_us("ts")).alias("_x"), time_bucket("ts", bucket_seconds).alias("_b"))
            .withColumn("depth", F.when(F.col("step") == n, F.lit(1)))
            .withColumn("last", F.when(F.col("step") == n, F.col("ts"))).repartition(key, "_b").checkpoint())
    later_rows = Window.partitionBy(key, "_b").orderBy("_x").rangeBetween(Window.unboundedPreceding, -1)
    later_buckets = Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for i in range(n - 1, 0, -1):
        reach = F.when(F.col("step") == i + 1, F.struct("ts", "depth", "last"))
        first = rows.groupBy(key, "_b").agg(F.min(reach).alias("_f"))
        carry = first.select(key, "_b", F.last("_f", ignorenulls=True).over(later_buckets).alias("_carry"))
        nxt = F.coalesce(F.last(reach, ignorenulls=True).over(later_rows), F.col("_carry"))
        rows = rows.join(carry, [key, "_b"], "left").withColumn("_n", nxt)
        ok = F.col("_n.ts") <= F.col("ts") + F.expr(f"INTERVAL {int(limit_seconds)} SECONDS")
        mine = F.col("step") == i
        rows = (rows.withColumn("depth", F.when(mine, F.when(ok, F.col("_n.depth") + 1).otherwise(1)).otherwise(F.col("depth")))
                .withColumn("last", F.when(mine, F.when(ok, F.col("_n.last")).otherwise(F.col("ts"))).otherwise(F.col("last")))
                .drop("_carry", "_n").checkpoint())
    order = F.struct("depth", F.col("_x").alias("_s"), (-F.col(tie)).alias("_i"), F.col("ts").alias("start_ts"),
                     F.col("last").alias("last_ts"))
    best = rows.filter("step = 1").groupBy(key).agg(F.max(order).alias("m"))
    return best.select(key, F.col("m.depth").alias("steps_reached"), F.col("m.start_ts").alias("start_ts"),
                       F.col("m.last_ts").alias("last_ts"))


def chain_coverage(matches: DataFrame, chain: list[str], chain_name: str, key: str = "user_id") -> DataFrame:
    """Q5: entities reaching each step with first/last time; ``rollup`` adds the
    chain total (step_no null) and the grand total."""
    spark = matches.sparkSession
    steps = values_table(spark, [(i + 1, s) for i, s in enumerate(chain)], "step_no int, action string")
    reached = matches.select(key, "start_ts", "last_ts", F.lit(chain_name).alias("chain"),
                             F.explode(F.sequence(F.lit(1), F.col("steps_reached"))).alias("step_no"))
    cov = (reached.rollup("chain", "step_no")
           .agg(F.count_distinct(key).alias("n_entities"), F.min("start_ts").alias("first_ts"),
                F.max("last_ts").alias("last_ts")))
    return cov.join(bounded_broadcast(steps), "step_no", "left")


def mitre_tags(spark) -> DataFrame:
    """J5 dimension: chain step -> MITRE technique."""
    return values_table(spark, PHISH_CHAIN, "action string, technique string")

"""Configuration drift (D1-D4) and policy checks.

Snapshots are ``(source, snapshot_ts, content)`` rows with JSON text content.
Consecutive snapshots are paired by a two-level ``lag`` over the narrow
(source, snapshot_ts) rows, both contents join the pair, and the deep diff is
local to the row: a Python walk with no limit on the depth (``functions.treediff``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar.functions.columns import time_bucket
from nightjar.functions.treediff import deep_diff

PAIR_BUCKET_SECONDS = 30 * 86_400

# ---- fixed values ------------------------------------------------------------------
S3_PUBLIC_ACTIONS = ("s3:*", "s3:GetObject", "s3:PutObject")
IAM_ESCALATION_ACTIONS = ("iam:CreateUser", "iam:AttachUserPolicy", "iam:PutUserPolicy", "iam:CreateAccessKey")
OPEN_CIDR = "0.0.0.0/0"
ADMIN_PORTS = (22, 3389)
# --------------------------------------------------------------------------------------


def snapshot_pairs(snaps: DataFrame, source: str = "source", ts: str = "snapshot_ts") -> DataFrame:
    """Each snapshot with the previous one of the same source (first dropped).

    The lag runs inside (source, time range); the first snapshot of a range
    takes the last one of the source's previous non-empty range. Snapshots of
    one (source, time) are one snapshot."""
    s = snaps.select(source, ts).distinct().withColumn("_b", time_bucket(ts, PAIR_BUCKET_SECONDS))
    before = (s.groupBy(source, "_b").agg(F.max(ts).alias("_last"))
              .select(source, "_b", F.lag("_last").over(Window.partitionBy(source).orderBy("_b")).alias("_before")))
    prev = F.lag(ts).over(Window.partitionBy(source, "_b").orderBy(ts))
    return (s.withColumn("_prev", prev).join(before, [source, "_b"])
            .select(source, F.coalesce("_prev", "_before").alias("prev_ts"), ts).filter(F.col("prev_ts").isNotNull()))


def _load(content):
    """The document; text that is no JSON is compared as a string."""
    try:
        return json.loads(content)
    except (TypeError, ValueError):
        return content


def config_diff(snaps: DataFrame, source: str = "source", ts: str = "snapshot_ts",
                content: str = "content", repetition: bool = True) -> DataFrame:
    """Deep diff, ignoring array order at every level, of each snapshot
    against the previous one; objects and lists inside arrays are paired with
    the nearest unmatched one and compared inside (``functions.treediff``).

    change_type in dictionary_item_added / dictionary_item_removed /
    values_changed / type_changes / iterable_item_added / iterable_item_removed.
    Without ``repetition`` it doesn't matter how often an array holds an item.
    """
    return diff_pairs(snapshot_pairs(snaps, source, ts), snaps, source, ts, content, repetition)


def diff_pairs(pairs: DataFrame, snaps: DataFrame, source: str = "source", ts: str = "snapshot_ts",
               content: str = "content", repetition: bool = True) -> DataFrame:
    """D2 for given pairs (source, prev_ts, snapshot_ts). Of several snapshots
    of one (source, time) the last content in text order counts."""
    one = snaps.groupBy(source, ts).agg(F.max(content).alias("_content"))
    now = one.select(source, ts, F.col("_content").alias("_new"))
    was = one.select(source, F.col(ts).alias("prev_ts"), F.col("_content").alias("_old"))
    both = pairs.join(now, [source, ts]).join(was, [source, "prev_ts"]).filter(~F.col("_old").eqNullSafe(F.col("_new")))
    names = [source, ts, "change_type", "path", "old_value", "new_value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, t, *change) for s, t, a, b in zip(pdf[source], pdf[ts], pdf["_old"], pdf["_new"])
                    for change in deep_diff(_load(a), _load(b), repetition)]
            yield pd.DataFrame(rows, columns=names)

    kinds = dict(snaps.dtypes)
    schema = f"{source} {kinds[source]}, {ts} {kinds[ts]}, change_type string, path string, old_value string, new_value string"
    return both.select(source, ts, "_old", "_new").mapInPandas(run, schema)


def drift_records(snaps: DataFrame, diff: DataFrame, source: str = "source",
                  ts: str = "snapshot_ts") -> DataFrame:
    """D1 + D3: one record per consecutive pair; ``changed`` when any diff row."""
    pairs = snapshot_pairs(snaps, source, ts)
    counts = diff.groupBy(source, ts).agg(F.count(F.lit(1)).alias("n_changes"))
    r = pairs.join(counts, [source, ts], "left").fillna(0, ["n_changes"])
    rid = F.concat(F.lit("drift-"), F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.col(source))
    return r.select(rid.alias("drift_id"), source, "prev_ts", ts, (F.col("n_changes") > 0).alias("changed"),
                    "n_changes")


def drift_events(records: DataFrame) -> DataFrame:
    """Changed records -> ConfigDrift events for the detection chain."""
    return records.filter("changed").select(
        F.col("drift_id").alias("event_id"), F.col("snapshot_ts").alias("ts"),
        F.lit("config_drift_service").alias("source"), F.lit("infrastructure").alias("entity_type"),
        F.col("source").alias("entity_id"), F.lit("ConfigDrift").alias("event_type"),
        F.lit("low").alias("severity_hint"))


# ---- policy checks ------------------------------------------------------------------

def _as_array(v: Column) -> Column:
    """Scalar-or-array variant -> array<variant> (a dict/scalar becomes one element)."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _str(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def policy_findings(configs: DataFrame, record: str = "record_id", content: str = "content",
                    public_string_ports: bool = False) -> DataFrame:
    """All checks over config documents -> findings (unionByName).

    Columns: record_id, issue, severity, subject, action, port, pos.
    ``public_string_ports`` parses "22/tcp" style inbound rules (no cidr -> open).
    """
    c = configs.select(record, F.parse_json(content).alias("cfg"))

    # Every finding has its place in the document, so that two findings of one subject stay apart.
    def at(*steps: str) -> Column:
        return F.concat_ws("-", *[F.col(x).cast("string") for x in steps]).alias("pos")

    def items(v: str, path: str) -> Column:
        return F.posexplode(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array()))

    def one_or_more(v: str, path: str) -> Column:
        return _as_array(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("[]"))))

    none_s, none_i = F.lit(None).cast("string").alias("action"), F.lit(None).cast("int").alias("port")
    effect = F.lower(F.coalesce(_str(F.col("s"), "$.Effect"), F.lit(""))) == "allow"

    # Public flag; D6: over-permissive bucket statements
    b = c.select(record, items("cfg", "$.s3.buckets").alias("i1", "b"))
    b = b.select(record, "i1", F.coalesce(_str(F.col("b"), "$.name"), F.lit("unknown-bucket")).alias("subject"), "b")
    flag = F.coalesce(F.try_variant_get("b", "$.public", "boolean"), F.lit(False))
    d5 = b.filter(flag).select(record, F.lit("s3_public_bucket").alias("issue"), "subject", none_s, none_i, at("i1"))
    st = (b.select(record, "i1", "subject", items("b", "$.policies").alias("i2", "p"))
          .select(record, "i1", "i2", "subject", F.posexplode(one_or_more("p", "$.Statement")).alias("i3", "s")))
    star = (F.coalesce(_str(F.col("s"), "$.Principal"), F.lit("")) == "*") | (
        (F.to_json(F.try_variant_get("s", "$.Principal", "variant")) == '{"AWS":"*"}'))
    acts = F.transform(one_or_more("s", "$.Action"), lambda a: _str(a))
    d6 = (st.filter(effect & star & F.arrays_overlap(acts, F.array(*[F.lit(a) for a in S3_PUBLIC_ACTIONS])))
          .select(record, F.lit("s3_overpermissive_policy").alias("issue"), "subject", none_s, none_i,
                  at("i1", "i2", "i3")))

    # IAM escalation, one finding per matching action
    u = c.select(record, items("cfg", "$.iam.users").alias("i1", "u"))
    u = u.select(record, "i1", F.coalesce(_str(F.col("u"), "$.name"), F.lit("unknown-user")).alias("subject"),
                 items("u", "$.policies").alias("i2", "p"))
    us = u.select(record, "i1", "i2", "subject", F.posexplode(one_or_more("p", "$.Statement")).alias("i3", "s"))
    ua = us.filter(effect).select(record, "i1", "i2", "i3", "subject", F.posexplode(
        F.transform(one_or_more("s", "$.Action"), lambda a: _str(a))).alias("i4", "action"))
    d7 = ua.filter(F.col("action").isin(*IAM_ESCALATION_ACTIONS)).select(
        record, F.lit("iam_privilege_escalation").alias("issue"), "subject", "action", none_i,
        at("i1", "i2", "i3", "i4"))

    # Inbound 22/3389 open to the world. Only a missing cidr counts as open (a null one does
    # not), and a port must be a number.
    g = c.select(record, items("cfg", "$.security_groups").alias("i1", "g"))
    g = g.select(record, "i1", F.coalesce(_str(F.col("g"), "$.name"), F.lit("sg-unknown")).alias("subject"),
                 items("g", "$.inbound").alias("i2", "r"))
    number = ~F.schema_of_variant(F.try_variant_get("r", "$.port", "variant")).isin("STRING", "BOOLEAN", "VOID")
    port = F.when(number, F.try_variant_get("r", "$.port", "double"))
    cidr = F.try_variant_get("r", "$.cidr", "variant")
    is_open = cidr.isNull() | ((F.schema_of_variant(cidr) == "STRING") & (_str(F.col("r"), "$.cidr") == OPEN_CIDR))
    if public_string_ports:
        text = F.regexp_extract(_str(F.col("r")), r"^(\d+)/", 1)
        port = F.coalesce(port, F.when(text != "", text).cast("double"))
    d8 = (g.select(record, "i1", "i2", "subject", port.alias("p"), is_open.alias("o"))
          .filter(F.col("o") & F.col("p").isin(*[float(x) for x in ADMIN_PORTS]))
          .select(record, F.lit("wide_open_ssh_rdp").alias("issue"), "subject", none_s,
                  F.col("p").cast("int").alias("port"), at("i1", "i2")))
    out = d5.unionByName(d6).unionByName(d7).unionByName(d8)
    return out.withColumn("severity", F.lit("high"))


def violation_events(findings: DataFrame, ts_col: Column | None = None, record: str = "record_id") -> DataFrame:
    """Findings -> PolicyViolation events. The id has record, issue, subject,
    action or port and the finding's place in the document, so it is unique;
    ``ts_col`` (if given) becomes ``ts``."""
    fid = F.concat_ws("-", F.lit("pv"), F.col(record).cast("string"), "issue", "subject",
                      F.coalesce("action", F.col("port").cast("string"), F.lit("")), "pos")
    cols = [fid.alias("event_id"), F.lit("policy_drift_service").alias("source"),
            F.lit("infrastructure").alias("entity_type"), F.col(record).cast("string").alias("entity_id"),
            F.lit("PolicyViolation").alias("event_type"), "issue", "severity", "subject"]
    return findings.select(*cols, *([] if ts_col is None else [ts_col.alias("ts")]))

"""Deterministic projections of the driver tables into the security data model.

All rules are modulo arithmetic on ids so Spark and DuckDB agree exactly
(integer division differs between the engines, ``%`` does not).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.sources.tables import table

# ---- fixed values (event-type wheel, regions, TI stub, role ARNs) -------------
EVENT_TYPE_WHEEL = [
    "ConsoleLogin", "ConsoleLogin", "ConsoleLogin", "ListBuckets", "CreateUser",
    "PutBucketPolicy", "GetObject", "AssumeRole", "S3GetObject", "IAMPolicyChange",
    "EC2StartInstances", "AuthFailure", "ProcessStart",
]
REGION_WHEEL = ["us-east-1", "us-east-1", "us-east-1", "us-east-1",
                "eu-west-1", "eu-west-1", "ap-south-1"]
BAD_IP = "9.10.11.12"
ROLE_ADMIN = "arn:aws:iam::123456789012:role/Admin"
ROLE_POWER = "arn:aws:iam::123456789012:role/PowerUser"
SOURCE_NAME = "cloudtrail"
# --------------------------------------------------------------------------------


def _wheel(values, idx_col) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx_col + F.lit(1)).cast("int"))


def sec_events_from(events: DataFrame) -> DataFrame:
    """``events`` -> canonical security Event rows (lifted CloudTrail fields)."""
    eid = F.col("event_id")
    uid = F.col("user_id")
    etype = _wheel(EVENT_TYPE_WHEEL, eid % 13)
    region = _wheel(REGION_WHEEL, eid % 7)
    ip = (F.when(eid % 11 == 0, F.lit(BAD_IP))
          .when(eid % 11 == 1, F.concat(F.lit("5.199."), (uid % 256).cast("string"), F.lit(".1")))
          .otherwise(F.concat(F.lit("10.0."), (uid % 256).cast("string"), F.lit("."),
                              (eid % 256).cast("string"))))
    base = events.select(
        "event_id", "ts", "props",
        F.lit(SOURCE_NAME).alias("source"),
        F.lit("user").alias("entity_type"),
        F.concat(F.lit("user_"), uid.cast("string")).alias("entity_id"),
        etype.alias("event_type"),
        region.alias("region"),
        ip.alias("source_ip"),
    )
    et = F.col("event_type")
    return base.select(
        "event_id", "ts", "source", "entity_type", "entity_id", "event_type", "region",
        "source_ip",
        F.when(et == "PutBucketPolicy",
               F.when(eid % 3 == 0, F.lit("public-read")).otherwise(F.lit("private"))).alias("policy"),
        F.when(et.isin("GetObject", "S3GetObject"),
               F.when(eid % 2 == 0, F.lit("secure-logs")).otherwise(F.lit("data"))).alias("bucket"),
        F.when(et == "AssumeRole",
               F.when(eid % 2 == 0, F.lit(ROLE_ADMIN)).otherwise(F.lit(ROLE_POWER))).alias("role_arn"),
        F.concat(F.lit("Simulated "), et, F.lit(" by "), F.col("entity_id"), F.lit(" from "),
                 F.col("source_ip"), F.lit(" "), F.col("props")).alias("details"),
        "props",
    )


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec_events_from(table(spark, sf_dir, "events"))


def ti_table(spark: SparkSession) -> DataFrame:
    """The reference's threat-intel stub as a dimension table (ip, ip_reputation)."""
    from nightjar.functions.joins import values_table
    return values_table(spark, [(BAD_IP, 0.9)], "ip string, ip_reputation double")


def raw_json_variant(event_id="event_id", event_type="event_type", region="region",
                     source_ip="source_ip") -> F.Column:
    """CloudTrail-like raw JSON with the IP/region under a key chosen by id % 6,
    so every fallback of the IP/region extractors is used."""
    k = F.col(event_id) % 6
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    head = F.concat(F.lit('{"eventName":'), q(event_type), F.lit(","))
    body = (F.when(k == 0, F.concat(F.lit('"awsRegion":'), q(region), F.lit(',"sourceIPAddress":'), q(source_ip)))
            .when(k == 1, F.concat(F.lit('"aws_region":'), q(region), F.lit(',"source_ip":'), q(source_ip)))
            .when(k == 2, F.concat(F.lit('"region":'), q(region), F.lit(',"clientIp":'), q(source_ip)))
            .when(k == 3, F.concat(F.lit('"geo":{"region":'), q(region), F.lit('},"requestParameters":{"ip":'),
                                   q(source_ip), F.lit("}")))
            .when(k == 4, F.concat(F.lit('"sourceIpAddress":"  ","ip_address":'), q(source_ip)))
            .otherwise(F.lit('"note":"none"')))
    return F.concat(head, body, F.lit("}"))


def alert_records(det: DataFrame) -> DataFrame:
    """Detection records as the stored events/alerts tables see them."""
    return det.select(
        F.col("event_id").alias("id"), "*",
        F.col("ts").alias("updated_ts"), F.col("ts").alias("ingest_ts"),
        raw_json_variant().alias("raw_json"))


# ---- vendor-shaped records built from events (keys left out by modulo) -------------
CLOUDTRAIL_SCHEMA = ("eventID string, eventTime string, eventName string, awsRegion string, "
                     "sourceIPAddress string, event_id string, entity_id string, "
                     "userIdentity struct<type: string, userName: string, arn: string, principalId: string>")
EDR_SCHEMA = ("id string, event_id string, uuid string, timestamp string, time string, event_type string, "
              "action string, eventName string, user string, username string, principal string, "
              "remote_ip string, src_ip string, host string, entity_type string")
NDR_SCHEMA = ("uid string, ts bigint, event_id string, timestamp string, src_ip string, "
              "`id.orig_h` string, dst_ip string, `id.resp_h` string, source string")


def _iso(ts="ts"):
    return F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _unless(cond, value):
    return F.when(~cond, value)


def cloudtrail_json(sec: DataFrame) -> DataFrame:
    """One CloudTrail-style JSON document per event (``value`` column)."""
    e = F.col("event_id")
    ident = F.struct(
        (F.when(e % 5 == 0, F.lit("Root")).when(e % 5 == 1, F.lit("AssumedRole"))
         .otherwise(F.lit("IAMUser"))).alias("type"),
        F.when(e % 3 == 0, F.lit("")).otherwise(F.col("entity_id")).alias("userName"),
        _unless(e % 4 == 0, F.concat(F.lit("arn:aws:iam::123456789012:user/"), F.col("entity_id"))).alias("arn"),
        _unless(e % 6 == 0, F.concat(F.lit("AID"), F.col("entity_id"))).alias("principalId"))
    rec = F.struct(
        _unless(e % 9 == 0, F.concat(F.lit("ev-"), e.cast("string"))).alias("eventID"),
        _iso().alias("eventTime"),
        _unless(e % 10 == 0, F.col("event_type")).alias("eventName"),
        F.col("region").alias("awsRegion"),
        _unless(e % 8 == 0, F.col("source_ip")).alias("sourceIPAddress"),
        F.when(e % 7 == 0, F.concat(F.lit("ent-"), e.cast("string"))).alias("entity_id"),
        F.when(e % 9 == 1, F.concat(F.lit("id-"), e.cast("string"))).alias("event_id"),
        ident.alias("userIdentity"))
    return sec.select("event_id", F.to_json(rec).alias("value"))


def edr_json(events: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rec = F.struct(
        F.when(e % 3 == 0, F.concat(F.lit("edr-"), e.cast("string"))).alias("id"),
        F.when(e % 3 == 1, e.cast("string")).alias("event_id"),
        F.when(e % 3 == 2, F.concat(F.lit("uuid-"), e.cast("string"))).alias("uuid"),
        F.when(e % 2 == 0, _iso()).alias("timestamp"),
        F.when(e % 2 == 1, _iso()).alias("time"),
        F.when(e % 4 == 0, F.col("event_type")).alias("event_type"),
        F.when(e % 4 == 1, F.concat(F.lit("proc_"), F.col("event_type"))).alias("action"),
        F.when(e % 4 == 2, F.initcap("event_type")).alias("eventName"),
        F.when(e % 5 == 0, F.concat(F.lit("user_"), u.cast("string"))).alias("user"),
        F.when(e % 5 == 1, F.concat(F.lit("u"), u.cast("string"))).alias("username"),
        F.when(e % 5 == 2, F.concat(F.lit("p"), u.cast("string"))).alias("principal"),
        F.when(e % 9 < 3, F.concat(F.lit("10.1."), (u % 256).cast("string"), F.lit(".9"))).alias("remote_ip"),
        F.when((e % 9 >= 3) & (e % 9 < 6), F.concat(F.lit("10.2."), (u % 256).cast("string"), F.lit(".9")))
        .alias("src_ip"),
        _unless(e % 6 == 0, F.concat(F.lit("host-"), (u % 20).cast("string"))).alias("host"),
        F.when(e % 8 == 0, F.lit("endpoint")).alias("entity_type"))
    return events.select("event_id", F.to_json(rec).alias("value"))


def ndr_json(events: DataFrame) -> DataFrame:
    from nightjar.functions.columns import epoch_us
    e, u = F.col("event_id"), F.col("user_id")
    rec = F.struct(
        _unless(e % 4 == 0, F.concat(F.lit("C"), e.cast("string"))).alias("uid"),
        _unless(e % 8 == 0, F.floor(epoch_us("ts") / 1000000).cast("bigint")).alias("ts"),
        F.concat(F.lit("n-"), e.cast("string")).alias("event_id"),
        _iso().alias("timestamp"),
        F.when(e % 2 == 0, F.concat(F.lit("10.3."), (u % 256).cast("string"), F.lit(".1"))).alias("src_ip"),
        F.when((e % 2 == 1) & (e % 10 != 1), F.concat(F.lit("10.4."), (u % 256).cast("string"), F.lit(".1")))
        .alias("id.orig_h"),
        F.when(e % 3 == 0, F.concat(F.lit("172.16.0."), (e % 256).cast("string"))).alias("dst_ip"),
        F.when(e % 3 == 1, F.concat(F.lit("172.17.0."), (e % 256).cast("string"))).alias("id.resp_h"),
        F.when(e % 5 == 0, F.lit("Zeek-sensor")).when(e % 5 == 1, F.lit("corelight")).alias("source"))
    return events.select("event_id", F.to_json(rec).alias("value"))


def parse_json(df: DataFrame, schema: str) -> DataFrame:
    """JSON text -> vendor columns (declared schema, PERMISSIVE)."""
    return df.select("event_id", F.from_json("value", schema).alias("r"), "value").select(
        F.col("event_id").alias("_row"), "r.*", "value")


def legacy_alerts(sec: DataFrame) -> DataFrame:
    """Old alert-store rows; every 17th has broken JSON."""
    e = F.col("event_id")
    ev = F.to_json(F.struct(
        _unless(e % 5 == 0, F.concat(F.lit("old-"), e.cast("string"))).alias("event_id"),
        _unless(e % 4 == 0, F.col("source")).alias("source"),
        _unless(e % 3 == 0, F.col("entity_type")).alias("entity_type"),
        F.col("event_type").alias("event_type"),
        F.struct(F.when(F.col("source_ip") == BAD_IP, F.lit(0.9)).otherwise(F.lit(0.0)).alias("ip_reputation"))
        .alias("ti")))
    bad = F.concat(F.lit('{"event_id": "broken'), e.cast("string"))
    return sec.select(
        e.alias("id"), "entity_id", F.round(F.col("event_id") % 100 / F.lit(100.0), 2).alias("score"),
        F.when(e % 17 == 0, bad).otherwise(ev).alias("event_json"), "ts")


# ---- configuration snapshots and policy documents ------------------------------------
def order_snapshots(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """One JSON snapshot per (nation, month): order count, a band that flips
    between a string and a number, status counts (keys come and go), the
    priorities seen at least twice (an unordered list) and a high-value flag."""
    o = (orders.select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                       F.make_timestamp_ntz(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1), F.lit(0),
                                            F.lit(0), F.lit(0)).alias("snapshot_ts"))
         .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .join(nation.select("n_nationkey", F.col("n_name").alias("source")),
               F.col("c_nationkey") == F.col("n_nationkey")))
    k = ["source", "snapshot_ts"]
    base = o.groupBy(*k).agg(F.count(F.lit(1)).alias("cnt"), F.max("o_totalprice").alias("maxp"))
    st = (o.groupBy(*k, "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
          .groupBy(*k).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderstatus", "n"))))
                           .alias("status")))
    pr = (o.groupBy(*k, "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
          .groupBy(*k).agg(F.sort_array(F.collect_list("o_orderpriority")).alias("priorities")))
    s = base.join(st, k).join(pr, k, "left")
    band = F.when(F.col("cnt") % 2 == 0, F.lit('"even"')).otherwise(F.col("cnt").cast("string"))
    content = F.concat(
        F.lit('{"orders":'), F.col("cnt").cast("string"), F.lit(',"band":'), band,
        F.lit(',"status":'), F.to_json("status"),
        F.lit(',"priorities":'), F.coalesce(F.to_json("priorities"), F.lit("[]")),
        F.lit(',"high_value":'), F.when(F.col("maxp") > 300000, F.lit("true")).otherwise(F.lit("false")),
        F.lit("}"))
    return s.select("source", "snapshot_ts", content.alias("content"))


def supplier_configs(supplier: DataFrame) -> DataFrame:
    """One small config document per supplier (record_id = s_suppkey) with IAM,
    S3 and security-group sections; scalar and array Statement/Action forms
    both occur."""
    k = F.col("s_suppkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    action = (F.when(k % 4 == 0, F.lit('"iam:CreateUser"'))
              .when(k % 4 == 1, F.lit('["iam:AttachUserPolicy","s3:GetObject"]'))
              .when(k % 4 == 2, F.lit('"ec2:DescribeInstances"'))
              .otherwise(F.lit('["iam:PutUserPolicy","iam:CreateAccessKey"]')))
    stmt = F.concat(F.lit('{"Effect":'), F.when(k % 3 == 0, F.lit('"Deny"')).otherwise(F.lit('"Allow"')),
                    F.lit(',"Action":'), action, F.lit("}"))
    stmts = F.when(k % 2 == 0, stmt).otherwise(
        F.concat(F.lit("["), stmt, F.lit(',{"Effect":"Deny","Action":"iam:CreateUser"}]')))
    user = F.concat(F.lit('{"name":'), q(F.col("s_name")), F.lit(',"policies":[{"Statement":'), stmts,
                    F.lit("}]}"))
    principal = (F.when(k % 3 == 0, F.lit('"*"')).when(k % 3 == 1, F.lit('{"AWS":"*"}'))
                 .otherwise(F.lit('"arn:aws:iam::1:root"')))
    s3_action = F.when(k % 2 == 0, F.lit('"s3:GetObject"')).otherwise(F.lit('["s3:ListBucket","s3:PutObject"]'))
    bucket = F.concat(
        F.lit('{"name":"bucket-'), k.cast("string"), F.lit('","public":'),
        F.when(k % 5 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(',"policies":[{"Statement":{"Effect":'), F.when(k % 7 == 0, F.lit('"Deny"')).otherwise(F.lit('"Allow"')),
        F.lit(',"Principal":'), principal, F.lit(',"Action":'), s3_action, F.lit("}}]}"))
    port = F.when(k % 3 == 0, F.lit("22")).when(k % 3 == 1, F.lit("3389")).otherwise(F.lit("443"))
    rule = (F.when(k % 4 == 0, F.concat(F.lit('{"port":'), port, F.lit("}")))
            .when(k % 4 == 2, F.concat(F.lit('{"port":'), port, F.lit(',"cidr":"10.0.0.0/8"}')))
            .otherwise(F.concat(F.lit('{"port":'), port, F.lit(',"cidr":"0.0.0.0/0"}'))))
    sg = F.concat(F.lit('{"name":"sg-'), k.cast("string"), F.lit('","inbound":['), rule, F.lit("]}"))
    content = F.concat(F.lit('{"iam":{"users":['), user, F.lit(']},"s3":{"buckets":['), bucket,
                       F.lit(']},"security_groups":['), sg, F.lit("]}"))
    return supplier.select(k.alias("record_id"), content.alias("content"))

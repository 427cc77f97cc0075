"""Vendor-record -> canonical Event mappers (P1-P4, P6, P7) and legacy migration.

Inputs are DataFrames whose columns are the vendor record's keys (as produced
by ``spark.read.json`` or ``from_json``). A key that the input schema lacks is
treated as missing, like a ``dict.get`` miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions.columns import first_present, present


def _has(df: DataFrame, path: str) -> bool:
    dt: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(dt, T.StructType) or part not in dt.fieldNames():
            return False
        dt = dt[part].dataType
    return True


def opt(df: DataFrame, path: str, raw: bool = False) -> Column:
    """Column for a (possibly nested) key; null literal when the schema lacks it.
    ``raw=True`` treats ``path`` as one top-level name that contains dots."""
    if raw:
        return F.col(f"`{path}`").cast("string") if path in df.columns else F.lit(None).cast("string")
    if _has(df, path):
        return F.col(path).cast("string")
    return F.lit(None).cast("string")


def map_cloudtrail(df: DataFrame) -> DataFrame:
    """entity = arn -> userName -> principalId -> 'unknown'; type default
    'CloudTrailEvent'; geo ip only when present."""
    ip = present(opt(df, "sourceIPAddress"))
    return df.select(
        opt(df, "eventID").alias("event_id"),
        opt(df, "eventTime").alias("timestamp"),
        F.lit("aws:cloudtrail").alias("source"),
        F.lit("user").alias("entity_type"),
        F.coalesce(first_present(opt(df, "userIdentity.arn"), opt(df, "userIdentity.userName"),
                                 opt(df, "userIdentity.principalId")), F.lit("unknown")).alias("entity_id"),
        F.coalesce(opt(df, "eventName"), F.lit("CloudTrailEvent")).alias("event_type"),
        ip.alias("geo_ip"),
    )


def entity_class(df: DataFrame) -> DataFrame:
    """Identity class root / role / user and the userName-first entity."""
    utype = F.lower(F.coalesce(opt(df, "userIdentity.type"), F.lit("")))
    return df.select(
        opt(df, "eventID").alias("event_id"),
        F.when(utype == "root", F.lit("root")).when(utype.contains("role"), F.lit("role"))
        .otherwise(F.lit("user")).alias("entity_type"),
        F.coalesce(first_present(opt(df, "userIdentity.userName"), opt(df, "userIdentity.arn"),
                                 opt(df, "userIdentity.principalId")), F.lit("unknown")).alias("entity_id"),
    )


def map_edr(df: DataFrame) -> DataFrame:
    """Coalesce chains over the EDR vendor keys."""
    user = F.coalesce(first_present(opt(df, "user"), opt(df, "username"), opt(df, "principal")), F.lit("unknown"))
    return df.select(
        first_present(opt(df, "id"), opt(df, "event_id"), opt(df, "uuid")).alias("event_id"),
        first_present(opt(df, "timestamp"), opt(df, "time")).alias("timestamp"),
        F.lit("edr").alias("source"),
        F.coalesce(present(opt(df, "entity_type")), F.lit("host")).alias("entity_type"),
        F.coalesce(present(opt(df, "host")), user).alias("entity_id"),
        F.coalesce(first_present(opt(df, "event_type"), opt(df, "action"), opt(df, "eventName")),
                   F.lit("EDREvent")).alias("event_type"),
        first_present(opt(df, "remote_ip"), opt(df, "src_ip")).alias("geo_ip"),
    )


def map_ndr(df: DataFrame) -> DataFrame:
    """Zeek/NDR flow records; ``dst_ip`` is kept (the reference drops it)."""
    src = first_present(opt(df, "src_ip"), opt(df, "id.orig_h", raw=True))
    dst = first_present(opt(df, "dst_ip"), opt(df, "id.resp_h", raw=True))
    zeek = F.lower(F.coalesce(opt(df, "source"), F.lit(""))).contains("zeek")
    return df.select(
        first_present(opt(df, "uid"), opt(df, "ts"), opt(df, "event_id")).alias("event_id"),
        first_present(opt(df, "ts"), opt(df, "timestamp")).alias("timestamp"),
        F.when(zeek, F.lit("zeek")).otherwise(F.lit("ndr")).alias("source"),
        F.lit("ip").alias("entity_type"),
        F.coalesce(src, F.lit("unknown")).alias("entity_id"),
        F.lit("netflow").alias("event_type"),
        src.alias("geo_ip"),
        dst.alias("dst_ip"),
    )


def record_key(df: DataFrame) -> Column:
    """Stable content key of a CloudTrail-like record (replaces a random uuid)."""
    parts = [opt(df, "eventTime"), opt(df, "eventName"), opt(df, "userIdentity.userName"),
             opt(df, "sourceIPAddress")]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def repair_events(df: DataFrame) -> DataFrame:
    """Missing event id -> sha2 of the record content (reruns agree);
    eventName -> event_type; userIdentity.userName -> entity_id when missing."""
    return df.select(
        F.coalesce(present(opt(df, "event_id")), record_key(df)).alias("event_id"),
        F.coalesce(opt(df, "event_type"), opt(df, "eventName")).alias("event_type"),
        F.coalesce(present(opt(df, "entity_id")), opt(df, "userIdentity.userName")).alias("entity_id"),
    )


def derive_entity(df: DataFrame) -> DataFrame:
    """entity_id -> userName -> arn -> principalId -> sourceIPAddress -> 'unknown'."""
    return df.select(
        opt(df, "eventID").alias("event_id"),
        F.coalesce(first_present(opt(df, "entity_id"), opt(df, "userIdentity.userName"),
                                 opt(df, "userIdentity.arn"), opt(df, "userIdentity.principalId"),
                                 opt(df, "sourceIPAddress")), F.lit("unknown")).alias("entity_id"),
    )


LEGACY_SCHEMA = ("event_id string, source string, entity_type string, event_type string, template_id string, "
                 "ti struct<ip_reputation: double>")


def migrate_alerts(legacy: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Legacy alert rows (id, entity_id, score, event_json, ts) -> event records.
    Bad JSON parses to an empty object (PERMISSIVE), so defaults apply."""
    ev = F.from_json("event_json", LEGACY_SCHEMA, {"mode": "PERMISSIVE"})
    score = F.col("score").cast("double")
    hit = F.coalesce(score > F.lit(threshold), F.lit(False))
    return legacy.withColumn("_ev", ev).select(
        "id",
        F.coalesce(present(F.col("_ev.event_id")), F.col("id").cast("string")).alias("event_id"),
        F.coalesce(present(F.col("_ev.source")), F.lit("migrated")).alias("source"),
        F.coalesce(present(F.col("_ev.entity_type")), F.lit("user")).alias("entity_type"),
        "entity_id",
        present(F.col("_ev.event_type")).alias("event_type"),
        F.col("_ev.ti.ip_reputation").alias("ti_score"),
        score.alias("detection_score"),
        F.when(hit, F.lit("problem")).otherwise(F.lit("normal")).alias("label"),
        hit.alias("detected"),
        F.lit("migrated").alias("model_version"),
        F.col("ts").alias("alert_ts"),
    )

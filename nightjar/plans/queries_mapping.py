"""Vendor mapping queries (P1-P4, P6, P7) and legacy migration."""

from __future__ import annotations

from nightjar.operators import mapping as M
from nightjar.plans.catalog import register
from nightjar.plans.fixtures import (CLOUDTRAIL_SCHEMA, EDR_SCHEMA, NDR_SCHEMA, cloudtrail_json, edr_json,
                                     legacy_alerts, ndr_json, parse_json, sec_events)
from nightjar.plans.oracle_sql import SEC_EVENTS, with_
from nightjar.sources.tables import table

_CT = with_(SEC_EVENTS, """
ct AS (
  SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'ev-' || CAST(event_id AS VARCHAR) END AS eventID,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS eventTime,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS eventName,
    CASE WHEN event_id % 8 = 0 THEN NULL ELSE source_ip END AS sourceIPAddress,
    CASE WHEN event_id % 7 = 0 THEN 'ent-' || CAST(event_id AS VARCHAR) END AS k_entity_id,
    CASE WHEN event_id % 9 = 1 THEN 'id-' || CAST(event_id AS VARCHAR) END AS k_event_id,
    CASE WHEN event_id % 5 = 0 THEN 'Root' WHEN event_id % 5 = 1 THEN 'AssumedRole' ELSE 'IAMUser' END AS u_type,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE entity_id END AS u_name,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'arn:aws:iam::123456789012:user/' || entity_id END AS u_arn,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'AID' || entity_id END AS u_pid
  FROM sec
)""")


def _ct(spark, sf):
    return parse_json(cloudtrail_json(sec_events(spark, sf)), CLOUDTRAIL_SCHEMA)


@register("map_cloudtrail", _CT + """
SELECT eventID AS event_id, eventTime AS timestamp, 'aws:cloudtrail' AS source, 'user' AS entity_type,
  coalesce(nullif(u_arn, ''), nullif(u_name, ''), nullif(u_pid, ''), 'unknown') AS entity_id,
  coalesce(eventName, 'CloudTrailEvent') AS event_type, nullif(sourceIPAddress, '') AS geo_ip
FROM ct""")
def q_map_cloudtrail(spark, sf):
    """P1 over CloudTrail JSON documents built from events."""
    return M.map_cloudtrail(_ct(spark, sf))


@register("entity_class", _CT + """
SELECT eventID AS event_id,
  CASE WHEN lower(u_type) = 'root' THEN 'root' WHEN contains(lower(u_type), 'role') THEN 'role' ELSE 'user' END
    AS entity_type,
  coalesce(nullif(u_name, ''), nullif(u_arn, ''), nullif(u_pid, ''), 'unknown') AS entity_id
FROM ct""")
def q_entity_class(spark, sf):
    """Identity class and userName-first entity."""
    return M.entity_class(_ct(spark, sf))


@register("repair_events", _CT + """
SELECT coalesce(nullif(k_event_id, ''),
         sha256(concat_ws('|', coalesce(eventTime, ''), coalesce(eventName, ''), coalesce(u_name, ''),
                          coalesce(sourceIPAddress, '')))) AS event_id,
  eventName AS event_type, coalesce(nullif(k_entity_id, ''), u_name) AS entity_id
FROM ct""")
def q_repair(spark, sf):
    """Id / type / entity repair with a content-hash id."""
    return M.repair_events(_ct(spark, sf))


@register("derive_entity", _CT + """
SELECT eventID AS event_id,
  coalesce(nullif(k_entity_id, ''), nullif(u_name, ''), nullif(u_arn, ''), nullif(u_pid, ''),
           nullif(sourceIPAddress, ''), 'unknown') AS entity_id
FROM ct""")
def q_derive_entity(spark, sf):
    """P7."""
    return M.derive_entity(_ct(spark, sf))


@register("map_edr", """
WITH edr AS (
  SELECT
    CASE WHEN event_id % 3 = 0 THEN 'edr-' || CAST(event_id AS VARCHAR) END AS id,
    CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) END AS k_event_id,
    CASE WHEN event_id % 3 = 2 THEN 'uuid-' || CAST(event_id AS VARCHAR) END AS uuid,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS k_timestamp,
    CASE WHEN event_id % 2 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS k_time,
    CASE WHEN event_id % 4 = 0 THEN event_type END AS k_event_type,
    CASE WHEN event_id % 4 = 1 THEN 'proc_' || event_type END AS action,
    CASE WHEN event_id % 4 = 2 THEN upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) END
      AS eventName,
    CASE WHEN event_id % 5 = 0 THEN 'user_' || CAST(user_id AS VARCHAR) END AS k_user,
    CASE WHEN event_id % 5 = 1 THEN 'u' || CAST(user_id AS VARCHAR) END AS username,
    CASE WHEN event_id % 5 = 2 THEN 'p' || CAST(user_id AS VARCHAR) END AS principal,
    CASE WHEN event_id % 9 < 3 THEN '10.1.' || CAST(user_id % 256 AS VARCHAR) || '.9' END AS remote_ip,
    CASE WHEN event_id % 9 >= 3 AND event_id % 9 < 6 THEN '10.2.' || CAST(user_id % 256 AS VARCHAR) || '.9' END
      AS src_ip,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'host-' || CAST(user_id % 20 AS VARCHAR) END AS host,
    CASE WHEN event_id % 8 = 0 THEN 'endpoint' END AS k_entity_type
  FROM events
)
SELECT coalesce(nullif(id, ''), nullif(k_event_id, ''), nullif(uuid, '')) AS event_id,
  coalesce(nullif(k_timestamp, ''), nullif(k_time, '')) AS timestamp, 'edr' AS source,
  coalesce(nullif(k_entity_type, ''), 'host') AS entity_type,
  coalesce(nullif(host, ''), nullif(k_user, ''), nullif(username, ''), nullif(principal, ''), 'unknown') AS entity_id,
  coalesce(nullif(k_event_type, ''), nullif(action, ''), nullif(eventName, ''), 'EDREvent') AS event_type,
  coalesce(nullif(remote_ip, ''), nullif(src_ip, '')) AS geo_ip
FROM edr""")
def q_map_edr(spark, sf):
    """P3 over EDR JSON documents built from events."""
    return M.map_edr(parse_json(edr_json(table(spark, sf, "events")), EDR_SCHEMA))


@register("map_ndr", """
WITH ndr AS (
  SELECT
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'C' || CAST(event_id AS VARCHAR) END AS uid,
    CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS VARCHAR) END
      AS k_ts,
    'n-' || CAST(event_id AS VARCHAR) AS k_event_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS k_timestamp,
    CASE WHEN event_id % 2 = 0 THEN '10.3.' || CAST(user_id % 256 AS VARCHAR) || '.1' END AS src_ip,
    CASE WHEN event_id % 2 = 1 AND event_id % 10 <> 1 THEN '10.4.' || CAST(user_id % 256 AS VARCHAR) || '.1' END
      AS orig_h,
    CASE WHEN event_id % 3 = 0 THEN '172.16.0.' || CAST(event_id % 256 AS VARCHAR) END AS dst_ip,
    CASE WHEN event_id % 3 = 1 THEN '172.17.0.' || CAST(event_id % 256 AS VARCHAR) END AS resp_h,
    CASE WHEN event_id % 5 = 0 THEN 'Zeek-sensor' WHEN event_id % 5 = 1 THEN 'corelight' END AS k_source
  FROM events
)
SELECT coalesce(nullif(uid, ''), nullif(k_ts, ''), nullif(k_event_id, '')) AS event_id,
  coalesce(nullif(k_ts, ''), nullif(k_timestamp, '')) AS timestamp,
  CASE WHEN contains(lower(coalesce(k_source, '')), 'zeek') THEN 'zeek' ELSE 'ndr' END AS source,
  'ip' AS entity_type, coalesce(nullif(src_ip, ''), nullif(orig_h, ''), 'unknown') AS entity_id,
  'netflow' AS event_type, coalesce(nullif(src_ip, ''), nullif(orig_h, '')) AS geo_ip,
  coalesce(nullif(dst_ip, ''), nullif(resp_h, '')) AS dst_ip
FROM ndr""")
def q_map_ndr(spark, sf):
    """P4 over Zeek-style JSON documents built from events."""
    return M.map_ndr(parse_json(ndr_json(table(spark, sf, "events")), NDR_SCHEMA))


@register("migrate_alerts", with_(SEC_EVENTS) + """
SELECT event_id AS id,
  CASE WHEN event_id % 17 = 0 OR event_id % 5 = 0 THEN CAST(event_id AS VARCHAR)
       ELSE 'old-' || CAST(event_id AS VARCHAR) END AS event_id,
  CASE WHEN event_id % 17 = 0 OR event_id % 4 = 0 THEN 'migrated' ELSE source END AS source,
  CASE WHEN event_id % 17 = 0 OR event_id % 3 = 0 THEN 'user' ELSE entity_type END AS entity_type,
  entity_id,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN source_ip = '9.10.11.12' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END
    AS ti_score,
  round(CAST(event_id % 100 AS DOUBLE) / 100.0::DOUBLE, 2) AS detection_score,
  CASE WHEN round(CAST(event_id % 100 AS DOUBLE) / 100.0::DOUBLE, 2) > 0.7::DOUBLE THEN 'problem' ELSE 'normal' END
    AS label,
  round(CAST(event_id % 100 AS DOUBLE) / 100.0::DOUBLE, 2) > 0.7::DOUBLE AS detected,
  'migrated' AS model_version, ts AS alert_ts
FROM sec""")
def q_migrate(spark, sf):
    """Legacy alert rows (broken JSON every 17th) migrated with defaults."""
    return M.migrate_alerts(legacy_alerts(sec_events(spark, sf)))


@register("json_columns", with_(SEC_EVENTS) + """,
lg AS (
  SELECT event_id AS id,
    CASE WHEN event_id % 17 = 0 THEN '{"event_id": "broken' || CAST(event_id AS VARCHAR) ELSE 'ok' END AS txt,
    event_type FROM sec
)
SELECT id, txt = 'ok' AS json_ok, CASE WHEN txt = 'ok' THEN event_type END AS event_type,
       CASE WHEN txt = 'ok' THEN NULL ELSE txt END AS raw_text FROM lg""")
def q_json_columns(spark, sf):
    """JSON text columns to objects; text that does not parse is kept as text."""
    from pyspark.sql import functions as F
    legacy = legacy_alerts(sec_events(spark, sf))
    ok = F.try_parse_json("event_json").isNotNull()
    return legacy.select("id", ok.alias("json_ok"),
                         F.when(ok, F.get_json_object("event_json", "$.event_type")).alias("event_type"),
                         F.when(~ok, F.col("event_json")).alias("raw_text"))

"""Reporting queries (A1-A15) and display mappings (P8-P14) over detection records."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import reports as RP
from nightjar.plans import detect as D
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import alert_records, sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, RECORDS, with_

AS_OF = "2024-01-20 00:00:00"
DETAIL_ID = 99

_REC = with_(DETECT, RECORDS)


def records(spark, sf):
    return alert_records(D.detect(sec_events(spark, sf), ti_table(spark)))


def _sql_first_present(exprs):
    return "coalesce(" + ", ".join(f"nullif({e}, '')" for e in exprs) + ")"


def _sql_first_nonblank(exprs):
    return "coalesce(" + ", ".join(f"CASE WHEN trim({e}) <> '' THEN {e} END" for e in exprs) + ")"


_P8 = _sql_first_present(
    [f"json_extract_string(raw_json, '$.{k}')" for k in RP.IP_KEYS]
    + [f"json_extract_string(raw_json, '$.{o}.{k}')" for o in RP.NESTED_OBJECTS for k in RP.NESTED_IP_KEYS]
    + ["source"])
_P9_IP = "coalesce(" + _sql_first_nonblank(
    [f"json_extract_string(raw_json, '$.{k}')" for k in RP.DISPLAY_IP_KEYS] + ["source"]) + ", '-')"
_P9_REGION = "coalesce(" + _sql_first_nonblank(
    [f"json_extract_string(raw_json, '$.{k}')" for k in RP.DISPLAY_REGION_KEYS] + ["source"]) + ", '-')"


@register("alert_source_ip", _REC + f"\nSELECT id, {_P8} AS source_ip_display FROM rec")
def q_alert_source_ip(spark, sf):
    """P8 (+P13 JSON columns): IP picked from the stored raw JSON, else `source`."""
    return records(spark, sf).select("id", RP.extract_ip().alias("source_ip_display"))


@register("alert_region", _REC + f"\nSELECT id, {_P9_IP} AS ip_display, {_P9_REGION} AS region_display FROM rec")
def q_alert_region(spark, sf):
    """Display IP and region with non-blank candidates and '-' fallback."""
    return records(spark, sf).select("id", RP.display_ip().alias("ip_display"),
                                     RP.display_region().alias("region_display"))


_P10 = """CASE WHEN {c} IS NULL OR {c} = '' THEN '-'
     WHEN contains({c}, '/') THEN CASE WHEN (string_split({c}, '/'))[-1] <> '' THEN (string_split({c}, '/'))[-1]
                                         ELSE {c} END
     ELSE {c} END"""


@register("entity_short", _REC + f"""
SELECT id, {_P10.format(c='entity_id')} AS entity_display, {_P10.format(c='role_arn')} AS role_display,
       {_P10.format(c="(role_arn || '/')")} AS role_slash_display
FROM (SELECT rec.*, s.role_arn FROM rec JOIN sec s ON s.event_id = rec.id) x""")
def q_entity_short(spark, sf):
    """P10: entity display names (ARN tails)."""
    r = records(spark, sf)
    arn = sec_events(spark, sf).select(F.col("event_id").alias("id"), "role_arn")
    r = r.join(arn, "id")
    return r.select("id", RP.entity_short("entity_id").alias("entity_display"),
                    RP.entity_short("role_arn").alias("role_display"),
                    RP.entity_short(F.concat("role_arn", F.lit("/"))).alias("role_slash_display"))


_IDV = "CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'custom:' || event_type ELSE identifier_type END"


@register("identifier_label", _REC + f"""
SELECT id, CASE WHEN ({_IDV}) IS NULL OR ({_IDV}) = '' THEN 'Fused'
  WHEN starts_with(lower({_IDV}), 'rule:') THEN 'Rule' WHEN starts_with(lower({_IDV}), 'graph:') THEN 'Graph'
  WHEN starts_with(lower({_IDV}), 'ti:') THEN 'Threat Intel' WHEN starts_with(lower({_IDV}), 'seq:') THEN 'Sequence'
  WHEN starts_with(lower({_IDV}), 'ueba:') THEN 'UEBA' WHEN starts_with(lower({_IDV}), 'fused:') THEN 'Fused'
  ELSE {_IDV} END AS identifier_label FROM rec""")
def q_identifier_label(spark, sf):
    """P11 (inputs varied by id: empty, unknown prefix, stored identifier)."""
    r = records(spark, sf)
    v = (F.when(F.col("id") % 5 == 0, F.lit(""))
         .when(F.col("id") % 5 == 1, F.concat(F.lit("custom:"), "event_type"))
         .otherwise(F.col("identifier_type")))
    return r.select("id", RP.identifier_label(v).alias("identifier_label"))


_SEV_RAW = ("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(severity, 1, 1) WHEN 2 THEN upper(severity) "
            "ELSE severity END")


@register("severity_display", _REC + f"""
SELECT id, CASE WHEN ({_SEV_RAW}) IS NULL OR ({_SEV_RAW}) = '' THEN
                  CASE WHEN coalesce(final_score, 0) > 0.7 THEN 'high'
                       WHEN coalesce(final_score, 0) >= 0.4 THEN 'medium' ELSE 'low' END
                WHEN lower({_SEV_RAW}) IN ('high', 'h') THEN 'high'
                WHEN lower({_SEV_RAW}) IN ('medium', 'med', 'm') THEN 'medium' ELSE 'low' END AS severity_display
FROM rec""")
def q_severity_display(spark, sf):
    """Stored severity normalised (abbreviations, case), else from the score."""
    r = records(spark, sf)
    raw = (F.when(F.col("id") % 4 == 0, F.lit(None).cast("string"))
           .when(F.col("id") % 4 == 1, F.substring("severity", 1, 1))
           .when(F.col("id") % 4 == 2, F.upper("severity")).otherwise(F.col("severity")))
    return r.select("id", RP.severity_display(raw, "final_score").alias("severity_display"))


@register("alerts_by_label", _REC + "\nSELECT id, label FROM rec WHERE label = 'normal'")
def q_alerts_by_label(spark, sf):
    """Label filter."""
    return records(spark, sf).filter(F.col("label") == "normal").select("id", "label")


UPSERT_IDENTITY, UPSERT_VERSION = ["source", "entity_type", "entity_id", "event_type"], "updated_ts"


def deliveries(spark, sf):
    """Records, and a later version of every 20th."""
    r = records(spark, sf).select("id", *UPSERT_IDENTITY, "final_score", "label", UPSERT_VERSION)
    again = (r.filter(F.col("id") % 20 == 0)
             .withColumn("source", F.lit("replay"))
             .withColumn("final_score", F.least(F.col("final_score") + F.lit(0.1), F.lit(1.0)))
             .withColumn("label", F.lit("problem"))
             .withColumn("updated_ts", F.col("updated_ts") + F.expr("INTERVAL 1 HOUR")))
    return r.unionByName(again)


@register("event_upsert", _REC + """,
deliveries AS (
  SELECT id, source, entity_type, entity_id, event_type, final_score, label, updated_ts FROM rec
  UNION ALL
  SELECT id, 'replay', entity_type, entity_id, event_type, least(final_score + 0.1::DOUBLE, 1.0::DOUBLE),
         'problem', updated_ts + INTERVAL 1 HOUR FROM rec WHERE id % 20 = 0
)
SELECT id, arg_min(source, updated_ts) AS source, arg_min(entity_type, updated_ts) AS entity_type,
       arg_min(entity_id, updated_ts) AS entity_id, arg_min(event_type, updated_ts) AS event_type,
       round(arg_max(final_score, updated_ts), 6) AS final_score, arg_max(label, updated_ts) AS label,
       max(updated_ts) AS updated_ts
FROM deliveries GROUP BY id""")
def q_event_upsert(spark, sf):
    """A1: upsert by id over a batch with re-deliveries (every 20th id updated)."""
    return rounded(RP.event_upsert(deliveries(spark, sf), "id", UPSERT_IDENTITY, UPSERT_VERSION))


@register("recent_alerts", _REC + """
SELECT id, entity_id, event_type, round(final_score, 6) AS final_score, severity, label, alert_ts
FROM rec WHERE detected ORDER BY alert_ts DESC, id DESC LIMIT 10""")
def q_recent_alerts(spark, sf):
    """A3: ten most recent alerts."""
    a = records(spark, sf).filter("detected")
    return rounded(RP.top_k(a, 10, F.col("alert_ts").desc(), F.col("id").desc())
                   .select("id", "entity_id", "event_type", "final_score", "severity", "label", "alert_ts"))


@register("latest_alerts", _REC + f"""
SELECT id, entity_id, event_type, severity, round(final_score, 6) AS final_score, {_P8} AS source_ip_display,
       alert_ts FROM rec WHERE detected ORDER BY alert_ts DESC NULLS LAST, id DESC LIMIT 200""")
def q_latest_alerts(spark, sf):
    """A5 (+A6): latest 200 alerts, falling back to latest events when none."""
    r = records(spark, sf)
    out = RP.latest_alerts(r.filter("detected"), r, 200)
    return rounded(out.select("id", "entity_id", "event_type", "severity", "final_score",
                              RP.extract_ip().alias("source_ip_display"), "alert_ts"))


@register("health_summary", _REC + f"""
SELECT max(coalesce(alert_ts, updated_ts, ingest_ts)) AS last_event_ts,
  count(CASE WHEN updated_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE AND updated_ts <= TIMESTAMP '{AS_OF}'
        THEN 1 END) AS events_in_window,
  round(coalesce(avg(CASE WHEN updated_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE
                          AND updated_ts <= TIMESTAMP '{AS_OF}' THEN coalesce(final_score, 0.0) END), 0.0), 6)
    AS mean_score_in_window,
  count(CASE WHEN detected THEN 1 END) AS alerts_total
FROM rec""")
def q_health(spark, sf):
    """A7 + A8 + A10: system-health document as of a fixed instant."""
    return RP.health_summary(records(spark, sf), AS_OF, 60)


@register("alerts_by_severity", _REC + """
SELECT coalesce(severity, 'unknown') AS severity, count(*) AS n FROM rec WHERE detected GROUP BY 1""")
def q_alerts_by_severity(spark, sf):
    """A9."""
    return RP.alerts_by_severity(records(spark, sf).filter("detected"))


@register("dash_severity", _REC + f"""
SELECT severity_display, count(*) AS n FROM (
  SELECT CASE WHEN ({_SEV_RAW}) IS NULL OR ({_SEV_RAW}) = '' THEN
                  CASE WHEN coalesce(final_score, 0) > 0.7 THEN 'high'
                       WHEN coalesce(final_score, 0) >= 0.4 THEN 'medium' ELSE 'low' END
              WHEN lower({_SEV_RAW}) IN ('high', 'h') THEN 'high'
              WHEN lower({_SEV_RAW}) IN ('medium', 'med', 'm') THEN 'medium' ELSE 'low' END AS severity_display
  FROM rec) GROUP BY 1""")
def q_dash_severity(spark, sf):
    """Dashboard counts by displayed severity (all stored records)."""
    r = records(spark, sf)
    raw = (F.when(F.col("id") % 4 == 0, F.lit(None).cast("string"))
           .when(F.col("id") % 4 == 1, F.substring("severity", 1, 1))
           .when(F.col("id") % 4 == 2, F.upper("severity")).otherwise(F.col("severity")))
    return (r.select(RP.severity_display(raw, "final_score").alias("severity_display"))
            .groupBy("severity_display").agg(F.count(F.lit(1)).alias("n")))


@register("top_entities", _REC + """
SELECT coalesce(entity_id, 'unknown') AS entity_id, count(*) AS n FROM rec WHERE detected
GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 5""")
def q_top_entities(spark, sf):
    """Top five entities by alert count."""
    return RP.top_by_count(records(spark, sf).filter("detected"), "entity_id", 5)


@register("top_event_types", _REC + """
SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n FROM rec WHERE detected
GROUP BY 1 ORDER BY n DESC, event_type LIMIT 5""")
def q_top_event_types(spark, sf):
    """Top five event types by alert count."""
    return RP.top_by_count(records(spark, sf).filter("detected"), "event_type", 5)


@register("risk_trend", _REC + """
SELECT date_trunc('day', ts) AS window_start, count(*) AS n_events, count(CASE WHEN detected THEN 1 END) AS n_alerts,
       round(avg(final_score), 6) AS mean_score, round(max(final_score), 6) AS max_score
FROM rec GROUP BY 1""")
def q_risk_trend(spark, sf):
    """Daily risk evolution."""
    return rounded(RP.risk_trend(records(spark, sf), "1 day"))


@register("alert_cube", _REC + """
SELECT entity_type, severity, count(*) AS n, CAST(GROUPING(entity_type, severity) AS BIGINT) AS gid
FROM rec WHERE detected GROUP BY CUBE (entity_type, severity)""")
def q_alert_cube(spark, sf):
    """cube(entity_type, severity) alert totals."""
    out = RP.alert_cube(records(spark, sf).filter("detected"))
    return out.withColumn("gid", F.col("gid").cast("bigint"))


@register("alert_detail", _REC + f"""
SELECT id, entity_id, event_type, severity, raw_json, label FROM rec WHERE id = {DETAIL_ID}""")
def q_alert_detail(spark, sf):
    """One alert by id with its raw JSON (top-1 of A5 when the id is absent)."""
    r = records(spark, sf)
    hit = r.filter(F.col("id") == DETAIL_ID)
    if hit.isEmpty():
        hit = RP.latest_alerts(r.filter("detected"), r, 1)
    return hit.select("id", "entity_id", "event_type", "severity", "raw_json", "label")


AS_OF_2 = "2024-01-10 12:00:00"


@register("health_summary_ingest", _REC + f"""
SELECT max(coalesce(alert_ts, updated_ts, ingest_ts)) AS last_event_ts,
  count(CASE WHEN ingest_ts >= TIMESTAMP '{AS_OF_2}' - INTERVAL 120 MINUTE AND ingest_ts <= TIMESTAMP '{AS_OF_2}'
        THEN 1 END) AS events_in_window,
  round(coalesce(avg(CASE WHEN ingest_ts >= TIMESTAMP '{AS_OF_2}' - INTERVAL 120 MINUTE
                          AND ingest_ts <= TIMESTAMP '{AS_OF_2}' THEN coalesce(final_score, 0.0) END), 0.0), 6)
    AS mean_score_in_window,
  count(CASE WHEN detected THEN 1 END) AS alerts_total
FROM rec""")
def q_health_ingest(spark, sf):
    """The health document windowed on ingest time (2 h)."""
    return RP.health_summary(records(spark, sf), AS_OF_2, 120, time_col="ingest_ts")

"""Detection-chain queries: P5, J1-J3, J6, W1-W6, R1-R17, A2."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.functions import rules as R
from nightjar.operators import enrich, sessions
from nightjar.plans import detect as D
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, RULE_CASE, SEC_EVENTS, with_
from nightjar.functions.joins import values_table


def detected(spark, sf):
    return D.detect(sec_events(spark, sf), ti_table(spark))


@register("detect", with_(DETECT) + "\nSELECT * REPLACE (round(rule_score, 6) AS rule_score, "
          "round(ueba_score, 6) AS ueba_score, round(seq_score, 6) AS seq_score, round(ti_score, 6) AS ti_score, "
          "round(online_score, 6) AS online_score, round(corr_score, 6) AS corr_score, "
          "round(fused_score, 6) AS fused_score, round(final_score, 6) AS final_score, "
          "round(threshold, 6) AS threshold) FROM det")
def q_detect(spark, sf):
    """R17 flagship: every event with its detection record."""
    return rounded(detected(spark, sf))


@register("alerts", with_(DETECT) + """
SELECT event_id, ts, entity_id, event_type, round(final_score, 6) AS final_score, severity, identifier_type,
       alert_ts FROM det WHERE detected""")
def q_alerts(spark, sf):
    """A2: alert rows are the problem detections."""
    return rounded(D.alerts(detected(spark, sf)).select(
        "event_id", "ts", "entity_id", "event_type", "final_score", "severity", "identifier_type", "alert_ts"))


@register("normalize_events", with_(SEC_EVENTS) + """
SELECT event_id, ts, source, entity_type, entity_id, event_type, source_ip AS geo_ip,
  CASE WHEN event_type IN ('IAMPolicyChange','EC2StartInstances') THEN 'high'
       WHEN event_type = 'AuthFailure' THEN 'medium' ELSE 'low' END AS severity_hint, ts + INTERVAL 5 SECOND AS ingest_ts
FROM sec""")
def q_normalize(spark, sf):
    """P5."""
    ev = D.normalize(sec_events(spark, sf), ingest_ts=F.col("ts") + F.expr("INTERVAL 5 SECONDS"))
    return ev.select("event_id", "ts", "source", "entity_type", "entity_id", "event_type",
                     F.col("source_ip").alias("geo_ip"), "severity_hint", "ingest_ts")


@register("ti_enrich", with_(SEC_EVENTS) + """
SELECT event_id, source_ip, round(coalesce(ti.ip_reputation, 0.0::DOUBLE), 6) AS ti_score
FROM sec LEFT JOIN (SELECT '9.10.11.12' AS ip, 0.9::DOUBLE AS ip_reputation) ti ON sec.source_ip = ti.ip""")
def q_ti(spark, sf):
    """J1 + R8."""
    return rounded(enrich.ti_enrich(sec_events(spark, sf), ti_table(spark)).select(
        "event_id", "source_ip", "ti_score"))


@register("session_running", with_(DETECT) + """
SELECT event_id, entity_id, session_count, session_unique FROM det""")
def q_session_running(spark, sf):
    """W1 + W3."""
    return sessions.session_running(sec_events(spark, sf), region_col=None).select(
        "event_id", "entity_id", "session_count", "session_unique")


@register("impossible_travel", with_(DETECT) + """
SELECT event_id, entity_id, region, prev_login_region,
       prev_login_region IS NOT NULL AND region <> prev_login_region AS travel
FROM det WHERE lower(event_type) LIKE '%consolelogin%'""")
def q_travel(spark, sf):
    """Previous login region per entity; the travel flag R1 uses."""
    s = sessions.session_running(sec_events(spark, sf))
    return (s.filter(F.lower("event_type").contains("consolelogin"))
            .select("event_id", "entity_id", "region", "prev_login_region",
                    (F.col("prev_login_region").isNotNull() & (F.col("region") != F.col("prev_login_region")))
                    .alias("travel")))


@register("rule_scores", with_(DETECT) + """
SELECT event_type, round(rule_score, 6) AS rule_score, count(*) AS n FROM det GROUP BY 1, 2""")
def q_rule_scores(spark, sf):
    """Rule-score distribution by event type (every branch is hit)."""
    d = detected(spark, sf)
    return rounded(d.groupBy("event_type", "rule_score").agg(F.count(F.lit(1)).alias("n")))


@register("fused_score", with_(DETECT) + """
SELECT event_id, round(fused_score, 6) AS fused_score, round(final_score, 6) AS final_score, label FROM det""")
def q_fused(spark, sf):
    """R9 + R11 + R12."""
    return rounded(detected(spark, sf).select("event_id", "fused_score", "final_score", "label"))


@register("fused_mean", with_(DETECT) + """
SELECT event_id, round((rule_score + ueba_score + seq_score + ti_score) / 4.0, 6) AS fused_mean FROM det""")
def q_fused_mean(spark, sf):
    """Fallback mean of the non-null components."""
    d = detected(spark, sf)
    return rounded(d.select("event_id", R.mean_fusion("rule_score", "ueba_score", "seq_score", "ti_score")
                            .alias("fused_mean")))


@register("final_score", with_(DETECT) + """
SELECT label, severity, count(*) AS n, round(avg(final_score), 6) AS mean_final,
       round(max(final_score), 6) AS max_final FROM det GROUP BY 1, 2""")
def q_final(spark, sf):
    """R11-R14 summary: label x severity."""
    d = detected(spark, sf)
    return rounded(d.groupBy("label", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.avg("final_score").alias("mean_final"),
        F.max("final_score").alias("max_final")))


@register("identify_alert", with_(DETECT) + """
SELECT identifier_type, severity, count(*) AS n FROM det WHERE detected GROUP BY 1, 2""")
def q_identify(spark, sf):
    """R13 + R14 over alerts."""
    return detected(spark, sf).filter("detected").groupBy("identifier_type", "severity").agg(
        F.count(F.lit(1)).alias("n"))


@register("explain_components", with_(DETECT) + """
SELECT event_id, round(rule_score, 6) AS c_rule, round(ueba_score, 6) AS c_ueba, round(seq_score, 6) AS c_seq,
       round(ti_score, 6) AS c_ti, 0.4::DOUBLE AS w_rule, 0.25::DOUBLE AS w_ueba, 0.2::DOUBLE AS w_seq,
       0.15::DOUBLE AS w_ti FROM det WHERE detected""")
def q_explain_components(spark, sf):
    """Components and weights of each alert."""
    from nightjar.operators.fusion import explain_components
    return rounded(explain_components(detected(spark, sf).filter("detected")))


@register("explain_shapley", with_(DETECT) + """,
contrib AS (
  SELECT event_id, 'rule' AS feature, 0.4::DOUBLE * rule_score AS phi FROM det WHERE detected
  UNION ALL SELECT event_id, 'ueba', 0.25::DOUBLE * ueba_score FROM det WHERE detected
  UNION ALL SELECT event_id, 'seq', 0.2::DOUBLE * seq_score FROM det WHERE detected
  UNION ALL SELECT event_id, 'ti', 0.15::DOUBLE * ti_score FROM det WHERE detected
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY phi DESC, feature) AS r FROM contrib
)
SELECT event_id, feature AS top_feature, round(phi, 6) AS top_phi,
       round(sum(phi) OVER (PARTITION BY event_id), 6) AS total_phi
FROM ranked QUALIFY r = 1""")
def q_explain_shapley(spark, sf):
    """R16 (re-aimed): exact Shapley values of the linear fusion, top driver per alert."""
    from nightjar.operators.fusion import shapley_top
    return rounded(shapley_top(detected(spark, sf).filter("detected")))


@register("ti_corroborated", with_(DETECT) + """
SELECT event_id, round(CASE WHEN greatest(rule_score, ueba_score, seq_score) >= 0.5 THEN ti_score
                       ELSE 0.0 END, 6) AS ti_gated FROM det WHERE ti_score > 0""")
def q_ti_corroborated(spark, sf):
    """Intel gated by internal corroboration."""
    d = detected(spark, sf).filter(F.col("ti_score") > 0)
    return rounded(enrich.ti_corroborated(d).select("event_id", "ti_gated"))


@register("ip_prefix_match", with_(SEC_EVENTS) + """,
cidr AS (SELECT * FROM (VALUES ('5.199.0.0/16'), ('9.10.11.0/24'), ('10.0.7.0/24')) t(cidr))
SELECT event_id, source_ip, cidr AS matched_cidr,
       coalesce(source_ip, '') LIKE '5.199%' AS prefix_rule
FROM sec LEFT JOIN cidr ON
  CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT)
  BETWEEN
  (CAST(split_part(split_part(cidr, '/', 1), '.', 1) AS BIGINT) * 16777216
   + CAST(split_part(split_part(cidr, '/', 1), '.', 2) AS BIGINT) * 65536
   + CAST(split_part(split_part(cidr, '/', 1), '.', 3) AS BIGINT) * 256
   + CAST(split_part(split_part(cidr, '/', 1), '.', 4) AS BIGINT))
  AND
  (CAST(split_part(split_part(cidr, '/', 1), '.', 1) AS BIGINT) * 16777216
   + CAST(split_part(split_part(cidr, '/', 1), '.', 2) AS BIGINT) * 65536
   + CAST(split_part(split_part(cidr, '/', 1), '.', 3) AS BIGINT) * 256
   + CAST(split_part(split_part(cidr, '/', 1), '.', 4) AS BIGINT))
   + (1 << (32 - CAST(split_part(cidr, '/', 2) AS INTEGER))) - 1""")
def q_ip_prefix(spark, sf):
    """The 5.199 prefix rule, and its table form as a CIDR range join."""
    cidrs = values_table(spark, [("5.199.0.0/16",), ("9.10.11.0/24",), ("10.0.7.0/24",)], "cidr string")
    ev = sec_events(spark, sf).select("event_id", "source_ip")
    out = enrich.ip_prefix_match(ev, cidrs)
    return out.select("event_id", "source_ip", F.col("cidr").alias("matched_cidr"),
                      F.coalesce(F.col("source_ip"), F.lit("")).startswith("5.199").alias("prefix_rule"))


@register("entities_no_alert", with_(DETECT) + """
SELECT DISTINCT entity_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM det a WHERE a.detected
  AND a.entity_id = d.entity_id)""")
def q_entities_no_alert(spark, sf):
    """Entities that never raised an alert (anti join)."""
    d = detected(spark, sf)
    return enrich.entities_without(d.select("entity_id").distinct(), d.filter("detected"))


@register("last_n_events", with_(SEC_EVENTS) + """
SELECT event_id, entity_id, array_to_string(list(event_type) OVER (PARTITION BY entity_id ORDER BY ts, event_id
  ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), ',') AS last_events FROM sec""")
def q_last_n(spark, sf):
    """Last 40 event types per entity (comma-joined)."""
    out = sessions.last_n_events(sec_events(spark, sf), n=40)
    return out.select("event_id", "entity_id", F.array_join("last_events", ",").alias("last_events"))


_GAP_SQL = """,
g1 AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id) IS NULL
                   OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id))
                      >= {gap}::BIGINT * 1000000 THEN 1 ELSE 0 END AS brk FROM sec),
g2 AS (SELECT *, sum(brk) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS sno FROM g1)
SELECT entity_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, min(ts) AS session_start,
       max(ts) AS session_last FROM g2 GROUP BY entity_id, sno"""


@register("session_gap", with_(SEC_EVENTS) + _GAP_SQL.format(gap=900))
def q_session_gap(spark, sf):
    """Gap sessions with the reference's 900 s."""
    return sessions.gap_sessions(sec_events(spark, sf), 900)


@register("session_gap_6h", with_(SEC_EVENTS) + _GAP_SQL.format(gap=21600))
def q_session_gap_6h(spark, sf):
    """W2 with a 6 h gap so multi-event sessions are exercised at small scale."""
    return sessions.gap_sessions(sec_events(spark, sf), 21600)


@register("last_event", with_(SEC_EVENTS) + """,
live AS (SELECT * FROM sec WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
                              AND ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 3600 SECOND)
SELECT entity_type, entity_id, arg_max(event_id, (ts, event_id)) AS event_id,
       max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM live GROUP BY 1, 2""")
def q_last_event(spark, sf):
    """Last event per entity with a 1 h TTL as of a fixed instant."""
    ev = sec_events(spark, sf).select("entity_type", "entity_id", "ts", "event_id", "event_type")
    out = sessions.latest_per_entity(ev, "2024-01-15 12:00:00", 3600)
    return out.select("entity_type", "entity_id", "event_id", "ts", "event_type")

"""The closed loop: learned weights and threshold in detection (R9, R12, F1, F7),
drift and policy events through the chain (D4, D9), template ids on records
(T1-T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import drift as DR
from nightjar.operators import feedback as FB
from nightjar.plans import detect as D
from nightjar.plans import queries_drift as QD
from nightjar.plans import queries_feedback as QF
from nightjar.plans import queries_templates as QT
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, SEC_EVENTS, with_

POLICY_TS = "1999-01-01 00:00:00"


def _body(sql: str) -> str:
    """CTEs of a WITH clause without its keyword."""
    return sql.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH").strip()


_ADAPTIVE = "WITH RECURSIVE " + ",\n".join([_body(QF._FB), _body(QF._FED), DETECT.strip(), f"""
tp AS (SELECT event_id, {QT._mask_sql("coalesce(nullif(details, ''), event_type)")} AS template FROM sec),
lw AS (SELECT r / d AS w_rule, u / d AS w_ueba, q / d AS w_seq, t / d AS w_ti
       FROM (SELECT *, CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END AS d FROM w4) x),
lt2 AS (SELECT t / 100.0 AS th FROM h WHERE rn = (SELECT max(rn) FROM h)),
ad AS (SELECT det.*, w_rule * rule_score + w_ueba * ueba_score + w_seq * seq_score + w_ti * ti_score AS fused2, th
       FROM det CROSS JOIN lw CROSS JOIN lt2),
ad2 AS (SELECT *, least(greatest(0.0::DOUBLE, fused2, rule_score, ueba_score, seq_score, ti_score, online_score,
                                 corr_score), 1.0::DOUBLE) AS final2 FROM ad)"""])


@register("detect_adaptive", _ADAPTIVE + f"""
SELECT event_id, {QT._TID} AS template_id, round(fused2, 6) AS fused_score, round(final2, 6) AS final_score,
       round(th, 6) AS threshold, final2 > th AS detected,
       CASE WHEN final2 > th THEN 'problem' ELSE 'normal' END AS label
FROM ad2 JOIN tp USING (event_id)""")
def q_detect_adaptive(spark, sf):
    """R9/R12 learned: fusion weights from the federated mean (F7), threshold
    from the analysts' feedback (F1); the template id (T3) is on the record."""
    learned = D.learned_settings(QF.feedback_rows(spark, sf), QF.fed_updates(spark, sf))
    det = D.detect(D.with_template(sec_events(spark, sf)), ti_table(spark), **learned)
    return rounded(det.select("event_id", "template_id", "fused_score", "final_score", "threshold", "detected", "label"))


def later_feedback(spark, sf):
    """Every fifth event's verdict, given an hour after it."""
    ev = QF.feedback_rows(spark, sf).where(F.col("event_id") % 5 == 0)
    return ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))


def rare_updates(spark, sf):
    """Weight vectors that clients send with every seventh event."""
    return QF.fed_updates(spark, sf).where(F.col("event_id") % 7 == 0)


_WEIGHTS = """
up AS (SELECT user_id % 8 AS client_id, ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS un
       FROM events WHERE event_id % 7 = 0),
cl AS (SELECT DISTINCT client_id FROM up),
at_ AS (SELECT up.un, up.ts, up.event_id, cl.client_id FROM up CROSS JOIN cl),
lat AS (SELECT at_.un, at_.ts, at_.event_id, p.event_id AS eid FROM at_ ASOF JOIN up p
        ON at_.client_id = p.client_id AND at_.un >= p.un),
mean AS (SELECT un, any_value(ts) AS ts, any_value(event_id) AS event_id, dim, avg(((eid * (dim + 1)) % 7)::DOUBLE) AS weight
         FROM (SELECT * FROM lat WHERE eid % 13 <> 0), (SELECT range AS dim FROM range(10)) d GROUP BY un, dim),
sc2 AS (SELECT *, (weight - min(weight) OVER (PARTITION BY un))
                  / (max(weight) OVER (PARTITION BY un) - min(weight) OVER (PARTITION BY un) + 0.000001::DOUBLE) AS s FROM mean),
w0 AS (SELECT up.un, up.ts, up.event_id, count(s) AS n, max(CASE WHEN dim = 0 THEN s END) AS r, max(CASE WHEN dim = 1 THEN s END) AS u,
              max(CASE WHEN dim = 2 THEN s END) AS q, max(CASE WHEN dim = 3 THEN s END) AS t
       FROM up LEFT JOIN sc2 USING (un) GROUP BY ALL),
wh AS (SELECT un, ts, event_id,
         CASE WHEN n = 0 THEN 0.4 ELSE r / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END END::DOUBLE AS w_rule,
         CASE WHEN n = 0 THEN 0.25 ELSE u / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END END::DOUBLE AS w_ueba,
         CASE WHEN n = 0 THEN 0.2 ELSE q / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END END::DOUBLE AS w_seq,
         CASE WHEN n = 0 THEN 0.15 ELSE t / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END END::DOUBLE AS w_ti
       FROM w0)"""


@register("weights_history", f"""WITH {_WEIGHTS}
SELECT ts, event_id, round(w_rule, 6) AS w_rule, round(w_ueba, 6) AS w_ueba, round(w_seq, 6) AS w_seq,
       round(w_ti, 6) AS w_ti FROM wh""")
def q_weights_history(spark, sf):
    """F6/F7 over time: the fusion weights after each client's update."""
    return rounded(FB.weights_history(rare_updates(spark, sf)))


_ASOF = "WITH RECURSIVE " + ",\n".join(["""
fb AS (SELECT ts + INTERVAL 1 HOUR AS ts, event_id, event_id % 3 = 0 AS problem,
              row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_id % 5 = 0),
h(rn, t) AS (SELECT 0::BIGINT, 70 UNION ALL
             SELECT h.rn + 1, CASE WHEN fb.problem THEN greatest(10, h.t - 1) ELSE least(99, h.t + 1) END
             FROM h JOIN fb ON fb.rn = h.rn + 1)""", _WEIGHTS.strip(), DETECT.strip(), """
th AS (SELECT ts, arg_max(t, rn) / 100.0::DOUBLE AS threshold_then FROM h JOIN fb USING (rn) GROUP BY ts),
wt AS (SELECT ts, arg_max(w_rule, un) AS w_rule, arg_max(w_ueba, un) AS w_ueba, arg_max(w_seq, un) AS w_seq,
              arg_max(w_ti, un) AS w_ti FROM wh GROUP BY ts),
j1 AS (SELECT det.*, th.threshold_then FROM det ASOF LEFT JOIN th ON det.ts > th.ts),
j2 AS (SELECT j1.*, coalesce(threshold_then, 0.7::DOUBLE) AS th, coalesce(w_rule, 0.4::DOUBLE) AS wr,
              coalesce(w_ueba, 0.25::DOUBLE) AS wu, coalesce(w_seq, 0.2::DOUBLE) AS wq, coalesce(w_ti, 0.15::DOUBLE) AS wti
       FROM j1 ASOF LEFT JOIN wt ON j1.ts > wt.ts),
j3 AS (SELECT *, wr * rule_score + wu * ueba_score + wq * seq_score + wti * ti_score AS fused2 FROM j2),
j4 AS (SELECT *, least(greatest(0.0::DOUBLE, fused2, rule_score, ueba_score, seq_score, ti_score, online_score,
                                corr_score), 1.0::DOUBLE) AS final2 FROM j3)"""])


@register("detect_asof", _ASOF + """
SELECT event_id, round(fused2, 6) AS fused_score, round(final2, 6) AS final_score, round(th, 6) AS threshold,
       final2 > th AS detected, CASE WHEN final2 > th THEN 'problem' ELSE 'normal' END AS label,
       CASE WHEN final2 > th THEN ts END AS alert_ts
FROM j4""")
def q_detect_asof(spark, sf):
    """R9/R12 as of event time: every event is judged by the threshold and the
    weights in force just before it."""
    det = D.detect_asof(sec_events(spark, sf), ti_table(spark), later_feedback(spark, sf), rare_updates(spark, sf))
    return rounded(det.select("event_id", "fused_score", "final_score", "threshold", "detected", "label", "alert_ts"))


_SERVICE = ",\n".join([_body(QD._SNAP), _body(QD._POL).replace("s AS (SELECT s_suppkey", "sup AS (SELECT s_suppkey")
                       .replace("FROM s WHERE", "FROM sup WHERE").replace("FROM s,", "FROM sup,")
                       .replace("FROM s\n", "FROM sup\n"), f"""
sec AS (
  SELECT drift_id AS event_id, snapshot_ts AS ts, 'config_drift_service' AS source, 'infrastructure' AS entity_type,
         source AS entity_id, 'ConfigDrift' AS event_type, CAST(NULL AS VARCHAR) AS region,
         CAST(NULL AS VARCHAR) AS source_ip, CAST(NULL AS VARCHAR) AS policy, CAST(NULL AS VARCHAR) AS bucket,
         CAST(NULL AS VARCHAR) AS role_arn, 'low' AS hint FROM rec WHERE changed
  UNION ALL
  SELECT concat_ws('-', 'pv', CAST(record_id AS VARCHAR), issue, subject, coalesce(action, CAST(port AS VARCHAR), ''), pos),
         TIMESTAMP '{POLICY_TS}', 'policy_drift_service', 'infrastructure', CAST(record_id AS VARCHAR),
         'PolicyViolation', NULL, NULL, NULL, NULL, NULL, 'high' FROM f
)""", DETECT[len(SEC_EVENTS):].strip().removeprefix(",").strip()])


@register("detect_drift", f"""WITH {_SERVICE}
SELECT det.event_id, det.ts, det.source, det.entity_type, det.entity_id, det.event_type, sec.hint AS severity_hint,
       session_count, session_unique, round(final_score, 6) AS final_score, label, severity
FROM det JOIN sec ON sec.event_id = det.event_id""")
def q_detect_drift(spark, sf):
    """D4 + D9 into R17: drift and policy events through the detection chain."""
    snaps = QD.snapshots(spark, sf)
    drift = DR.drift_events(DR.drift_records(snaps, DR.config_diff(snaps)))
    violations = DR.violation_events(DR.policy_findings(QD.configs(spark, sf)), F.lit(POLICY_TS).cast("timestamp_ntz"))
    det = D.detect(D.service_events(drift, violations), ti_table(spark))
    return rounded(det.select("event_id", "ts", "source", "entity_type", "entity_id", "event_type", "severity_hint",
                              "session_count", "session_unique", "final_score", "label", "severity"))

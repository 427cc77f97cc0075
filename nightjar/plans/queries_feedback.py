"""Feedback / response / federated queries (F1-F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import feedback as FB
from nightjar.plans import detect as D
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, with_
from nightjar.sources.tables import table
from nightjar.functions.joins import values_table

SEED = 42
PLAYBOOK = [("high", "ti", "block_ip"), ("high", "rule", "isolate_host"), ("high", "fused", "collect_forensics"),
            ("medium", "rule", "notify"), ("medium", "fused", "notify")]


def feedback_rows(spark, sf):
    """Analyst verdicts in time order: 'problem' when event_id % 3 = 0."""
    ev = table(spark, sf, "events")
    return ev.select("ts", "event_id", F.when(F.col("event_id") % 3 == 0, F.lit("problem"))
                     .otherwise(F.lit("normal")).alias("label"))


_FB = """
WITH RECURSIVE fb AS (
  SELECT ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'problem' ELSE 'normal' END AS label,
         row_number() OVER (ORDER BY ts, event_id) AS rn FROM events
),
h(rn, t) AS (
  SELECT 0::BIGINT, 70
  UNION ALL
  SELECT h.rn + 1, CASE WHEN fb.label = 'problem' THEN greatest(10, h.t - 1) ELSE least(99, h.t + 1) END
  FROM h JOIN fb ON fb.rn = h.rn + 1
)"""


@register("threshold_history", _FB + """
SELECT fb.ts, fb.event_id, fb.label, round(h.t / 100.0, 6) AS new_threshold FROM h JOIN fb ON fb.rn = h.rn""")
def q_threshold_history(spark, sf):
    """threshold after each feedback (parallel associative scan)."""
    return rounded(FB.threshold_history(feedback_rows(spark, sf)))


@register("threshold_final", _FB + """
SELECT round(t / 100.0, 6) AS threshold, (SELECT count(*) FROM fb) AS n_feedback FROM h
WHERE rn = (SELECT max(rn) FROM h)""")
def q_threshold_final(spark, sf):
    """final threshold after all feedback."""
    return rounded(FB.threshold_final(feedback_rows(spark, sf)))


def outcomes(spark, sf):
    ev = table(spark, sf, "events")
    acts = F.element_at(F.array(*[F.lit(a) for a in FB.ACTIONS]), ((F.col("event_id") % 3) + 1).cast("int"))
    return ev.select("event_id", acts.alias("action"), (F.col("event_id") % 5 == 0).cast("int").alias("reward"))


_Q = """
WITH oc AS (SELECT event_id, (['notify','collect_forensics','isolate_host'])[event_id % 3 + 1] AS action,
                   CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS reward FROM events),
acts AS (SELECT * FROM (VALUES ('notify', 0), ('collect_forensics', 1), ('isolate_host', 2)) t(action, action_order)),
q AS (SELECT a.action, a.action_order, coalesce(k, 0) AS n_updates,
             coalesce(s / (k + 1)::DOUBLE, 0.0::DOUBLE) AS q_value
      FROM acts a LEFT JOIN (SELECT action, sum(reward) AS s, count(*) AS k FROM oc GROUP BY 1) x ON x.action = a.action),
g AS (SELECT action AS greedy_action, q_value FROM q ORDER BY q_value DESC, action_order LIMIT 1)"""


@register("action_values", _Q + "\nSELECT action, action_order, n_updates, round(q_value, 6) AS q_value FROM q")
def q_action_values(spark, sf):
    """bandit action values."""
    return rounded(FB.action_values(outcomes(spark, sf)))


@register("greedy_action", _Q + f""",
hh AS (SELECT event_id, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':{SEED}'), 1, 8) AS BIGINT) AS h
       FROM events)
SELECT event_id, h % 1000 < 100 AS explored,
       CASE WHEN h % 1000 < 100 THEN (['notify','collect_forensics','isolate_host'])[(h // 1000) % 3 + 1]
            ELSE (SELECT greedy_action FROM g) END AS action
FROM hh""")
def q_greedy(spark, sf):
    """epsilon-greedy action per event with seeded-hash exploration."""
    vals = FB.action_values(outcomes(spark, sf))
    return FB.choose_actions(table(spark, sf, "events"), vals, seed=SEED)


@register("response_actions", with_(DETECT) + """,
pb AS (SELECT * FROM (VALUES ('high', 'ti', 'block_ip'), ('high', 'rule', 'isolate_host'),
                             ('high', 'fused', 'collect_forensics'), ('medium', 'rule', 'notify'),
                             ('medium', 'fused', 'notify')) t(pb_severity, pb_prefix, response)),
j AS (SELECT d.*, pb.response FROM det d JOIN pb ON d.severity = pb.pb_severity
      AND split_part(d.identifier_type, ':', 1) = pb.pb_prefix WHERE d.detected)
SELECT entity_id, date_trunc('hour', alert_ts) AS hour_start, response,
       arg_min(event_id, (alert_ts, event_id)) AS first_event_id, count(*) AS n_alerts
FROM j GROUP BY 1, 2, 3""")
def q_response(spark, sf):
    """playbook actions per entity and hour (deduplicated)."""
    det = D.alerts(D.detect(sec_events(spark, sf), ti_table(spark)))
    pb = values_table(spark, PLAYBOOK, "pb_severity string, pb_prefix string, response string")
    return FB.response_actions(det, pb)


def fed_updates(spark, sf):
    ev = table(spark, sf, "events")
    vec = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: (F.col("event_id") * i) % 7)
    return ev.select((F.col("user_id") % 8).alias("client_id"), "ts", "event_id",
                     F.when(F.col("event_id") % 13 == 0, F.array().cast("array<bigint>")).otherwise(vec)
                     .alias("weights"))


_FED = """
WITH lt AS (SELECT user_id % 8 AS client_id, arg_max(event_id, (ts, event_id)) AS eid FROM events GROUP BY 1),
ok AS (SELECT * FROM lt WHERE eid % 13 <> 0),
fm AS (SELECT d.dim, avg(((ok.eid * (d.dim + 1)) % 7)::DOUBLE) AS weight
       FROM ok CROSS JOIN (SELECT range AS dim FROM range(10)) d GROUP BY d.dim),
st AS (SELECT min(weight) AS mn, max(weight) AS mx FROM fm),
sc AS (SELECT dim, (weight - mn) / (mx - mn + 0.000001::DOUBLE) AS s FROM fm CROSS JOIN st),
w4 AS (SELECT coalesce(max(CASE WHEN dim = 0 THEN s END), 0.4) AS r, coalesce(max(CASE WHEN dim = 1 THEN s END), 0.25) AS u,
              coalesce(max(CASE WHEN dim = 2 THEN s END), 0.2) AS q, coalesce(max(CASE WHEN dim = 3 THEN s END), 0.15) AS t
       FROM sc)"""


@register("federated_mean", _FED + "\nSELECT CAST(dim AS INTEGER) AS dim, round(weight, 6) AS weight FROM fm")
def q_fed_mean(spark, sf):
    """mean of each client's latest non-empty update."""
    return rounded(FB.federated_mean(fed_updates(spark, sf)))


@register("federated_weights", _FED + """
SELECT round(r / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END, 6) AS w_rule,
       round(u / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END, 6) AS w_ueba,
       round(q / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END, 6) AS w_seq,
       round(t / CASE WHEN r + u + q + t = 0 THEN 1.0 ELSE r + u + q + t END, 6) AS w_ti FROM w4""")
def q_fed_weights(spark, sf):
    """fusion weights from the federated mean."""
    return rounded(FB.federated_weights(FB.federated_mean(fed_updates(spark, sf))))


def feedback_table(spark, sf):
    ev = table(spark, sf, "events")
    first = ev.select("event_id", F.lit("a1").alias("analyst"),
                      F.when(F.col("event_id") % 3 == 0, F.lit("problem")).otherwise(F.lit("normal"))
                      .alias("feedback_label"),
                      (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_ts"))
    second = ev.filter(F.col("event_id") % 10 == 0).select(
        "event_id", F.lit("a2").alias("analyst"),
        F.when(F.col("event_id") % 3 == 0, F.lit("normal")).otherwise(F.lit("problem")).alias("feedback_label"),
        (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("feedback_ts"))
    return first.unionByName(second)


@register("feedback_agreement", with_(DETECT) + """,
fb AS (
  SELECT event_id, 'a1' AS analyst, CASE WHEN event_id % 3 = 0 THEN 'problem' ELSE 'normal' END AS feedback_label,
         ts + INTERVAL 1 HOUR AS feedback_ts FROM events
  UNION ALL
  SELECT event_id, 'a2', CASE WHEN event_id % 3 = 0 THEN 'normal' ELSE 'problem' END, ts + INTERVAL 2 HOUR
  FROM events WHERE event_id % 10 = 0
),
lf AS (SELECT event_id, arg_max(feedback_label, (feedback_ts, analyst)) AS feedback_label FROM fb GROUP BY 1)
SELECT feedback_label, count(*) AS n_feedback, CAST(sum(CASE WHEN feedback_label = d.label THEN 1 ELSE 0 END) AS BIGINT)
       AS n_agree, round(sum(CASE WHEN feedback_label = d.label THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS agreement
FROM lf LEFT JOIN det d USING (event_id) GROUP BY 1""")
def q_feedback_agreement(spark, sf):
    """F8: latest analyst verdict vs detection label."""
    det = D.detect(sec_events(spark, sf), ti_table(spark))
    return rounded(FB.feedback_agreement(feedback_table(spark, sf), det))

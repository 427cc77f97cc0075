"""Sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import sequences as SQ
from nightjar.operators import sessions
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events
from nightjar.plans.oracle_sql import SEC_EVENTS, with_
from nightjar.sources.tables import table

CHAIN = ["signup", "view", "click", "purchase"]
CHAIN_NAME = "signup_to_purchase"
LIMIT_S = 3 * 86400

_ENC = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {i + 1}" for i, e in enumerate(SQ.EVENT_VOCAB)) + " ELSE 0 END"


def windows(spark, sf):
    w = sessions.last_n_events(sec_events(spark, sf), n=40)
    return w.withColumn("prev_type", F.when(F.size("last_events") >= 2, F.element_at("last_events", -2)))


@register("seq_encode", with_(SEC_EVENTS) + f""",
enc AS (SELECT event_id, entity_id, ts, {_ENC} AS type_id FROM sec)
SELECT event_id, type_id, array_to_string(list(type_id) OVER (PARTITION BY entity_id ORDER BY ts, event_id
       ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), ',') AS seq_ids FROM enc""")
def q_seq_encode(spark, sf):
    """Q1: vocabulary ids of the event and of its last-40 window."""
    w = windows(spark, sf)
    return w.select("event_id", SQ.encode(F.col("event_type")).alias("type_id"),
                    F.array_join(SQ.encode_list(F.col("last_events")).cast("array<string>"), ",").alias("seq_ids"))


def _surprise_sql(etype: str = "event_type") -> str:
    return with_(SEC_EVENTS) + f""",
sx AS (SELECT event_id, entity_id, ts, coalesce({etype}, 'UnknownEvent') AS etype FROM sec),
s1 AS (SELECT *, lag(etype) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS prev_type FROM sx),
vv AS (SELECT count(DISTINCT etype) AS v FROM sx),
tc AS (SELECT prev_type, etype, count(*) AS c FROM s1 WHERE prev_type IS NOT NULL GROUP BY 1, 2),
fp AS (SELECT prev_type, sum(c) AS cp FROM tc GROUP BY 1),
tp AS (SELECT tc.prev_type, tc.etype, (c + 1) / (cp + v)::DOUBLE AS p FROM tc JOIN fp USING (prev_type)
       CROSS JOIN vv),
s2 AS (SELECT s1.*, -ln(tp.p) AS nl FROM s1 LEFT JOIN tp ON tp.prev_type = s1.prev_type AND tp.etype = s1.etype),
s3 AS (SELECT event_id, avg(nl) OVER w38 AS ms, max(CASE WHEN etype = 'MaliciousAction' THEN 1 ELSE 0 END) OVER w39 > 0
       AS malicious FROM s2
       WINDOW w38 AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 38 PRECEDING AND CURRENT ROW),
              w39 AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
sc AS (SELECT event_id, ms, malicious, coalesce(1.0 - 1.0 / (1.0 + ms), 0.0) AS seq_score FROM s3)"""


_SURPRISE = _surprise_sql()
#: Types with gaps, and a malicious one now and then.
_SPARSE = "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 211 = 0 THEN 'MaliciousAction' ELSE event_type END"


def surprise(spark, sf):
    return SQ.sequence_surprise(sec_events(spark, sf))


@register("seq_surprise", _SURPRISE + """
SELECT event_id, round(ms, 6) AS mean_surprise, malicious, round(seq_score, 6) AS seq_score FROM sc""")
def q_seq_surprise(spark, sf):
    """Q2 (re-aimed): transition-surprise score of the last 40 events."""
    return rounded(surprise(spark, sf))


@register("seq_surprise_sparse", _surprise_sql(_SPARSE) + """
SELECT event_id, round(ms, 6) AS mean_surprise, malicious, round(seq_score, 6) AS seq_score FROM sc""")
def q_seq_surprise_sparse(spark, sf):
    """Q2 with missing types (they count as UnknownEvent) and malicious ones."""
    return rounded(SQ.sequence_surprise(sec_events(spark, sf).withColumn("event_type", F.expr(_SPARSE))))


@register("seq_summary", _SURPRISE + """
SELECT count(*) AS n, round(avg(seq_score), 6) AS mean_score, round(max(seq_score), 6) AS max_score FROM sc""")
def q_seq_summary(spark, sf):
    """Q6: sequence-score summary."""
    s = surprise(spark, sf)
    return rounded(s.agg(F.count(F.lit(1)).alias("n"), F.avg("seq_score").alias("mean_score"),
                         F.max("seq_score").alias("max_score")))


def _chain_sql() -> str:
    parts = ["""
WITH ev AS (SELECT user_id, ts, event_id, event_type FROM events),
c1 AS (SELECT event_id AS anchor_id, user_id, ts AS start_ts, ts AS t1 FROM ev WHERE event_type = 'signup')"""]
    for i, step in enumerate(CHAIN[1:], start=2):
        parts.append(f"""
a{i} AS (SELECT c.*, x.ts AS nx FROM c{i-1} c ASOF LEFT JOIN (SELECT user_id, ts FROM ev WHERE event_type = '{step}') x
         ON c.user_id = x.user_id AND c.t{i-1} < x.ts),
c{i} AS (SELECT * EXCLUDE (nx), CASE WHEN nx <= t{i-1} + INTERVAL {LIMIT_S} SECOND THEN nx END AS t{i} FROM a{i})""")
    n = len(CHAIN)
    depth = "1 + " + " + ".join(
        "CASE WHEN " + " AND ".join(f"t{j} IS NOT NULL" for j in range(2, i + 1)) + " THEN 1 ELSE 0 END"
        for i in range(2, n + 1))
    last = "coalesce(" + ", ".join(f"t{i}" for i in range(n, 0, -1)) + ")"
    parts.append(f"""
pr AS (SELECT anchor_id, user_id, start_ts, {depth} AS depth, {last} AS last_ts FROM c{n}),
best AS (SELECT user_id, arg_max(depth, (depth, -epoch_us(start_ts), -anchor_id)) AS steps_reached,
                arg_max(start_ts, (depth, -epoch_us(start_ts), -anchor_id)) AS start_ts, arg_max(last_ts, (depth, -epoch_us(start_ts), -anchor_id)) AS last_ts
         FROM pr GROUP BY user_id)""")
    return ",".join(parts)


@register("chain_match", _chain_sql() + "\nSELECT user_id, steps_reached, start_ts, last_ts FROM best")
def q_chain_match(spark, sf):
    """Q4 (re-aimed): longest in-order prefix of signup -> view -> click -> purchase, 3-day step limit."""
    return SQ.chain_match(table(spark, sf, "events"), CHAIN, limit_seconds=LIMIT_S)


@register("chain_coverage", _chain_sql() + f""",
steps AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(CHAIN))}) t(step_no, action)),
reached AS (SELECT b.user_id, b.start_ts, b.last_ts, '{CHAIN_NAME}' AS chain, s.step_no FROM best b
            JOIN steps s ON s.step_no <= b.steps_reached),
cov AS (SELECT chain, step_no, count(DISTINCT user_id) AS n_entities, min(start_ts) AS first_ts, max(last_ts) AS last_ts
        FROM reached GROUP BY ROLLUP (chain, step_no))
SELECT cov.step_no, chain, n_entities, first_ts, last_ts, steps.action FROM cov LEFT JOIN steps USING (step_no)""")
def q_chain_coverage(spark, sf):
    """Q5: coverage of the chain by step, with rollup totals."""
    m = SQ.chain_match(table(spark, sf, "events"), CHAIN, limit_seconds=LIMIT_S)
    return SQ.chain_coverage(m, CHAIN, CHAIN_NAME).withColumn("step_no", F.col("step_no").cast("int"))


@register("mitre_tag", with_(SEC_EVENTS) + """,
tags AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{t}')" for a, t in SQ.PHISH_CHAIN) + """) t(action, technique))
SELECT event_id, event_type, technique FROM sec LEFT JOIN tags ON tags.action = sec.event_type""")
def q_mitre(spark, sf):
    """MITRE technique of each event's step name."""
    from nightjar.operators.enrich import mitre_tag
    ev = sec_events(spark, sf).select("event_id", "event_type")
    return mitre_tag(ev, SQ.mitre_tags(spark)).select("event_id", "event_type", "technique")

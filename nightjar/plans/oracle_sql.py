"""DuckDB oracle SQL fragments shared by the catalog.

The oracles restate each operator in plain SQL over the driver tables, the
straightforward way (whole-table windows, no skew handling). Decimal literals
are cast to DOUBLE so both engines compute in binary floating point.
"""

from __future__ import annotations

# DuckDB lists are 1-based: wheel[(x % n) + 1].
SEC_EVENTS = """
sec0 AS (
  SELECT event_id, ts, props, 'cloudtrail' AS source, 'user' AS entity_type,
         'user_' || CAST(user_id AS VARCHAR) AS entity_id,
         (['ConsoleLogin','ConsoleLogin','ConsoleLogin','ListBuckets','CreateUser','PutBucketPolicy',
           'GetObject','AssumeRole','S3GetObject','IAMPolicyChange','EC2StartInstances','AuthFailure',
           'ProcessStart'])[event_id % 13 + 1] AS event_type,
         (['us-east-1','us-east-1','us-east-1','us-east-1','eu-west-1','eu-west-1','ap-south-1'])[event_id % 7 + 1]
           AS region,
         CASE WHEN event_id % 11 = 0 THEN '9.10.11.12'
              WHEN event_id % 11 = 1 THEN '5.199.' || CAST(user_id % 256 AS VARCHAR) || '.1'
              ELSE '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) END
           AS source_ip
  FROM events
),
sec AS (
  SELECT event_id, ts, source, entity_type, entity_id, event_type, region, source_ip,
         CASE WHEN event_type = 'PutBucketPolicy' THEN
              CASE WHEN event_id % 3 = 0 THEN 'public-read' ELSE 'private' END END AS policy,
         CASE WHEN event_type IN ('GetObject','S3GetObject') THEN
              CASE WHEN event_id % 2 = 0 THEN 'secure-logs' ELSE 'data' END END AS bucket,
         CASE WHEN event_type = 'AssumeRole' THEN
              CASE WHEN event_id % 2 = 0 THEN 'arn:aws:iam::123456789012:role/Admin'
                   ELSE 'arn:aws:iam::123456789012:role/PowerUser' END END AS role_arn,
         'Simulated ' || event_type || ' by ' || entity_id || ' from ' || source_ip || ' ' || props AS details,
         props
  FROM sec0
)"""

RULE_CASE = """
CASE WHEN lower(event_type) LIKE '%consolelogin%' THEN
          CASE WHEN coalesce(source_ip, '') LIKE '5.199%' THEN 0.9::DOUBLE
               WHEN prev_login_region IS NOT NULL AND region IS NOT NULL AND region <> prev_login_region
                 THEN 0.7::DOUBLE
               ELSE 0.1::DOUBLE END
     WHEN lower(event_type) LIKE '%listbuckets%' THEN 0.2::DOUBLE
     WHEN lower(event_type) LIKE '%createuser%' THEN 0.6::DOUBLE
     WHEN lower(event_type) LIKE '%putbucketpolicy%' THEN
          CASE WHEN coalesce(policy, '') LIKE '%public-read%' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END
     WHEN lower(event_type) LIKE '%getobject%' THEN
          CASE WHEN coalesce(bucket, '') = 'secure-logs' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END
     WHEN lower(event_type) LIKE '%assumerole%' THEN
          CASE WHEN coalesce(role_arn, '') LIKE '%Admin%' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END
     ELSE 0.0::DOUBLE END"""

# W1/W5 + J1 + rules + fusion over sec, components zero: the `det` CTE.
DETECT = SEC_EVENTS + """,
s1 AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, event_type ORDER BY ts, event_id) AS rn_t,
         lower(event_type) LIKE '%consolelogin%' AS is_login
  FROM sec
),
s2 AS (
  SELECT *,
    count(*) OVER (PARTITION BY entity_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_count,
    CAST(sum(CASE WHEN rn_t = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_unique,
    CASE WHEN is_login THEN lag(region) OVER (PARTITION BY entity_id, is_login ORDER BY ts, event_id) END
      AS prev_login_region
  FROM s1
),
ti AS (SELECT '9.10.11.12' AS ip, 0.9::DOUBLE AS ip_reputation),
s3 AS (
  SELECT s2.*, coalesce(ti.ip_reputation, 0.0::DOUBLE) AS ti_score,
    CASE WHEN event_type IN ('IAMPolicyChange','EC2StartInstances') THEN 'high'
         WHEN event_type = 'AuthFailure' THEN 'medium' ELSE 'low' END AS severity_hint
  FROM s2 LEFT JOIN ti ON s2.source_ip = ti.ip
),
s4 AS (
  SELECT *, """ + RULE_CASE + """ AS rule_score,
    0.0::DOUBLE AS ueba_score, 0.0::DOUBLE AS seq_score, 0.0::DOUBLE AS online_score, 0.0::DOUBLE AS corr_score
  FROM s3
),
s5 AS (
  SELECT *, 0.4::DOUBLE * rule_score + 0.25::DOUBLE * ueba_score + 0.2::DOUBLE * seq_score
            + 0.15::DOUBLE * ti_score AS fused_score
  FROM s4
),
s6 AS (
  SELECT *, least(greatest(0.0::DOUBLE, greatest(fused_score, rule_score, ueba_score, seq_score, ti_score,
                                                   online_score, corr_score)), 1.0::DOUBLE) AS final_score
  FROM s5
),
det AS (
  SELECT event_id, ts, coalesce(nullif(source, ''), nullif(region, '')) AS source, entity_type, entity_id,
    event_type, region, source_ip, severity_hint, session_count, session_unique, prev_login_region,
    rule_score, ueba_score, seq_score, ti_score, online_score, corr_score, fused_score, final_score,
    0.7::DOUBLE AS threshold,
    CASE WHEN final_score > 0.7::DOUBLE THEN 'problem' ELSE 'normal' END AS label,
    final_score > 0.7::DOUBLE AS detected,
    CASE WHEN ti_score > 0.5 THEN 'ti:ip_reputation' WHEN rule_score >= 0.8 THEN 'rule:iam_change'
         WHEN corr_score >= 0.5 THEN 'graph:correlation' WHEN seq_score >= 0.5 THEN 'seq:anomaly'
         WHEN ueba_score >= 0.5 THEN 'ueba:score' ELSE 'fused:combination' END AS identifier_type,
    CASE WHEN final_score > 0.7 THEN 'high' WHEN final_score >= 0.4 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN final_score > 0.7::DOUBLE THEN ts END AS alert_ts
  FROM s6
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())

# Stored-record view of `det` (alert_records in fixtures.py).
RECORDS = """
rec AS (
  SELECT event_id AS id, *, ts AS updated_ts, ts AS ingest_ts,
    '{"eventName":"' || event_type || '",' ||
    CASE event_id % 6
      WHEN 0 THEN '"awsRegion":"' || region || '","sourceIPAddress":"' || source_ip || '"'
      WHEN 1 THEN '"aws_region":"' || region || '","source_ip":"' || source_ip || '"'
      WHEN 2 THEN '"region":"' || region || '","clientIp":"' || source_ip || '"'
      WHEN 3 THEN '"geo":{"region":"' || region || '"},"requestParameters":{"ip":"' || source_ip || '"}'
      WHEN 4 THEN '"sourceIpAddress":"  ","ip_address":"' || source_ip || '"'
      ELSE '"note":"none"' END || '}' AS raw_json
  FROM det
)"""

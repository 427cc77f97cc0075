"""Configuration-drift queries (D1-D4) over monthly per-nation snapshots built
from orders, and policy checks (D5-D9) over per-supplier config documents.

The oracles compute the expected diffs/findings directly from the relational
aggregates (no JSON), an independent check of the JSON flatten + diff path.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import drift as DR
from nightjar.plans.catalog import register
from nightjar.plans.fixtures import order_snapshots, supplier_configs
from nightjar.sources.tables import table


def snapshots(spark, sf):
    return order_snapshots(table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation"))


def configs(spark, sf):
    return supplier_configs(table(spark, sf, "supplier"))


_SNAP = """
WITH o AS (
  SELECT n_name AS source, date_trunc('month', o_orderdate) AS snapshot_ts, o_orderstatus, o_totalprice,
         o_orderpriority
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
),
snap AS (SELECT source, snapshot_ts, count(*) AS cnt, max(o_totalprice) > 300000 AS hv FROM o GROUP BY 1, 2),
st AS (SELECT source, snapshot_ts, o_orderstatus AS status, count(*) AS n FROM o GROUP BY 1, 2, 3),
pr AS (SELECT source, snapshot_ts, o_orderpriority AS p FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 2),
pairs0 AS (SELECT source, snapshot_ts, lag(snapshot_ts) OVER (PARTITION BY source ORDER BY snapshot_ts) AS prev_ts
           FROM snap),
pairs AS (SELECT * FROM pairs0 WHERE prev_ts IS NOT NULL),
cur AS (SELECT p.source, p.snapshot_ts, p.prev_ts, n.cnt AS ncnt, n.hv AS nhv, o.cnt AS ocnt, o.hv AS ohv
        FROM pairs p JOIN snap n ON n.source = p.source AND n.snapshot_ts = p.snapshot_ts
        JOIN snap o ON o.source = p.source AND o.snapshot_ts = p.prev_ts),
diff AS (
  SELECT source, snapshot_ts, 'values_changed' AS change_type, 'root[''orders'']' AS path,
         CAST(ocnt AS VARCHAR) AS old_value, CAST(ncnt AS VARCHAR) AS new_value FROM cur WHERE ocnt <> ncnt
  UNION ALL
  SELECT source, snapshot_ts,
         CASE WHEN (ocnt % 2 = 0) <> (ncnt % 2 = 0) THEN 'type_changes' ELSE 'values_changed' END, 'root[''band'']',
         CASE WHEN ocnt % 2 = 0 THEN '"even"' ELSE CAST(ocnt AS VARCHAR) END,
         CASE WHEN ncnt % 2 = 0 THEN '"even"' ELSE CAST(ncnt AS VARCHAR) END
  FROM cur WHERE (ocnt % 2 = 0) <> (ncnt % 2 = 0) OR (ocnt % 2 = 1 AND ncnt % 2 = 1 AND ocnt <> ncnt)
  UNION ALL
  SELECT source, snapshot_ts, 'values_changed', 'root[''high_value'']', CAST(ohv AS VARCHAR), CAST(nhv AS VARCHAR)
  FROM cur WHERE ohv <> nhv
  UNION ALL
  SELECT q.source, q.snapshot_ts,
         CASE WHEN o.n IS NULL THEN 'dictionary_item_added' WHEN n.n IS NULL THEN 'dictionary_item_removed'
              ELSE 'values_changed' END,
         'root[''status''][''' || coalesce(n.status, o.status) || ''']', CAST(o.n AS VARCHAR), CAST(n.n AS VARCHAR)
  FROM pairs q
  JOIN (SELECT q2.source, q2.snapshot_ts, n2.status FROM pairs q2
          JOIN st n2 ON n2.source = q2.source AND n2.snapshot_ts = q2.snapshot_ts
        UNION
        SELECT q2.source, q2.snapshot_ts, o2.status FROM pairs q2
          JOIN st o2 ON o2.source = q2.source AND o2.snapshot_ts = q2.prev_ts) ks
    ON ks.source = q.source AND ks.snapshot_ts = q.snapshot_ts
  LEFT JOIN st n ON n.source = q.source AND n.snapshot_ts = q.snapshot_ts AND n.status = ks.status
  LEFT JOIN st o ON o.source = q.source AND o.snapshot_ts = q.prev_ts AND o.status = ks.status
  WHERE o.n IS NULL OR n.n IS NULL OR o.n <> n.n
  UNION ALL
  SELECT q.source, q.snapshot_ts, 'iterable_item_added', 'root[''priorities'']', NULL, '"' || n.p || '"'
  FROM pairs q JOIN pr n ON n.source = q.source AND n.snapshot_ts = q.snapshot_ts
  WHERE NOT EXISTS (SELECT 1 FROM pr o WHERE o.source = q.source AND o.snapshot_ts = q.prev_ts AND o.p = n.p)
  UNION ALL
  SELECT q.source, q.snapshot_ts, 'iterable_item_removed', 'root[''priorities'']', '"' || o.p || '"', NULL
  FROM pairs q JOIN pr o ON o.source = q.source AND o.snapshot_ts = q.prev_ts
  WHERE NOT EXISTS (SELECT 1 FROM pr n WHERE n.source = q.source AND n.snapshot_ts = q.snapshot_ts AND n.p = o.p)
),
rec AS (
  SELECT 'drift-' || strftime(p.snapshot_ts, '%Y%m%dT%H%M%S') || '-' || p.source AS drift_id, p.source, p.prev_ts,
         p.snapshot_ts, coalesce(d.n, 0) > 0 AS changed, coalesce(d.n, 0) AS n_changes
  FROM pairs p LEFT JOIN (SELECT source, snapshot_ts, count(*) AS n FROM diff GROUP BY 1, 2) d
    ON d.source = p.source AND d.snapshot_ts = p.snapshot_ts
)"""


@register("snapshot_pairs", _SNAP + "\nSELECT source, prev_ts, snapshot_ts FROM pairs")
def q_pairs(spark, sf):
    """Consecutive snapshot pairs per source."""
    return DR.snapshot_pairs(snapshots(spark, sf))


@register("config_diff", _SNAP + "\nSELECT source, snapshot_ts, change_type, path, old_value, new_value FROM diff")
def q_config_diff(spark, sf):
    """Order-insensitive deep diff of each snapshot against the previous one."""
    return DR.config_diff(snapshots(spark, sf))


@register("drift_records", _SNAP + "\nSELECT * FROM rec")
def q_drift_records(spark, sf):
    """D1 + D3: drift records (id, changed flag, number of changes)."""
    s = snapshots(spark, sf)
    return DR.drift_records(s, DR.config_diff(s))


@register("drift_events", _SNAP + """
SELECT drift_id AS event_id, snapshot_ts AS ts, 'config_drift_service' AS source, 'infrastructure' AS entity_type,
       source AS entity_id, 'ConfigDrift' AS event_type, 'low' AS severity_hint FROM rec WHERE changed""")
def q_drift_events(spark, sf):
    """ConfigDrift events."""
    s = snapshots(spark, sf)
    return DR.drift_events(DR.drift_records(s, DR.config_diff(s)))


_DEEP = [f"level{i}" for i in range(1, 11)]
_DEEP_PATH = "root" + "".join(f"['{k}']" for k in _DEEP)


@register("config_diff_deep", f"""
WITH snap AS (SELECT n_name AS source, date_trunc('month', o_orderdate) AS snapshot_ts, count(*) AS cnt
              FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
d AS (SELECT *, lag(cnt) OVER (PARTITION BY source ORDER BY snapshot_ts) AS before FROM snap)
SELECT source, snapshot_ts, 'values_changed' AS change_type, '{_DEEP_PATH.replace("'", "''")}[''orders'']' AS path,
       CAST(before AS VARCHAR) AS old_value, CAST(cnt AS VARCHAR) AS new_value
FROM d WHERE before <> cnt""")
def q_config_diff_deep(spark, sf):
    """D2 eleven levels below the root."""
    s = snapshots(spark, sf)
    inner = F.concat(F.lit('{"orders":'), F.get_json_object("content", "$.orders"), F.lit("}"))
    for k in reversed(_DEEP):
        inner = F.concat(F.lit(f'{{"{k}":'), inner, F.lit("}"))
    return DR.config_diff(s.withColumn("content", inner))


def group_snapshots(spark, sf):
    """Snapshots whose groups, one per order status, are a list of objects with
    a nested list. Every second month turns both lists round."""
    o = (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
         .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    month = F.make_timestamp_ntz(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    st = o.groupBy(F.col("n_name").alias("source"), month.alias("snapshot_ts"), "o_orderstatus").agg(F.count("*").alias("n"))
    odd = F.month("snapshot_ts") % 2 == 1
    tags = F.concat(*[F.concat(F.lit(f',"tag{i}":"'), F.col("o_orderstatus"), F.lit(f'-{i}"')) for i in range(1, 5)])
    group = F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit(',"nest":'),
                     F.when(odd, F.lit('[["z","y"],"x"]')).otherwise(F.lit('["x",["y","z"]]')),
                     F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"'), tags, F.lit("}"))
    st = st.groupBy("source", "snapshot_ts").agg(F.sort_array(F.collect_list(group)).alias("g"))
    groups = F.when(odd, F.reverse("g")).otherwise(F.col("g"))
    return st.select("source", "snapshot_ts", F.concat(F.lit('{"groups":['), F.array_join(groups, ","), F.lit("]}")).alias("content"))


@register("config_diff_groups", _SNAP + """,
obj AS (SELECT source, snapshot_ts, status, n, month(snapshot_ts) % 2 = 1 AS odd,
               '{"n":' || n || ',"nest":' || CASE WHEN month(snapshot_ts) % 2 = 1 THEN '[["z","y"],"x"]' ELSE '["x",["y","z"]]' END
               || ',"status":"' || status || '","tag1":"' || status || '-1","tag2":"' || status || '-2","tag3":"' || status
               || '-3","tag4":"' || status || '-4"}' AS t FROM st),
pos AS (SELECT *, CASE WHEN odd THEN row_number() OVER (PARTITION BY source, snapshot_ts ORDER BY t DESC)
                       ELSE row_number() OVER (PARTITION BY source, snapshot_ts ORDER BY t) END - 1 AS i FROM obj)
SELECT q.source, q.snapshot_ts, 'values_changed' AS change_type, 'root[''groups''][' || o.i || '][''n'']' AS path,
       CAST(o.n AS VARCHAR) AS old_value, CAST(n.n AS VARCHAR) AS new_value
FROM pairs q JOIN pos n ON n.source = q.source AND n.snapshot_ts = q.snapshot_ts
JOIN pos o ON o.source = q.source AND o.snapshot_ts = q.prev_ts AND o.status = n.status WHERE o.n <> n.n
UNION ALL
SELECT q.source, q.snapshot_ts, 'iterable_item_added', 'root[''groups'']', NULL, n.t
FROM pairs q JOIN pos n ON n.source = q.source AND n.snapshot_ts = q.snapshot_ts
WHERE NOT EXISTS (SELECT 1 FROM pos o WHERE o.source = q.source AND o.snapshot_ts = q.prev_ts AND o.status = n.status)
UNION ALL
SELECT q.source, q.snapshot_ts, 'iterable_item_removed', 'root[''groups'']', o.t, NULL
FROM pairs q JOIN pos o ON o.source = q.source AND o.snapshot_ts = q.prev_ts
WHERE NOT EXISTS (SELECT 1 FROM pos n WHERE n.source = q.source AND n.snapshot_ts = q.snapshot_ts AND n.status = o.status)""")
def q_config_diff_groups(spark, sf):
    """D2 in lists of objects: reordered lists are no change, changed objects are compared inside."""
    return DR.config_diff(group_snapshots(spark, sf))


_POL = """
WITH s AS (SELECT s_suppkey AS k, s_name FROM supplier),
f AS (
  SELECT k AS record_id, 's3_public_bucket' AS issue, 'bucket-' || CAST(k AS VARCHAR) AS subject,
         CAST(NULL AS VARCHAR) AS action, CAST(NULL AS INTEGER) AS port, '0' AS pos FROM s WHERE k % 5 = 0
  UNION ALL
  SELECT k, 's3_overpermissive_policy', 'bucket-' || CAST(k AS VARCHAR), NULL, NULL, '0-0-0' FROM s
  WHERE k % 7 <> 0 AND k % 3 <> 2
  UNION ALL
  SELECT k, 'iam_privilege_escalation', s_name, a, NULL, '0-0-0-' || CAST(i AS VARCHAR) FROM s,
    (SELECT unnest(['iam:CreateUser']) AS a, 0 AS m, 0 AS i UNION ALL SELECT 'iam:AttachUserPolicy', 1, 0
     UNION ALL SELECT 'iam:PutUserPolicy', 3, 0 UNION ALL SELECT 'iam:CreateAccessKey', 3, 1) acts
  WHERE k % 3 <> 0 AND k % 4 = acts.m
  UNION ALL
  SELECT k, 'wide_open_ssh_rdp', 'sg-' || CAST(k AS VARCHAR), NULL, CAST(CASE WHEN k % 3 = 0 THEN 22 ELSE 3389 END
         AS INTEGER), '0-0' FROM s WHERE k % 3 IN (0, 1) AND k % 4 <> 2
)"""


@register("policy_s3", _POL + """
SELECT record_id, issue, 'high' AS severity, subject FROM f WHERE issue LIKE 's3%'""")
def q_policy_s3(spark, sf):
    """D5 + D6."""
    f = DR.policy_findings(configs(spark, sf))
    return f.filter(F.col("issue").startswith("s3")).select("record_id", "issue", "severity", "subject")


@register("policy_iam", _POL + """
SELECT record_id, issue, 'high' AS severity, subject, action FROM f WHERE issue LIKE 'iam%'""")
def q_policy_iam(spark, sf):
    """One finding per escalation action."""
    f = DR.policy_findings(configs(spark, sf))
    return f.filter(F.col("issue").startswith("iam")).select("record_id", "issue", "severity", "subject", "action")


@register("policy_sg", _POL + """
SELECT record_id, issue, 'high' AS severity, subject, port FROM f WHERE issue LIKE 'wide%'""")
def q_policy_sg(spark, sf):
    """SSH/RDP open to the world (missing cidr counts as open)."""
    f = DR.policy_findings(configs(spark, sf))
    return f.filter(F.col("issue").startswith("wide")).select("record_id", "issue", "severity", "subject", "port")


@register("policy_findings", _POL + """
SELECT concat_ws('-', 'pv', CAST(record_id AS VARCHAR), issue, subject, coalesce(action, CAST(port AS VARCHAR), ''), pos)
         AS event_id, 'policy_drift_service' AS source, 'infrastructure' AS entity_type,
       CAST(record_id AS VARCHAR) AS entity_id, 'PolicyViolation' AS event_type, issue, 'high' AS severity, subject
FROM f""")
def q_policy_findings(spark, sf):
    """Every finding as a PolicyViolation event with a collision-free id."""
    return DR.violation_events(DR.policy_findings(configs(spark, sf)))

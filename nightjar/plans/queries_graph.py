"""Graph queries (G1-G12) over the entity graph built from events, plus a
customer->part graph from orders x lineitem for volume."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nightjar.functions.components import connected_components
from nightjar.operators import graph as G
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events
from nightjar.plans.oracle_sql import SEC_EVENTS, with_
from nightjar.session import checkpoint_dir
from nightjar.sources.tables import table

CENTER = "user_7"
PR_ROUNDS = 60          # fixed rounds of the oracle, enough for both graphs to settle
PR_TOL = 1e-13

_EDGES = """
gev AS (
  SELECT entity_id AS src, source_ip AS dst, 'used_ip' AS type, ts, event_id FROM sec
  WHERE source_ip IS NOT NULL AND source_ip <> ''
  UNION ALL
  SELECT entity_id, event_type, 'did_event', ts, event_id FROM sec WHERE event_type IS NOT NULL
),
edges AS (
  SELECT src, dst, arg_max(type, (ts, event_id)) AS type, max(ts) AS ts FROM gev WHERE src IS NOT NULL
  GROUP BY src, dst
),
vertices AS (
  SELECT id, arg_min(type, p) AS type FROM (
    SELECT src AS id, 0 AS p, 'entity' AS type FROM edges
    UNION ALL SELECT dst, 1, CASE WHEN type = 'used_ip' THEN 'ip' ELSE 'event_type' END FROM edges)
  GROUP BY id
)"""

_DEG = """
deg AS (
  SELECT v.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree,
         coalesce(i.n, 0) + coalesce(o.n, 0) AS degree
  FROM vertices v
  LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) i ON i.id = v.id
  LEFT JOIN (SELECT src AS id, count(*) AS n FROM edges GROUP BY src) o ON o.id = v.id
)"""


def pagerank_sql(rounds: int, alpha: float = G.DAMPING) -> str:
    """Unrolled power iteration over `edges`/`vertices` CTEs; result CTE `pr`."""
    parts = ["""
pr_out AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
pr_w AS (SELECT e.src, e.dst, 1.0::DOUBLE / o.d AS w FROM edges e JOIN pr_out o ON o.src = e.src),
pr_v AS (SELECT v.id, o.src IS NULL AS dangling FROM vertices v LEFT JOIN pr_out o ON o.src = v.id),
pr_n AS (SELECT count(*)::DOUBLE AS n FROM vertices),
r0 AS (SELECT pr_v.id, pr_v.dangling, 1.0::DOUBLE / pr_n.n AS pr FROM pr_v CROSS JOIN pr_n)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""
r{i} AS (
  SELECT pr_v.id, pr_v.dangling,
    {alpha}::DOUBLE * coalesce(s.inflow, 0.0::DOUBLE)
      + ({alpha}::DOUBLE * (SELECT coalesce(sum(pr), 0.0::DOUBLE) FROM r{i-1} WHERE dangling) / pr_n.n
         + (1.0::DOUBLE - {alpha}::DOUBLE) / pr_n.n) AS pr
  FROM pr_v CROSS JOIN pr_n
  LEFT JOIN (SELECT w.dst AS id, sum(r.pr * w.w) AS inflow FROM pr_w w JOIN r{i-1} r ON r.id = w.src
             GROUP BY w.dst) s ON s.id = pr_v.id
)""")
    parts.append(f"\npr AS (SELECT id, pr AS pagerank FROM r{rounds})")
    return ",".join(parts)


def _graph(spark, sf):
    e = G.build_edges(sec_events(spark, sf))
    return e, G.build_vertices(e)


_G = with_(SEC_EVENTS, _EDGES)


@register("graph_edges", _G + "\nSELECT src, dst, type, ts FROM edges")
def q_edges(spark, sf):
    """G1."""
    return G.build_edges(sec_events(spark, sf))


@register("graph_vertices", _G + "\nSELECT id, type FROM vertices")
def q_vertices(spark, sf):
    """G2."""
    return _graph(spark, sf)[1]


@register("graph_neighbors", _G + f"\nSELECT dst AS neighbor, type, ts FROM edges WHERE src = '{CENTER}'")
def q_neighbors(spark, sf):
    """Out-neighbours of one entity."""
    return G.neighbors(_graph(spark, sf)[0], CENTER)


@register("graph_ego2", _G + f""",
h1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src = '{CENTER}'),
h2 AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN h1 ON e.src = h1.id),
reach AS (SELECT '{CENTER}' AS id UNION SELECT id FROM h1 UNION SELECT id FROM h2)
SELECT src, dst, type, ts FROM edges WHERE src IN (SELECT id FROM reach) AND dst IN (SELECT id FROM reach)""")
def q_ego(spark, sf):
    """Radius-2 ego graph (induced edges)."""
    return G.ego_graph(_graph(spark, sf)[0], CENTER, 2)


@register("graph_degree", with_(SEC_EVENTS, _EDGES, _DEG) + "\nSELECT id, in_degree, out_degree, degree FROM deg")
def q_degree(spark, sf):
    """G5."""
    e, v = _graph(spark, sf)
    return G.degrees(e, v).select("id", "in_degree", "out_degree", "degree")


@register("pagerank", with_(SEC_EVENTS, _EDGES, pagerank_sql(PR_ROUNDS))
          + "\nSELECT id, round(pagerank, 6) AS pagerank FROM pr")
def q_pagerank(spark, sf):
    """PageRank until it settles."""
    e, v = _graph(spark, sf)
    return rounded(G.pagerank(e, v, tol=PR_TOL))


@register("graph_attribution", with_(SEC_EVENTS, _EDGES, _DEG, pagerank_sql(PR_ROUNDS)) + """
SELECT pr.id, round(pagerank, 6) AS pagerank, degree,
       round((pagerank + degree / ((SELECT count(*) FROM vertices) + 1)::DOUBLE) / 2.0, 6) AS attribution
FROM pr JOIN deg ON deg.id = pr.id JOIN vertices v ON v.id = pr.id WHERE v.type = 'entity'""")
def q_attribution(spark, sf):
    """Attribution of entity nodes."""
    e, v = _graph(spark, sf)
    checkpoint_dir(spark)
    v = v.checkpoint()
    n = v.count()
    pr = G.pagerank(e, v, tol=PR_TOL)
    out = G.attribution(pr, G.degrees(e, v), n).join(v.filter(F.col("type") == "entity").select("id"), "id")
    return rounded(out)


_ANOM = """,
st AS (SELECT avg(in_degree) AS mi, stddev_pop(in_degree) AS si, avg(out_degree) AS mo,
              stddev_pop(out_degree) AS so FROM deg),
x AS (SELECT id, CASE WHEN si > 0 THEN (in_degree - mi) / si ELSE 0.0 END AS x0,
             CASE WHEN so > 0 THEN (out_degree - mo) / so ELSE 0.0 END AS x1 FROM deg CROSS JOIN st),
prop AS (SELECT e.src AS id, sum(x.x0) AS a0, sum(x.x1) AS a1 FROM edges e JOIN x ON x.id = e.dst GROUP BY e.src),
h AS (SELECT x.id, coalesce(a0, 0.0) + 0.01::DOUBLE * x0 AS h0, coalesce(a1, 0.0) + 0.01::DOUBLE * x1 AS h1
      FROM x LEFT JOIN prop ON prop.id = x.id),
hm AS (SELECT avg(h0) AS m0, avg(h1) AS m1 FROM h),
anom AS (SELECT id, sqrt((h0 - m0) * (h0 - m0) + (h1 - m1) * (h1 - m1)) AS distance FROM h CROSS JOIN hm)"""


@register("node_anomaly", with_(SEC_EVENTS, _EDGES, _DEG) + _ANOM + """
SELECT id, round(distance, 6) AS distance, round(1.0 - 1.0 / (1.0 + distance), 6) AS score FROM anom""")
def q_node_anomaly(spark, sf):
    """Propagated-degree anomaly per node."""
    e, v = _graph(spark, sf)
    return rounded(G.node_anomaly(e, v))


@register("correlation", with_(SEC_EVENTS, _EDGES, _DEG) + _ANOM + """
SELECT s.entity_id, round(coalesce(1.0 - 1.0 / (1.0 + a.distance), 0.0), 6) AS attribution,
       coalesce(d.out_degree, 0) AS n_neighbors,
       round(coalesce((1.0 - 1.0 / (1.0 + a.distance)) * (1.0 + 0.1 * d.out_degree), 0.0), 6) AS corr_score
FROM (SELECT DISTINCT entity_id FROM sec) s LEFT JOIN anom a ON a.id = s.entity_id
LEFT JOIN deg d ON d.id = s.entity_id""")
def q_correlation(spark, sf):
    """G8 + J4: correlation score per entity."""
    ev = sec_events(spark, sf)
    e = G.build_edges(ev)
    v = G.build_vertices(e)
    return rounded(G.correlation(e, G.node_anomaly(e, v), ev))


@register("graph_summary", with_(SEC_EVENTS, _EDGES, _DEG) + _ANOM + """
SELECT count(*) AS n_nodes, round(avg(1.0 - 1.0 / (1.0 + distance)), 6) AS mean_risk,
       round(max(1.0 - 1.0 / (1.0 + distance)), 6) AS max_risk FROM anom""")
def q_graph_summary(spark, sf):
    """G11."""
    e, v = _graph(spark, sf)
    s = G.node_anomaly(e, v)
    return rounded(s.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("score").alias("mean_risk"),
                         F.max("score").alias("max_risk")))


@register("shared_ip_groups", _G + """
SELECT dst AS ip, count(*) AS n_entities FROM edges WHERE type = 'used_ip' GROUP BY dst HAVING count(*) >= 2""")
def q_shared_ip(spark, sf):
    """G12 (re-aimed): IPs shared by several entities, without all-pairs output."""
    return G.shared_ip_groups(_graph(spark, sf)[0])


_COMPONENTS = """,
ue AS (SELECT DISTINCT src AS entity, dst AS ip FROM edges WHERE type = 'used_ip'),
near AS (SELECT DISTINCT a.entity AS x, b.entity AS y FROM ue a JOIN ue b USING (ip)),
reach AS (SELECT entity AS x, entity AS y FROM ue UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y)
SELECT x AS entity_id, min(y) AS component FROM reach GROUP BY x"""


@register("shared_ip_components", _G.replace("WITH", "WITH RECURSIVE", 1) + _COMPONENTS)
def q_components(spark, sf):
    """Entities connected through shared IPs (component id per entity)."""
    return G.shared_ip_components(_graph(spark, sf)[0])


@register("order_chain_components", """
SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey % 10) AS component FROM orders""")
def q_chain_components(spark, sf):
    """G12 on long paths: each order is linked with the next one of its group of
    customers, so a component is a path of a tenth of all orders."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("g"))
    # The path's order within a group comes from a two-level lag: (group, range of keys).
    o = o.withColumn("_r", F.floor(F.col("o_orderkey") / 4096))
    w = Window.partitionBy("g", "_r").orderBy("o_orderkey")
    last = (o.groupBy("g", "_r").agg(F.max("o_orderkey").alias("_last"))
            .withColumn("_before", F.lag("_last").over(Window.partitionBy("g").orderBy("_r"))))
    e = (o.withColumn("b", F.lag("o_orderkey").over(w)).join(last, ["g", "_r"])
         .select(F.col("o_orderkey").alias("a"), F.coalesce("b", "_before", "o_orderkey").alias("b")))
    found = connected_components(e)
    return (o.select(F.col("o_orderkey").alias("node")).join(found, "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))


_ORDERS_GRAPH = """
oe AS (
  SELECT 'c' || CAST(o.o_custkey AS VARCHAR) AS src, 'p' || CAST(l.l_partkey AS VARCHAR) AS dst,
         'bought' AS type, max(o.o_orderdate) AS ts
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2
),
edges AS (SELECT * FROM oe),
vertices AS (SELECT DISTINCT src AS id FROM edges UNION SELECT DISTINCT dst FROM edges)"""


def orders_graph(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    e = (o.join(li, o.o_orderkey == li.l_orderkey)
         .groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                  F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
         .agg(F.max("o_orderdate").alias("ts"))
         .withColumn("type", F.lit("bought")))
    v = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    return e, v


@register("pagerank_orders", with_(_ORDERS_GRAPH, pagerank_sql(PR_ROUNDS))
          + "\nSELECT id, round(pagerank * 1000, 6) AS pagerank_milli FROM pr")
def q_pagerank_orders(spark, sf):
    """G6 at volume: PageRank on the customer->part purchase graph."""
    e, v = orders_graph(spark, sf)
    pr = G.pagerank(e, v, tol=PR_TOL)
    return rounded(pr.select("id", (F.col("pagerank") * 1000).alias("pagerank_milli")))

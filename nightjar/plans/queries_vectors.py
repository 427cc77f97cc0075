"""Vector queries (V1-V6) over the embeddings table (queries: vec_id % 10 = 0;
modalities: first and second half of each embedding)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import vectors as V
from nightjar.plans import detect as D
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, with_
from nightjar.sources.tables import table

DIM = 64
BATCH = 16


def emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label",
                                                  F.col("embedding").cast("array<double>").alias("vec"))


def split(spark, sf):
    e = emb(spark, sf)
    return e.filter(F.col("vec_id") % 10 != 0), e.filter(F.col("vec_id") % 10 == 0)


_D = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"

_KNN = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT * FROM e WHERE vec_id % 10 <> 0),
q AS (SELECT * FROM e WHERE vec_id % 10 = 0),
d AS (SELECT q.vec_id AS qid, q.label AS qlabel, t.vec_id AS tid, t.label AS tlabel, {_D.format(a='q.v', b='t.v')} AS dist
      FROM q CROSS JOIN t),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d)"""


@register("knn_classify", _KNN + """,
v AS (SELECT qid, qlabel, tlabel, count(*) AS c FROM r WHERE rn <= 3 GROUP BY 1, 2, 3)
SELECT qid AS vec_id, qlabel AS label, arg_max(tlabel, (c, -tlabel)) AS predicted FROM v GROUP BY 1, 2""")
def q_knn(spark, sf):
    """V1: exact 3-NN majority vote (in blocks, no cross join)."""
    train, queries = split(spark, sf)
    pred = V.knn_classify(train, queries, 3)
    return queries.select(F.col("vec_id"), "label").join(pred.withColumnRenamed("q_id", "vec_id"), "vec_id")


@register("knn_recall", """
SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) AS n_queries,
       3 * (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) AS n_true, true AS recalled""")
def q_knn_recall(spark, sf):
    """V1 by hash tables: at least nine of ten of the exact 3 nearest are found."""
    train, queries = split(spark, sf)
    found = V.knn_indexed(train, queries, 3, n_cells=64)
    return V.recall_of(found, V.knn(train, queries, 3)).select(
        "n_queries", "n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("recalled"))


@register("knn_deviation", _KNN + """
SELECT count(*) AS n, round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS max_distance FROM r WHERE rn = 1""")
def q_knn_dev(spark, sf):
    """V2: nearest-neighbour distance, mean and max."""
    train, queries = split(spark, sf)
    return rounded(V.knn_deviation(train, queries))


_EMB = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


@register("embed_mean", _EMB + """,
m AS (SELECT vec_id, list_transform(list_zip(v[1:32], v[33:64]), lambda x: (x[1] + x[2]) / 2.0) AS z FROM e)
SELECT vec_id, round(sqrt(list_sum(list_transform(z, lambda x: x * x))), 6) AS z_norm,
       round(list_sum(z), 6) AS z_sum FROM m""")
def q_embed_mean(spark, sf):
    """V3: two-modality mean embedding (norm and sum reported)."""
    e = emb(spark, sf)
    a, b = V.halves("vec", DIM)
    z = V.embed_mean(a, b)
    return rounded(e.select("vec_id", V.norm(z).alias("z_norm"),
                            F.aggregate(z, F.lit(0.0), lambda acc, x: acc + x).alias("z_sum")))


@register("embedding_anomaly", _EMB + """,
p AS (SELECT e.vec_id, e.label, u.x, u.pos FROM e,
      LATERAL (SELECT unnest(e.v) AS x, generate_subscripts(e.v, 1) AS pos) u),
c AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY 1, 2),
cv AS (SELECT label, list(m ORDER BY pos) AS centroid FROM c GROUP BY 1),
dd AS (SELECT e.vec_id, e.label, e.v, """ + _D.format(a="e.v", b="cv.centroid") + """ AS distance
       FROM e LEFT JOIN cv ON cv.label = e.label)
SELECT vec_id, label, round(distance, 6) AS distance,
       round(CASE WHEN len(v) = 0 THEN 0.0 ELSE 1.0 - 1.0 / (1.0 + distance) END, 6) AS score,
       round(CASE WHEN len(v) = 0 THEN 0.0 ELSE 1.0 - 1.0 / (1.0 + sqrt(list_sum(list_transform(v, lambda x: x * x))))
             END, 6) AS score_norm
FROM dd""")
def q_emb_anomaly(spark, sf):
    """V4: centroid-distance anomaly score (and the norm-only variant)."""
    return rounded(V.embedding_anomaly(emb(spark, sf)))


@register("infonce", _EMB + f""",
n AS (SELECT vec_id, vec_id // {BATCH} AS batch, v[1:32] AS a0, v[33:64] AS b0 FROM e),
nz AS (SELECT vec_id, batch,
         list_transform(a0, lambda x: x / sqrt(list_sum(list_transform(a0, lambda y: y * y)))) AS a,
         list_transform(b0, lambda x: x / sqrt(list_sum(list_transform(b0, lambda y: y * y)))) AS b FROM n),
lg AS (SELECT l.batch, l.vec_id AS i, r.vec_id AS j,
         list_sum(list_transform(list_zip(l.a, r.b), lambda x: x[1] * x[2])) / {V.TEMPERATURE}::DOUBLE AS logit
       FROM nz l JOIN nz r ON l.batch = r.batch),
pi AS (SELECT batch, i, ln(sum(exp(logit))) AS lse, max(CASE WHEN i = j THEN logit END) AS pos FROM lg GROUP BY 1, 2)
SELECT batch, count(*) AS n, round(avg(lse - pos), 6) AS loss FROM pi GROUP BY 1""")
def q_infonce(spark, sf):
    """V5: InfoNCE (temperature 0.5) per batch of 16, in-batch negatives."""
    e = emb(spark, sf)
    a, b = V.halves("vec", DIM)
    e = e.select("vec_id", F.floor(F.col("vec_id") / BATCH).cast("bigint").alias("batch"),
                 a.alias("z1"), b.alias("z2"))
    return rounded(V.info_nce(e, "z1", "z2"))


@register("fusion_summary", with_(DETECT) + """
SELECT count(*) AS n, round(avg(final_score), 6) AS mean_risk, round(max(final_score), 6) AS max_risk FROM det""")
def q_fusion_summary(spark, sf):
    """V6: mean and max fused risk."""
    d = D.detect(sec_events(spark, sf), ti_table(spark))
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.avg("final_score").alias("mean_risk"),
                         F.max("final_score").alias("max_risk")))

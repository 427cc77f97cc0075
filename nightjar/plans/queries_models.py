"""Model queries (M1-M4, M6, Q3, G10): rows-only except the confusion check."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import anomaly as AN
from nightjar.operators import graph as G
from nightjar.operators import sessions
from nightjar.plans import detect as D
from nightjar.plans.catalog import register, rounded
from nightjar.plans.fixtures import sec_events, ti_table
from nightjar.plans.oracle_sql import DETECT, with_
from nightjar.session import checkpoint_dir, file_per_task
from nightjar.sources.files import scratch_path

FEATURES = ["session_count", "session_unique"]
CLASSIFIER_ROUNDS = 500
CLASSIFIER_ROWS = 50_000        # rows of a training task, which holds them all in memory


def session_features(spark, sf):
    return sessions.session_running(sec_events(spark, sf), region_col=None).select("event_id", "ts", *FEATURES)


@register("iforest_fit")
def q_iforest_fit(spark, sf):
    """M1: isolation forest (200 trees, 256 samples, seed 42) as a node table."""
    return AN.iforest_fit(session_features(spark, sf), FEATURES, "event_id")


def ueba(spark, sf):
    checkpoint_dir(spark)
    f = session_features(spark, sf).checkpoint()
    forest = AN.iforest_fit(f, FEATURES, "event_id")
    return AN.ueba_scores(f, forest, FEATURES)


@register("ueba_score")
def q_ueba_score(spark, sf):
    """M2: UEBA score per event = clip(-decision_function, 0, 1)."""
    return rounded(ueba(spark, sf).select("event_id", "score_samples", "decision", "ueba_score"))


@register("ueba_summary")
def q_ueba_summary(spark, sf):
    """M3: scored sessions, mean and max UEBA score."""
    return rounded(AN.ueba_summary(ueba(spark, sf)))


def _hst_sql(window: int = 250) -> str:
    """Leaf codes and masses are plain arithmetic once the trees are given."""
    dims, splits = AN.hst_trees(len(FEATURES))
    trees = ", ".join(f"({t}, {j}, {int(dims[t, j])}, {float(splits[t, j])!r}::DOUBLE)"
                      for t in range(dims.shape[0]) for j in range(dims.shape[1]))
    return with_(DETECT) + f""",
trees AS (SELECT * FROM (VALUES {trees}) t(tree, level, dim, split)),
mm AS (SELECT min(session_count) AS a0, max(session_count) AS b0, min(session_unique) AS a1, max(session_unique) AS b1
       FROM det),
fx AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index,
              (session_count - a0) / greatest(b0 - a0, 1e-12)::DOUBLE AS x0,
              (session_unique - a1) / greatest(b1 - a1, 1e-12)::DOUBLE AS x1 FROM det CROSS JOIN mm),
leaf AS (SELECT event_id, row_index, row_index // {window} AS win, tree,
                sum(CASE WHEN (CASE WHEN dim = 0 THEN x0 ELSE x1 END) >= split THEN 1 << ({dims.shape[1]} - 1 - level)
                    ELSE 0 END) AS code
         FROM fx CROSS JOIN trees GROUP BY 1, 2, 3, 4),
mass AS (SELECT win, tree, code, count(*) AS m FROM leaf GROUP BY 1, 2, 3)
SELECT event_id, row_index, leaf.win,
       round(CASE WHEN leaf.win = 0 THEN 0.0 ELSE 1.0 - sum(coalesce(m, 0)) / ({dims.shape[0]}.0 * {window}) END, 6)
         AS hst_score
FROM leaf LEFT JOIN mass ON mass.win = leaf.win - 1 AND mass.tree = leaf.tree AND mass.code = leaf.code
GROUP BY event_id, row_index, leaf.win"""


@register("hst_window_score", _hst_sql())
def q_hst(spark, sf):
    """M4 (re-aimed): half-space-trees score per event, windows of 250 events in time order."""
    f = session_features(spark, sf)
    return rounded(AN.hst_window_score(f, FEATURES, ["ts", "event_id"]).select(
        "event_id", "row_index", "win", "hst_score"))


_LEAVES = _hst_sql().split("mass AS (SELECT")[0].rstrip().rstrip(",")


@register("hst_running_score", _LEAVES + f""",
before AS (SELECT event_id, row_index, count(*) OVER (PARTITION BY tree, code ORDER BY row_index) - 1 AS m FROM leaf)
SELECT event_id, round(CASE WHEN row_index = 0 THEN 0.0
                            ELSE 1.0 - sum(m) / ({AN.hst_trees(len(FEATURES))[0].shape[0]}.0 * row_index) END, 6) AS hst_score
FROM before GROUP BY event_id, row_index""")
def q_hst_running(spark, sf):
    """M4, score before learn: one half-space-trees model in arrival order."""
    f = session_features(spark, sf)
    trees = AN.HalfSpaceTrees(FEATURES, AN.feature_limits(f, FEATURES))
    return rounded(AN.hst_running_score(f, trees, ["ts", "event_id"]).select("event_id", "hst_score"))


@register("score_confusion", with_(DETECT) + """
SELECT CAST(sum(CASE WHEN final_score > 0.5 AND event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN final_score > 0.5 AND event_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN final_score <= 0.5 AND event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN final_score <= 0.5 AND event_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       round(sum(CASE WHEN final_score > 0.5 AND event_id % 3 = 0 THEN 1 ELSE 0 END)
             / sum(CASE WHEN final_score > 0.5 THEN 1 ELSE 0 END)::DOUBLE, 6) AS precision,
       round(sum(CASE WHEN final_score > 0.5 AND event_id % 3 = 0 THEN 1 ELSE 0 END)
             / sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE, 6) AS recall
FROM det""")
def q_score_confusion(spark, sf):
    """M6: detection score > 0.5 against the analyst label (event_id % 3 = 0 -> problem)."""
    d = D.detect(sec_events(spark, sf), ti_table(spark))
    d = d.withColumn("analyst_problem", (F.col("event_id") % 3 == 0).cast("int"))
    return rounded(AN.score_confusion(d, "analyst_problem", "final_score", 0.5))


@register("seq_classifier")
def q_seq_classifier(spark, sf):
    """Q3 (re-aimed): bag-of-types + bigram counts of the last 40 events ->
    logistic regression predicting the detection label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, NGram, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ev = sec_events(spark, sf)
    det = D.detect(ev, ti_table(spark)).select("event_id", F.col("detected").cast("double").alias("label"))
    # Labels meet narrow rows, so that no list of types is shuffled. An event_id
    # may repeat: each of its rows gets all its labels.
    kinds = {"_ones": F.lit(1.0), "_zeros": F.lit(0.0), "_none": F.lit(None).cast("double")}
    labels = det.where("event_id IS NOT NULL").groupBy("event_id").agg(
        *[F.count_if(F.col("label").eqNullSafe(value)).cast("int").alias(k) for k, value in kinds.items()])
    w = sessions.last_n_events(ev.join(labels.hint("merge"), "event_id", "left"), n=40)
    label = F.explode(F.concat(*[F.array_repeat(value, F.col(k)) for k, value in kinds.items()])).alias("label")
    data = w.where("_ones IS NOT NULL").select("event_id", "last_events", label)
    # Written once: the vocabularies, the training and the scoring read it.
    path = scratch_path(spark, "classifier")
    data.write.option("maxRecordsPerFile", CLASSIFIER_ROWS).parquet(path)
    data = spark.read.schema(data.schema).parquet(path)
    # The vocabularies hold every type and every pair of neighbours that there is.
    types = data.select(F.explode(F.array_distinct("last_events"))).distinct().count()
    pairs = F.transform(F.sequence(F.lit(1), F.size("last_events") - 1),
                        lambda i: F.struct(F.get("last_events", i - 1).alias("a"), F.get("last_events", i).alias("b")))
    bigrams = data.where(F.size("last_events") > 1).select(F.explode(F.array_distinct(pairs))).distinct().count()
    pipe = Pipeline(stages=[
        CountVectorizer(inputCol="last_events", outputCol="bag", vocabSize=max(1, types)),
        NGram(n=2, inputCol="last_events", outputCol="bigrams"),
        CountVectorizer(inputCol="bigrams", outputCol="bag2", vocabSize=max(1, bigrams)),
        VectorAssembler(inputCols=["bag", "bag2"], outputCol="features"),
        LogisticRegression(maxIter=CLASSIFIER_ROUNDS, tol=1e-6, regParam=0.01),
    ])
    with file_per_task(spark):
        model = pipe.fit(data)
    if model.stages[-1].summary.totalIterations >= CLASSIFIER_ROUNDS:
        raise RuntimeError(f"the classifier did not settle in {CLASSIFIER_ROUNDS} rounds")
    out = model.transform(data)
    return rounded(out.select("event_id", "label", "prediction",
                              vector_to_array("probability")[1].alias("p_problem")))


@register("node_svd")
def q_node_svd(spark, sf):
    """Rank-16 SVD node embedding distance to the mean."""
    e = G.build_edges(sec_events(spark, sf))
    v = G.build_vertices(e)
    return rounded(G.node_svd(e, v, 16))


@register("detect_full")
def q_detect_full(spark, sf):
    """R17 with UEBA (M2), sequence (Q2), online (M4) and graph-correlation
    components fused (rows-only: the models are not SQL)."""
    return rounded(D.detect_full(sec_events(spark, sf), ti_table(spark)))

"""Detection on a stream with every model component.

Models are fitted on stored events and saved as numbered versions. The stream
keeps per-entity session state and the last event types (``session_events``);
each micro-batch is then scored by the newest version there is. What a batch
read is noted under its number, and so are the masses of the online model after
it: a batch that runs again after a failure does and writes the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.operators import anomaly, graph, sequences
from nightjar.operators.sessions import session_running
from nightjar.plans.detect import detect_scored, model_scores
from nightjar.session import checkpoint_dir
from nightjar.streaming.pipeline import idempotent_batch_writer, previous_version

FEATURES = ["session_count", "session_unique"]
LAST_N = 40


@dataclass
class Models:
    """What a version holds: forest nodes and their offset (M1, M2), transition
    probabilities (Q2), correlation by entity (G8), limits of the features (M4)."""

    forest: DataFrame
    offset: float
    transitions: DataFrame
    correlation: DataFrame
    trees: anomaly.HalfSpaceTrees
    last_n: int = LAST_N


def fit_models(ev: DataFrame, last_n: int = LAST_N) -> Models:
    """Models of the events ``ev``."""
    checkpoint_dir(ev.sparkSession)
    feats = session_running(ev, region_col=None).select("event_id", *FEATURES).checkpoint()
    forest = anomaly.iforest_fit(feats, FEATURES, "event_id").checkpoint()
    samples = feats.select(anomaly.iforest_score_samples(feats, forest, FEATURES).alias("s"))
    offset = samples.agg(F.percentile_approx("s", anomaly.CONTAMINATION, 1_000_000)).first()[0]
    edges = graph.build_edges(ev).checkpoint()
    corr = graph.correlation(edges, graph.node_anomaly(edges, graph.build_vertices(edges)), ev).select("entity_id", "corr_score")
    limits = anomaly.feature_limits(feats, FEATURES)
    return Models(forest, float(offset or 0.0), sequences.transition_table(sequences.with_previous(ev)), corr,
                  anomaly.HalfSpaceTrees(FEATURES, limits), last_n)


def save_models(models: Models, path: str, version: int) -> None:
    """Write a version. It counts from when its last table, the settings, is complete."""
    parts = f"{path}/parts/v={version}"
    models.forest.write.mode("overwrite").parquet(f"{parts}/forest")
    models.transitions.write.mode("overwrite").parquet(f"{parts}/transitions")
    models.correlation.write.mode("overwrite").parquet(f"{parts}/correlation")
    settings = {"offset": models.offset, "limits": models.trees.limits, "features": models.trees.features, "last_n": models.last_n}
    spark = models.forest.sparkSession
    spark.range(1).select(F.lit(json.dumps(settings)).alias("settings")).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version}")


def load_models(spark: SparkSession, path: str, version: int) -> Models:
    settings = json.loads(spark.read.parquet(f"{path}/v={version}").first()["settings"])
    parts = f"{path}/parts/v={version}"
    trees = anomaly.HalfSpaceTrees(settings["features"], [tuple(x) for x in settings["limits"]])
    return Models(spark.read.parquet(f"{parts}/forest"), settings["offset"], spark.read.parquet(f"{parts}/transitions"),
                  spark.read.parquet(f"{parts}/correlation"), trees, settings["last_n"])


def model_writer(models_path: str, state_path: str, out_path: str, ti: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for the rows of ``session_events(..., last_n=...)``:
    detection records with all components, one folder per batch.

    The online model's masses are kept with the version they belong to (another
    version scales features otherwise): they start anew with a new version."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{state_path}/rows/v={batch_id}"
        # Written once: the stateful part of the plan runs once, and all below reads the same rows.
        numbered = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("_row", F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(numbered.schema).parquet(staged)
        done = previous_version(spark, f"{state_path}/read", batch_id + 1)
        if done == batch_id:        # this batch ran before: it read that version
            version = spark.read.parquet(f"{state_path}/read/v={batch_id}").first()["version"]
        else:
            version = previous_version(spark, models_path)
            if version is None:
                raise ValueError(f"no models at {models_path}")
            one = spark.range(1).select(F.lit(version).alias("version")).coalesce(1)
            one.write.mode("overwrite").parquet(f"{state_path}/read/v={batch_id}")
        models = load_models(spark, models_path, version)
        start = np.zeros(models.trees.leaves, dtype=np.int64)
        before = previous_version(spark, f"{state_path}/masses", batch_id)
        if before is not None:
            kept = spark.read.parquet(f"{state_path}/masses/v={before}").first()
            if kept["version"] == version:
                start = np.array(kept["mass"], dtype=np.int64)
        scored = model_scores(rows, models, "_row", start)
        idempotent_batch_writer(out_path)(detect_scored(scored, ti), batch_id)
        after = start + anomaly.hst_masses(rows, models.trees)
        spark.createDataFrame([(version, after.tolist())], "version int, mass array<long>").coalesce(1).write.mode(
            "overwrite").parquet(f"{state_path}/masses/v={batch_id}")

    return on_batch

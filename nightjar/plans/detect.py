"""The per-event detection chain (R17) as one lazy DataFrame plan.

normalize (P5) -> TI join (J1) -> running session (W1/W3/W5) -> rules (R1-R7)
-> fusion / final / label / identifier / severity (R9-R14) -> detection record.

Model components (ueba, seq, online, corr) are columns that default to 0; the
full pipeline joins them in from their operators (``detect_full``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.functions import rules as R
from nightjar.functions.columns import first_present
from nightjar.operators import templates as TM
from nightjar.operators.enrich import ti_enrich
from nightjar.operators.sessions import DEFAULT_BUCKET_SECONDS, MAX_BUCKET_ROWS, session_running

DETECT_COLUMNS = [
    "event_id", "ts", "source", "entity_type", "entity_id", "event_type", "region", "source_ip",
    "severity_hint", "session_count", "session_unique", "prev_login_region",
    "rule_score", "ueba_score", "seq_score", "ti_score", "online_score", "corr_score",
    "fused_score", "final_score", "threshold", "label", "detected", "identifier_type", "severity",
    "alert_ts",
]


def normalize(ev: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """P5: keep the canonical fields and add the severity hint (an event's own
    hint stays). With ``ingest_ts`` events that carry no ingest time get it; it
    is an argument, so a replay does not depend on the clock."""
    hint = R.severity_hint("event_type")
    if "severity_hint" in ev.columns:
        hint = F.coalesce("severity_hint", hint)
    ev = ev.withColumn("severity_hint", hint)
    if ingest_ts is None:
        return ev
    own = F.coalesce("ingest_ts", ingest_ts) if "ingest_ts" in ev.columns else ingest_ts
    return ev.withColumn("ingest_ts", own)


def learned_settings(feedback: DataFrame, updates: DataFrame) -> dict:
    """R9 and R12 from the loop: the decision threshold after all analyst
    feedback (F1) and the fusion weights of the federated mean (F6, F7), as
    arguments for ``detect``: five numbers."""
    from nightjar.operators import feedback as FB
    w = FB.federated_weights(FB.federated_mean(updates)).first()
    threshold, _ = FB.threshold_value(feedback)
    return {"threshold": threshold,
            "weights": {"rule": w["w_rule"], "ueba": w["w_ueba"], "seq": w["w_seq"], "ti": w["w_ti"]}}


def with_template(ev: DataFrame) -> DataFrame:
    """T1-T3 on the event's text, as ``template_id``."""
    return TM.mine(ev, TM.content()).drop("template")


def service_events(drift: DataFrame, violations: DataFrame) -> DataFrame:
    """D4 + D9: ConfigDrift and PolicyViolation events as canonical events, ready
    for ``detect``: fields that such events lack are null."""
    cols = {"event_id": "string", "ts": "timestamp_ntz", "source": "string", "entity_type": "string",
            "entity_id": "string", "event_type": "string", "region": "string", "source_ip": "string",
            "policy": "string", "bucket": "string", "role_arn": "string", "details": "string", "severity_hint": "string"}

    def canonical(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])

    return canonical(drift).unionByName(canonical(
        violations.withColumn("severity_hint", F.col("severity")).withColumn("details", F.concat_ws(" ", "issue", "subject"))))


def score_and_label(df: DataFrame, weights: dict | None = None,
                    threshold: float | Column = R.DEFAULT_THRESHOLD) -> DataFrame:
    """R9-R14 on a frame that has the six component columns. Weights and
    threshold are numbers, or columns where they differ by event."""
    df = df.withColumn("fused_score", R.weighted_fusion(weights=weights))
    df = df.withColumn("final_score", R.final_score("fused_score", "rule_score", "ueba_score", "seq_score",
                                                    "ti_score", "online_score", "corr_score"))
    df = df.withColumn("threshold", threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    df = df.withColumn("detected", F.col("final_score") > F.col("threshold"))
    df = df.withColumn("label", F.when(F.col("detected"), F.lit("problem")).otherwise(F.lit("normal")))
    df = df.withColumn("identifier_type", R.identifier_type())
    return df.withColumn("severity", R.score_severity("final_score"))


def detect(ev: DataFrame, ti: DataFrame, components: DataFrame | None = None,
           weights: dict | None = None, threshold: float = R.DEFAULT_THRESHOLD,
           travel: bool = True, bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
           max_bucket_rows: int | None = MAX_BUCKET_ROWS) -> DataFrame:
    """R17 over canonical events. ``components`` (optional) is keyed by event_id
    and may carry ueba_score / seq_score / online_score / corr_score. A
    ``template_id`` column (``with_template``) stays on the record."""
    # Session features first (the only shuffle of the row stream), then the
    # broadcast TI join and row-local expressions.
    df = session_running(ev, bucket_seconds=bucket_seconds, max_bucket_rows=max_bucket_rows)
    df = normalize(df)
    df = ti_enrich(df, ti, "source_ip")
    df = df.withColumn("rule_score", R.rule_score(travel=travel))
    for c in ("ueba_score", "seq_score", "online_score", "corr_score"):
        if components is None or c not in components.columns:
            df = df.withColumn(c, F.lit(0.0))
    if components is not None:
        df = df.join(components, "event_id", "left")
        for c in ("ueba_score", "seq_score", "online_score", "corr_score"):
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    df = score_and_label(df, weights, threshold)
    df = df.withColumn("source", first_present("source", "region"))
    df = df.withColumn("alert_ts", F.when(F.col("detected"), F.col("ts")))
    return df.select(*DETECT_COLUMNS, *(["template_id"] if "template_id" in df.columns else []))


def detect_asof(ev: DataFrame, ti: DataFrame, feedback: DataFrame, updates: DataFrame, **kw) -> DataFrame:
    """R9 and R12 with what was in force when the event happened: the threshold
    after the feedback given before it (F2) and the weights of the federated
    mean before it (F6, F7); the defaults until there is any. ``feedback`` is
    (ts, event_id, label), ``updates`` (client_id, ts, event_id, weights), both
    at the time they came in."""
    from nightjar.operators import feedback as FB
    from nightjar.operators.asof import as_of
    names = [f"w_{n}" for n in FB.DEFAULT_FUSION]
    thresholds = FB.threshold_history(feedback).select("ts", "event_id", F.col("new_threshold").alias("threshold_then"))
    weights = FB.weights_history(updates)
    # One history of both, so that the events are shuffled once for it.
    settings = as_of(thresholds, weights, names, tie="event_id").unionByName(
        as_of(weights, thresholds, ["threshold_then"], tie="event_id"))
    df = as_of(detect(ev, ti, **kw), settings, ["threshold_then", *names], tie="event_id", inclusive=False)
    weights = {n: F.coalesce(f"w_{n}", F.lit(w)) for n, w in FB.DEFAULT_FUSION.items()}
    df = score_and_label(df, weights, F.coalesce("threshold_then", F.lit(R.DEFAULT_THRESHOLD)))
    df = df.withColumn("alert_ts", F.when(F.col("detected"), F.col("ts")))
    return df.select(*DETECT_COLUMNS, *(["template_id"] if "template_id" in df.columns else []), *names)


def alerts(detected: DataFrame) -> DataFrame:
    """A2: problem rows only."""
    return detected.filter(F.col("detected"))


def model_scores(rows: DataFrame, models, row: str, start=None, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``rows`` (session features and ``last_events`` on them) with the four
    components by given ``models`` (``streaming.models.Models``): UEBA (M2) by
    the forest, sequence (Q2) by the transitions, online (M4) by the running
    masses from ``start`` on, graph correlation (G8) by entity. ``row``
    identifies a row."""
    from nightjar.operators import anomaly, sequences
    samples = anomaly.iforest_score_samples(rows, models.forest, models.trees.features)
    df = rows.withColumn("ueba_score", anomaly.ueba_score(samples, models.offset))
    df = df.join(models.correlation, "entity_id", "left")
    df = df.join(sequences.list_surprise(rows, models.transitions, row), row, "left")
    df = df.fillna(0.0, ["seq_score", "corr_score"])
    return anomaly.hst_running_score(df, models.trees, list(order), start).withColumnRenamed("hst_score", "online_score")


def detect_scored(df: DataFrame, ti: DataFrame) -> DataFrame:
    """R17 on rows that have their session features and model components."""
    df = ti_enrich(normalize(df), ti, "source_ip").withColumn("rule_score", R.rule_score(travel=True))
    df = score_and_label(df).withColumn("source", first_present("source", "region"))
    return df.withColumn("alert_ts", F.when(F.col("detected"), F.col("ts"))).select(*DETECT_COLUMNS)


def detect_by_models(ev: DataFrame, ti: DataFrame, models) -> DataFrame:
    """R17 with every component, by given models; the batch form of the stream
    with models, which has seen the events in time order."""
    from nightjar.operators.sessions import last_n_events
    from nightjar.session import checkpoint_dir
    checkpoint_dir(ev.sparkSession)
    lists = last_n_events(ev, n=models.last_n).select("event_id", "last_events")
    rows = session_running(ev).join(lists, "event_id").checkpoint()
    return detect_scored(model_scores(rows, models, "event_id"), ti)


def components(ev: DataFrame, features_fn=None) -> DataFrame:
    """Model components per event for ``detect_full``: ueba (M2), seq (Q2),
    online (M4) by event_id, corr (G8) by entity. Each is its own distributed
    job; the result is one row per event."""
    from nightjar.operators import anomaly, graph, sequences
    from nightjar.session import checkpoint_dir

    checkpoint_dir(ev.sparkSession)

    feats = session_running(ev, region_col=None).select("event_id", "ts", "entity_id", "session_count",
                                                        "session_unique").checkpoint()
    fcols = ["session_count", "session_unique"]
    forest = anomaly.iforest_fit(feats, fcols, "event_id")
    ueba = anomaly.ueba_scores(feats, forest, fcols).select("event_id", "ueba_score")
    online = anomaly.hst_window_score(feats.select("event_id", "ts", *fcols), fcols, ["ts", "event_id"]).select(
        "event_id", F.col("hst_score").alias("online_score"))
    seq = sequences.sequence_surprise(ev).select("event_id", "seq_score")
    edges = graph.build_edges(ev).checkpoint()
    corr = graph.correlation(edges, graph.node_anomaly(edges, graph.build_vertices(edges)), ev).select(
        "entity_id", "corr_score")
    base = feats.select("event_id", "entity_id")
    return (base.join(ueba, "event_id", "left").join(online, "event_id", "left")
            .join(seq, "event_id", "left").join(corr, "entity_id", "left").drop("entity_id"))


def detect_full(ev: DataFrame, ti: DataFrame, **kw) -> DataFrame:
    """R17 with every component joined in (build-plan step 5)."""
    return detect(ev, ti, components=components(ev), **kw)

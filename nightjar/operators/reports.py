"""Persistence and reporting operators (A1-A15) and display mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.functions.columns import col, first_nonblank, first_present

# ---- fixed values: candidate keys, in the reference's order -------------------------
IP_KEYS = ("sourceIPAddress", "source_ip", "sourceIpAddress", "clientIp", "ip_address", "ip")
NESTED_OBJECTS = ("requestParameters", "request_parameters", "request")
NESTED_IP_KEYS = ("sourceIPAddress", "source_ip", "ip")
DISPLAY_IP_KEYS = ("sourceIPAddress", "source_ip", "sourceIpAddress", "source")
DISPLAY_REGION_KEYS = ("awsRegion", "aws_region", "region", "geo.region")
IDENTIFIER_LABELS = (("rule:", "Rule"), ("graph:", "Graph"), ("ti:", "Threat Intel"),
                     ("seq:", "Sequence"), ("ueba:", "UEBA"), ("fused:", "Fused"))
# --------------------------------------------------------------------------------------


def _json_path(key: str) -> str:
    return "$." + key


def extract_ip(json_cols=("raw_json",), fallback="source") -> Column:
    """First truthy IP key of each JSON document in turn, then nested request
    objects, then the stored ``source`` column."""
    cands = []
    for jc in json_cols:
        cands += [F.get_json_object(col(jc), _json_path(k)) for k in IP_KEYS]
        cands += [F.get_json_object(col(jc), f"$.{o}.{k}") for o in NESTED_OBJECTS for k in NESTED_IP_KEYS]
    return first_present(*cands, col(fallback))


def display_ip(raw="raw_json", fallback="source") -> Column:
    """Non-blank candidates, then source, then '-'."""
    c = [F.get_json_object(col(raw), _json_path(k)) for k in DISPLAY_IP_KEYS]
    return F.coalesce(first_nonblank(*c, col(fallback)), F.lit("-"))


def display_region(raw="raw_json", fallback="source") -> Column:
    c = [F.get_json_object(col(raw), _json_path(k)) for k in DISPLAY_REGION_KEYS]
    return F.coalesce(first_nonblank(*c, col(fallback)), F.lit("-"))


def entity_short(c) -> Column:
    """P10: last '/' segment (whole string when that is empty); null/'' -> '-'."""
    c = col(c)
    last = F.element_at(F.split(c, "/"), -1)
    return (F.when(c.isNull() | (c == ""), F.lit("-"))
            .when(c.contains("/"), F.when(last != "", last).otherwise(c))
            .otherwise(c))


def identifier_label(c) -> Column:
    """P11."""
    c = col(c)
    s = F.lower(c)
    out = F.when(c.isNull() | (c == ""), F.lit("Fused"))
    for prefix, label in IDENTIFIER_LABELS:
        out = out.when(s.startswith(prefix), F.lit(label))
    return out.otherwise(c)


def severity_display(severity="severity", score="final_score") -> Column:
    """Normalise a stored severity, else derive it from the score."""
    s = F.lower(col(severity))
    from_score = (F.when(F.coalesce(col(score), F.lit(0.0)) > 0.7, F.lit("high"))
                  .when(F.coalesce(col(score), F.lit(0.0)) >= 0.4, F.lit("medium")).otherwise(F.lit("low")))
    return (F.when(col(severity).isNull() | (col(severity) == ""), from_score)
            .when(s.isin("high", "h"), F.lit("high"))
            .when(s.isin("medium", "med", "m"), F.lit("medium"))
            .otherwise(F.lit("low")))


def event_upsert(records: DataFrame, key: str, identity_cols, version_col: str) -> DataFrame:
    """A1: keep identity columns from the first write, everything else from the
    latest. A partial aggregate (``min_by``/``max_by`` combine map-side), so a
    key delivered many times is pre-reduced before the shuffle. Rows of one
    version are told apart by a hash of all columns, so the result does not
    depend on the order of arrival."""
    rest = [c for c in records.columns if c not in (key, *identity_cols)]
    order = F.struct(F.col(version_col), F.xxhash64(*records.columns))
    return (records.groupBy(key)
            .agg(F.min_by(F.struct(*identity_cols), order).alias("_id"),
                 F.max_by(F.struct(*rest), order).alias("_rest"))
            .select(key, "_id.*", "_rest.*"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Top-k report: orderBy + limit plans as TakeOrderedAndProject (per-partition
    top-k, then a k-row merge), never a global sort."""
    return df.orderBy(*order).limit(k)


def latest_alerts(alerts: DataFrame, events: DataFrame, limit: int = 200) -> DataFrame:
    """A5: latest alerts; if there are none, the latest events instead."""
    # The top-k runs once and its k rows (a bounded report) decide.
    spark = alerts.sparkSession
    rows = top_k(alerts, limit, F.col("alert_ts").desc_nulls_last(), F.col("id").desc()).collect()
    if rows:
        return spark.createDataFrame(rows, alerts.schema)
    return top_k(events, limit, F.col("updated_ts").desc_nulls_last(), F.col("id").desc())


def health_summary(events: DataFrame, as_of: str, minutes: int = 60, time_col: str = "updated_ts",
                   score: str = "final_score") -> DataFrame:
    """A7 + A8 (+ A11 via ``time_col``): one-row health document."""
    as_of_c = F.lit(as_of).cast("timestamp_ntz")
    in_win = (F.col(time_col) >= as_of_c - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(time_col) <= as_of_c)
    return events.agg(
        F.max(F.coalesce("alert_ts", "updated_ts", "ingest_ts")).alias("last_event_ts"),
        F.count(F.when(in_win, F.lit(1))).alias("events_in_window"),
        F.round(F.coalesce(F.avg(F.when(in_win, F.coalesce(F.col(score), F.lit(0.0)))), F.lit(0.0)), 6)
        .alias("mean_score_in_window"),
        F.count(F.when(F.col("detected"), F.lit(1))).alias("alerts_total"))


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """Alert count by severity, null -> 'unknown'."""
    return (alerts.groupBy(F.coalesce(F.col("severity"), F.lit("unknown")).alias("severity"))
            .agg(F.count(F.lit(1)).alias("n")))


def top_by_count(alerts: DataFrame, c: str, k: int = 5) -> DataFrame:
    """Top-k values of ``c`` by alert count, name breaks ties."""
    g = alerts.groupBy(F.coalesce(F.col(c), F.lit("unknown")).alias(c)).agg(F.count(F.lit(1)).alias("n"))
    return top_k(g, k, F.col("n").desc(), F.col(c).asc())


def risk_trend(det: DataFrame, every: str = "1 day", ts: str = "ts") -> DataFrame:
    """Risk evolution per tumbling window."""
    return (det.groupBy(F.window(ts, every).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.count(F.when(F.col("detected"), F.lit(1))).alias("n_alerts"),
                 F.avg("final_score").alias("mean_score"), F.max("final_score").alias("max_score"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_events", "n_alerts",
                    "mean_score", "max_score"))


def alert_cube(alerts: DataFrame) -> DataFrame:
    """cube(entity_type, severity) totals."""
    return (alerts.cube("entity_type", "severity")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))

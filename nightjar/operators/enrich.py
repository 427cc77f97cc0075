"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.functions.joins import bounded_broadcast


def ti_enrich(ev: DataFrame, ti: DataFrame, ip_col: str = "source_ip") -> DataFrame:
    """J1 + R8: left join reputation by exact IP; miss or absent IP -> 0.0.

    The intel table is broadcast only if Catalyst's size estimate is within
    the bound; a large feed falls back to a shuffled join.
    """
    t = ti.select(F.col("ip").alias("_ti_ip"), F.col("ip_reputation").alias("_ti_rep"))
    out = ev.join(bounded_broadcast(t), F.col(ip_col) == F.col("_ti_ip"), "left")
    return out.withColumn("ti_score", F.coalesce(F.col("_ti_rep"), F.lit(0.0))).drop("_ti_ip", "_ti_rep")


def ti_corroborated(df: DataFrame, floor: float = 0.5, ti: str = "ti_score",
                    others=("rule_score", "ueba_score", "seq_score")) -> DataFrame:
    """Intel counts only when some internal component reaches ``floor``."""
    corroborated = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in others]) >= F.lit(floor)
    return df.withColumn("ti_gated", F.when(corroborated, F.col(ti)).otherwise(F.lit(0.0)))


def ipv4_to_long(c) -> F.Column:
    """Dotted quad -> integer, null when malformed."""
    parts = F.split(c, r"\.")
    ok = F.col(c).rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$") if isinstance(c, str) else c.rlike(
        r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    val = (parts[0].cast("bigint") * 16777216 + parts[1].cast("bigint") * 65536
           + parts[2].cast("bigint") * 256 + parts[3].cast("bigint"))
    return F.when(ok, val)


def cidr_table(cidrs: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """CIDR text -> (lo, hi) integer bounds."""
    ip = F.split(F.col(cidr_col), "/")[0]
    bits = F.split(F.col(cidr_col), "/")[1].cast("int")
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("bigint")
    lo = F.floor(ipv4_to_long(ip) / size) * size
    return cidrs.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", (lo + size - 1).cast("bigint"))


def ip_prefix_match(ev: DataFrame, cidrs: DataFrame, ip_col: str = "source_ip",
                    cidr_col: str = "cidr", max_prefix_bits: int = 8) -> DataFrame:
    """J3 table form: range join of IPs against CIDR blocks.

    Equi-join on the leading ``max_prefix_bits`` bits (blocks shorter than that
    prefix are expanded over the covered keys), then the exact range filter. A
    broadcast nested-loop join is never planned.
    """
    step = 1 << (32 - max_prefix_bits)
    c = cidr_table(cidrs, cidr_col)
    c = c.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") / step).cast("bigint"),
                                                 F.floor(F.col("_hi") / step).cast("bigint"))))
    c = c.withColumnRenamed("_k", "_ck")
    e = ev.withColumn("_ipn", ipv4_to_long(ip_col)).withColumn("_k", F.floor(F.col("_ipn") / step).cast("bigint"))
    # Range test inside the ON clause keeps left-join semantics (a miss gives nulls);
    # overlapping blocks give one row per containing block.
    cond = (F.col("_k") == F.col("_ck")) & (F.col("_ipn") >= F.col("_lo")) & (F.col("_ipn") <= F.col("_hi"))
    j = e.join(bounded_broadcast(c), cond, "left")
    return j.drop("_k", "_ck", "_lo", "_hi", "_ipn")


def mitre_tag(steps: DataFrame, techniques: DataFrame, step_col: str = "event_type") -> DataFrame:
    """Step name -> MITRE technique id (left join on a bounded dimension)."""
    return steps.join(bounded_broadcast(techniques), F.col(step_col) == F.col("action"), "left").drop("action")


def entities_without(entities: DataFrame, flagged: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entities with no row in ``flagged`` (left anti join)."""
    return entities.join(flagged.select(key).distinct(), key, "left_anti")

"""Explanations of the fused score (R15, R16) and weight plumbing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.functions.rules import DEFAULT_WEIGHTS

_COMPONENTS = ("rule", "ueba", "seq", "ti")


def explain_components(df: DataFrame, weights: dict | None = None, key: str = "event_id") -> DataFrame:
    """The components and weights behind each fused score, as columns."""
    w = weights or DEFAULT_WEIGHTS
    cols = [F.col(f"{c}_score").alias(f"c_{c}") for c in _COMPONENTS]
    cols += [F.lit(float(w[c])).alias(f"w_{c}") for c in _COMPONENTS]
    return df.select(key, *cols)


def shapley_contributions(df: DataFrame, weights: dict | None = None) -> F.Column:
    """Exact Shapley values of f(x) = sum w_i x_i against a zero baseline: phi_i = w_i x_i."""
    w = weights or DEFAULT_WEIGHTS
    order = {c: i for i, c in enumerate(sorted(_COMPONENTS))}
    return F.array(*[F.struct((F.lit(float(w[c])) * F.col(f"{c}_score")).alias("phi"),
                              F.lit(-order[c]).alias("_o"), F.lit(c).alias("feature"))
                     for c in _COMPONENTS])


def shapley_top(df: DataFrame, weights: dict | None = None, key: str = "event_id") -> DataFrame:
    """R16 (re-aimed): top contributing component per row, ties to the first name."""
    arr = shapley_contributions(df, weights)
    out = df.select(key, arr.alias("_phi"))
    top = F.array_max("_phi")
    total = F.aggregate("_phi", F.lit(0.0), lambda acc, s: acc + s["phi"])
    return out.select(key, top["feature"].alias("top_feature"), top["phi"].alias("top_phi"),
                      total.alias("total_phi"))

"""Connected components by contraction: every round joins nodes with a neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.sources.files import scratch_path

MAX_ROUNDS = 200


def _down(a, b) -> list:
    """Every link points from the larger to the smaller node."""
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Written and read back: unlike a checkpoint, what is read keeps nothing of
    the plan that made it, which would grow with the rounds."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``a``, ``b`` of
    one orderable type, not null); ``component`` is the smallest node reachable.

    In each round a node goes over to the node of lowest hash among itself and
    its neighbours; the hash is another one in each round. The links between
    what is left are those of the next round. About half of the nodes are gone
    after a round, also on long paths, so that all rounds together read and
    shuffle a small multiple of the input. Then each round's steps are resolved
    by those behind it, the last first.

    Every round is written to the shared checkpoint folder. A node may have any
    number of links: minima are pre-aggregated and the joins back are plain
    equi-joins that AQE can split. The loop ends when no link is left and
    raises, rather than return a wrong result, should it not have ended after
    ``MAX_ROUNDS``.
    """
    folder = scratch_path(edges.sparkSession, "components")
    links = _kept(edges.where("a <> b").select(*_down("a", "b")).distinct(), f"{folder}/links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        if len(steps) == MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        nth = F.lit(len(steps))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b", nth)).alias("b"))
        step = _kept(near.select(F.col("a").alias("node"), F.when(F.xxhash64("a", nth) <= F.xxhash64("b", nth), F.col("a"))
                                 .otherwise(F.col("b")).alias("to")), f"{folder}/step-{len(steps)}")
        steps.append(step)
        links = _kept(links.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
                      .select(*_down("x", "y")).distinct(), f"{folder}/links-{len(steps)}")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps.pop()
    while steps:
        found = (steps.pop().join(found.toDF("to", "on"), "to", "left")
                 .select("node", F.coalesce("on", "to").alias("to")))
    found = _kept(found, f"{folder}/found")
    return found.join(found.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")

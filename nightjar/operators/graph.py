"""Entity graph as edge/vertex DataFrames.

Edges are ``(src, dst, type, ts)`` with one row per (src, dst) pair, vertices
``(id, type)``. Every algorithm is joins + aggregates over these tables; the
iterative ones (PageRank, components) cut lineage with reliable
``checkpoint()`` into the cluster's checkpoint folder every few rounds and
pull back only one scalar per round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.functions.components import connected_components
from nightjar.session import checkpoint_dir, partitions_for, shuffle_partitions
from nightjar.functions.joins import values_table

# ---- fixed values ---------------------------------------------------------------
DAMPING = 0.85
ATTR_SCALE = 0.1          # correlation = attr * (1 + 0.1 * out-neighbours)
SELF_LOOP = 0.01          # (A + 0.01 I) X propagation of the node-anomaly score
# ----------------------------------------------------------------------------------


def build_edges(ev: DataFrame, entity="entity_id", ip="source_ip", etype="event_type", ts="ts",
                tie="event_id") -> DataFrame:
    """G1: entity->ip (used_ip) and entity->event type (did_event); last write wins."""
    used = ev.filter(F.col(ip).isNotNull() & (F.col(ip) != "")).select(
        F.col(entity).alias("src"), F.col(ip).alias("dst"), F.lit("used_ip").alias("type"), ts, tie)
    did = ev.filter(F.col(etype).isNotNull()).select(
        F.col(entity).alias("src"), F.col(etype).alias("dst"), F.lit("did_event").alias("type"), ts, tie)
    both = used.unionByName(did).filter(F.col("src").isNotNull())
    # max(struct) is a partial aggregate: a hub pair is combined map-side.
    last = both.groupBy("src", "dst").agg(F.max(F.struct(ts, tie, "type")).alias("_m"))
    return last.select("src", "dst", F.col("_m.type").alias("type"), F.col(f"_m.{ts}").alias("ts"))


def build_vertices(edges: DataFrame) -> DataFrame:
    """Every endpoint typed entity / ip / event_type (entity wins a clash)."""
    v = (edges.select(F.col("src").alias("id"), F.lit(0).alias("_p"), F.lit("entity").alias("type"))
         .unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("_p"),
                                   F.when(F.col("type") == "used_ip", F.lit("ip"))
                                   .otherwise(F.lit("event_type")).alias("type"))))
    return v.groupBy("id").agg(F.min(F.struct("_p", "type")).alias("_m")).select("id", "_m.type")


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """Out-neighbours of ``node`` with edge attributes."""
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("neighbor"), "type", "ts")


def ego_graph(edges: DataFrame, node: str, radius: int = 2) -> DataFrame:
    """Edges induced by the nodes within ``radius`` out-hops of ``node``.

    The edges are checkpointed once and so are the reached nodes of each hop:
    no hop computes the ones before it again."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    edges = edges.checkpoint()
    reach = values_table(spark, [(node,)], "id string")
    frontier = reach
    for _ in range(radius):
        nxt = edges.join(frontier, edges.src == frontier.id, "left_semi").select(F.col("dst").alias("id"))
        frontier = nxt.join(reach, "id", "left_anti").distinct()
        frontier = frontier.checkpoint()
        reach = reach.unionByName(frontier)
    e = edges.join(reach, edges.src == reach.id, "left_semi")
    e = e.join(reach, e.dst == reach.id, "left_semi")
    return e


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """in/out/total degree for every vertex (0 when absent)."""
    outd = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    d = vertices.select("id").join(outd, "id", "left").join(ind, "id", "left")
    d = d.fillna(0, ["out_degree", "in_degree"])
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def pagerank(edges: DataFrame, vertices: DataFrame, alpha: float = DAMPING, tol: float = 1e-6,
             max_rounds: int = 100) -> DataFrame:
    """Power iteration with uniform teleport and dangling mass spread evenly.

    Ends when the L1 change of a round is below ``N * tol``; raises if that has
    not happened after ``max_rounds``, rather than return unsettled ranks.

    Edges stay where they are for all rounds (by source, cached and sorted); a
    round shuffles what flows into each vertex, pre-aggregated. A source with
    more edges than a partition's fair share is dealt over several.
    """
    spark: SparkSession = edges.sparkSession
    checkpoint_dir(spark)
    # Both are read several times before the first round; what made them runs once.
    edges, vertices = edges.select("src", "dst").checkpoint(), vertices.select("id").checkpoint()
    n, m = vertices.count(), edges.count()
    if n == 0:
        return vertices.select("id", F.lit(0.0).alias("pagerank"))
    parts = max(partitions_for(edges, rows=m), partitions_for(vertices, rows=n))
    outd = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    share = max(1, -(-m // parts))
    salts = F.ceil(F.col("_d") / share).cast("int")
    w = (edges.join(outd, "src")
         .select("src", "dst", (F.lit(1.0) / F.col("_d")).alias("_w"), F.pmod(F.xxhash64("dst"), salts).alias("_salt")))
    v = vertices.select("id").join(outd.withColumnRenamed("src", "id"), "id", "left").select(
        "id", F.col("_d").isNull().alias("_dangling"), F.coalesce(salts, F.lit(0)).alias("_salts"))
    with shuffle_partitions(spark, parts):
        w = w.repartition(parts, "src", "_salt").sortWithinPartitions("src", "_salt").persist()
        v = v.repartition(parts, "id").sortWithinPartitions("id").persist()
        try:
            return _pagerank_rounds(w, v, n, alpha, tol, max_rounds)
        finally:
            w.unpersist()
            v.unpersist()


def _pagerank_rounds(w: DataFrame, v: DataFrame, n: int, alpha: float, tol: float, max_rounds: int) -> DataFrame:
    """Every round's ranks (one row per vertex) are checkpointed: a round reads
    them twice, so plans that keep earlier rounds would double with each."""
    ranks = v.select("*", F.lit(1.0 / n).alias("pr"))
    dangling = v.filter("_dangling").count() / n
    for _ in range(max_rounds):
        copies = ranks.filter("_salts > 0").select(
            F.col("id").alias("src"), "pr",
            F.explode(F.sequence(F.lit(0), F.col("_salts") - 1).cast("array<bigint>")).alias("_salt"))
        inflow = (w.join(copies, ["src", "_salt"]).groupBy(F.col("dst").alias("id"))
                  .agg(F.sum(F.col("pr") * F.col("_w")).alias("_in")))
        base = (alpha * dangling + (1.0 - alpha)) / n
        new = (ranks.select("id", "_dangling", "_salts", F.col("pr").alias("_old")).join(inflow, "id", "left")
               .select("id", "_dangling", "_salts", "_old",
                       (F.lit(alpha) * F.coalesce(F.col("_in"), F.lit(0.0)) + F.lit(base)).alias("pr")).checkpoint())
        # One small job per round: the change and the dangling mass for the next round.
        delta, dangling = new.agg(F.sum(F.abs(F.col("pr") - F.col("_old"))),
                                  F.coalesce(F.sum(F.when(F.col("_dangling"), F.col("pr"))), F.lit(0.0))).first()
        ranks = new.drop("_old")
        if delta < n * tol:
            return ranks.select("id", F.col("pr").alias("pagerank"))
    raise RuntimeError(f"PageRank did not settle in {max_rounds} rounds")


def attribution(pr: DataFrame, deg: DataFrame, n_nodes: int) -> DataFrame:
    """(pagerank + degree / (N + 1)) / 2."""
    return (pr.join(deg.select("id", "degree"), "id")
            .select("id", "pagerank", "degree",
                    ((F.col("pagerank") + F.col("degree") / F.lit(float(n_nodes + 1))) / 2.0)
                    .alias("attribution")))


def node_anomaly(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """G9 (deterministic form): X = standardised (in, out) degree (population std,
    zero variance -> 0); H = (A + 0.01 I) X; score = 1 - 1/(1 + ||H - mean(H)||)."""
    # Degrees and the propagated features (one narrow row per node) are
    # checkpointed: each feeds a one-row statistics aggregate and the next step.
    checkpoint_dir(edges.sparkSession)
    d = degrees(edges, vertices).checkpoint()
    st = d.agg(F.avg("in_degree").alias("mi"), F.stddev_pop("in_degree").alias("si"),
               F.avg("out_degree").alias("mo"), F.stddev_pop("out_degree").alias("so")).first()

    def z(c, m, s):
        return (F.col(c) - F.lit(m)) / F.lit(s) if s and s > 0 else F.lit(0.0)

    x = d.select("id", z("in_degree", st.mi, st.si).alias("x0"), z("out_degree", st.mo, st.so).alias("x1"))
    prop = (edges.select("src", "dst").join(x.withColumnRenamed("id", "dst"), "dst")
            .groupBy(F.col("src").alias("id")).agg(F.sum("x0").alias("a0"), F.sum("x1").alias("a1")))
    h = (x.join(prop, "id", "left")
         .select("id", (F.coalesce("a0", F.lit(0.0)) + F.lit(SELF_LOOP) * F.col("x0")).alias("h0"),
                 (F.coalesce("a1", F.lit(0.0)) + F.lit(SELF_LOOP) * F.col("x1")).alias("h1"))).checkpoint()
    mean = h.agg(F.avg("h0"), F.avg("h1")).first()
    dist = F.sqrt((F.col("h0") - F.lit(mean[0])) ** 2 + (F.col("h1") - F.lit(mean[1])) ** 2)
    return h.select("id", dist.alias("distance"), (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + dist)).alias("score"))


def correlation(edges: DataFrame, node_scores: DataFrame, entities: DataFrame) -> DataFrame:
    """G8 + J4: attr x (1 + 0.1 x out-neighbours); entities missing from the graph score 0."""
    outn = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_neighbors"))
    g = node_scores.select("id", F.col("score").alias("attr")).join(outn, "id", "left").fillna(0, ["n_neighbors"])
    g = g.select("id", "attr", "n_neighbors",
                 (F.col("attr") * (F.lit(1.0) + F.lit(ATTR_SCALE) * F.col("n_neighbors"))).alias("corr_score"))
    e = entities.select(F.col("entity_id").alias("id")).distinct()
    return (e.join(g, "id", "left")
            .select(F.col("id").alias("entity_id"), F.coalesce("attr", F.lit(0.0)).alias("attribution"),
                    F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"),
                    F.coalesce("corr_score", F.lit(0.0)).alias("corr_score")))


def shared_ip_groups(edges: DataFrame, min_entities: int = 2) -> DataFrame:
    """G12 (re-aimed, no pair explosion): IPs used by several entities, with the
    entity count. Partial aggregation, so a hub IP is pre-counted map-side."""
    return (edges.filter(F.col("type") == "used_ip")
            .groupBy(F.col("dst").alias("ip")).agg(F.count(F.lit(1)).alias("n_entities"))
            .filter(F.col("n_entities") >= min_entities))


def shared_ip_components(edges: DataFrame) -> DataFrame:
    """Entities linked through shared IPs, as connected components of the
    entity-IP graph; the component is named by its smallest entity. Hidden links
    are reported as a component id per entity, never as an all-pairs list."""
    e = edges.filter(F.col("type") == "used_ip").select(
        F.concat(F.lit("e:"), "src").alias("a"), F.concat(F.lit("i:"), "dst").alias("b"))
    # "e:" sorts before "i:", so a component's smallest node is its smallest entity.
    found = connected_components(e).filter(F.col("node").startswith("e:"))
    return found.select(F.substring("node", 3, 1 << 30).alias("entity_id"),
                        F.substring("component", 3, 1 << 30).alias("component"))


def node_svd(edges: DataFrame, vertices: DataFrame, k: int = 16, rounds: int = 4, oversample: int = 8,
             seed: int = 42) -> DataFrame:
    """Rank-k SVD embedding (U x Sigma) of the adjacency matrix, Euclidean
    distance of each node's embedding to the mean embedding (unscaled).

    Randomised block power iteration: the factors are tables of one row per
    node, a product with the matrix is a join with the edges and a partial sum,
    and only Gram matrices of ``k + oversample`` columns reach the driver. The
    distance does not change under rotations of the embedding, so no factor of
    the node count is ever held in one place."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    width = k + oversample
    names = [f"x{j}" for j in range(width)]
    e = edges.select("src", "dst").distinct().checkpoint()
    n = vertices.count()

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy() for c in names], axis=1)

    def gram(df: DataFrame) -> np.ndarray:
        """Sum of the partitions' Gram matrices: one small row each."""
        def run(batches):
            out = np.zeros((width, width))
            for batch in batches:
                x = matrix(batch)
                out += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["g"])

        rows = df.select(*names).mapInArrow(run, "g binary").collect()
        return sum((np.frombuffer(bytes(r["g"])).reshape(width, width) for r in rows), np.zeros((width, width)))

    def turned(df: DataFrame, m: np.ndarray) -> DataFrame:
        """Rows times a small matrix."""
        def run(batches):
            for batch in batches:
                y = matrix(batch) @ m
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(y[:, j]) for j in range(width))],
                                                 names=["id", *names])

        return df.select("id", *names).mapInArrow(run, "id string, " + ", ".join(f"{c} double" for c in names))

    def orthonormal(df: DataFrame) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(df))
        keep = values > max(values.max(), 0) * 1e-12
        scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0.0)
        return turned(df, vectors * scale[None, :])

    def times(df: DataFrame, frm: str, to: str) -> DataFrame:
        """The matrix (or its transpose) times the columns of ``df``."""
        return (e.join(df, F.col(frm) == F.col("id")).groupBy(F.col(to).alias("id"))
                .agg(*[F.sum(c).alias(c) for c in names]).checkpoint())

    def noise(j: int) -> Column:
        """A pseudo-random sign of node and column, the same in every run."""
        return F.when(F.xxhash64("id", F.lit(seed + j)) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias(names[j])

    y = times(vertices.select("id", *[noise(j) for j in range(width)]), "dst", "src")
    for _ in range(rounds):
        y = times(orthonormal(times(orthonormal(y), "src", "dst")), "dst", "src")
    q = orthonormal(y)
    values, vectors = np.linalg.eigh(gram(times(q, "src", "dst")))
    top = np.argsort(values)[::-1][:min(k, n)]
    scaled = np.zeros((width, width))
    scaled[:, :len(top)] = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))[None, :]
    # Nodes without out-edges have the zero embedding.
    emb = vertices.select("id").join(turned(q, scaled), "id", "left").fillna(0.0, names).checkpoint()
    mean = emb.agg(*[F.avg(c) for c in names]).first()
    square = sum(((F.col(c) - F.lit(float(m))) ** 2 for c, m in zip(names, mean or [0.0] * width)), F.lit(0.0))
    return emb.select("id", F.sqrt(square).alias("svd_distance"))

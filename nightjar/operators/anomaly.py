"""Anomaly models (M1-M4, M6).

Isolation forest (Liu et al. 2008): no isolation forest exists in pyspark.ml,
so it is built from Spark pieces. A sample pool of fixed expected size is
drawn with one hash per row, each pool row is assigned to trees by a seeded
hash, every tree keeps its 256 smallest-hash rows (a bounded group), and one
``applyInPandas`` call per tree grows that tree. The forest (<= 511 nodes per
tree) is the only thing collected and broadcast; scoring is an Arrow
``pandas_udf`` that walks all trees for a whole batch at once.

Half-space trees (Tan et al. 2011) are re-aimed batch-parallel: rows get a
global index (range partitions + per-partition counts), tumbling windows of
``window`` rows are scored against the node masses of the previous window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.session import checkpoint_dir, partitions_for

# ---- fixed values ------------------------------------------------------------------
N_TREES = 200
CONTAMINATION = 0.02
SEED = 42
MAX_SAMPLES = 256
EULER = 0.5772156649
# --------------------------------------------------------------------------------------

_NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
                "size long, depth int")


def _c(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(pdf: pd.DataFrame, features: list[str], seed: int) -> pd.DataFrame:
    tree = int(pdf["_tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    x = pdf[features].to_numpy(dtype=float)
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    rows = []

    def build(idx, depth):
        nid = len(rows)
        rows.append(None)
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(idx) <= 1 or len(usable) == 0:
            rows[nid] = (tree, nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        ln = build(left, depth + 1)
        rn = build(right, depth + 1)
        rows[nid] = (tree, nid, f, thr, ln, rn, len(idx), depth)
        return nid

    build(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def iforest_fit(df: DataFrame, features: list[str], key: str, n_trees: int = N_TREES,
                max_samples: int = MAX_SAMPLES, seed: int = SEED, pool_factor: int = 4) -> DataFrame:
    """M1: forest as a node table (tree, node, feature, threshold, left, right, size, depth)."""
    n = df.count()
    psi = min(max_samples, n)
    pool_n = min(n, pool_factor * psi * n_trees)
    frac = pool_n / max(n, 1)
    h = F.abs(F.xxhash64(F.col(key), F.lit(seed))) % 1_000_000_007
    pool = df.select(key, *features).filter(h < F.lit(frac * 1_000_000_007))
    # Each pool row joins a tree with probability ~3 psi / pool (3x oversampling,
    # so a tree almost surely has >= psi candidates); the tree keeps its psi
    # smallest hashes. Explodes ~3 psi rows per tree instead of the whole pool.
    q = min(1.0, 3.0 * psi / max(pool_n, 1))
    m = 1_000_000_007
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(m)) < F.lit(q * m))
    assign = pool.select(key, *features, F.explode(trees).alias("_tree"))
    assign = assign.withColumn("_h", F.xxhash64(F.col(key), F.col("_tree"), F.lit(seed)))
    w = Window.partitionBy("_tree").orderBy("_h", key)
    sample = assign.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi)
    grown = sample.groupBy("_tree").applyInPandas(lambda p: _grow(p, features, seed), _NODE_SCHEMA)
    return grown.withColumn("psi", F.lit(psi))


def _forest_arrays(forest_rows):
    nt = max(r["tree"] for r in forest_rows) + 1
    nn = max(r["node"] for r in forest_rows) + 1
    feat = np.full((nt, nn), -1, dtype=np.int64)
    thr = np.zeros((nt, nn))
    left = np.full((nt, nn), -1, dtype=np.int64)
    right = np.full((nt, nn), -1, dtype=np.int64)
    leaf_len = np.zeros((nt, nn))
    for r in forest_rows:
        t, i = r["tree"], r["node"]
        feat[t, i], thr[t, i], left[t, i], right[t, i] = r["feature"], r["threshold"], r["left"], r["right"]
        leaf_len[t, i] = r["depth"] + float(_c(np.array([r["size"]]))[0])
    return feat, thr, left, right, leaf_len


def iforest_score_samples(df: DataFrame, forest: DataFrame, features: list[str]) -> Column:
    """sklearn-style ``score_samples``: -2^(-E[h(x)] / c(psi)) (higher = more normal)."""
    rows = forest.collect()                    # <= n_trees * (2 * psi - 1) rows: bounded
    psi = rows[0]["psi"]
    bc = df.sparkSession.sparkContext.broadcast(_forest_arrays(rows))
    cpsi = float(_c(np.array([psi]))[0])

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        feat, thr, left, right, leaf_len = bc.value
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total = np.zeros(len(x))
        rows_idx = np.arange(len(x))
        for t in range(feat.shape[0]):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feat[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = np.zeros(len(x), dtype=bool)
                fi = np.where(inner, f, 0)
                go_left[inner] = x[rows_idx[inner], fi[inner]] < thr[t, node[inner]]
                node = np.where(inner, np.where(go_left, left[t, node], right[t, node]), node)
            total += leaf_len[t, node]
        mean = total / feat.shape[0]
        return pd.Series(-np.power(2.0, -mean / cpsi))

    return score(*[F.col(c).cast("double") for c in features])


def ueba_score(score_samples: Column, offset: float) -> Column:
    """M2 on one row: clip(-(score_samples - offset), 0, 1)."""
    return F.least(F.greatest(F.lit(float(offset)) - score_samples, F.lit(0.0)), F.lit(1.0))


def ueba_scores(df: DataFrame, forest: DataFrame, features: list[str], contamination: float = CONTAMINATION,
                key: str = "event_id") -> DataFrame:
    """M2: ueba = clip(-(score_samples - offset), 0, 1), offset = contamination
    quantile of the training scores (percentile_approx, accuracy 1e6)."""
    s = df.select(key, *features, iforest_score_samples(df, forest, features).alias("score_samples"))
    spark = df.sparkSession
    checkpoint_dir(spark)
    s = s.checkpoint()                           # scored once; reused for the offset and the output
    offset = s.agg(F.percentile_approx("score_samples", contamination, 1_000_000)).scalar()
    dec = F.col("score_samples") - offset
    return s.select(key, *features, "score_samples", dec.alias("decision"),
                    F.least(F.greatest(-dec, F.lit(0.0)), F.lit(1.0)).alias("ueba_score"))


def ueba_summary(scored: DataFrame) -> DataFrame:
    """M3."""
    return scored.agg(F.count(F.lit(1)).alias("n_scored"), F.avg("ueba_score").alias("mean_score"),
                      F.max("ueba_score").alias("max_score"))


def score_confusion(scored: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """M6: confusion counts, precision and recall of ``score > threshold`` against a 0/1 label."""
    pred = (F.col(score) > threshold).cast("int")
    lab = F.col(label).cast("int")
    c = scored.agg(F.sum(pred * lab).alias("tp"), F.sum(pred * (1 - lab)).alias("fp"),
                   F.sum((1 - pred) * lab).alias("fn"), F.sum((1 - pred) * (1 - lab)).alias("tn"))
    c = c.select(*[F.col(x).cast("bigint").alias(x) for x in ("tp", "fp", "fn", "tn")])
    return c.select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))


# ---- half-space trees, batch-parallel ---------------------------------------------------

def global_index(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense 0-based row index in ``order`` without a single-partition window:
    range partitions, per-partition counts (one row each, collected) as offsets."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions_for(df, rows=df.count())
    r = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    r = r.checkpoint()
    counts = sorted((row["_pid"], row["c"]) for row in r.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect())
    offs, acc = {}, 0
    for pid, c in counts:
        offs[pid] = acc
        acc += c
    # One small row per partition.
    offsets = F.broadcast(spark.createDataFrame(list(offs.items()), "_pid int, _before long"))
    w = Window.partitionBy("_pid").orderBy(*order)
    return (r.join(offsets, "_pid").withColumn("row_index", (F.col("_before") + F.row_number().over(w) - 1)
                                               .cast("bigint")).drop("_pid", "_before"))


def _hst_kernel(features: list[str], dims, splits, window: int, key: str):
    n_trees, height = dims.shape
    weights = 2 ** np.arange(height - 1, -1, -1)

    def leaves(x: np.ndarray) -> np.ndarray:
        # (rows, trees): leaf code of each row in each tree (bits of the comparisons)
        bits = x[:, dims] >= splits[None, :, :]
        return (bits * weights[None, None, :]).sum(axis=2)

    def run(cur: pd.DataFrame, prev: pd.DataFrame) -> pd.DataFrame:
        if len(cur) == 0:
            return pd.DataFrame({key: [], "row_index": [], "win": [], "hst_score": []})
        xc = cur[[f"_s{i}" for i in range(len(features))]].to_numpy(dtype=float)
        if len(prev) == 0:
            score = np.zeros(len(cur))
        else:
            xp = prev[[f"_p{i}" for i in range(len(features))]].to_numpy(dtype=float)
            lc, lp = leaves(xc), leaves(xp)
            raw = np.zeros(len(cur))
            for t in range(n_trees):
                u, c = np.unique(lp[:, t], return_counts=True)
                mass = dict(zip(u.tolist(), c.tolist()))
                raw += np.array([mass.get(v, 0) for v in lc[:, t].tolist()], dtype=float)
            score = 1.0 - raw / float(n_trees * window)
        return pd.DataFrame({key: cur[key].to_numpy(), "row_index": cur["row_index"].to_numpy(),
                             "win": cur["win"].to_numpy(), "hst_score": score})

    return run


def hst_trees(n_features: int, n_trees: int = 25, height: int = 8, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Which feature each level of each tree looks at, and where it splits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, n_features, size=(n_trees, height)), rng.uniform(0.0, 1.0, size=(n_trees, height))


def hst_window_score(df: DataFrame, features: list[str], order: list[str], window: int = 250,
                     n_trees: int = 25, height: int = 8, seed: int = SEED, key: str = "event_id") -> DataFrame:
    """M4 (re-aimed): per row ``hst_score`` in [0, 1] (1 = most anomalous)
    against the node masses of the previous tumbling window; the first window
    is 0. Features are min-max scaled to [0, 1] (one-row aggregate). Window
    ``w`` is cogrouped with window ``w - 1`` (at most 2 x ``window`` rows per
    group) and scored in numpy; no per-tree explosion of the rows."""
    dims, splits = hst_trees(len(features), n_trees, height, seed)
    # The index carries all columns and is checkpointed: the input plan runs once.
    g = global_index(df, order)
    mm = g.agg(*[F.min(c).alias(f"mn_{c}") for c in features], *[F.max(c).alias(f"mx_{c}") for c in features]).first()
    scaled = [((F.col(c) - F.lit(mm[f"mn_{c}"] or 0)) / F.lit(max((mm[f"mx_{c}"] or 0) - (mm[f"mn_{c}"] or 0), 1e-12)))
              .cast("double").alias(f"_s{i}") for i, c in enumerate(features)]
    whole = g.withColumn("win", F.floor(F.col("row_index") / window).cast("bigint"))
    g = whole.select(key, "row_index", "win", *scaled)
    # The previous window gets freshly aliased columns: a cogroup of two sides
    # derived from one plan otherwise loses columns to attribute de-duplication.
    prev = g.select((F.col("win") + 1).alias("win"),
                    *[F.col(f"_s{i}").alias(f"_p{i}") for i in range(len(features))])
    out = (g.groupBy("win").cogroup(prev.groupBy("win"))
           .applyInPandas(_hst_kernel(features, dims, splits, window, key),
                          f"{key} long, row_index long, win long, hst_score double"))
    return whole.drop("row_index", "win").join(out, key)


# ---- half-space trees, score before learn ------------------------------------------------

def feature_limits(df: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """Least and largest value of each feature (0 and 0 where there is none)."""
    row = df.agg(*[f(c).alias(f"{i}{f.__name__}") for i, c in enumerate(features) for f in (F.min, F.max)]).first()
    return [tuple(float(row[f"{i}{n}"] or 0) for n in ("min", "max")) for i in range(len(features))]


class HalfSpaceTrees:
    """Trees of fixed splits over features scaled by ``limits``; a leaf is a
    number, tree by tree."""

    def __init__(self, features: list[str], limits: list[tuple[float, float]], n_trees: int = 25, height: int = 8, seed: int = SEED):
        self.features, self.limits, self.leaves = features, limits, n_trees << height
        self.dims, self.splits = hst_trees(len(features), n_trees, height, seed)

    def leaf(self, batch: pa.RecordBatch) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree. A null feature counts as the least value."""
        scaled = []
        for name, (low, high) in zip(self.features, self.limits):
            x = np.nan_to_num(batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=low)
            scaled.append((x - low) / max(high - low, 1e-12))
        trees, height = self.dims.shape
        code = np.zeros((batch.num_rows, trees), dtype=np.int64)
        x = np.stack(scaled, axis=1)
        for level in range(height):
            code = code * 2 + (x[:, self.dims[:, level]] >= self.splits[:, level])
        return code + (np.arange(trees) << height)


def hst_masses(df: DataFrame, trees: HalfSpaceTrees) -> np.ndarray:
    """How many rows of ``df`` lie in each leaf of each tree: a fixed number of counts."""
    def run(batches):
        mass = np.zeros(trees.leaves, dtype=np.int64)
        for batch in batches:
            mass += np.bincount(trees.leaf(batch).reshape(-1), minlength=trees.leaves)
        at = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[at])], names=["leaf", "n"])

    found = df.select(*trees.features).mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    mass = np.zeros(trees.leaves, dtype=np.int64)
    for r in found:
        mass[r["leaf"]] = r["n"]
    return mass


def hst_running_score(df: DataFrame, trees: HalfSpaceTrees, order: list[str], start: np.ndarray | None = None,
                      partitions: int | None = None) -> DataFrame:
    """M4, score before learn: ``df`` with ``hst_score``, how unlike all earlier
    rows in ``order`` (and those counted in ``start``) a row is: 1 less the mean
    share of them in its leaves; 0 where there are none. Then the row counts
    for the later ones. One global model, as one loop over the rows has it.

    A two-level prefix count: range partitions count their leaves, a window per
    leaf sums the partitions before (each leaf has one row a partition), and
    every partition is scored from where the earlier ones left off. The rows
    are dealt by range once and by partition number once; a task holds one
    batch and a count per leaf.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or partitions_for(df, rows=df.count())
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("_pid", F.spark_partition_id()).checkpoint()

    def count(batches):
        mass, pid = None, 0
        for batch in batches:
            if batch.num_rows:
                mass = np.zeros(trees.leaves, dtype=np.int64) if mass is None else mass
                pid = batch.column("_pid")[0].as_py()
                mass += np.bincount(trees.leaf(batch).reshape(-1), minlength=trees.leaves)
        if mass is not None:
            at = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pid, dtype=np.int32)), pa.array(at), pa.array(mass[at])],
                                             names=["_pid", "_leaf", "_n"])

    counts = rows.select("_pid", *trees.features).mapInArrow(count, "_pid int, _leaf long, _n long")
    # Partition p starts with the counts of all before it; a leaf's sums change only where it was met.
    met = Window.partitionBy("_leaf").orderBy("_pid")
    sums = counts.select((F.col("_pid") + 1).alias("_pid"), "_leaf", F.sum("_n").over(met.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"),
                         F.lead("_pid").over(met).alias("_next"))
    sums = sums.withColumn("_next", F.coalesce("_next", F.lit(n - 1))).where("_pid <= _next")
    sums = sums.select("_leaf", "_n", F.explode(F.sequence("_pid", "_next")).alias("_pid"))
    kept = [c for c in df.columns if c != "hst_score"]
    own = rows.select("_pid", *kept, F.lit(None).cast("long").alias("_leaf"), F.lit(None).cast("long").alias("_n"), F.lit(1).alias("_kind"))
    head = sums.select("_pid", "_leaf", "_n", F.lit(0).alias("_kind"))
    both = own.unionByName(head, allowMissingColumns=True).repartition(n, "_pid").sortWithinPartitions("_pid", "_kind", *order)
    first = np.zeros(trees.leaves, dtype=np.int64) if start is None else start
    shared = spark.sparkContext.broadcast(first)
    n_trees = len(trees.dims)

    def score(batches):
        pid, mass = None, None
        for batch in batches:
            pids = batch.column("_pid").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pids)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if pids[a] != pid:
                    pid, mass = pids[a], shared.value.copy()
                head = part.column("_kind").to_numpy() == 0
                if head.any():
                    at = pa.array(head)
                    mass[part.filter(at).column("_leaf").to_numpy()] += part.filter(at).column("_n").to_numpy()
                    part = part.filter(pa.array(~head))
                if not part.num_rows:
                    continue
                leaf = trees.leaf(part)
                before = np.empty(leaf.shape, dtype=np.int64)
                for t in range(n_trees):
                    # How many rows of the batch before each one lie in its leaf.
                    by_leaf = np.argsort(leaf[:, t], kind="stable")
                    ordered = leaf[by_leaf, t]
                    fresh = np.flatnonzero(np.diff(ordered, prepend=-1))
                    run = np.arange(len(ordered)) - np.repeat(fresh, np.diff([*fresh, len(ordered)]))
                    before[by_leaf, t] = run
                seen = int(mass.sum()) // n_trees + np.arange(len(leaf))
                share = (mass[leaf] + before).sum(axis=1) / (n_trees * np.maximum(seen, 1))
                value = np.where(seen > 0, 1.0 - share, 0.0)
                mass += np.bincount(leaf.reshape(-1), minlength=trees.leaves)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(value)], names=[*kept, "hst_score"])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("hst_score", T.DoubleType())])
    return both.mapInArrow(score, schema)

"""Vector operators (V1-V6): k-NN exact and by hash tables, embedding fusion/anomaly, InfoNCE.

k-NN compares a stated query set with all training rows, in blocks: training
rows are dealt into blocks of about ``BLOCK_ROWS`` by a hash, every query goes
to every block, and a task holds one block while queries stream past it in
strips, so neither side is ever held whole. In dozens of dimensions no pivot
or cell bound excludes anything, so none is pretended: the distances of a strip
are one matrix product, and those near the k-th best are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightjar.functions.joins import bounded_broadcast

BLOCK_ROWS = 8_192
STRIP = 256
MAX_BATCH = 4_096       # rows of an InfoNCE batch

# ---- fixed values ------------------------------------------------------------------
TEMPERATURE = 0.5
# --------------------------------------------------------------------------------------


def sq_dist(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def dist(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def norm(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def nearest(q: np.ndarray, t: np.ndarray, t_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k nearest ``t`` of each ``q`` by (distance, id), and the
    distances. The matrix product only selects: what it ranks within rounding
    of the k-th best is measured exactly."""
    k = min(k, len(t))
    tt = (t * t).sum(axis=1)
    index, dist = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    for s in range(0, len(q), STRIP):
        part = q[s:s + STRIP]
        qq = (part * part).sum(axis=1)
        near = qq[:, None] + tt[None, :] - 2 * (part @ t.T)
        limit = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-9 * (qq + tt.max())
        row, col = np.nonzero(near <= limit[:, None])
        exact = np.sqrt(((part[row] - t[col]) ** 2).sum(axis=1))
        order = np.lexsort((t_id[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, np.arange(len(part)))
        pick = first[:, None] + np.arange(k)[None, :]
        index[s:s + STRIP], dist[s:s + STRIP] = col[pick], exact[pick]
    return index, dist


def _block_kernel(k: int):
    """Rows come sorted by block, training rows first: the block is held, queries stream past it."""
    names = ["q_id", "t_id", "t_label", "dist"]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(v, dtype=float) for v in batch.column("v").to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for batch in batches:
            while batch.num_rows:
                b = batch.column("block")[0].as_py()
                blocks = batch.column("block").to_numpy()
                own = batch.slice(0, int(np.searchsorted(blocks, b, side="right")))
                batch = batch.slice(own.num_rows)
                if b != block:
                    block, parts, held = b, [], None
                n_train = int((own.column("kind").to_numpy() == 0).sum())
                if n_train:
                    parts.append(own.slice(0, n_train))
                asked = own.slice(n_train)
                if not asked.num_rows or not parts:
                    continue
                if held is None:
                    held = (np.concatenate([matrix(p) for p in parts]),
                            np.concatenate([p.column("id").to_numpy() for p in parts]),
                            [x for p in parts for x in p.column("label").to_pylist()])
                t, t_id, label = held
                index, dist = nearest(matrix(asked), t, t_id, k)
                flat = index.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked.column("id").to_numpy(), index.shape[1])), pa.array(t_id[flat]),
                     pa.array([label[i] for i in flat.tolist()], type=pa.int32()), pa.array(dist.ravel())], names=names)

    return run


def _best(t: DataFrame, q: DataFrame, blocks: int, k: int) -> DataFrame:
    """The k nearest of each query among the blocks it was sent to."""
    parts = min(blocks, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = (t.unionByName(q).repartition(parts, "block").sortWithinPartitions("block", "kind", "id")
            .mapInArrow(_block_kernel(k), "q_id long, t_id long, t_label int, dist double"))
    w = Window.partitionBy("q_id").orderBy("dist", "t_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(train: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vec: str = "vec",
        label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest training rows per query: (q_id, t_id, t_label, dist, rank)."""
    spark = train.sparkSession
    blocks = max(1, -(-train.count() // block_rows))
    t = train.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
                     F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vec).alias("v"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                       F.col(key).cast("long").alias("id"), F.lit(None).cast("int").alias("label"), F.col(vec).alias("v"))
    return _best(t, q, blocks, k)


class HashTables:
    """Several tables that hash a vector to the nearest of a table's anchors.
    A query looks into the ``probes`` cells of each table whose anchors are
    nearest to it."""

    def __init__(self, anchors: list[np.ndarray], probes: int = 1):
        self.anchors, self.probes = anchors, probes

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """(rows, tables, n): the nearest cells of each row, nearest first."""
        out = np.empty((len(x), len(self.anchors), n), dtype=np.int32)
        for i, a in enumerate(self.anchors):
            far = (a * a).sum(axis=1)[None, :] - 2 * (x @ a.T)
            some = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(a) else np.broadcast_to(np.arange(len(a)), far.shape)
            some = np.ascontiguousarray(some)
            out[:, i] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)
        return out


def _cells(df: DataFrame, key: str, vec: str, label: Column, tables: HashTables, probes: int) -> DataFrame:
    """(id, label, v, table, cell): every row in its ``probes`` nearest cells of each table."""
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.asarray(v, dtype=float) for v in batch.column("v").to_pylist()])
                found = shared.value.order(x, probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.reshape(len(x), -1).tolist(), pa.list_(pa.int32()))],
                                                 names=[*batch.schema.names, "cells"])

    rows = df.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.col(vec).alias("v"))
    found = rows.mapInArrow(run, f"id long, label int, v {dict(df.dtypes)[vec]}, cells array<int>")
    return found.select("id", "label", "v", F.posexplode("cells").alias("at", "cell")).withColumn(
        "table", F.expr(f"at div {probes}").cast("int")).drop("at")


def fit_tables(train: DataFrame, queries: DataFrame, k: int, recall: float, n_tables: int, n_cells: int, n_sample: int,
               key: str, vec: str, seed: int = 42) -> HashTables:
    """Anchors are rows of ``train`` chosen by hash and moved to the means of a
    bounded sample; the number of probes is the least that finds the share
    ``recall`` of the exact neighbours of ``n_sample`` queries (or all cells)."""
    def some(df: DataFrame, n: int, salt: int) -> DataFrame:
        return df.orderBy(F.xxhash64(key, F.lit(salt)), key).limit(n)

    def matrix(df: DataFrame) -> np.ndarray:
        return np.array([r[0] for r in df.select(vec).collect()], dtype=float)

    pool = matrix(some(train, n_tables * n_cells * 8, seed))       # bounded by the parameters
    rng, anchors = np.random.default_rng(seed), []
    for _ in range(n_tables):
        a = pool[rng.permutation(len(pool))[:n_cells]].copy()
        for _ in range(5):
            near = HashTables([a]).order(pool, 1)[:, 0, 0]
            n = np.bincount(near, minlength=len(a))
            total = np.zeros_like(a)
            np.add.at(total, near, pool)
            a[n > 0] = total[n > 0] / n[n > 0, None]
        anchors.append(a)
    tables = HashTables(anchors)
    asked = some(queries, n_sample, seed + 1)
    true = knn(train, asked, k, key=key, vec=vec).select("q_id", "t_id")
    pairs = (true.join(asked.select(F.col(key).alias("q_id"), F.col(vec).alias("q")), "q_id")
             .join(train.select(F.col(key).alias("t_id"), F.col(vec).alias("t")), "t_id").select("q", "t").collect())
    if pairs:
        width = len(anchors[0])
        probe = tables.order(np.array([p["q"] for p in pairs], dtype=float), width)
        cell = tables.order(np.array([p["t"] for p in pairs], dtype=float), 1)
        first = (probe == cell).argmax(axis=2).min(axis=1)          # probes after which a pair meets in some table
        tables.probes = int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1
    return tables


def knn_indexed(train: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vec: str = "vec", label: str = "label",
                recall: float = 0.95, n_tables: int = 2, n_cells: int | None = None, n_sample: int = 256,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """V1 for many queries: like ``knn``, but a query is compared with the rows
    in its nearest cells of several hash tables only; distances are exact.
    ``recall`` is the share of true neighbours among ``n_sample`` queries that
    fixes the number of probes. All rows are indexed: a cell of many rows is cut
    into blocks of about ``block_rows``, all of which its queries visit. With
    fewer rows than a few blocks the exact search runs."""
    n = train.count()
    if n <= 4 * block_rows and n_cells is None:
        return knn(train, queries, k, key, vec, label, block_rows)
    n_cells = n_cells or int(min(4096, max(16, n ** 0.5)))
    tables = fit_tables(train, queries, k, recall, n_tables, min(n_cells, n), n_sample, key, vec)
    t = _cells(train, key, vec, F.col(label).cast("int"), tables, 1)
    q = _cells(queries, key, vec, F.lit(None).cast("int"), tables, min(tables.probes, len(tables.anchors[0])))
    # One small row per cell: how many blocks, and their numbers.
    size = t.groupBy("table", "cell").agg(F.expr(f"(count(*) + {block_rows - 1}) div {block_rows}").alias("n")).collect()
    first, cells = 0, []
    for r in sorted(size):
        cells.append((r["table"], r["cell"], first, r["n"]))
        first += r["n"]
    places = F.broadcast(train.sparkSession.createDataFrame(cells, "table int, cell int, first long, n long"))
    t = t.join(places, ["table", "cell"]).select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "v")
    q = q.join(places, ["table", "cell"]).select(
        F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("n") - 1).cast("int"))).alias("block"), F.lit(1).alias("kind"), "id", "label", "v")
    # A pair may meet in several tables: k of each table's best are k different rows.
    found = _best(t, q, max(1, first), k * n_tables).drop("rank").distinct()
    w = Window.partitionBy("q_id").orderBy("dist", "t_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_classify(train: DataFrame, queries: DataFrame, k: int = 3, **kw) -> DataFrame:
    """V1: majority vote of the k nearest labels; ties go to the smallest label."""
    nn = knn(train, queries, k, **kw)
    votes = nn.groupBy("q_id", "t_label").agg(F.count(F.lit(1)).alias("c"))
    return votes.groupBy("q_id").agg(F.max(F.struct("c", -F.col("t_label"), "t_label")).alias("m")).select(
        "q_id", F.col("m.t_label").alias("predicted"))


def knn_deviation(train: DataFrame, queries: DataFrame, **kw) -> DataFrame:
    """V2: nearest-neighbour distance per query, summarised (n, mean, max)."""
    nn = knn(train, queries, 1, **kw)
    return nn.agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean_distance"),
                  F.max("dist").alias("max_distance"))


def halves(vec: str, dim: int) -> tuple[Column, Column]:
    h = dim // 2
    return F.slice(vec, 1, h), F.slice(vec, h + 1, dim - h)


def embed_mean(a, b) -> Column:
    """V3: mean of the two modality embeddings."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2.0)


def label_centroids(df: DataFrame, vec: str = "vec", label: str = "label") -> DataFrame:
    """Per-label mean vector: one partial aggregate, one array per label."""
    return (df.filter(F.size(vec) > 0).groupBy(label)
            .agg(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias("centroid")))


def anomaly_score(d: Column) -> Column:
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + d)


def embedding_anomaly(df: DataFrame, vec: str = "vec", label: str = "label", key: str = "vec_id") -> DataFrame:
    """V4: 1 - 1/(1 + ||v - c||) against the label centroid, and against 0
    (no centroid: the norm). Empty vectors score 0."""
    c = label_centroids(df, vec, label)
    j = df.join(bounded_broadcast(c, 256 << 20), label, "left")
    empty = F.size(vec) == 0
    d = dist(vec, "centroid")
    return j.select(key, label, d.alias("distance"),
                    F.when(empty, F.lit(0.0)).otherwise(anomaly_score(d)).alias("score"),
                    F.when(empty, F.lit(0.0)).otherwise(anomaly_score(norm(vec))).alias("score_norm"))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Queries, true neighbours and how many of them were found."""
    hit = exact.select("q_id", "t_id").join(found.select("q_id", "t_id", F.lit(1).alias("hit")), ["q_id", "t_id"], "left")
    return hit.agg(F.count_distinct("q_id").alias("n_queries"), F.count("*").alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))


def info_nce(df: DataFrame, z1: str, z2: str, batch: str = "batch", key: str = "vec_id",
             temperature: float = TEMPERATURE) -> DataFrame:
    """V5: InfoNCE per batch with in-batch negatives. All pairs of a batch are
    compared, so batches of more than ``MAX_BATCH`` rows are refused."""
    if not df.groupBy(batch).count().filter(F.col("count") > MAX_BATCH).isEmpty():
        raise ValueError(f"a batch has more than {MAX_BATCH} rows")
    rows = df.select(F.col(batch).alias("b"), F.col(key).alias("i"), F.col(z1).alias("z1"), F.col(z2).alias("z2"))
    kind = dict(df.dtypes)[batch]

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack([np.asarray(v, dtype=float) for v in pdf[c]]) for c in ("z1", "z2"))
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (a, b))
        logit = a @ b.T / temperature
        top = logit.max(axis=1)
        lse = np.log(np.exp(logit - top[:, None]).sum(axis=1)) + top
        return pd.DataFrame({batch: [pdf["b"].iloc[0]], "n": [len(pdf)], "loss": [float((lse - np.diag(logit)).mean())]})

    return rows.groupBy("b").applyInPandas(loss, f"{batch} {kind}, n long, loss double")

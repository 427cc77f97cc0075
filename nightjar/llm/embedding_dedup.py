"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale per vector; the length of
what quantisation leaves out bounds the error of a product of two quantised
vectors. Distinct vectors are dealt into blocks of about ``BLOCK`` by a hash,
and every pair of blocks is one tile: the int8 products of a tile (computed as
float matrix products of integers, which are exact) give an upper bound of
each cosine, and only pairs that may reach the threshold are recomputed in
double precision. All pairs are covered, whatever the labels.

Equal vectors are one point with a count. A tile answers with link counts per
point and with links that span its groups, at most one row per point each, so
dense groups never become lists of pairs. The work is quadratic in the number
of distinct vectors, as an exact comparison of all rows by tiles is; memory
per task is that of two blocks.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link. Null ids take part and
get a null id's component; repeated rows are equal vectors. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions.components import connected_components
from nightjar.session import checkpoint_dir

BLOCK = 4_096
STRIP = 512             # rows of a tile worked on at once
RECHECK = 16_384        # pairs recomputed at once


def _vectors(kind: str):
    """Rows (vec_id, vec): the vector's bytes, null where it links with nothing."""
    def usable(v: list | None) -> bytes | None:
        if not v or None in v:
            return None
        a = np.array(v, dtype=kind) + 0         # -0 becomes 0
        return a.tobytes() if np.isfinite(a).all() and a.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [usable(v) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vecs, type=pa.binary())],
                                             names=["vec_id", "vec"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its points' names, counts and vectors (rows come sorted by block)."""
    names, types = ["dim", "block", "nodes", "counts", "vecs"], [pa.int32(), pa.int32(), *[pa.binary()] * 3]

    def done(key, nodes, counts, vecs) -> pa.RecordBatch:
        row = [*key, np.array(nodes, np.int64).tobytes(), np.array(counts, np.int64).tobytes(), b"".join(vecs)]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types)], names=names)

    key, nodes, counts, vecs = None, [], [], []
    for batch in batches:
        cols = batch.to_pydict()
        for dim, block, node, count, vec in zip(*(cols[c] for c in ("dim", "block", "node", "n", "vec"))):
            if key != (dim, block):
                if nodes:
                    yield done(key, nodes, counts, vecs)
                key, nodes, counts, vecs = (dim, block), [], [], []
            nodes.append(node)
            counts.append(count)
            vecs.append(vec)
    if nodes:
        yield done(key, nodes, counts, vecs)


class Tile:
    """A block's vectors, quantised."""

    def __init__(self, vecs: np.ndarray):
        self.x = vecs / np.abs(vecs).max(axis=1, keepdims=True)     # no overflow in the norms
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        unit = self.x / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        # Sums of dim products of int8 values are exact in float32 below 2^24.
        exact = np.float32 if vecs.shape[1] * 127 * 127 < 1 << 24 else np.float64
        whole = np.rint(unit / self.scale[:, None])
        self.q = whole.astype(np.int8).astype(exact)
        self.error = np.sqrt(((unit - whole * self.scale[:, None]) ** 2).sum(axis=1)) + 1e-12
        self.length = np.sqrt(((whole * self.scale[:, None]) ** 2).sum(axis=1))


def linked_pairs(a: Tile, b: Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs with cosine >= threshold; each unordered pair once."""
    slack = 1e-9
    for s in range(0, len(a.q), STRIP):
        e = min(s + STRIP, len(a.q))
        product = a.q[s:e] @ b.q.T
        # cos <= scaled product + |u_a| err_b + |u_b| err_a + err_a err_b
        worst = a.length[s:e] * b.error.max() + a.error[s:e] * (b.length.max() + b.error.max()) + slack
        least = np.where(threshold > worst, (threshold - worst) / (a.scale[s:e] * b.scale.max()), -np.inf)
        i, j = np.nonzero(product >= least[:, None].astype(product.dtype) * (1 - 1e-6))
        if same:
            i, j = i[i + s < j], j[i + s < j]
        bound = (product[i, j] * (a.scale[i + s] * b.scale[j]) + a.length[i + s] * b.error[j]
                 + b.length[j] * a.error[i + s] + a.error[i + s] * b.error[j] + slack)
        maybe = bound >= threshold
        i, j = i[maybe] + s, j[maybe]
        for at in range(0, len(i), RECHECK):
            p, q = i[at:at + RECHECK], j[at:at + RECHECK]
            cos = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q])
            ok = cos >= threshold
            if ok.any():
                yield p[ok], q[ok]


def _compare(threshold: float, kind: str):
    """Rows (a, b, n): with b a link, without b the copies that a links to."""
    def answer(rows: list[dict]) -> pa.RecordBatch | None:
        same = len(rows) == 1
        first, last = rows[0], rows[-1]
        nodes = [np.frombuffer(r["nodes"], np.int64) for r in (first, last)]
        counts = [np.frombuffer(r["counts"], np.int64) for r in (first, last)]
        tiles = [Tile(np.frombuffer(r["vecs"], kind).astype(np.float64).reshape(len(r["nodes"]) // 8, -1)) for r in rows]
        names = nodes[0] if same else np.concatenate(nodes)
        shift = 0 if same else len(nodes[0])
        label, links = np.arange(len(names)), np.zeros(len(names), np.int64)
        for i, j in linked_pairs(tiles[0], tiles[-1], threshold, same):
            links += np.bincount(i, weights=counts[1][j], minlength=len(names)).astype(np.int64)
            links += np.bincount(j + shift, weights=counts[0][i], minlength=len(names)).astype(np.int64)
            _join(label, i, j + shift)
        hit = np.flatnonzero(links)
        moved = np.flatnonzero(label != np.arange(len(names)))
        if not len(hit):
            return None
        cols = [pa.array(np.concatenate([names[moved], names[hit]])),
                pa.array([*names[label[moved]].tolist(), *[None] * len(hit)], type=pa.int64()),
                pa.array(np.concatenate([np.zeros(len(moved), np.int64), links[hit]]))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in ("dim", "low", "high")):
                    if (out := answer(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := answer(held)) is not None:
            yield out

    return run


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups that the pairs connect; a group's label is its smallest member."""
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    width = int(kind[-1])
    values = F.col("embedding") if width == 4 else F.col("embedding").cast("array<double>")
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v"))
            .mapInArrow(_vectors(kind), "vec_id long, vec binary")
            .withColumn("node", F.xxhash64("vec")).checkpoint())
    points = (rows.where("vec IS NOT NULL").groupBy("node", "vec")
              .agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
              .withColumn("dim", (F.length("vec") / width).cast("int")).checkpoint())
    blocks_of = points.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # A row per vector length: a handful.
    sized = points.join(F.broadcast(blocks_of), "dim").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    packed = (sized.select("dim", "block", "node", "n", "vec").repartition(parts, "dim", "block")
              .sortWithinPartitions("dim", "block", "node")
              .mapInArrow(_pack, "dim int, block int, nodes binary, counts binary, vecs binary"))
    paired = (packed.join(F.broadcast(blocks_of), "dim")
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("dim", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                      "block", "nodes", "counts", "vecs"))
    found = (paired.repartition(max(parts, 4 * spark.sparkContext.defaultParallelism), "dim", "low", "high")
             .sortWithinPartitions("dim", "low", "high", "block")
             .mapInArrow(_compare(threshold, kind), "a long, b long, n long").checkpoint())
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    low = (points.join(groups, "node", "left")
           .withColumn("component", F.coalesce("component", "node")))
    first = low.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = (low.join(first, "component").join(links, "node", "left")
             .select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    out = rows.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("node")).alias("node")).join(named, "node", "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

"""SimHash near-dedup by anchor-point covering.

Fingerprints are points of {0,1}^64. The anchors are the words of a covering
code: the product of two binary Golay codes on bits 0-22 and 23-45 (covering
radius 3 each, and perfect, so a point has exactly one nearest word) and the
one-word code on the other 18 bits. Each fingerprint has one home anchor; it is
replicated to every anchor whose blocks lie within covering radius plus what
the distance threshold leaves for that block. If two fingerprints differ in at
most ``max_distance`` (0 to 2) bits, each is replicated to the other's home, so
comparing homes with replicas per anchor finds every link.

Replicas that meet no home are dropped by a bitmap of occupied anchors
(2^24 bits, 2 MiB whatever the input). Equal fingerprints are one point. An
anchor with more than ``MAX_HOMES`` homes is split: its homes are dealt over
sub-anchors and its replicas go to each. Per anchor only spanning links leave
the task, never all pairs; components are then found over distinct
fingerprints.

A null text counts as empty; texts without words have fingerprint zero and are
linked like any other. Rows with null ``doc_id`` take part; the smallest id
ignores nulls. Repeated rows are ordinary members of their group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.arrow import append_columns
from nightjar.functions.components import connected_components
from nightjar.session import checkpoint_dir

SEED = 42
BLOCK = 23                      # bits of a Golay word
GENERATOR = 0b101011100011      # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
RADIUS = 3
ANCHOR_BITS = 24
SEGMENT = 1 << 15               # anchors per row of the bitmap
MAX_HOMES = 2_048


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of the A-Z lowered text, repeats included;
    fewer words make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(words) - k + 1)


def fingerprints(texts: list[bytes], k: int) -> np.ndarray:
    """Bit i is 1 if it is set in over half of a text's hashes. Eight bits are
    counted at once, one per byte of a 64-bit sum of at most 255 hashes."""
    hashes = [shingle_hashes(t, k) for t in texts]
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([hashes[i] for i in some])
    size = sizes[some]
    runs = -(-size // 255)
    inner = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(np.cumsum(size) - size, runs) + 255 * inner
    counts = np.empty((len(starts), 8, 8), dtype=np.int64)
    for j in range(8):
        lanes = (flat >> np.uint64(j)) & np.uint64(0x0101010101010101)
        counts[:, :, j] = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64), np.cumsum(runs) - runs, axis=0)
    bits = total * 2 > size[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    rest = words.astype(np.uint32).copy()
    for bit in range(BLOCK - 1, 10, -1):
        high = (rest >> np.uint32(bit)) & np.uint32(1)
        rest ^= high * np.uint32(GENERATOR << (bit - 11))
    return rest


def _error_table() -> list[np.ndarray]:
    """For each excess 0, 1, 2: error patterns by syndrome (rows padded with
    -1) that lead from a word to the code words at distance up to RADIUS, then
    RADIUS + 1, then RADIUS + 2."""
    tables = []
    for weights in (range(RADIUS + 1), [RADIUS + 1], [RADIUS + 2]):
        errors = np.array([sum(1 << bit for bit in bits) for w in weights for bits in combinations(range(BLOCK), w)],
                          dtype=np.uint32)
        syndrome = _syndrome(errors)
        order = np.argsort(syndrome, kind="stable")
        errors, syndrome = errors[order], syndrome[order]
        count = np.bincount(syndrome, minlength=1 << 11)
        table = np.full((1 << 11, max(1, count.max())), -1, dtype=np.int64)
        table[syndrome, np.arange(len(errors)) - (np.cumsum(count) - count)[syndrome]] = errors
        tables.append(table)
    return tables


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_error_table())
    return _TABLES


def _block_words(blocks: np.ndarray, excess: int) -> np.ndarray:
    """Code words (their 12 leading bits) of each 23-bit block; -1 is padding."""
    errors = _tables()[excess][_syndrome(blocks)]
    return np.where(errors < 0, -1, (blocks[:, None].astype(np.int64) ^ errors) >> 11)


def _blocks(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOCK) - 1)
    return (points & mask).astype(np.uint32), ((points >> np.uint64(BLOCK)) & mask).astype(np.uint32)


def home_anchors(points: np.ndarray) -> np.ndarray:
    a, b = _blocks(points)
    return (_block_words(a, 0)[:, 0] << 12) | _block_words(b, 0)[:, 0]


def replica_anchors(points: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor other than the home that a point goes to."""
    a, b = _blocks(points)
    wa = [_block_words(a, e) for e in range(max_distance + 1)]
    wb = [_block_words(b, e) for e in range(max_distance + 1)]
    rows, anchors = [], []
    for ea in range(max_distance + 1):
        for eb in range(max_distance + 1 - ea):
            if ea + eb == 0:
                continue
            both = (wa[ea][:, :, None] << 12) | wb[eb][:, None, :]
            ok = (wa[ea][:, :, None] >= 0) & (wb[eb][:, None, :] >= 0)
            rows.append(np.nonzero(ok)[0])
            anchors.append(both[ok])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(anchors)


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("point").to_numpy(zero_copy_only=False).view(np.uint64)


def _occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's occupied anchors as packed segments."""
    seen = np.zeros(1 << ANCHOR_BITS, dtype=bool)
    for batch in batches:
        seen[home_anchors(_points(batch))] = True
    parts = seen.reshape(-1, SEGMENT)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, type=pa.int32()), pa.array([np.packbits(parts[s]).tobytes() for s in used], type=pa.binary())],
        names=["segment", "bits"])


def _merge_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}       # at most 2 MiB
    for batch in batches:
        for segment, bits in zip(*(c.to_pylist() for c in batch.columns)):
            bits = np.frombuffer(bits, np.uint8)
            held[segment] = held[segment] | bits if segment in held else bits
    yield pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.int32()),
                                      pa.array([v.tobytes() for v in held.values()], type=pa.binary())],
                                     names=["segment", "bits"])


def _spread(shared, max_distance: int):
    """Rows (anchor, point, home): each point at home and wherever it can meet one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            everything = _points(batch)
            for at in range(0, len(everything), 4096):
                points = everything[at:at + 4096]
                rows, anchors = replica_anchors(points, max_distance)
                met = (bits[anchors >> 3] >> (7 - (anchors & 7)).astype(np.uint8)) & 1 == 1
                rows, anchors = rows[met], anchors[met]
                anchor = np.concatenate([home_anchors(points), anchors]).astype(np.int32)
                point = np.concatenate([points, points[rows]]).view(np.int64)
                home = np.zeros(len(point), dtype=bool)
                home[:len(points)] = True
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(point), pa.array(home)],
                                                 names=["anchor", "point", "home"])
    return run


class _Anchor:
    """The homes met so far at one anchor, and which of them hang together."""

    def __init__(self, key):
        self.key = key
        self.homes = np.empty(0, np.uint64)
        self.group = np.empty(0, np.int64)      # index of a home that stands for its group

    def add(self, points: np.ndarray, home: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
        """Links that span what the new rows connect: at most one for each row
        and one for each joining of two groups of homes."""
        new = points[home]
        self.group = np.concatenate([self.group, np.arange(len(self.homes), len(self.homes) + len(new))])
        self.homes = np.concatenate([self.homes, new])
        links: list[tuple[int, int]] = []
        for at in range(0, len(points), 512):
            part = points[at:at + 512]
            gap = np.bitwise_count(part[:, None] ^ self.homes[None, :])
            row, near = np.nonzero((gap <= max_distance) & (gap > 0))
            if not len(row):
                continue
            rows, first = np.unique(row, return_index=True)
            links += zip(part[rows].tolist(), self.homes[near[first]].tolist())
            label = self.group[near]
            apart = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
            stop = np.append(first[1:], len(row))
            for i in np.flatnonzero(apart):
                labels = np.unique(self.group[near[first[i]:stop[i]]])
                if len(labels) > 1:
                    links += [(int(self.homes[labels[0]]), int(self.homes[x])) for x in labels[1:]]
                    self.group[np.isin(self.group, labels)] = labels[0]
        return links


def _compare(max_distance: int):
    """Compare homes with replicas per (anchor, sub); rows come sorted by them, homes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = (batch.column("anchor").to_numpy().astype(np.int64) << 32) | batch.column("sub").to_numpy()
            points = _points(batch)
            home = batch.column("home").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            links: list[tuple[int, int]] = []
            last = len(starts) - 1
            # Single rows inside a batch meet nobody; the first and the last group may go on.
            todo = [g for g in np.flatnonzero(ends - starts > 1).tolist() if 0 < g < last]
            for g in sorted({0, *todo, last}):
                s, e = starts[g], ends[g]
                if state is None or state.key != key[s]:
                    state = _Anchor(key[s])
                links += state.add(points[s:e], home[s:e], max_distance)
            if links:
                ab = np.array(links, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])
    return run


def fingerprint_rows(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with ``point``: the fingerprint as a (signed) long."""
    return append_columns(docs, "text", lambda texts: {"point": fingerprints(texts, k).view(np.int64)},
                          [T.StructField("point", T.LongType())])


def links_between(points: DataFrame, max_distance: int) -> DataFrame:
    """Links (a, b) that span the groups of distinct ``point`` values within
    ``max_distance`` bits. ``points`` should be cheap to read twice."""
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2 for this code")
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = (points.mapInArrow(_occupied, "segment int, bits binary").repartition(min(parts, 64), "segment")
                .mapInArrow(_merge_segments, "segment int, bits binary").collect())     # at most 2 MiB
    bitmap = bytearray((1 << ANCHOR_BITS) // 8)
    for segment, bits in segments:
        bitmap[segment * SEGMENT // 8:(segment + 1) * SEGMENT // 8] = bits
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    spread = points.mapInArrow(_spread(shared, max_distance), "anchor int, point long, home boolean").checkpoint()
    crowded = (spread.where("home").groupBy("anchor").count().where(F.col("count") > MAX_HOMES)
               .select("anchor", F.expr(f"cast(ceil(count / {MAX_HOMES}) AS int)").alias("subs"))).checkpoint()
    if crowded.isEmpty():
        dealt = spread.withColumn("sub", F.lit(0))
    else:
        # A crowded anchor: its homes are dealt out, every row is compared with each part.
        subs = F.coalesce("subs", F.lit(1))
        dealt = (spread.join(crowded, "anchor", "left")
                 .withColumn("own", F.pmod(F.xxhash64("point"), subs).cast("int"))
                 .withColumn("sub", F.explode(F.sequence(F.lit(0), subs - 1)))
                 .select("anchor", "point", (F.col("home") & (F.col("own") == F.col("sub"))).alias("home"), "sub"))
    return (dealt.repartition(parts, "anchor", "sub")
            .sortWithinPartitions("anchor", "sub", F.desc("home"), "point")
            .mapInArrow(_compare(max_distance), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, text_hash, point, component_id, group_point) per row of
    ``docs``; ``text_hash`` tells rows of one doc_id apart. ``group_point``, the
    smallest fingerprint of the component, names it even where one doc_id is in
    several components or a component has no id."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = fingerprint_rows(src, k).select("doc_id", "text_hash", "point").checkpoint()
    points = rows.groupBy("point").agg(F.min("doc_id").alias("first_id")).checkpoint()
    links = links_between(points.select("point"), max_distance)
    groups = connected_components(links)
    named = groups.join(points, groups["node"] == points["point"]).select("node", "component", "first_id")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    moved = named.join(lowest, "component").select(F.col("node").alias("point"), "component", "component_id")
    final = (points.join(moved, "point", "left")
             .select("point", F.coalesce("component_id", "first_id").alias("component_id"),
                     F.coalesce("component", "point").alias("group_point")))
    return rows.join(final, "point").select("doc_id", "text_hash", "point", "component_id", "group_point")


def keep_one_each(docs: DataFrame, k: int = 3, max_distance: int = 2) -> DataFrame:
    """The rows of ``docs`` that represent their group: the one with the
    smallest (doc_id, text_hash). Of repeated rows one stays."""
    found = near_duplicates(docs, k, max_distance)
    member = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    # A group's head is among the rows with its smallest id.
    heads = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("group_point").agg(F.min(member).alias("m"))
             .select(F.col("m.doc_id").alias("__id"), F.col("m.text_hash").alias("__hash"))).checkpoint()
    copies = (found.select("doc_id", "text_hash").groupBy("doc_id", "text_hash").count().where("count > 1")
              .limit(1).isEmpty())
    marked = docs.withColumn("__h", F.xxhash64("text"))
    kept = marked.join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")),
                       "left_semi")
    if not copies:
        kept = kept.dropDuplicates(["doc_id", "__h"])
    return kept.drop("__h")

"""Substring dedup with a compressed FM-index per shard.

A window is ``window`` consecutive words of one document. Every word covered by
a window whose word sequence also starts elsewhere in the corpus goes.

1. Anchors. A window's anchor is the word k-gram with the smallest hash inside
   it (the leftmost of equals), so equal windows have equal anchors at equal
   places. Neighbouring windows with the same anchor place form a piece of at
   most ``2 window - k`` words. Two Bloom filters over the anchors of all
   pieces tell which anchors may occur twice; pieces with other anchors hold
   no repeated window.
2. Shards. The remaining pieces are dealt by anchor; equal pieces are merged
   with a count, in the task before the shuffle and again after it. Each task
   cuts its sorted anchors into shards of about ``SHARD_WORDS`` words and
   builds one FM-index per shard (pieces of an anchor that has only one
   distinct piece need no index: they are repeated if their count says so).
3. Search. Pieces that occur once are streamed against their shard's index by
   backward search; matching statistics give the stretches in which every
   window occurs at least twice. A piece that occurs twice is repeated whole.
4. The stretches go back to their documents by row.

An anchor in more than ``HOT_PIECES`` pieces would make a shard of any size;
its windows are dealt by the hash of all their words instead, one piece each.
Nothing is dropped or capped.

Words are runs of anything but ASCII white space, unchanged. Null texts have
no words; texts shorter than a window keep all. Repeated rows repeat all their
windows. Null ids are ordinary. Other columns pass through; existing result
columns are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm import repeat_filter
from nightjar.llm.arrow import append_columns, bytes_of, slices
from nightjar.llm.fm_index import FMIndex, repeated_windows
from nightjar.session import checkpoint_dir

WINDOW = 35
SHARD_WORDS = 700_000
HOT_PIECES = 20_000
HOLD_KEYS = 1 << 20         # anchors a task holds before it marks them
HOLD_BYTES = 48 << 20       # pieces a task holds before it emits them
SEED = 99


def gram_size(window: int) -> int:
    return max(1, min(8, window // 3))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """One mixed hash per run of ``size`` words."""
    out = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[j:len(hashes) - size + 1 + j]
    return _mix(out)


class Pieces:
    """The pieces of some texts: ``doc``, ``start`` and ``end`` (words of the
    document), ``key`` (the anchor's hash)."""

    def __init__(self, texts: list[bytes], window: int):
        k = gram_size(window)
        self.words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        ids = np.fromiter((known[w] for ws in self.words for w in ws), dtype=np.int64, count=int(sizes.sum()))
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in known), dtype=np.uint64,
                                  count=len(known))[ids] if len(ids) else np.empty(0, np.uint64)
        n = len(ids)
        self.doc = self.start = self.end = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        if n < window:
            return
        grams = _grams(self.hashes, k)
        low = ((grams >> np.uint64(32)) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        span, width = 1, window - k + 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:-(width - span)], low[width - span:])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        whole = np.flatnonzero(owner[:n - window + 1] == owner[window - 1:])
        if not len(whole):
            return
        anchor = place[whole]
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(whole)) - 1
        self.doc = owner[whole[starts]]
        self.start = whole[starts] - self.first[self.doc]
        self.end = whole[stops] + window - self.first[self.doc]
        self.key = grams[anchor[starts]]

    def text(self, i: int) -> bytes:
        return b" ".join(self.words[self.doc[i]][self.start[i]:self.end[i]])


def _both(keys: np.ndarray) -> np.ndarray:
    """Two halves for the filters."""
    return np.stack([keys, _mix(keys + np.uint64(1))], axis=1)


def _mark_anchors(window: int, bits: int):
    """Rows of the two filters; rows of segment -1 hold anchors that a task has
    several times, with counts."""
    def flush(held: list[np.ndarray]) -> list[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts > 1
        repeated = np.repeat(keys, np.minimum(counts, 2))
        heavy = pa.RecordBatch.from_arrays(
            [pa.array([-1], type=pa.int32()), pa.array([keys[many].tobytes()], type=pa.binary()),
             pa.array([counts[many].astype(np.int64).tobytes()], type=pa.binary())], names=["segment", "once", "twice"])
        return [repeat_filter.mark(_both(repeated), bits), heavy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(Pieces(bytes_of(part, "text"), window).key)
                n += len(held[-1])
                if n >= HOLD_KEYS:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["once"], np.int64)),
                                              pa.array(np.frombuffer(row["twice"], np.int64))], names=["key", "n"])


def _emit_pieces(window: int, bits: int, shared):
    """Rows (anchor, piece, places): suspected pieces, merged within the task."""
    names, types = ["anchor", "piece", "places"], [pa.int64(), pa.binary(), pa.binary()]

    def flush(held: dict) -> pa.RecordBatch:
        cols = [[v[0] for v in held.values()], list(held), [np.array(v[1], np.int64).tobytes() for v in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, hot = shared.value
        held: dict[bytes, tuple[int, list]] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                pieces = Pieces(bytes_of(part, "text"), window)
                if not len(pieces.key):
                    continue
                maybe = repeat_filter.suspected(packed, _both(pieces.key), bits)
                crowded = np.isin(pieces.key, hot)
                keys = pieces.key.view(np.int64)
                todo = [(int(keys[i]), int(pieces.doc[i]), int(pieces.start[i]), int(pieces.end[i]))
                        for i in np.flatnonzero(maybe & ~crowded)]
                for i in np.flatnonzero(maybe & crowded):       # one piece per window, by all its words
                    d, s, e = int(pieces.doc[i]), int(pieces.start[i]), int(pieces.end[i])
                    at = pieces.first[d]
                    whole = _grams(pieces.hashes[at + s:at + e], window).view(np.int64).tolist()
                    todo += [(key, d, s + j, s + j + window) for j, key in enumerate(whole)]
                for key, d, s, e in todo:
                    text = b" ".join(pieces.words[d][s:e])
                    if text in held:
                        held[text][1].extend((a[d], b[d], s))
                    else:
                        held[text] = (key, [a[d], b[d], s])
                        size += len(text) + 300
                if size >= HOLD_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


class Shard:
    """Pieces of some anchors; ``cover`` says what their documents lose."""

    def __init__(self, window: int):
        self.window = window
        self.groups: list[dict[bytes, list[bytes]]] = []
        self.n_words = 0

    def cover(self) -> dict[tuple[int, int], list[tuple[int, int]]]:
        out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)

        def put(places: np.ndarray, runs: list[tuple[int, int]]) -> None:
            for a, b, at in places.reshape(-1, 3).tolist():
                out[a, b] += [(at + s, at + e + self.window) for s, e in runs]

        known: defaultdict = defaultdict()
        known.default_factory = lambda: len(known) + 1      # 0 parts the pieces
        symbols, starts, lengths, wanted, n = [], [], [], [], 0
        for group in self.groups:
            for text, places in group.items():
                found = np.frombuffer(b"".join(places), np.int64)
                words = text.split(b" ")
                if len(found) > 3:
                    put(found, [(0, len(words) - self.window)])
                if len(group) == 1:
                    continue
                symbols.append(np.fromiter(map(known.__getitem__, words), np.int64, count=len(words)))
                symbols.append(np.zeros(1, np.int64))
                if len(found) == 3:
                    starts.append(n)
                    lengths.append(len(words))
                    wanted.append(found)
                n += len(words) + 1
        if wanted:
            text = np.concatenate(symbols)
            index = FMIndex(text, 2 * self.window)
            runs = repeated_windows(index, text, np.array(starts), np.array(lengths), self.window)
            for places, found in zip(wanted, runs):
                if found:
                    put(places, found)
        return out


def _search(window: int):
    """Rows (a, b, ranges): word ranges that a document loses; rows come sorted by anchor."""
    def answer(shard: Shard) -> pa.RecordBatch | None:
        cover = shard.cover()
        if not cover:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in cover], type=pa.int64()), pa.array([k[1] for k in cover], type=pa.int64()),
             pa.array([np.array(v, np.int64).tobytes() for v in cover.values()], type=pa.binary())],
            names=["a", "b", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, anchor = Shard(window), None, None
        for batch in batches:
            for key, piece, places in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "places"))):
                if group is None or key != anchor:
                    if shard.n_words >= SHARD_WORDS:
                        if (out := answer(shard)) is not None:
                            yield out
                        shard = Shard(window)
                    anchor, group = key, {}
                    shard.groups.append(group)
                if piece not in group:
                    group[piece] = []
                    shard.n_words += len(piece) // 5 + 1
                group[piece].append(places)
        if (out := answer(shard)) is not None:
            yield out

    return run


_FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
           T.StructField("n_removed", T.LongType())]


def _remove(texts: list[bytes], ranges: list) -> dict:
    made = {"text": [], "n_words": [], "n_removed": []}
    for text, parts in zip(texts, ranges):
        words = text.split()
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for part in parts or ():
            pairs = np.frombuffer(part, np.int64).reshape(-1, 2)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 1], -1)
        gone = np.cumsum(change[:-1]) > 0
        made["n_words"].append(len(words))
        made["n_removed"].append(int(gone.sum()))
        made["text"].append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words))
    return made


def dedup_substrings(docs: DataFrame, window: int = WINDOW, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``docs`` with ``text`` made of the kept words joined by one space,
    ``n_words`` (before) and ``n_removed``."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked_docs = docs.withColumns({"__a": F.xxhash64("doc_id", "text"), "__b": F.xxhash64("text", "doc_id", F.lit(1))})
    bits = repeat_filter.size_bits(docs, 4)
    marks = (docs.select(F.col("text").cast("binary").alias("text"))
             .mapInArrow(_mark_anchors(window, bits), repeat_filter.SCHEMA).checkpoint())
    packed = repeat_filter.collect(marks.where("segment >= 0"), bits)
    # At most (pieces / hot_pieces) anchors.
    hot = (marks.where("segment < 0").mapInArrow(_heavy, "key long, n long").groupBy("key")
           .agg(F.sum("n").alias("n")).where(F.col("n") > hot_pieces).select("key").collect())
    shared = spark.sparkContext.broadcast((packed, np.array([r[0] for r in hot], np.int64).view(np.uint64)))
    pieces = (marked_docs.select(F.col("__a").alias("a"), F.col("__b").alias("b"), F.col("text").cast("binary").alias("text"))
              .mapInArrow(_emit_pieces(window, bits, shared), "anchor long, piece binary, places binary"))
    ranges = (pieces.repartition(parts, "anchor").sortWithinPartitions("anchor")
              .mapInArrow(_search(window), "a long, b long, ranges binary")
              .groupBy(F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.collect_list("ranges").alias("__ranges")))
    joined = marked_docs.join(ranges, ["__a", "__b"], "left")
    return append_columns(joined, "text", _remove, _FIELDS, also=("__ranges",)).drop("__a", "__b", "__ranges")

"""Line dedup with two Bloom filters.

1. Every task hashes the line keys of its documents and marks the cells of two
   Bloom filters: seen once, and seen at least twice. The filters are merged
   segment by segment: a cell that two tasks have seen counts as seen twice.
   No repeated key is missed; a few single ones look repeated.
2. Keys that the second filter suspects, and only they, are counted exactly:
   each task pre-aggregates its suspects, then one row per key and task is
   shuffled. The first occurrence (smallest doc_id, then line) is chosen here.
3. Confirmed keys are applied to the texts: broadcast while they are at most
   ``MAX_BROADCAST_KEYS``, else joined to the documents by row.

The filters' size follows the input's estimated size up to ``repeat_filter.MAX_BITS``
(32 MiB, the proven bound of the broadcast). Beyond it more keys are suspected
and counted exactly; the result does not change. Keys are compared by a
128-bit digest.

A line's key is the line without ASCII white space at both ends, A-Z lowered.
Null and empty texts are one empty line. Every row counts as one document, so
repeated rows count as several; null ids are ordinary. Other columns pass
through; existing ``n_lines`` and ``n_dropped`` columns are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm import repeat_filter
from nightjar.llm.arrow import append_columns, bytes_of, slices
from nightjar.session import checkpoint_dir

FLUSH_KEYS = 1 << 20            # keys a task holds before it emits
MAX_BROADCAST_KEYS = 500_000    # 16 bytes each

_FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
           T.StructField("n_dropped", T.LongType())]


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip() for line in text.lower().split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def digests(text: bytes, min_chars: int) -> dict[bytes, int]:
    """Digest of each distinct key of one text and the first line that has it."""
    found: dict[bytes, int] = {}
    for i, key in enumerate(line_keys(text)):
        if key and long_enough(key, min_chars):
            found.setdefault(xxhash.xxh3_128_digest(key), i)
    return found


def _mark(bits: int, min_chars: int):
    """The task's keys as rows of the two filters."""
    def flush(held: list[bytes]) -> pa.RecordBatch:
        return repeat_filter.mark(np.frombuffer(b"".join(held), dtype="<u8").reshape(-1, 2), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for part in slices(batch, "text"):
                for text in bytes_of(part, "text"):
                    held.extend(digests(text, min_chars))
                if len(held) >= FLUSH_KEYS:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _suspects(shared, bits: int, min_chars: int):
    """Rows (digest, documents, first doc_id, first line) of a task's suspects."""
    names = ["digest", "n_docs", "doc_id", "line"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]

    def first(a: tuple, b: tuple) -> bool:
        return (a[0] is not None, a[0] or 0, a[1]) < (b[0] is not None, b[0] or 0, b[1])

    def flush(held: dict) -> pa.RecordBatch:
        cols = [list(held), [v[0] for v in held.values()], [v[1][0] for v in held.values()],
                [v[1][1] for v in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        held: dict[bytes, list] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(d, doc_id, line)
                         for doc_id, text in zip(part.column("doc_id").to_pylist(), bytes_of(part, "text"))
                         for d, line in digests(text, min_chars).items()]
                if not found:
                    continue
                keys = np.frombuffer(b"".join(f[0] for f in found), dtype="<u8").reshape(-1, 2)
                for i in np.flatnonzero(repeat_filter.suspected(packed, keys, bits)):
                    d, doc_id, line = found[i]
                    if d not in held:
                        held[d] = [1, (doc_id, line)]
                    else:
                        held[d][0] += 1
                        if first((doc_id, line), held[d][1]):
                            held[d][1] = (doc_id, line)
                if len(held) >= FLUSH_KEYS:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    return run


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(digest, n_docs, first) of the keys in at least ``min_docs`` (2 or more)
    documents, counted exactly; ``first`` is (doc_id, line)."""
    if min_docs < 2:
        raise ValueError("min_docs is at least 2")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bits = repeat_filter.size_bits(docs, 8)
    marked = src.select("text").mapInArrow(_mark(bits, min_chars), repeat_filter.SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(repeat_filter.collect(marked, bits))
    suspects = src.mapInArrow(_suspects(shared, bits, min_chars), "digest binary, n_docs long, doc_id long, line int")
    return (suspects.groupBy("digest")
            .agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("first"))
            .where(F.col("n_docs") >= min_docs))


def without_lines(text: bytes, drop, doc_id, min_chars: int, spare: bool = False) -> tuple[bytes, int, int]:
    """(kept text, lines, dropped lines). ``drop`` maps a digest to the first
    occurrence that stays, or to None. With ``spare`` a text that would lose
    all its lines but blank ones stays whole."""
    lines, kept = text.split(b"\n"), []
    for i, key in enumerate(line_keys(text)):
        gone = False
        if key and long_enough(key, min_chars):
            d = xxhash.xxh3_128_digest(key)
            gone = d in drop and drop[d] != (doc_id, i)
        if not gone:
            kept.append(lines[i])
    if spare and len(kept) < len(lines) and not b"".join(kept).strip():
        return text, len(lines), 0
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


_MAPS: dict[str, dict] = {}     # a worker's map of the run at hand


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none",
                max_broadcast_keys: int = MAX_BROADCAST_KEYS, spare: bool = False) -> DataFrame:
    """``docs`` with ``text`` lacking the lines whose key is in at least
    ``min_docs`` documents, ``n_lines`` (before) and ``n_dropped``.

    ``keep="first"`` leaves each key's first occurrence in place. With ``spare`` a document
    all of whose lines would go stays whole.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    spark = docs.sparkSession
    checkpoint_dir(spark)
    keys = repeated_keys(docs, min_docs, min_chars).checkpoint()
    stays = keep == "first"

    def entry(first):
        return (first["doc_id"], first["line"]) if stays else None

    def result(rows: list[tuple[bytes, int, int]]) -> dict:
        return {"text": [r[0] for r in rows], "n_lines": [r[1] for r in rows], "n_dropped": [r[2] for r in rows]}

    if keys.count() <= max_broadcast_keys:
        shared = spark.sparkContext.broadcast([(bytes(r["digest"]), entry(r["first"])) for r in keys.collect()])

        tag = uuid.uuid4().hex

        def by_broadcast(texts: list[bytes], ids: list) -> dict:
            drop = _MAPS.get(tag)
            if drop is None:
                _MAPS.clear()
                drop = _MAPS[tag] = dict(shared.value)
            return result([without_lines(t, drop, i, min_chars, spare) for t, i in zip(texts, ids)])

        return append_columns(docs, "text", by_broadcast, _FIELDS, also=("doc_id",))

    # Too many keys for a broadcast: each row gets the list of its own keys.
    row = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1))
    marked = docs.withColumns({"__a": row[0], "__b": row[1]})
    own = append_columns(marked.select("__a", "__b", "text"), "text",
                         lambda texts: {"digest": [list(digests(t, min_chars)) for t in texts]},
                         [T.StructField("digest", T.ArrayType(T.BinaryType()))])
    pairs = own.select("__a", "__b", F.explode("digest").alias("digest")).distinct()
    lists = (pairs.join(keys.select("digest", "first"), "digest").groupBy("__a", "__b")
             .agg(F.collect_list("digest").alias("__drop"), F.collect_list("first").alias("__first")))

    def by_row(texts: list[bytes], ids: list, drops: list, firsts: list) -> dict:
        return result([without_lines(t, dict(zip(d or (), map(entry, f or ()))), i, min_chars, spare)
                       for t, i, d, f in zip(texts, ids, drops, firsts)])

    joined = marked.join(lists, ["__a", "__b"], "left")
    out = append_columns(joined, "text", by_row, _FIELDS, also=("doc_id", "__drop", "__first"))
    return out.drop("__a", "__b", "__drop", "__first")

"""Two Bloom filters over a distributed stream of 128-bit keys: seen once and
seen at least twice, merged segment by segment.

Every task marks its own keys (``mark``); merging (``merge``) takes a cell that
two tasks have seen as seen twice, so no repeated key is missed and some single
keys look repeated. The result (``collect``) is ``bits / 8`` bytes, at most
``MAX_BITS / 8`` = 32 MiB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightjar.functions.joins import estimated_bytes

MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
SEGMENT_BITS = 1 << 16          # cells merged together
SCHEMA = "segment int, once binary, twice binary"


def size_bits(df: DataFrame, bytes_per_bit: int) -> int:
    """Filter size that follows the estimated size of ``df`` up to the bound."""
    size = estimated_bytes(df) or MAX_BITS
    return min(MAX_BITS, max(MIN_BITS, 1 << (size // bytes_per_bit).bit_length()))


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """The two cells of each key (rows of two 64-bit halves)."""
    return (keys & np.uint64(bits - 1)).astype(np.uint32)


def mark(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (segment, cells seen once, cells seen twice) of one task's keys."""
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    again = (keys[1:] == keys[:-1]).all(axis=1)
    once = np.unique(cells(keys, bits))
    twice = np.unique(cells(keys[1:][again], bits))
    edges = np.arange(0, bits + 1, SEGMENT_BITS)
    a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
    used = np.flatnonzero(a[1:] > a[:-1])
    return pa.RecordBatch.from_arrays(
        [pa.array(used, type=pa.int32()),
         pa.array([(once[a[s]:a[s + 1]] % SEGMENT_BITS).astype("<u2").tobytes() for s in used], type=pa.binary()),
         pa.array([(twice[b[s]:b[s + 1]] % SEGMENT_BITS).astype("<u2").tobytes() for s in used], type=pa.binary())],
        names=["segment", "once", "twice"])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of a segment (sorted) into its second filter, packed."""
    current, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([current], type=pa.int32()), pa.array([np.packbits(twice).tobytes()], type=pa.binary())],
            names=["segment", "bits"])

    for batch in batches:
        for segment, seen, again in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != current:
                if current is not None and twice.any():
                    yield done()
                current, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            at = np.frombuffer(seen, dtype="<u2")
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(again, dtype="<u2")] = True
    if current is not None and twice.any():
        yield done()


def collect(marked: DataFrame, bits: int) -> bytes:
    """The packed filter of keys seen at least twice, from rows of ``mark``."""
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = (marked.repartition(parts, "segment").sortWithinPartitions("segment")
              .mapInArrow(merge, "segment int, bits binary"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    step = SEGMENT_BITS // 8
    for segment, packed in merged.collect():        # at most bits / 8 bytes in all
        out[segment * step:(segment + 1) * step] = np.frombuffer(bytes(packed), dtype=np.uint8)
    return out.tobytes()


def suspected(packed: bytes, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys may have been seen twice."""
    held = np.frombuffer(packed, dtype=np.uint8)
    at = cells(keys, bits)
    return ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)

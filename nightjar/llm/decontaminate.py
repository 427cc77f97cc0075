"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item's patterns are its windows of ``window`` consecutive words
(an item with fewer words is one pattern). Words become integers: known
benchmark words have an id, every other word is 0 and occurs in no pattern.
Patterns of one length share a matcher:

* the shift table gives, for a block of two words, how far the search may
  move on without skipping an occurrence (hashed blocks keep the smallest
  shift, so collisions cost time, never matches); a word that no pattern has
  skips the whole window,
* where the shift is 0, the hash of the suffix block selects a bucket of
  patterns, the prefix block thins it, and comparing all words decides.

Many places of a text are searched at once, each in its own stretch, as numpy
vectors. Benchmarks larger than ``BLOCK_BYTES`` are searched in several passes,
one block of items each, so no task holds more than one block.

Null and empty texts and texts without words have ``n_words`` 0 and are clean;
items without words match nothing. Repeated items count once per item_id (null
item ids together as one, written as an empty string). Other columns pass
through; existing result columns are replaced.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm.arrow import append_columns
from nightjar.session import checkpoint_dir

WINDOW = 10
BLOCK_BYTES = 16 << 20
TABLE_BITS = 18
STRETCH = 512       # words that one search position covers

#: Bytes that are no word bytes become spaces; A-Z become lower case.
WORD_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class WuManber:
    """Occurrences of equally long integer patterns in an integer stream."""

    def __init__(self, patterns: np.ndarray):
        self.patterns = patterns
        n, m = patterns.shape
        self.m, self.block = m, min(2, m)
        self.shift = np.full(1 << TABLE_BITS, m - self.block + 1, dtype=np.int32)
        for j in range(self.block - 1, m):      # blocks nearer to the end allow less
            code = self._code(patterns, j)
            self.shift[code] = np.minimum(self.shift[code], m - 1 - j)
        suffix = self._code(patterns, m - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.count = np.bincount(suffix, minlength=1 << TABLE_BITS)
        self.start = np.cumsum(self.count) - self.count
        self.prefix = self._code(patterns, self.block - 1)

    def _mix(self, before, last):
        mixed = before.astype(np.uint32) * np.uint32(0x9E3779B1) + last.astype(np.uint32) * np.uint32(0x85EBCA77)
        return (mixed ^ (mixed >> np.uint32(15))) >> np.uint32(32 - TABLE_BITS)

    def _code(self, rows: np.ndarray, end: int):
        """Table index of the block of each row that ends at column ``end``."""
        last = rows[:, end]
        return self._mix(rows[:, end - 1] if self.block == 2 else last, last)

    def _at(self, stream: np.ndarray, end: np.ndarray):
        last = stream[end]
        return self._mix(stream[end - 1] if self.block == 2 else last, last), last

    def search(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence. 0 in the stream matches nothing."""
        n, m = len(stream), self.m
        if n < m or not len(self.patterns):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos = np.arange(m - 1, n, STRETCH, dtype=np.int64)
        stop = np.minimum(pos + STRETCH, n)
        ends = []
        while len(pos):
            code, last = self._at(stream, pos)
            step = np.where(last == 0, m, self.shift[code])
            ends.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            go = pos < stop
            pos, stop = pos[go], stop[go]
        end = np.concatenate(ends)
        code, _ = self._at(stream, end)
        size = self.count[code]
        place = np.repeat(np.arange(len(end)), size)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
        pattern = self.order[self.start[code][place] + inner]
        start = end[place] - (m - 1)
        head = start + self.block - 1
        ok = self._at(stream, head)[0] == self.prefix[pattern]
        start, pattern = start[ok], pattern[ok]
        for j in range(m):
            ok = stream[start + j] == self.patterns[pattern, j]
            start, pattern = start[ok], pattern[ok]
        return start, pattern


class Benchmark:
    """Matchers of a block of items, by pattern length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.known: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item_id, text in items:
            ids = [self.known.setdefault(w, len(self.known) + 1) for w in words(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(ids[i:i + m]), set()).add(item_id)
        self.matchers = [(WuManber(np.array(list(found), dtype=np.int32)), list(found.values()))
                         for found in by_length.values()]

    def search(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, set]]:
        """For each text: words, which of them are hit, items that occur."""
        get, stream, bounds = self.known.get, [], []
        for text in texts:
            found = words(text)
            bounds.append((len(stream), len(found)))
            stream.extend(map(get, found, repeat(0)))
            stream.append(0)        # parts documents: matches nothing
        ids = np.array(stream, dtype=np.int32)
        change = np.zeros(len(ids) + 1, dtype=np.int32)
        first = np.array([b[0] for b in bounds], dtype=np.int64)
        items: list[set] = [set() for _ in texts]
        for matcher, owners in self.matchers:
            start, pattern = matcher.search(ids)
            np.add.at(change, start, 1)
            np.add.at(change, start + matcher.m, -1)
            doc = np.searchsorted(first, start, side="right") - 1
            for d, p in set(zip(doc.tolist(), pattern.tolist())):
                items[d] |= owners[p]
        hit = np.cumsum(change[:-1]) > 0
        return [(n, hit[a:a + n], items[i]) for i, (a, n) in enumerate(bounds)]


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
           T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_bits", T.BinaryType())]


def search_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence),
    ``item_ids`` (sorted as strings) and ``hit_bits`` (one bit per word, null
    where nothing is hit)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             F.col("text").cast("binary").alias("text"))
    held = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-held // block_bytes) or 1
    # Items of the same id must share no state, so any split of the rows will do.
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = docs.withColumns({"item_ids": F.lit(None).cast("array<string>"), "hit_bits": F.lit(None).cast("binary")})
    for b in range(blocks):
        # One block is about block_bytes by construction.
        rows = items.where(F.col("block") == b).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Benchmark([(r[0], bytes(r[1] or b"")) for r in rows], window))

        def run(texts: list[bytes], ids: list, bits: list, shared=shared) -> dict:
            made = {"n_words": [], "n_hit": [], "item_ids": [], "hit_bits": []}
            for (n, hit, items_), old_ids, old in zip(shared.value.search(texts), ids, bits):
                if old:
                    hit = hit | np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
                n_hit = int(hit.sum())
                made["n_words"].append(n)
                made["n_hit"].append(n_hit)
                made["item_ids"].append(sorted(items_ | set(old_ids or ())))
                made["hit_bits"].append(np.packbits(hit).tobytes() if n_hit else None)
            return made

        if b:
            out = out.checkpoint()      # one pass's matchers at a time
        out = append_columns(out, "text", run, _FIELDS, also=("item_ids", "hit_bits"))
    return out

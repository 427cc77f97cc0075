"""Ranked lexical search: term at a time with limited accumulators.

Queries (items) are ranked against all documents in blocks of items of bounded
size. A block takes two passes over the texts; neither shuffles them.

1. Statistics: the number of documents with a term, all their terms, and for
   each term of the block how many documents hold it. A task sends one count
   per term it met.
2. Ranking: a task gathers the postings of its documents for the block's terms,
   a shard of at most ``SHARD`` at a time. An item takes its terms rarest first.
   Each posting adds to its document's accumulator; as soon as the bounds of the
   terms left add up to less than the k-th best partial score (or than what k
   documents of earlier shards of the task have reached), no document without
   an accumulator can come among the best, so none is created any more. The
   accumulators that there are go on to be updated by all further terms, so
   their scores are exact. A bound is a term's largest contribution in the shard.

A task sends its k best documents per item; a window ranks them over all
tasks, first in ``MERGE`` groups per item, then per item.

Terms are the maximal runs of ASCII letters and digits and of all code points
above ASCII; only A-Z are lower-cased. Null and empty texts have no terms and
are no documents. Every row is a document; rows may share a ``doc_id``, and a
null one counts as the smallest. Rows of items that share an ``item_id`` (null
too) are one item with the terms of all of them; an item without terms, and one
whose terms no document holds, gives no row. Other columns are not read. Empty
tables give an empty result. Scores are 64-bit integers, weights come from
doubles, so the result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from nightjar.llm.arrow import bytes_of, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_BYTES = 4 << 20   # distinct terms of the items of one block
SHARD = 2_000_000       # postings held by a task
MERGE = 32              # groups in which an item's candidates are ranked first

_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The m of documents of ``n_terms`` terms: their length against the mean."""
    if len(n_terms) and 90 * int(n_terms.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * n * n_docs // all_terms for n in n_terms.tolist()], dtype=np.int64)
    return 10 + 90 * n_terms * n_docs // all_terms


def count_terms(known: dict[bytes, int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text, and for every text and known term in it: text, term, occurrences."""
    get, sizes, stream = known.get, [], []
    for text in texts:
        found = terms(text)
        sizes.append(len(found))
        stream.extend(map(get, found, repeat(-1)))
    n = np.array(sizes, dtype=np.int64)
    ids = np.array(stream, dtype=np.int64)
    at = np.repeat(np.arange(len(n)), n)
    key, tf = np.unique((at * len(known) + ids)[ids >= 0], return_counts=True)
    return n, key // max(1, len(known)), key % max(1, len(known)), tf


class Shard:
    """Postings of some documents, by term, and one accumulator per document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, adds: np.ndarray, doc_ids: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")     # documents stay ascending within a term
        self.doc, self.adds, self.doc_ids = doc[order], adds[order], doc_ids
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.bound = np.zeros(n_terms, dtype=np.int64)
        np.maximum.at(self.bound, term, adds)
        self.total = np.zeros(len(doc_ids), dtype=np.int64)

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[t], self.start[t + 1]
        return self.doc[a:b], self.adds[a:b]

    def best(self, item: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, doc_id) of the item's ``k`` best documents here with a score
        of at least ``floor``, best first. ``item``: its terms, rarest first."""
        item = item[self.bound[item] > 0]
        bounds = self.bound[item]
        left = np.cumsum(bounds[::-1])[::-1].tolist()
        total, reach, stop = self.total, 0, len(item)
        for i, t in enumerate(item.tolist()):
            # The k-th partial score is at most the sum of the bounds so far.
            if left[i] < max(floor, reach) and left[i] < max(floor, self.kth(k)):
                stop = i
                break
            doc, adds = self.postings(t)
            total[doc] += adds
            reach += int(bounds[i])
        alive = np.flatnonzero(total)
        for t in item[stop:].tolist():
            doc, adds = self.postings(t)
            if len(doc) < 16 * len(alive):
                old = total[doc] > 0
                total[doc[old]] += adds[old]
            else:
                at = np.minimum(np.searchsorted(doc, alive), len(doc) - 1)
                same = doc[at] == alive
                total[alive[same]] += adds[at[same]]
        score = total[alive]
        total[alive] = 0
        if len(score) > k:
            floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
        good = score >= max(1, floor)
        score, ids = score[good], self.doc_ids[alive[good]]
        order = np.lexsort((ids, -score))[:k]
        return score[order], ids[order]

    def kth(self, k: int) -> int:
        held = self.total[self.total > 0]
        return int(np.partition(held, len(held) - k)[len(held) - k]) if len(held) >= k else 0


def _statistics(shared):
    """Per task: documents and terms (term -1), and documents per known term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df = np.zeros(len(known), dtype=np.int64)
        docs = total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                n, _, term, _ = count_terms(known, bytes_of(part, "text"))
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                df += np.bincount(term, minlength=len(known))
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *met.tolist()], pa.int32()), pa.array([docs, *df[met].tolist()], pa.int64()),
             pa.array([total] + [0] * len(met), pa.int64())], names=["term", "n", "total"])

    return run


NO_ID = np.iinfo(np.int64).min


def _ranking(shared, k: int, shard: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, n_docs, all_terms, names, items = shared.value
        empty = np.zeros(0, dtype=np.int64)
        found = [(empty, empty)] * len(items)       # best scores and documents of each item so far
        parts: list[tuple] = []
        docs = held = 0

        def flush() -> None:
            doc, term, adds, ids = (np.concatenate(c) for c in zip(*parts))
            index = Shard(doc, term, adds, ids, len(known))
            for i, item in enumerate(items):
                score, doc_id = found[i]
                more, more_ids = index.best(item, k, int(score[-1]) if len(score) == k else 0)
                if len(more):
                    score, doc_id = np.concatenate([score, more]), np.concatenate([doc_id, more_ids])
                    order = np.lexsort((doc_id, -score))[:k]
                    found[i] = score[order], doc_id[order]

        for batch in batches:
            for part in slices(batch, "text"):
                n, at, term, tf = count_terms(known, bytes_of(part, "text"))
                m = damping(n, n_docs, all_terms)[at]
                adds = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                # Only documents that hold a term have a place.
                own, place = np.unique(at, return_inverse=True)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)[own]
                parts.append((place + docs, term, adds, ids))
                docs, held = docs + len(own), held + len(term)
                if held >= shard:
                    flush()
                    parts, docs, held = [], 0, 0
        if held:
            flush()
        rows = [(names[i], None if d == NO_ID else d, s) for i, (score, doc_id) in enumerate(found)
                for s, d in zip(score.tolist(), doc_id.tolist())]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (item_type, pa.int64(), pa.int64()))],
                                         names=["item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES,
         shard: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of ``queries`` (item_id,
    text) the ``k`` rows of ``docs`` (doc_id, text) of the highest score above
    nought, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = queries.select("item_id", F.explode(F.regexp_extract_all(
        F.translate("text", UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    size = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = queries.schema["item_id"].dataType
    out = []
    for b in range(blocks):
        # One block is about block_bytes by construction; one item is never cut.
        rows = asked.where(F.col("block") == b).select("item_id", "term").collect()
        known = {t: i for i, t in enumerate(sorted({r["term"].encode() for r in rows}))}
        counts = texts.select("text").mapInArrow(_statistics(spark.sparkContext.broadcast(known)), "term int, n long, total long")
        found = {r["term"]: r for r in counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
        n_docs, all_terms = (found[-1]["n"], found[-1]["total"]) if -1 in found else (0, 0)
        df = [found[i]["n"] if i in found else 0 for i in range(len(known))]
        weights = np.array([weight(n_docs, n) for n in df], dtype=np.int64)
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append(known[r["term"].encode()])
        items = [np.array(sorted((t for t in ts if df[t]), key=lambda t: (df[t], t)), dtype=np.int64) for ts in by_item.values()]
        shared = spark.sparkContext.broadcast((known, weights, n_docs, all_terms, list(by_item), items))
        schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()),
                               T.StructField("score", T.LongType())])
        out.append(texts.mapInArrow(_ranking(shared, k, shard, to_arrow_type(kind)), schema))
    best = out[0]
    for more in out[1:]:
        best = best.unionByName(more)
    order = [F.desc("score"), F.asc("doc_id")]
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")

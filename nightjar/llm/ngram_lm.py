"""Language-model scoring by deleted interpolation of n-gram estimates.

P(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 1/(V+1), with weights l per bucket
of the context's frequency c(v) (powers of two). The weights are learned by
expectation-maximisation on counts of training documents that were held out
of the counting (``TUNE_SHARE`` of them, by a hash of doc_id); the final model
counts all training documents.

How it runs:

1. Each task turns its documents into chunks of about ``CHUNK_TOKENS`` tokens:
   a local vocabulary (64-bit word hashes) and compressed local ids. Chunks
   are checkpointed, so texts are read once and a chunk never changes.
2. Every chunk sends its distinct n-grams with local counts to the bucket of
   the n-gram's hash; a bucket sums them and answers each chunk in the order
   asked. A frequent n-gram is one entry per chunk, so no bucket gets hot.
   Words first, then word pairs.
3. A chunk and its answers meet again by chunk id. Chunks of held-out training
   documents make a histogram of likelihood ratios (bounded by its bins) for
   the EM; then all chunks are scored.

Nothing is cut off: all words and pairs of all documents are counted. Null and
empty texts have one token, the end. Null ids and repeated rows are scored row
by row. Only doc_id, text and the training flag are read. An empty table
gives an empty result; without training rows every score is that of the
uniform part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm.arrow import bytes_of, release_memory, slices
from nightjar.session import checkpoint_dir

CHUNK_TOKENS = 1_000_000
BUCKET_ENTRIES = 750_000
TUNE_SHARE = 10             # one in so many training documents is held out for EM
EM_ROUNDS = 60
RATIO_STEP = 0.05           # width of a histogram bin, natural log
END, BOS = 1, 2             # reserved word hashes

_CHUNK = "chunk long, tune boolean, n_tokens long, docs binary, ids array<long>, training array<boolean>, " \
         "words binary, tokens binary"


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _zip_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte planes apart."""
    return _zip(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unzip_keys(b: bytes) -> np.ndarray:
    planes = _unzip(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: their blobs are large, a whole batch need not be copied."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


class _Chunk:
    """Documents of a task on their way into a chunk."""

    def __init__(self):
        self.known: defaultdict = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[None]            # 0: end of text
        self.tokens, self.lengths, self.ids, self.training, self.n = [], [], [], [], 0

    def add(self, doc_id, training: bool, text: bytes) -> None:
        words = text.lower().split()
        ids = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint32, count=len(words))
        self.tokens += [ids, np.zeros(1, np.uint32)]
        self.lengths.append(len(words) + 1)
        self.ids.append(doc_id)
        self.training.append(training)
        self.n += len(words) + 1

    def batch(self, chunk: int, tune: bool) -> pa.RecordBatch:
        words = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in self.known), dtype=np.uint64,
                            count=len(self.known))
        row = [chunk, tune, self.n, _zip(np.array(self.lengths, np.uint32)), self.ids, self.training,
               _zip(words), _zip(np.concatenate(self.tokens))]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()),
                 pa.binary(), pa.binary()]
        names = ["chunk", "tune", "n_tokens", "docs", "ids", "training", "words", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types)], names=names)


def _make_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    open_: dict[bool, _Chunk] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            for doc_id, training, tune, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "training", "tune")),
                                                    bytes_of(part, "text")):
                held = open_.setdefault(tune, _Chunk())
                held.add(doc_id, training, text)
                if held.n >= CHUNK_TOKENS:
                    yield held.batch(number, tune)
                    number += 1
                    del open_[tune], held
                    release_memory()
    for tune in list(open_):
        yield open_.pop(tune).batch(number, tune)
        number += 1
    release_memory()


class _Grams:
    """A chunk's distinct words or pairs, sorted by key, and where each token's is."""

    def __init__(self, row: dict, order: int):
        words = _unzip(row["words"], np.uint64)
        ids = _unzip(row["tokens"], np.uint32)
        lengths = _unzip(row["docs"], np.uint32).astype(np.int64)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.training = np.repeat(np.array(row["training"], dtype=bool), lengths)
        self.tune = row["tune"]
        self.token, self.before = ids, np.concatenate([[0], ids[:-1]]).astype(np.uint32)
        self.first = np.zeros(len(ids), bool)
        self.first[self.starts] = True
        if order == 1:
            # The start of a text is a context too: it is asked for like a word, counted by documents.
            order_ = np.argsort(np.append(words, np.uint64(BOS)), kind="stable")
            self.keys = np.append(words, np.uint64(BOS))[order_]
            place = np.empty(len(order_), np.int64)
            place[order_] = np.arange(len(order_))
            self.at, self.context = place[ids], np.where(self.first, place[-1], place[self.before])
        else:
            left = np.where(self.first, np.uint64(BOS), words[self.before])
            pair = (left * np.uint64(0x9E3779B97F4A7C15) + words[ids]) * np.uint64(0xC2B2AE3D27D4EB4F)
            pair ^= pair >> np.uint64(29)
            pair = pair * np.uint64(0xBF58476D1CE4E5B9)
            pair ^= pair >> np.uint64(32)
            self.keys, self.at = np.unique(pair, return_inverse=True)

    def counts(self, order: int) -> np.ndarray:
        used = self.at[self.training]
        got = np.bincount(used, minlength=len(self.keys))
        if order == 1:
            got[np.searchsorted(self.keys, np.uint64(BOS))] = int((self.first & self.training).sum())
        return got.astype(np.uint32)


def _ask(order: int, bucket_bits: int):
    """Rows (bucket, chunk, tune, keys, counts): what a chunk has, by bucket."""
    names, types = ["bucket", "chunk", "tune", "keys", "counts"], [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                grams = _Grams(row, order)
                counts = grams.counts(order)
                cuts = _cuts(grams.keys, bucket_bits)
                rows = [(b, row["chunk"], row["tune"], _zip_keys(grams.keys[s:e]), _zip(counts[s:e]))
                        for b, s, e in cuts]
                del grams, counts
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
                del rows
                release_memory()

    return run


def _cuts(keys: np.ndarray, bucket_bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that a sorted key array touches."""
    bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]))


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum each bucket (rows come sorted by bucket) and answer every chunk.
    The row of chunk -1 has the bucket's number of distinct keys and tokens."""
    names = ["bucket", "chunk", "tune", "total", "kept", "n_keys", "n_kept_keys"]
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def done(rows: list[dict]) -> pa.RecordBatch:
        keys = [_unzip_keys(r["keys"]) for r in rows]
        counts = [_unzip(r["counts"], np.uint32).astype(np.int64) for r in rows]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        kept_counts = np.concatenate([np.zeros_like(c) if r["tune"] else c for r, c in zip(rows, counts)])
        total = np.zeros(len(every), np.int64)
        kept = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        np.add.at(kept, at, kept_counts)
        word = every != BOS
        out, start = [], 0
        for r, k in zip(rows, keys):
            own = at[start:start + len(k)]
            start += len(k)
            out.append((r["bucket"], r["chunk"], r["tune"], _zip(total[own]), _zip(kept[own]), None, None))
        out.append((rows[0]["bucket"], -1, None, None, None, int((total[word] > 0).sum()), int((kept[word] > 0).sum())))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

    held: list[dict] = []
    for batch in batches:
        for row in _rows(batch):
            if held and held[0]["bucket"] != row["bucket"]:
                yield done(held)
                held = []
                release_memory()
            held.append(row)
    if held:
        yield done(held)
        held.clear()
        release_memory()


def _partitions(df: DataFrame, pieces: int) -> int:
    """The session's setting, or one task per piece where that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces)


def _exchange(chunks: DataFrame, order: int, bucket_bits: int) -> DataFrame:
    parts = _partitions(chunks, 1 << bucket_bits)
    return (chunks.mapInArrow(_ask(order, bucket_bits),
                              "bucket int, chunk long, tune boolean, keys binary, counts binary")
            .repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
            .mapInArrow(_answer, "bucket int, chunk long, tune boolean, total binary, kept binary, n_keys long, "
                                 "n_kept_keys long").checkpoint())


def _with_answers(chunks: DataFrame, words: DataFrame, pairs: DataFrame, n_chunks: int) -> DataFrame:
    """Chunk rows and their answers, brought together and sorted: the chunk
    first, then word answers, then pair answers by bucket."""
    def answers(df: DataFrame, kind: int) -> DataFrame:
        return df.where("chunk >= 0").select("chunk", F.lit(kind).alias("kind"), "bucket", "total", "kept")

    base = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), *chunks.columns[1:])
    both = base.unionByName(answers(words, 1), True).unionByName(answers(pairs, 2), True)
    parts = _partitions(chunks, n_chunks)
    return both.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")


def _joined(batches: Iterator[pa.RecordBatch], which: str) -> Iterator[tuple[dict, "_Grams", tuple]]:
    """(chunk row, its words, (c(word), c(context), c(pair)) per token)."""
    row, got = None, ([], [])

    def ready():
        one, two = _Grams(row, 1), _Grams(row, 2)
        words, pairs = np.concatenate(got[0]), np.concatenate(got[1])
        return row, one, (words[one.at], words[one.context], pairs[two.at])

    for batch in batches:
        for r in _rows(batch):
            if r["kind"] == 0:
                if row is not None:
                    yield ready()
                    release_memory()
                row, got = r, ([], [])
            else:
                got[r["kind"] - 1].append(_unzip(r[which], np.int64))
    if row is not None:
        yield ready()
        row, got = None, ([], [])
        release_memory()


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0: unseen context; else 1 + floor(log2 count)."""
    return np.where(count > 0, np.frexp(count.astype(np.float64))[1], 0).astype(np.int64)


def _histogram(n_tokens: int, n_types: int):
    """Rows (bucket, r1, r2, n): binned log ratios of the word and the pair
    estimate to the uniform one, of held-out training tokens; -1: no estimate."""
    names, types = ["bucket", "r1", "r2", "n"], [pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (word, context, pair) in _joined(batches, "kept"):
            with np.errstate(divide="ignore", invalid="ignore"):
                r1 = np.log(word / max(1, n_tokens) * (n_types + 1))
                r2 = np.log(pair / context * (n_types + 1))
            r1 = np.where(word > 0, np.floor(np.nan_to_num(r1, neginf=0) / RATIO_STEP) + 2000, -1)
            r2 = np.where((pair > 0) & (context > 0), np.floor(np.nan_to_num(r2, neginf=0) / RATIO_STEP) + 2000, -1)
            cells = np.stack([context_bucket(context), r1.astype(np.int64), r2.astype(np.int64)], axis=1)
            cells, n = np.unique(cells, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip([*cells.T, n], types)], names=names)

    return run


def learn_weights(cells: np.ndarray) -> np.ndarray:
    """EM over histogram rows (bucket, r1, r2, n): weights [bucket, (uniform,
    word, pair)]. Buckets without data take the nearest lower one's weights."""
    weights = np.full((66, 3), np.nan)
    for b in range(66):
        rows = cells[cells[:, 0] == b] if len(cells) else cells
        if not len(rows):
            weights[b] = weights[b - 1] if b > 1 else [0.2, 0.8, 0] if b == 0 else [0.1, 0.3, 0.6]
            continue
        like = np.ones((len(rows), 3))
        for k in (1, 2):
            like[:, k] = np.where(rows[:, k] >= 0, np.exp((rows[:, k] - 2000 + 0.5) * RATIO_STEP), 0)
        n = rows[:, 3].astype(np.float64)
        w = np.array([0.2, 0.4, 0.4])
        for _ in range(EM_ROUNDS):
            share = like * w
            share *= (n / share.sum(1))[:, None]
            w = share.sum(0) + (0.5 if b else np.array([0.5, 0.5, 0]))
            w /= w.sum()
        weights[b] = w
    weights[0] /= weights[0, :2].sum()
    weights[0, 2] = 0.0
    return weights


def _score(weights: np.ndarray, n_tokens: int, n_types: int):
    names = ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, grams, (word, context, pair) in _joined(batches, "total"):
            w = weights[context_bucket(context)]
            p = (w[:, 0] / (n_types + 1) + w[:, 1] * (word / max(1, n_tokens))
                 + w[:, 2] * np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0))
            base = np.log10((word + 1) / (n_tokens + n_types + 1))
            add = lambda x: np.add.reduceat(x, grams.starts)  # noqa: E731  every text has a token at least
            cols = [row["ids"], row["training"], grams.lengths, add((word > 0).astype(np.int64)), add(base),
                    add(np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return run


def score_texts(docs: DataFrame, is_training: Column) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score)
    per row of ``docs``; scores are log10 probabilities. ``is_training`` is a
    condition over the columns of ``docs``; null is false."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    training = F.coalesce(is_training, F.lit(False))
    tune = training & (F.pmod(F.xxhash64("doc_id"), F.lit(TUNE_SHARE)) == 0)
    chunks = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                          training.alias("training"), tune.alias("tune"))
              .mapInArrow(_make_chunks, _CHUNK).checkpoint())
    tokens, n_chunks = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    bits = min(30, max(0, (tokens // BUCKET_ENTRIES).bit_length()))
    words = _exchange(chunks, 1, bits)
    pairs = _exchange(chunks, 2, bits)
    types = words.agg(F.sum("n_keys"), F.sum("n_kept_keys")).first()
    counts = chunks.select("tune", "docs", "training").mapInArrow(_training_tokens, "tune boolean, n long")
    by_part = {r["tune"]: r["n"] for r in counts.groupBy("tune").agg(F.sum("n").alias("n")).collect()}
    n_all, n_kept = sum(by_part.values()), by_part.get(False, 0)
    held_out = _with_answers(chunks.where("tune"), words.where("tune"), pairs.where("tune"), n_chunks)
    cells = (held_out.mapInArrow(_histogram(n_kept, types[1] or 0), "bucket int, r1 int, r2 int, n long")
             .groupBy("bucket", "r1", "r2").agg(F.sum("n").alias("n")).collect())    # bounded by the bins
    weights = learn_weights(np.array([tuple(c) for c in cells], dtype=np.int64).reshape(-1, 4))
    scored = _with_answers(chunks, words, pairs, n_chunks).mapInArrow(
        _score(weights, n_all, types[0] or 0),
        "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))


def _training_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["tune"], int(_unzip(r["docs"], np.uint32)[np.array(r["training"], dtype=bool)].sum()))
                for r in _rows(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.bool_()),
                                          pa.array([r[1] for r in rows], type=pa.int64())], names=["tune", "n"])

"""Token ids in a binary format: blocks that are decoded on their own.

``write_tokens`` sorts documents by ``doc_id``, tokenises them, appends the end
id to each and writes all ids in that order as blocks; ``read_documents`` reads
them back. Spark writes and reads the files (Parquet as the container of
opaque blocks), so they lie in any store that Spark reaches and a lost executor
costs its task only.

A task holds a range of documents (a part); a document of any length is cut at
the end of a block and goes on in the next. A block is, little-endian:

    8 bytes   ``NJTOKEN1``
    5 x u32   ids, documents, distinct ids, bytes of the document table, bytes of the distinct ids
    2 x u64   the part's ids and documents before the block (a document that goes on counts as begun)
    2 x u32   CRC-32 of all ids as u32, CRC-32 of what follows
    zlib      document table: null flags as u8, doc_id differences as i64, ids here as u32
    zlib      differences of the distinct ids, ascending, as u32
              (numbers of both by byte planes: all first bytes, all second bytes and so on)
    2 x n     words of the range coder (``id_coder``)

Null and empty texts are the end id alone. Repeated rows and rows that share a
``doc_id`` stay apart, their order among each other is that of the input; null
``doc_id`` values come first. Other columns are not read. An empty table gives
no block and reads back empty. A damaged block raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm import id_coder
from nightjar.llm.arrow import bytes_of, slices
from nightjar.llm.packing import encoder

MAGIC = b"NJTOKEN1"
HEAD = struct.Struct("<8s5I2Q2I")
BLOCK = 4096            # ids of a block, at most
LEAST = 1024            # ids of a block, at least, unless there are no more
LANES = 2048            # blocks coded side by side
SLICE = 8 << 20         # bytes of text tokenised at once: the known words are walked once for each slice
BLOCKS = "part long, block long, n_ids long, payload binary"


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    """First bytes of all numbers, then second bytes and so on: small numbers leave long runs of noughts."""
    wide = numbers.astype(kind)
    return wide.view(np.uint8).reshape(-1, wide.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str, count: int, offset: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8, count=count * size, offset=offset).reshape(size, count)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1).astype(np.int64)


def pack_block(ids: np.ndarray, known: np.ndarray, words: np.ndarray, doc_ids: list, lengths: list[int],
               ids_before: int, docs_before: int) -> bytes:
    """The bytes of one block."""
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    at = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)
    with np.errstate(over="ignore"):
        step = np.diff(at, prepend=np.int64(0))
    table = zlib.compress(null.tobytes() + _planes(step, "<i8") + _planes(np.array(lengths), "<u4"), 1)
    steps = zlib.compress(_planes(np.diff(known.astype(np.int64), prepend=0), "<u4"), 1)
    body = table + steps + words.tobytes()
    return HEAD.pack(MAGIC, len(ids), len(doc_ids), len(known), len(table), len(steps), ids_before, docs_before,
                     zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def open_blocks(payloads: list[bytes]) -> Iterator[tuple[np.ndarray, list, np.ndarray, int, int]]:
    """(ids, doc_ids, ids of each here, ids before, documents before) of each block."""
    heads, coded = [], []
    for raw in payloads:
        if len(raw) < HEAD.size or raw[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        head = HEAD.unpack_from(raw)
        body = raw[HEAD.size:]
        if zlib.crc32(body) != head[9]:
            raise ValueError("damaged block of token ids")
        _, n, _, n_known, table, steps, *_ = head
        known = np.cumsum(_numbers(zlib.decompress(body[table:table + steps]), "<u4", n_known))
        coded.append((n, known.astype("<u4"), np.frombuffer(body[table + steps:], dtype="<u2")))
        heads.append((head, body[:table]))
    for (head, table), ids in zip(heads, id_coder.decode(coded)):
        if zlib.crc32(ids.tobytes()) != head[8]:
            raise ValueError("block of token ids doesn't decode to what was written")
        raw, n = zlib.decompress(table), head[2]
        null = np.frombuffer(raw, dtype=np.uint8, count=n)
        with np.errstate(over="ignore"):
            at = np.cumsum(_numbers(raw, "<i8", n, n))
        doc_ids = [None if z else d for z, d in zip(null.tolist(), at.tolist())]
        yield ids, doc_ids, _numbers(raw, "<u4", n, 9 * n), head[6], head[7]


def _write(path: str, end_id: int, block: int, lanes: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        doc_ids: list = []
        found: list[bytes] = []
        held = blocks = ids_before = docs_before = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """All that is held, in blocks: as many as there are lanes, if they are not too short."""
            nonlocal blocks
            ids = np.frombuffer(b"".join(found), dtype="<u4")
            ends = np.cumsum([len(f) // 4 for f in found])
            size = min(block, max(LEAST, -(-len(ids) // lanes)))
            for first in range(0, len(ids), size * lanes):
                cuts = [(a, min(a + size, len(ids))) for a in range(first, min(first + size * lanes, len(ids)), size)]
                rows = []
                for (a, b), (known, words) in zip(cuts, id_coder.encode([ids[a:b] for a, b in cuts])):
                    d, e = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
                    inside = np.diff(np.minimum(ends[d:e + 1], b), prepend=a).tolist()
                    rows.append(pack_block(ids[a:b], known, words, doc_ids[d:e + 1], inside, ids_before + a, docs_before + d))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array(range(blocks, blocks + n), pa.int64()),
                     pa.array([b - a for a, b in cuts], pa.int64()), pa.array(rows, pa.binary())],
                    names=["part", "block", "n_ids", "payload"])
                blocks += n

        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), enc.ids(bytes_of(piece, "text"))):
                    doc_ids.append(doc_id)
                    found.append(ids + end)
                    held += len(ids) // 4 + 1
                if held >= block * lanes:
                    yield from flush()
                    ids_before, docs_before = ids_before + held, docs_before + len(doc_ids)
                    doc_ids, found, held = [], [], 0
        if held:
            yield from flush()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, block: int = BLOCK,
                 lanes: int = LANES) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``folder``, in ascending
    ``doc_id`` order: parts ascend, blocks ascend within a part. ``vocabulary``
    is the path of a tokenizers file whose pre-tokeniser cuts at white space;
    every worker reads it."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                      F.monotonically_increasing_id().alias("row"))
    # Ranges by row as well: one doc_id may hold any number of rows.
    ranges = src.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    coded = ranges.mapInArrow(_write(vocabulary, end_id, block, lanes), BLOCKS)
    coded.write.option("compression", "none").parquet(folder)


def _pieces(with_ids: bool, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, lanes):
                some = batch.slice(at, lanes)
                rows: list[tuple] = []
                for part, (ids, doc_ids, sizes, before, docs) in zip(
                        some.column("part").to_pylist(), open_blocks(some.column("payload").to_pylist())):
                    raw, ends = ids.tobytes(), np.cumsum(sizes).tolist()
                    for i, (doc_id, b) in enumerate(zip(doc_ids, ends)):
                        a = ends[i - 1] if i else 0
                        own = raw[4 * a:4 * b]
                        rows.append((part, docs + i, doc_id, before + a, b - a, zlib.crc32(own), own if with_ids else None))
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=["part", "row", "doc_id", "position", "n", "crc32", "ids"])

    return run


def read_pieces(spark: SparkSession, folder: str, with_ids: bool = False, lanes: int = LANES) -> DataFrame:
    """What each block holds of each document: part, row (the document's number
    in its part), doc_id, position (ids of the part before), n, crc32 and, if
    asked for, ids (little-endian u32)."""
    blocks = spark.read.schema(BLOCKS).parquet(folder).select("part", "payload")
    return blocks.mapInArrow(_pieces(with_ids, lanes),
                             "part long, row long, doc_id long, position long, n long, crc32 long, ids binary")


@lru_cache(maxsize=1)
def _zero_bytes() -> list[np.ndarray]:
    """What 2^k zero bytes make of a CRC-32 register, without its inversions,
    for k from 0 to 39: tables of 4 x 256, by the register's bytes."""
    def times(table, v):
        return table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]

    register = np.arange(256, dtype=np.int64)[None, :] << (8 * np.arange(4, dtype=np.int64))[:, None]
    step = register.copy()
    for _ in range(8):      # bit by bit
        step = (step >> 1) ^ np.where(step & 1, 0xEDB88320, 0)
    made = [step]
    for _ in range(39):
        made.append(times(made[-1], made[-1]))
    return made


def join_crc32(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of pairs of byte strings in a row, from theirs."""
    out = first.copy()
    for k, table in enumerate(_zero_bytes()):
        on = np.flatnonzero(second_bytes >> k & 1)
        if len(on):
            v = out[on]
            out[on] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
    return out ^ second


def _joined(offsets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = offsets.value
        for batch in batches:
            start = before[batch.column("part").to_numpy()] + batch.column("position").to_numpy()
            crc = batch.column("crc32").to_numpy().copy()
            lists = batch.column("pieces")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            pieces = lists.flatten()        # of documents in several pieces, one document after the other
            first = np.cumsum(size) - size
            n, crcs = pieces.field("n").to_numpy(), pieces.field("crc32").to_numpy()
            rows = np.flatnonzero(size)
            crc[rows] = crcs[first[rows]]
            for nth in range(1, int(size.max(initial=0))):
                rows = rows[size[rows] > nth]
                at = first[rows] + nth
                crc[rows] = join_crc32(crc[rows], crcs[at], 4 * n[at])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start), batch.column("n_tokens"), pa.array(crc)],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document: ``start`` counts
    the ids of all documents before it. Only three numbers per block that a
    document crosses meet in one row."""
    sizes = spark.read.schema(BLOCKS).parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    ids_of = np.zeros(1 + max([r["part"] for r in sizes], default=0), dtype=np.int64)   # one per task that wrote
    for r in sizes:
        ids_of[r["part"]] = r["n"]
    offsets = spark.sparkContext.broadcast(np.cumsum(ids_of) - ids_of)
    whole = read_pieces(spark, folder).groupBy("part", "row").agg(
        F.max("doc_id").alias("doc_id"), F.min("position").alias("position"), F.sum("n").alias("n_tokens"),
        F.max("crc32").alias("crc32"), F.sort_array(F.collect_list(F.struct("position", "n", "crc32"))).alias("pieces"))
    whole = whole.withColumn("pieces", F.when(F.size("pieces") > 1, F.col("pieces")))
    return whole.select("part", "doc_id", "position", "n_tokens", "crc32", "pieces").mapInArrow(
        _joined(offsets), "doc_id long, start long, n_tokens long, ids_crc32 long")

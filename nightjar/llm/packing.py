"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

1. Each scan partition tokenises its documents, cuts only those longer than
   the capacity, and packs its pieces by best-fit decreasing, in chunks of at
   most ``CHUNK`` pieces. Only integers leave the task.
2. Bins that are nearly full are final. Every other bin is an item of its fill
   (its pieces stay together). The items are counted per fill, at most
   ``capacity`` classes however many there are, and the driver packs the counts
   by best-fit decreasing: items of a class that land alike are placed at once.
3. Each item has a rank among all items of its fill: its rank inside its scan
   partition plus the items of that fill in earlier partitions. Ranks tell every
   item its sequence and offset, so no bin is left out and no node holds them.

Null and empty texts are one piece holding the end id alone. Repeated rows and
repeated or null ``doc_id`` values are packed row by row. An empty table gives
an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.llm.arrow import bytes_of, kept_by_worker, release_memory, slices
from nightjar.session import checkpoint_dir

CAPACITY = 2048
NEARLY_FULL = 0.99      # bins filled to this share are final at once
CHUNK = 65_536          # pieces packed together in a task
OPEN_BINS = 1_024       # counts (partition, fill) up to which the driver sums the ranks; beyond, Spark does
MERGED = 1 << 62        # first sequence id of the second round, above all ids of scan partitions
CACHE_WORDS = 300_000   # distinct words whose ids a worker remembers
BLOCK_BYTES = 8 << 20   # bytes of text whose words are numbered at once, at least one word

_WHITE = re.compile(rb"[ \t\n\r\x0b\f]")


class WordEncoder:
    """Token ids of a text through a vocabulary that never joins characters
    across white space (its pre-tokeniser cuts there): the ids of a text are
    the ids of its words in a row, so each distinct word is encoded once.

    Words and their ids are kept in arrays, not as Python objects: the known
    words and those of the texts are numbered by Arrow in one go (known words
    keep their numbers, new ones come after), and the ids of all texts are
    gathered by number. Beyond ``CACHE_WORDS`` words the half most used stays.

    New words are encoded many at a time, parted by a control character whose
    id shows where one word's ids end.

    Of a byte-level vocabulary with an end-of-word mark, whose pre-tokeniser
    also cuts between letters, signs and digits, a word of Latin letters, signs
    and digits alone is cut there, too. Letters alone need neither the
    normaliser nor the pre-tokeniser's pattern, so they go to the merges
    directly; their ids end at the marked ones."""

    PART = b"\x01"
    SPACE, LETTER, SIGN, DIGIT, OTHER = range(5)
    SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"     # apart from those of contractions and special tokens
    ACCENTED = bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))  # after 0xC3: letters of U+00C0 to U+00FF in UTF-8

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        part = self.encode(self.PART)
        self.part_id = int(part[0]) if len(part) == 1 else None
        self.bare = self.bare_words(path)
        self.kind = np.full(256, self.OTHER, dtype=np.uint8)
        self.kind[list(b" \t\n\r\x0b\f")] = self.SPACE
        if self.bare is not None:
            self.kind[list(bytes(range(65, 91)) + bytes(range(97, 123)) + b"\xc3" + self.ACCENTED)] = self.LETTER
            self.kind[list(self.SIGNS)] = self.SIGN
            self.kind[list(b"0123456789")] = self.DIGIT
        self.lower = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
        self.lower_accented = self.lower.copy()
        self.lower_accented[0x80:0x9F] += 0x20
        self.words = pa.array([], pa.binary())
        self.start = self.length = self.used = np.zeros(0, dtype=np.int64)     # of each word: place of its ids, how many, occurrences
        self.known = np.zeros(0, dtype="<u4")

    def bare_words(self, path: str):
        """The merges alone, for words of letters; null where the vocabulary isn't of that kind."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        cuts = (steps[0].get("pattern") or {}).get("Regex", "")
        lower = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
        mark = made["model"].get("end_of_word_suffix")
        if not (mark and r"[\p{L}]+|[\p{N}]|" in cuts and steps[-1].get("type") == "ByteLevel" and lower[:1] + lower[-1:] == ["NFC", "Lowercase"]):
            return None
        bare = Tokenizer.from_file(path)
        bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = bare.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(mark)]] = True
        # Byte-level vocabularies show bytes that are no printable characters as those from 256 on.
        self.shown = np.arange(256, dtype="<u2")
        hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
        self.shown[hidden] = np.arange(256, 256 + len(hidden))
        self.shown[32] = 32
        return bare

    def encode(self, text: bytes) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return np.array(found[0].ids, dtype="<u4")

    def learn_letters(self, new: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the words in a row and how many each has, by groups of words."""
        for at in range(0, len(new), 4096):
            group = new[at:at + 4096]
            text = b" ".join(group)
            text = text.decode() if text.isascii() else self.shown[np.frombuffer(text, dtype=np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                yield ids, np.diff(ends, prepend=0)
            else:
                yield from self.learn_whole(group)

    def learn_whole(self, new: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(new), 512):
            group = new[at:at + 512]
            ids = self.encode((b" " + self.PART + b" ").join(group))
            cuts = np.flatnonzero(ids == self.part_id) if self.part_id is not None else ()
            if len(cuts) == len(group) - 1:
                yield np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
            else:       # a word has the control character itself
                alone = [self.encode(w) for w in group]
                yield np.concatenate(alone), np.array([len(i) for i in alone])

    def learn(self, words: pa.Array, kind: np.ndarray) -> None:
        """The ids of ``words``, which follow those known."""
        letters = kind == self.LETTER
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        new, n = words.take(pa.array(order)).to_pylist(), int(letters.sum())
        ids, lengths = zip(*self.learn_letters(new[:n]), *self.learn_whole(new[n:]))
        length, start = np.zeros((2, len(new)), dtype=np.int64)
        length[order] = np.concatenate(lengths)
        start[order] = len(self.known) + np.cumsum(length[order]) - length[order]
        self.known = np.concatenate([self.known, *ids])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])

    def forget(self) -> None:
        """Keep the half most used."""
        kept = np.sort(np.argpartition(-self.used, CACHE_WORDS // 2)[:CACHE_WORDS // 2])
        self.words, self.used = self.words.take(pa.array(kept)), self.used[kept] >> 1
        self.known, ends = self.gather(kept)
        self.length = self.length[kept]
        self.start = ends - self.length

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of these numbers in a row, and where each word's end."""
        length = self.length.take(words)
        ends = np.cumsum(length)
        at = np.repeat(self.start.take(words) - ends + length, length)
        at += np.arange(len(at))
        return self.known.take(at), ends

    def cut(self, raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of ``raw``, lower case, their kinds and places."""
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = self.kind.take(data)
        low = self.lower_accented.take(data)
        if not raw.isascii():       # 0xC3 and one byte after it, nothing else, are a letter
            begun, goes_on = np.append(data == 0xC3, False), np.append((data & 0xC0) == 0x80, False)
            kind[begun[:-1] & ~goes_on[1:] | goes_on[:-1] & ~np.roll(begun, 1)[:-1]] = self.OTHER
        space = kind == self.SPACE
        other = np.flatnonzero(kind == self.OTHER)
        if len(other):              # their words stay whole
            edge = np.flatnonzero(np.diff(space, prepend=True, append=True)).reshape(-1, 2)
            edge = edge[np.unique(np.searchsorted(edge[:, 0], other, "right") - 1)]
            inside = np.zeros(len(data) + 1, dtype=np.int8)
            inside[edge[:, 0]] = 1
            inside[edge[:, 1]] = -1
            other = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
            kind[other] = self.OTHER
            # The vocabulary is lower case, but the strings of special tokens must keep their case.
            low[other] = data[other] if b"<|" in raw else self.lower[data[other]]
        first = np.ones(len(data), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == self.DIGIT
        first &= ~space
        places = np.flatnonzero(first)
        held = ~space
        starts = np.append(np.flatnonzero(first[held]), np.count_nonzero(held)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(starts), pa.py_buffer(low[held])])
        return words, kind.take(places), places

    def ids_of_block(self, texts: list[bytes]) -> list[bytes]:
        words, kind, places = self.cut(b" ".join(texts))
        many = len(self.words)
        both = pa.concat_arrays([self.words, words]).dictionary_encode()
        number = both.indices.to_numpy()[many:]
        if len(both.dictionary) > many:
            kinds = np.zeros(len(both.dictionary), dtype=np.uint8)
            kinds[number] = kind
            self.words = both.dictionary
            self.learn(self.words.slice(many), kinds[many:])
        ids, ends = self.gather(number)
        self.used += np.bincount(number, minlength=len(self.used))
        if len(self.words) > CACHE_WORDS:
            self.forget()
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = (4 * np.append(0, ends)[np.searchsorted(places, begins)]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Invalid UTF-8 is
        read with replacement characters."""
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            if len(text) > BLOCK_BYTES:     # cut at white space: memory doesn't follow the longest text
                found = []
                at = 0
                while at < len(text):
                    gap = _WHITE.search(text, at + BLOCK_BYTES)
                    end = gap.start() if gap else len(text)
                    found += self.ids_of_block([text[at:end]])
                    at = end
                out += self.ids_of_block(held) if held else []
                out.append(b"".join(found))
                held, size = [], 0
                continue
            if size + len(text) > BLOCK_BYTES:
                out += self.ids_of_block(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        return out + (self.ids_of_block(held) if held else [])


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    return kept_by_worker(path, WordEncoder)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing. Returns (bin of each item, its offset, fill of each
    bin). Bins are indexed by what is left in them; a bit mask over these
    values gives the tightest bin in one operation."""
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    fill: list[int] = []
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            left[room].append(b)
            mask |= 1 << room
    return bin_of, offset, fill


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of ``counts[size]`` items of each size. Returns the
    ranges (size, first rank, items, first bin, items in a bin, first offset),
    by size and rank, and the number of bins. Rank r of a range is in bin
    ``first + (r - rank) div each`` at ``offset + ((r - rank) mod each) * size``.

    Bins that got the same sizes in the same order are one run of numbers, so
    the work follows the number of sizes, not of items."""
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]   # (first bin, bins) by what is left
    mask, made = 0, 0
    out = []
    for size in sorted(counts, reverse=True):
        rank, todo = 0, counts[size]
        while todo:
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                first, bins = runs[room].pop()
                if not runs[room]:
                    mask ^= 1 << room
            else:
                # Every new bin takes what it can before the next is made.
                room, first = capacity, made
                bins = -(-todo // (capacity // size))
                made += bins
            each = room // size
            full = min(bins, todo // each)
            parts = [(first, full, each)]
            if full < bins:
                over = todo - full * each
                parts += [(first + full, 1, over), (first + full + 1, bins - full - 1, 0)] if over else [
                    (first + full, bins - full, 0)]
            for at, n, k in parts:
                if not n:
                    continue
                if k:
                    out.append((size, rank, n * k, at, k, capacity - room))
                    rank, todo = rank + n * k, todo - n * k
                rest = room - k * size
                if rest:
                    runs[rest].append((at, n))
                    mask |= 1 << rest
    return out, made


_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, "
           "bin_id long, offset long, open_fill int, open_rank long, node long")


def _tokenise_and_pack(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "bin_id", "offset", "open_fill", "open_rank",
             "node"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
             pa.int32(), pa.int64(), pa.int64()]

    def flush(rows: list[tuple], node: int, first_bin: int, ranks: list[int]) -> pa.RecordBatch:
        bin_of, offset, fill = best_fit([r[3] for r in rows], capacity)
        rank = [None] * len(fill)
        for b, f in enumerate(fill):
            if f < capacity * NEARLY_FULL:
                rank[b], ranks[f] = ranks[f], ranks[f] + 1
        cols = [list(c) for c in zip(*rows)]
        cols += [[first_bin + b for b in bin_of], offset, [None if rank[b] is None else fill[b] for b in bin_of],
                 [rank[b] for b in bin_of], [node] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        node = TaskContext.get().partitionId()
        rows: list[tuple] = []
        ranks = [0] * (capacity + 1)        # bins of each fill so far
        made, held = node << 40, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.ids(bytes_of(part, "text"))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at:at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece),
                                     piece if with_ids else None))
                        held += len(piece) * with_ids
                    if len(rows) >= CHUNK or held >= 64 << 20:
                        yield flush(rows, node, made, ranks)
                        made, rows, held = made + len(rows), [], 0
        if rows:
            yield flush(rows, node, made, ranks)
        rows = []
        release_memory()

    return run


def _place(shared):
    """Sequence and offset of the pieces of open bins, from the ranks of their bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ranges = shared.value
        size, rank, _, first, each, offset = ranges.T
        starts = base[size] + rank
        for batch in batches:
            fill, earlier, own, inside = (batch.column(n).to_numpy().astype(np.int64)
                                          for n in ("open_fill", "earlier", "open_rank", "offset"))
            at = base[fill] + earlier + own
            r = np.searchsorted(starts, at, "right") - 1
            nth = at - starts[r]
            sequence = MERGED + first[r] + nth // each[r]
            kept = [n for n in batch.schema.names if n not in ("open_fill", "earlier", "open_rank", "offset", "node")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence),
                 pa.array(offset[r] + nth % each[r] * fill + inside)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with ``with_ids`` the piece's ids (little-endian uint32).

    ``vocabulary`` is the path of a tokenizers file whose pre-tokeniser cuts at
    white space; every worker reads it.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Checkpointed: the bins of a task must not change if it runs again later.
    pieces = src.mapInArrow(_tokenise_and_pack(vocabulary, capacity, end_id, with_ids), _PIECES).checkpoint()
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    final = pieces.where("open_fill IS NULL").select(*kept, F.col("bin_id").alias("sequence_id"), "offset")
    counts = (pieces.where("open_fill IS NOT NULL AND offset = 0").groupBy("node", "open_fill")
              .agg(F.count("*").alias("n")).checkpoint())
    per_fill = {r["open_fill"]: r["n"] for r in counts.groupBy("open_fill").agg(F.sum("n").alias("n")).collect()}
    if not per_fill:
        return final
    ranges = np.array(best_fit_counts(per_fill, capacity)[0], dtype=np.int64)
    # Ranks of all fills in one row of numbers: a fill's ranks begin at its base.
    n_of = np.zeros(capacity + 1, dtype=np.int64)
    n_of[list(per_fill)] = list(per_fill.values())
    base = np.cumsum(n_of) - n_of
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    shared = spark.sparkContext.broadcast((base, ranges))
    if counts.count() <= OPEN_BINS:
        seen, rows = {}, []
        for r in sorted(counts.collect()):
            rows.append((r["node"], r["open_fill"], seen.get(r["open_fill"], 0)))
            seen[r["open_fill"]] = rows[-1][2] + r["n"]
        earlier = F.broadcast(spark.createDataFrame(rows, "node long, open_fill int, earlier long"))
    else:
        # One row per partition and fill; a fill's rows are summed in order of the partitions.
        before = Window.partitionBy("open_fill").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        earlier = counts.select("node", "open_fill", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    opened = (pieces.where("open_fill IS NOT NULL").select(*kept, "offset", "open_fill", "open_rank", "node")
              .join(earlier, ["node", "open_fill"]))
    # The columns in the order of ``final``.
    placed = opened.mapInArrow(_place(shared), final.schema)
    return final.unionByName(placed)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from ``pack(..., with_ids=True)``: groups
    are bounded by the capacity."""
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"),
                 F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", "n_tokens",
                    F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids")))

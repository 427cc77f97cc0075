"""JSON documents of any size, cut into their records by many tasks.

A document (an array, an object with a ``Records`` array, or one object) is
read as text whose lines end at ``}``: Spark splits such a file like any text,
and no line is longer than what lies between two closing braces. What a split
means depends on what came before it: how deep it begins, and whether inside a
string. Both compose: for each of the three ways a split may begin (outside
strings, inside, inside behind a backslash) one pass notes how it ends, how the
depth changes and how low it gets. The driver folds these few numbers, a row
per split, in order. A second pass then cuts each split into records; what
crosses its ends is put together from the pieces.

Records come out as JSON text, one a line, so that Spark's JSON reader infers,
parses and quarantines them like any JSON lines. Compressed files are one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2      # where a split begins or ends: outside strings, in one, behind its backslash
FIRST_LINE = 8 << 20                    # bytes up to which a first line is looked at as a line
HIGH = 1 << 60                          # lowest depth of a text that closes nothing

_CLOSE = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_RECORDS = re.compile(rb'"Records"\s*:\s*\[')
_BRACKET = re.compile(rb"[\[\]{}]")
_MARK = re.compile(rb"[\[\]{},]")
_BOM = b"\xef\xbb\xbf"


def _unclosed(tail: bytes) -> int:
    """State at the end of a string's text that isn't closed."""
    return ESCAPED if (len(tail) - len(tail.rstrip(b"\\"))) % 2 else INSIDE


def bare(text: bytes, state: int) -> tuple[bytes, int]:
    """``text`` with dots in place of strings, and the state behind it."""
    at = 0
    if state != OUTSIDE:
        if not text:
            return b"", state
        at = 1 if state == ESCAPED else 0
        closed = _CLOSE.match(text, at)
        if closed is None:
            return b"." * len(text), _unclosed(text[at:])
        at = closed.end()
    rest = b"." * at + _STRING.sub(lambda m: b"." * len(m[0]), text[at:])
    cut = rest.find(b'"')
    if cut < 0:
        return rest, OUTSIDE
    return rest[:cut] + b"." * (len(rest) - cut), _unclosed(text[cut + 1:])


def _records_begin(text: bytes, plain: bytes) -> set[int]:
    """Places of the brackets that open a Records array."""
    if b'"Records"' not in text:
        return set()
    return {m.end() - 1 for m in _RECORDS.finditer(text) if plain[m.start():m.start() + 1] == b"." and plain[m.end() - 1:m.end()] == b"["}


class Walk:
    """Depth along a split that begins in ``state``, counted from 0 there."""

    def __init__(self, state: int):
        self.state, self.depth, self.low, self.more = state, 0, HIGH, False
        self.records: dict[int, int] = {}       # depth where a Records array begins -> lowest depth since the last one
        self.before: tuple | None = None        # the same, less the brace behind the last line

    def line(self, text: bytes) -> None:
        plain, self.state = bare(text, self.state)
        begins = _records_begin(text, plain)
        end = 0
        for m in _BRACKET.finditer(plain):
            end = m.end()
            if m[0] in b"{[":
                if m.start() in begins:
                    self.records[self.depth] = self.depth + 1
                self.depth, self.more = self.depth + 1, True
            else:
                self._down()
        if plain[end:].strip():
            self.more = True
        self.before = self.state, self.depth, self.low, self.more, dict(self.records)

    def brace(self) -> None:
        if self.state == OUTSIDE:
            self._down()
        else:
            self.state = INSIDE

    def _down(self) -> None:
        self.depth -= 1
        if self.depth <= self.low:      # ``more``: anything but blanks behind the lowest depth
            self.low, self.more = self.depth, False
        else:
            self.more = True
        for at, low in self.records.items():
            self.records[at] = min(low, self.depth)


def _lines(spark: SparkSession, path) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("f"),
                       F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[bytes], bool]]:
    """(file, start, size), lines, and whether the split begins with them."""
    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("f", "at", "size"))))
        values = batch.column("value").to_pylist()
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                yield keys[begin], values[begin:i], keys[begin] != now
                now, begin = keys[begin], i


_WALK = "array<struct<state: int, depth: long, low: long, more: boolean, records: map<long, long>>>"
_SUMMARY = f"f string, at long, size long, bytes long, first string, by_line boolean, whole {_WALK}, open {_WALK}"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = pa.list_(pa.struct([("state", pa.int32()), ("depth", pa.int64()), ("low", pa.int64()), ("more", pa.bool_()),
                               ("records", pa.map_(pa.int64(), pa.int64()))]))
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), walk, walk]
    names = ["f", "at", "size", "bytes", "first", "by_line", "whole", "open"]
    key, walks, size, first, by_line = None, [], 0, None, None

    def row() -> pa.RecordBatch:
        fields = ("state", "depth", "low", "more", "records")
        whole = [dict(zip(fields, (w.state, w.depth, w.low, w.more, list(w.records.items())))) for w in walks]
        before = [dict(zip(fields, (*w.before[:4], list(w.before[4].items())))) for w in walks]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, size, first, by_line, whole, before), types)], names=names)

    for found, lines, fresh in _splits(batches):
        if fresh:
            if key is not None:
                yield row()
            key, walks, size, first, by_line = found, [Walk(s) for s in (OUTSIDE, INSIDE, ESCAPED)], 0, None, None
        for line in lines:
            text = line[len(_BOM):] if size == 0 and key[1] == 0 and line.startswith(_BOM) else line
            size += len(line) + 1
            if by_line:         # nothing else is asked of such a file
                continue
            fresh_value = first is None and bool(text.strip())
            if fresh_value:
                first = text.lstrip()[:1].decode("latin-1")
            for w in walks:
                w.line(text)
                w.brace()
            if key[1] == 0 and first is not None and by_line is None:
                if b"\n" in (text.lstrip() if fresh_value else text) or size > FIRST_LINE:
                    by_line = False     # the first value goes on in another line, or for very long
                elif walks[OUTSIDE].state == OUTSIDE and walks[OUTSIDE].depth <= 0:
                    by_line = first == "{"
    if key is not None:
        yield row()


@dataclass
class Document:
    """How a file is cut: the depth at which its records close, where its splits
    begin (state, depth, among the records), the last of them, and whether its
    last line has no brace behind it."""

    base: int
    starts: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    last: int = 0
    open_end: bool = False


def fold(splits: list) -> Document | None:
    """The document of a file's split summaries in order; null if it is none."""
    first = next((s["first"] for s in splits if s["first"]), None)
    size = sum(s["bytes"] for s in splits)
    over = size - splits[0]["size"]
    open_end = over in (1, 1 - len(_BOM))       # Spark may have left out a byte order mark
    if first not in ("{", "[") or over - open_end not in (0, -len(_BOM)):
        return None
    out = Document(0, last=splits[-1]["at"], open_end=open_end)
    state, depth, inside, records, done = OUTSIDE, 0, False, False, False
    for s in splits:
        out.starts[s["at"]] = state, depth, inside
        w = s["open" if open_end and s is splits[-1] else "whole"][state]
        low = depth + w["low"]
        if low < 0 or (done and (w["more"] or w["low"] < HIGH)):
            return None
        begun = (w["records"] or {}).get(1 - depth) if first == "{" else None
        inside = depth + begun > 1 if begun is not None else inside and low > 1
        records |= begun is not None
        if low == 0:        # the document ends here, with nothing behind it
            if w["more"]:
                return None
            done = True
        state, depth = w["state"], depth + w["depth"]
    if state != OUTSIDE or depth != 0 or not done:
        return None
    if first == "[" or not records:     # among the records all the way
        out.starts = {at: (s, d, d > 0) for at, (s, d, _) in out.starts.items()}
    out.base = 1 if first == "[" else 2 if records else 0
    return out


def _clean(text: bytes) -> str:
    return text.replace(b"\n", b" ").replace(b"\r", b" ").strip(b" \t,").decode("utf-8", "replace")


def _cut(documents):
    """(kind, value): records, and as JSON the pieces of records that cross the ends of splits."""
    def pieces(key, lines_of: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[int, bytes]]:
        """(0: whole, 1: up to the first end in the split, 2: behind the last one), text."""
        doc = documents.value[key[0]]
        state, depth, inside = doc.starts[key[1]]
        head, held, base = inside, bytearray(), doc.base

        def end() -> Iterator[tuple[int, bytes]]:
            nonlocal head
            if head or held.strip(b" \t\r\n,"):
                yield int(head), bytes(held)
            head = False
            held.clear()

        for text, closed in lines_of:
            plain, state = bare(text, state)
            begins = _records_begin(text, plain) if base == 2 else ()
            at = 0
            for m in _MARK.finditer(plain):
                i, c = m.start(), m[0]
                if c == b",":
                    if inside and depth == base and base:
                        held += text[at:i]
                        yield from end()
                        at = i + 1
                elif c in b"{[":
                    opens = depth == base - 1 and c == b"[" and (base == 1 or i in begins) or base == depth == 0
                    depth += 1
                    if opens and not inside:
                        inside, at = True, i + (base > 0)
                else:
                    depth -= 1
                    if inside and depth < base:
                        held += text[at:i]
                        yield from end()
                        inside = False
            if inside:
                held += text[at:]
            if closed:
                if inside:
                    held += b"}"
                if state == OUTSIDE:
                    depth -= 1
                    if inside and depth <= base:
                        yield from end()
                        inside = base > 0
                else:
                    state = INSIDE
        if inside:
            yield (1 if head else 2), bytes(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        def rows(split) -> Iterator[tuple[str, str]]:
            key, lines = split
            for kind, text in pieces(key, lines):
                if kind == 0:
                    yield "record", _clean(text)
                else:
                    yield "piece", json.dumps({"f": key[0], "at": key[1], "kind": kind, "text": text.decode("latin-1")})

        def whole_splits() -> Iterator[tuple]:
            """Splits whose lines come one by one, over all batches they span."""
            source = ((key, line) for key, lines, _ in _splits(batches) for line in lines)
            pending = next(source, None)
            while pending is not None:
                key = pending[0]
                doc = documents.value.get(key[0])

                def lines_of(key=key, doc=doc):
                    nonlocal pending
                    first = True
                    while pending is not None and pending[0] == key:
                        text, pending = pending[1], next(source, None)
                        more = pending is not None and pending[0] == key
                        if first and key[1] == 0 and text.startswith(_BOM):
                            text = text[len(_BOM):]
                        first = False
                        yield text, more or not (doc.open_end and key[1] == doc.last)

                if doc is None:
                    for _ in lines_of(doc=Document(0)):
                        pass
                else:
                    yield key, lines_of()

        out: list[tuple[str, str]] = []
        held = 0
        for split in whole_splits():
            for row in rows(split):
                out.append(row)
                held += len(row[1])
                if len(out) >= 10_000 or held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["kind", "value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["kind", "value"])

    return run


def shapes(spark: SparkSession, path) -> tuple[list[str], dict[str, Document]]:
    """(files of JSON lines, documents by file). A file is read by line if its
    first value ends in its first line or if it is no document."""
    found: dict[str, list] = {}
    for r in _lines(spark, path).mapInArrow(_summarise, _SUMMARY).collect():    # a row per split
        found.setdefault(r["f"], []).append(r)
    lines, documents = [], {}
    for name, splits in sorted(found.items()):
        splits.sort(key=lambda r: r["at"])
        if not any(s["first"] for s in splits):
            continue        # blank
        doc = None if splits[0]["by_line"] else fold(splits)
        if doc is None:
            lines.append(name)
        else:
            documents[name] = doc
    return lines, documents


def write_records(spark: SparkSession, path, documents: dict[str, Document], folder: str) -> list[str]:
    """Write the records of the ``documents`` under ``path`` below ``folder``,
    one a line; the paths to read them from. The same ``path`` as for
    ``shapes``: Spark's splits depend on all that is read."""
    shared = spark.sparkContext.broadcast(documents)
    cut = _lines(spark, path).mapInArrow(_cut(shared), "kind string, value string")
    cut.write.partitionBy("kind").text(f"{folder}/cut")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    records, cut_ones = (f"{folder}/cut/kind={k}" for k in ("record", "piece"))
    found = {name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(name)) for name in (records, cut_ones)}
    text = spark.read.text(cut_ones) if found[cut_ones] else spark.range(0).select(F.lit("").alias("value"))
    piece = F.from_json("value", "f string, at long, kind int, text string")
    pieces = text.select(piece.alias("p")).select("p.*")
    # A piece behind a split's last end begins a record that goes on in the splits behind it.
    nth = F.sum((F.col("kind") == 2).cast("int")).over(Window.partitionBy("f").orderBy("at", "kind"))
    joined = (pieces.withColumn("nth", nth).groupBy("f", "nth")
              .agg(F.sort_array(F.collect_list(F.struct("at", "kind", "text"))).alias("x"))
              .select(F.array_join(F.transform("x", lambda p: p["text"]), "").alias("text")))
    text = F.trim(F.translate(F.decode(F.encode("text", "ISO-8859-1"), "UTF-8"), "\r\n", "  "))
    text = F.regexp_replace(text, r"^[\s,]+|[\s,]+$", "")
    joined.select(text.alias("value")).where("value <> ''").write.text(f"{folder}/joined")
    return [f"{folder}/joined", *([records] if found[records] else [])]

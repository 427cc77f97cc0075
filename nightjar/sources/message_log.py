"""A partitioned message log in a shared folder, as a Spark data source.

``spark.dataSource.register(MessageLog)``, then ``readStream`` / ``writeStream``
with ``format("message_log")`` and the log's folder as ``path``. It stands where
a message bus would: topics of numbered partitions, an offset per message,
``startingOffsets``, at-least-once delivery to whoever starts again.

Writing: a task sorts its messages into partitions by the CRC-32 of the key
(null: by its own number) and writes one Parquet segment for each. When all tasks
are done the batch is published by one small commit file that gives every
segment its first offset. A batch that runs again is known by the writer's name
and the batch number, and isn't published twice; what failed tasks or batches
leave behind is never named by a commit. A log has one writer at a time.

Reading: an offset is the count of messages per partition; a commit file holds
the counts after it, so the newest one is the end of the log. A batch reads the
segments between two offsets, one task per segment. A query's checkpoint says
where it goes on. Beside that a sink may note in the log, for a named group, how
far its finished batches came (``noting``); ``startingOffsets=group`` goes on
from there with another query and a new checkpoint.

The folder is opened by ``pyarrow.fs``: a path or a URI of a store that pyarrow
reaches from all machines.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "partition int, offset long, key string, value string"
_SEGMENT = pa.schema([("key", pa.string()), ("value", pa.string())])


class Log:
    """The files of a log."""

    def __init__(self, path: str):
        path = re.sub(r"^file:/+", "/", path)
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def load(self, name: str) -> dict:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def save(self, folder: str, name: str, content: dict) -> None:
        """All or nothing: written beside and moved."""
        self.fs.create_dir(f"{self.root}/{folder}", recursive=True)
        beside = f"{self.root}/{folder}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(beside) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(beside, f"{self.root}/{folder}/{name}")

    def head(self) -> dict:
        """The newest commit: its number, counts per partition, last batch of each writer."""
        names = self.names("commits")
        return self.load(f"commits/{names[-1]}") if names else {"number": -1, "ends": [], "batches": {}, "segments": []}

    def segments(self, start: list[int], end: list[int]) -> Iterator[tuple[int, int, int, str, int]]:
        """(partition, from, to, file, the file's first offset) between two offsets, newest first."""
        for name in reversed(self.names("commits")):
            commit = self.load(f"commits/{name}")
            for p, first, n, file in commit["segments"]:
                a, b = max(first, start[p] if p < len(start) else 0), min(first + n, end[p] if p < len(end) else 0)
                if a < b:
                    yield p, a, b, file, first
            if all(e - sum(s[2] for s in commit["segments"] if s[0] == p) <= (start[p] if p < len(start) else 0)
                   for p, e in enumerate(commit["ends"])):
                return      # all earlier messages lie before the start


@dataclass
class Segment(InputPartition):
    partition: int
    begin: int
    end: int
    file: str
    first: int


@dataclass
class Written(WriterCommitMessage):
    segments: list


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.group = options["path"], options.get("group")
        self.starting = options.get("startingoffsets", "earliest")

    def _offset(self, ends: list[int]) -> dict:
        return {str(p): n for p, n in enumerate(ends)}

    def initialOffset(self) -> dict:
        log = Log(self.path)
        if self.starting == "latest":
            return self._offset(log.head()["ends"])
        if self.starting == "group":
            names = log.names(f"groups/{self.group}")
            return log.load(f"groups/{self.group}/{names[-1]}") if names else {}
        return {} if self.starting == "earliest" else {str(p): int(n) for p, n in json.loads(self.starting).items()}

    def latestOffset(self) -> dict:
        return self._offset(Log(self.path).head()["ends"])

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        counts = [[o.get(str(p), 0) for p in range(max(map(int, o), default=-1) + 1)] for o in (start, end)]
        return [Segment(*s) for s in Log(self.path).segments(*counts)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        log = Log(self.path)
        with log.fs.open_input_file(f"{log.root}/{partition.file}") as f:
            at = partition.first
            for batch in pq.ParquetFile(f).iter_batches(10_000):
                a, b = max(partition.begin - at, 0), min(partition.end - at, batch.num_rows)
                if a < b:
                    own = batch.slice(a, b - a)
                    n = own.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.partition] * n, pa.int32()), pa.array(range(at + a, at + b), pa.int64()),
                         own.column("key"), own.column("value")], names=["partition", "offset", "key", "value"])
                at += batch.num_rows

    def commit(self, end: dict) -> None:
        pass        # messages stay

    def stop(self) -> None:
        pass


def noting(path: str, group: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that notes the group's offsets behind each batch of
    messages (``partition`` and ``offset`` still on them) that ``write`` has
    finished. A batch that runs again notes the same."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write(batch, batch_id)
            ends = {str(r["partition"]): r["n"] + 1 for r in batch.groupBy("partition").agg(F.max("offset").alias("n")).collect()}
        finally:
            batch.unpersist()
        log = Log(path)
        names = log.names(f"groups/{group}")
        before = log.load(f"groups/{group}/{names[-1]}") if names else {}
        ends = before | {p: max(n, before.get(p, 0)) for p, n in ends.items()}
        log.save(f"groups/{group}", f"{sum(ends.values()):020d}.json", ends)

    return on_batch


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path, self.name = options["path"], options.get("writer", "writer")
        self.partitions = int(options.get("partitions", "4"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        log, mine, out = Log(self.path), uuid.uuid4().hex, {}
        own = TaskContext.get().partitionId() % self.partitions
        log.fs.create_dir(f"{log.root}/data", recursive=True)
        try:
            for batch in iterator:
                batch = pa.RecordBatch.from_arrays([batch.column(c).cast(pa.string()) for c in _SEGMENT.names], schema=_SEGMENT)
                place = [own if k is None else zlib.crc32(k.encode()) % self.partitions for k in batch.column("key").to_pylist()]
                for p in sorted(set(place)):
                    if p not in out:
                        file = f"data/{mine}-{p}.parquet"
                        out[p] = [file, pq.ParquetWriter(log.fs.open_output_stream(f"{log.root}/{file}"), _SEGMENT), 0]
                    some = batch.filter(pa.array([q == p for q in place]))
                    out[p][1].write_batch(some)
                    out[p][2] += some.num_rows
        finally:
            for _, writer, _ in out.values():
                writer.close()
        return Written([(p, n, file) for p, (file, _, n) in sorted(out.items())])

    def commit(self, messages: list, batchId: int) -> None:
        log = Log(self.path)
        head = log.head()
        if head["batches"].get(self.name, -1) >= batchId:       # published before a failure
            return self.abort(messages, batchId)
        ends = head["ends"] + [0] * (self.partitions - len(head["ends"]))
        segments = []
        for message in messages:
            for p, n, file in message.segments if message is not None else ():
                segments.append((p, ends[p], n, file))
                ends[p] += n
        number = head["number"] + 1
        log.save("commits", f"{number:020d}.json", {"number": number, "ends": ends, "segments": segments,
                                                    "batches": head["batches"] | {self.name: batchId}})

    def abort(self, messages: list, batchId: int) -> None:
        log = Log(self.path)
        for message in messages:
            for _, _, file in message.segments if message is not None else ():
                log.fs.delete_file(f"{log.root}/{file}")


class MessageLog(DataSource):
    """Options: ``path``; reading ``startingOffsets`` (earliest, latest, group or
    JSON of counts per partition) and ``group``; writing ``partitions`` (of a
    new log) and ``writer`` (a name that stays over restarts)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def streamReader(self, schema) -> LogReader:
        return LogReader(self._options())

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self._options())

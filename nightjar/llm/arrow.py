"""Small helpers for Arrow-batched row functions.

``append_columns`` runs a Python function over bounded slices of each Arrow
batch and appends (or replaces) columns; every other column passes through
untouched, so extra columns of the input survive. A slice holds at most
``max_bytes`` of text unless a single row is longer: memory follows the longest
row, never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 4 << 20

_KEPT: dict[str, object] = {}


def kept_by_worker(key: str, make: Callable[[str], object]):
    """``make(key)``, made once per worker process and kept for its next tasks
    of this kind. Workers outlive their tasks and take turns, so what one kind
    leaves behind in each of them would lie beside the memory of the next:
    tasks of ``append_columns`` begin by dropping it."""
    if key not in _KEPT:
        _KEPT[key] = make(key)
    return _KEPT[key]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that a slice's ``column`` (binary) holds about ``max_bytes``."""
    n = batch.num_rows
    lengths = [0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()]
    start, held = 0, 0
    for i, size in enumerate(lengths):
        if i > start and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < n:
        yield batch.slice(start, n - start)


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values; null counts as empty."""
    return [v or b"" for v in batch.column(column).to_pylist()]


def release_memory() -> None:
    """Give freed memory back to the system. Workers live on between tasks, and
    what their allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):     # no glibc
        pass


def drop_kept() -> None:
    """Drop what tasks of another kind keep in this worker."""
    if _KEPT:
        _KEPT.clear()
        release_memory()


def append_columns(df: DataFrame, text: str, fn: Callable[..., dict], fields: list[T.StructField],
                   max_bytes: int = SLICE_BYTES, also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``fields`` computed by ``fn`` from the UTF-8
    bytes of ``text``. Columns of ``df`` with the same names are replaced.

    ``fn`` gets the list of texts of a slice (null: ``b""``), then the lists of
    the columns ``also``, and returns one list or array per field. A text that
    is kept is sent to Python once: its bytes are a view of the column.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    carried = "__text_bytes"
    viewed = any(f.name == text and isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in kept)
    src = df.select(*[F.col(f"`{f.name}`") for f in kept],
                    *([] if viewed else [F.col(f"`{text}`").cast("binary").alias(carried)]),
                    *[F.col(f"`{c}`").alias(f"__also_{i}") for i, c in enumerate(also)])
    extra = len(also)
    schema = T.StructType([*kept, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    order = [f.name for f in fields]
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            if viewed:
                whole = batch.column(text)
                raw = whole.cast(pa.large_binary() if pa.types.is_large_string(whole.type) else pa.binary())
                batch = pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, carried])
            for part in slices(batch, carried, max_bytes):
                made = fn(bytes_of(part, carried), *[part.column(f"__also_{i}").to_pylist() for i in range(extra)])
                arrays = [part.column(n) for n in kept_names] + [pa.array(made[n], type=t) for n, t in zip(order, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept_names + order)
        release_memory()

    return src.mapInArrow(run, schema)

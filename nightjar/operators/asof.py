"""As-of join: for every row, the last change in force at its time.

Both sides are unioned and range-partitioned once by (key, time), so one key,
one instant or no key at all may hold any number of rows: a run of equal keys
goes over as many partitions as it needs. Inside a partition the last change
is filled forward. What a partition needs from earlier ones is one row, the
last change before it; these rows (one per partition) are carried across on
the driver.

A row is written to the checkpoint folder between the two passes: that pins
the partitions, and a lost executor repeats its part only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.session import checkpoint_dir, partitions_for

_KEY, _SIDE, _PID, _TIE = "_asof_key", "_asof_side", "_asof_pid", "_asof_tie"


def _last_changes(value_cols: list[str]):
    """Per partition: its last change, one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            at = np.flatnonzero(batch.column(_SIDE).to_numpy(zero_copy_only=False) == 0)
            if len(at):
                last = batch.select([_PID, _KEY, *value_cols]).slice(int(at[-1]), 1)
        if last is not None:
            yield last

    return run


def _fill(carried, keep: list[str], value_cols: list[str], out_cols: list[str]):
    """Rows with the last change before them, of their own key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, started = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not started:
                found, at_start = carried.value
                i = at_start.get(batch.column(_PID)[0].as_py())
                last, started = None if i is None else found.slice(i, 1), True
            changes = pa.Table.from_batches([batch.select([_KEY, *value_cols])])
            if last is not None:
                changes = pa.concat_tables([last.cast(changes.schema), changes])
            changes = changes.combine_chunks()
            n = batch.num_rows
            shift = changes.num_rows - n
            change = batch.column(_SIDE).to_numpy(zero_copy_only=False) == 0
            at = np.where(change, np.arange(n) + shift, shift - 1)
            at = np.maximum.accumulate(at)
            held = at >= 0
            known = changes.column(_KEY).take(pa.array(np.maximum(at, 0))).combine_chunks()
            same = pc.fill_null(pc.equal(known, batch.column(_KEY)), False).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(~change)
            take = pa.array(at[rows], mask=~(held & same)[rows])
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [own.column(c) for c in keep] + [changes.column(c).take(take).combine_chunks() for c in value_cols],
                names=keep + out_cols)
            if held[-1]:
                last = changes.slice(int(at[-1]), 1)

    return run


def as_of(rows: DataFrame, changes: DataFrame, values: list[str], on: tuple[str, ...] = ("ts",), by: tuple[str, ...] = (),
          tie: str | None = None, inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """``rows`` with the columns ``values`` of the last row of ``changes`` whose
    ``on`` columns are at or before the row's (``inclusive=False``: before),
    among those of equal ``by`` columns; null where there is none.

    Both sides hold ``on`` and ``by``. ``tie`` decides among changes of equal
    ``on`` (the largest wins). A null in ``by`` matches nothing; a null in the
    first ``on`` column of a row gives null values, such changes are left out.
    Columns of ``rows`` named like ``values`` are replaced. An empty side is
    no special case.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    keep = [c for c in rows.columns if c not in values]
    renamed = [f"_asof_value_{i}" for i in range(len(values))]
    key = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
    if by:      # to_json leaves null fields out: a key with one is null as a whole
        key = F.when(F.expr(" and ".join(f"`{c}` is not null" for c in by)), key)
    left = rows.select(*keep, key.alias(_KEY), F.lit(1).alias(_SIDE))
    right = changes.where(F.col(on[0]).isNotNull()).select(
        *by, *on, *([F.col(tie).alias(_TIE)] if tie else []), key.alias(_KEY), F.lit(0).alias(_SIDE),
        *[F.col(v).alias(r) for v, r in zip(values, renamed)])
    both = left.unionByName(right, allowMissingColumns=True)
    # Changes come before rows of the same instant, or after them.
    side = F.col(_SIDE) if inclusive else -F.col(_SIDE)
    order = [F.col(_KEY), *[F.col(c) for c in on], side, *([F.col(_TIE)] if tie else [])]
    # Rows of one instant spread by their own tie.
    order += [F.col(c) for c in ([tie] if tie and tie in keep and tie not in on else [])]
    n = partitions or partitions_for(both, rows=both.count())
    both = both.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(*([_TIE] if tie else []))
    both = both.withColumn(_PID, F.spark_partition_id()).checkpoint()
    types = {f.name: f.dataType for f in both.schema.fields}
    last = both.mapInArrow(_last_changes(renamed), T.StructType(
        [T.StructField(c, types[c]) for c in (_PID, _KEY, *renamed)])).toArrow()
    pids, carry = last.column(_PID).to_pylist(), {}
    by_pid = sorted(range(len(pids)), key=pids.__getitem__)
    for i, after in zip(by_pid, by_pid[1:] + [None]):
        # In force from the next partition to the one that changes it again.
        until = n - 1 if after is None else pids[after]
        carry.update({p: i for p in range(pids[i] + 1, until + 1)})
    shared = spark.sparkContext.broadcast((last.drop_columns([_PID]).combine_chunks(), carry))
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    schema = T.StructType([*[T.StructField(c, types[c]) for c in keep], *[T.StructField(v, kinds[v]) for v in values]])
    return both.mapInArrow(_fill(shared, keep, renamed, list(values)), schema)

"""Join helpers with an explicit, checked broadcast decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we will ever ship to every executor (Catalyst estimate).
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for ``df`` (no job is run). None if unknown."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # Spark Connect or a plan without statistics
        return None
    return int(size if isinstance(size, int) else size.toString())


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if its estimated size is within ``max_bytes``.

    Beyond the bound the side is returned unchanged, so the planner falls back
    to a shuffled (sort-merge / shuffle-hash) join and AQE may still convert it
    at runtime from real shuffle statistics.
    """
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_table(spark, rows, schema: str) -> DataFrame:
    """A small literal dimension table as a VALUES relation.

    Unlike ``createDataFrame`` (an RDD scan of unknown size), a VALUES
    relation carries exact statistics, so ``bounded_broadcast`` can prove its
    size and broadcast it."""
    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    names = [f[0] for f in fields]
    cols = ", ".join(f"CAST(col{i + 1} AS {t}) AS {n}" for i, (n, t) in enumerate(fields))
    vals = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT {cols} FROM VALUES {vals}")
    return df.select(*names)

"""Small Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """Python truthiness of a string: null and '' are missing (no trim)."""
    c = col(c)
    return F.when(c != F.lit(""), c)


def nonblank(c) -> Column:
    """Non-blank string test used by the UI helpers: trims before testing."""
    c = col(c)
    return F.when(F.trim(c) != F.lit(""), c)


def first_present(*cols) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def first_nonblank(*cols) -> Column:
    return F.coalesce(*[nonblank(c) for c in cols])


def epoch_us(ts) -> Column:
    """Microseconds since epoch for TIMESTAMP_NTZ (time-zone independent)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {ts})") if isinstance(ts, str) \
        else F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts)


def epoch_s(ts) -> Column:
    return epoch_us(ts) / F.lit(1_000_000.0)


def time_bucket(ts, seconds: int) -> Column:
    """Integer bucket number of ``ts`` for a bucket of ``seconds`` (ntz-safe)."""
    return F.floor(epoch_us(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def r6(c) -> Column:
    """Round doubles to 6 dp for stable comparisons."""
    return F.round(col(c).cast("double"), 6)

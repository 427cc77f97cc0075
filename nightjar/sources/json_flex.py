"""Flexible JSON event readers.

Accepted shapes: NDJSON (one object per line, blank lines skipped), a JSON
array, a single object, and ``{"Records": [...]}``, in any mix of files under
one path. The shape is decided per file: a file whose first value is an object
that ends in its first line is read line by line, any other file as one
document, of any size, that many tasks cut into records (``json_split``); if
its brackets and strings don't close, its lines are read after all. What does
not parse is kept in ``_corrupt_record`` (quarantine) and every other line or
record survives. Rows with a ``Records`` array are exploded; rows without one
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.sources.files import scratch_path
from nightjar.sources.json_split import shapes, write_records

CORRUPT = "_corrupt_record"
RECORDS_PER_DOCUMENT = 1_000


class EmptyInputError(ValueError):
    pass


def _explode_records(df: DataFrame) -> DataFrame:
    f = df.schema["Records"].dataType if "Records" in df.columns else None
    if not (isinstance(f, T.ArrayType) and isinstance(f.elementType, T.StructType)):
        return df
    batches = df.filter(F.col("Records").isNotNull()).select(F.explode("Records").alias("_r")).select("_r.*")
    return _union(batches, df.filter(F.col("Records").isNull()).drop("Records"))


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column that the two sides infer differently becomes text."""
    types = [{f.name: f.dataType for f in d.schema.fields} for d in (a, b)]
    for name in types[0].keys() & types[1].keys():
        if types[0][name] != types[1][name]:
            a, b = (d.withColumn(name, F.col(f"`{name}`").cast("string") if not isinstance(t[name], (T.StructType, T.ArrayType))
                                 else F.to_json(f"`{name}`")) for d, t in zip((a, b), types))
    return a.unionByName(b, allowMissingColumns=True)


def read_events_flex(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                     mode: str = "PERMISSIVE") -> DataFrame:
    """S1 (PERMISSIVE, quarantine column) / S2 (``mode="FAILFAST"``). With a
    declared ``schema`` nothing is inferred from the data."""
    reader = spark.read.option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        reader = reader.schema(schema)
    lines, documents = shapes(spark, path)
    parts = []
    if documents:
        records = write_records(spark, path, documents, scratch_path(spark, "json"))
        parts.append(_explode_records(reader.option("mode", mode).option("multiLine", False).json(records)))
    if lines:
        parts.append(_explode_records(reader.option("mode", mode).option("multiLine", False).json(lines)))
    if not parts:
        raise EmptyInputError(f"no JSON records under {path}")
    return parts[0] if len(parts) == 1 else _union(*parts)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (good rows, bad rows) on the corrupt-record column."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    # Spark refuses a raw-file scan that reads only the corrupt-record column,
    # so the parsed rows are persisted (memory and disk) once for both sides.
    df = df.persist()
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def write_records_docs(df: DataFrame, value_col: str, path: str, mode: str = "overwrite") -> None:
    """Write JSON values as ``{"Records": [...]}`` documents of about
    ``RECORDS_PER_DOCUMENT`` values, by a hash of the value."""
    chunks = max(1, df.count() // RECORDS_PER_DOCUMENT)
    docs = df.select(value_col, F.pmod(F.xxhash64(value_col), F.lit(chunks)).alias("_c")).groupBy("_c").agg(
        F.concat(F.lit('{"Records":['), F.concat_ws(",", F.collect_list(value_col)), F.lit("]}")).alias("value"))
    docs.select("value").write.mode(mode).text(path)

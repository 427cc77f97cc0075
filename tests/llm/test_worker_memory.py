"""What workers hold between and during tasks."""

import gc
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm import packing, queries
from nightjar.llm.arrow import append_columns

CRC = [T.StructField("crc", T.LongType())]


def test_tasks_of_another_kind_drop_the_encoders(spark):
    docs = spark.range(160, numPartitions=16).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    packing.pack(docs, queries.vocabulary("word_bpe_49k.json")).collect()

    def encoders(texts):
        return {"n": [sum(isinstance(o, packing.WordEncoder) for o in gc.get_objects())] * len(texts)}

    got = append_columns(docs, "text", encoders, [T.StructField("n", T.LongType())])
    assert {r["n"] for r in got.collect()} == {0}


@pytest.mark.parametrize("as_type,replaced", [("string", False), ("binary", False), ("string", True), ("binary", True)])
def test_a_kept_text_is_sent_to_python_once(spark, as_type, replaced):
    raw = [None, b"", b"abc", "straße".encode(), b"\xff\xc3a", b"long " * 5000]
    docs = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(raw)], "doc_id long, text binary")
    docs = docs.withColumn("text", F.col("text").cast(as_type))
    crcs = lambda texts: {"crc": [zlib.crc32(t) for t in texts]}
    fields = CRC + ([T.StructField("text", T.StringType())] if replaced else [])
    made = (lambda texts: crcs(texts) | {"text": ["x"] * len(texts)}) if replaced else crcs
    got = append_columns(docs, "text", made, fields, max_bytes=10_000)
    assert ("__text_bytes" in got._jdf.queryExecution().optimizedPlan().toString()) is replaced
    assert got.columns == (["doc_id", "crc", "text"] if replaced else ["doc_id", "text", "crc"])
    rows = got.select("doc_id", F.col("text").cast("binary").alias("text"), "crc").collect()
    assert {r["doc_id"]: r["crc"] for r in rows} == {i: zlib.crc32(t or b"") for i, t in enumerate(raw)}
    if not replaced:
        assert [None if r["text"] is None else bytes(r["text"]) for r in sorted(rows)] == raw

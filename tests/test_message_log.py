"""The message log: offsets, restarts, replays and repeated delivery."""

import json
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from nightjar.session import share_package
from nightjar.sources import message_log as ML
from nightjar.streaming import pipeline as P


@pytest.fixture
def log(spark, tmp_path):
    share_package(spark)
    spark.dataSource.register(ML.MessageLog)
    base = str(tmp_path)
    schema = "key string, value string"

    def send(rows, writer="w"):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{base}/in-{writer}")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in-{writer}")
        P.run_available_now(stream, f"{base}/sent-{writer}", fmt="message_log",
                            options={"path": f"{base}/topic", "writer": writer, "partitions": "3"})

    def read(name, starting="earliest", group=None):
        options = {"path": f"{base}/topic", "startingOffsets": starting} | ({"group": group} if group else {})
        stream = spark.readStream.format("message_log").options(**options).load()
        write = P.idempotent_batch_writer(f"{base}/got-{name}/data")
        P.run_available_now(stream, f"{base}/got-{name}", foreach_batch=ML.noting(f"{base}/topic", group, write) if group else write)
        return [tuple(r) for r in spark.read.parquet(f"{base}/got-{name}/data").drop("batch_id").orderBy("partition", "offset").collect()]

    return base, send, read


ROWS = [(None if i % 10 == 0 else f"k{i % 7}", f"v{i}") for i in range(100)]
MORE = [(f"k{i % 7}", f"w{i}") for i in range(40)]


def test_restarts_of_both_ends(log):
    base, send, read = log
    send(ROWS)
    got = read("a")
    assert Counter((k, v) for _, _, k, v in got) == Counter(ROWS)
    for p in range(3):      # dense offsets, and a key stays in its partition
        assert [o for q, o, *_ in got if q == p] == list(range(sum(q == p for q, *_ in got)))
    assert all(len({p for p, _, k, _ in got if k == key}) == 1 for key in {r[0] for r in ROWS if r[0]})
    send(MORE)              # the writer goes on where it stopped
    again = read("a")       # so does the reader
    assert len(again) == 140 and set(got) < set(again) and len(set(again)) == 140
    assert read("a") == again


def test_starting_offsets_and_groups(log):
    base, send, read = log
    send(ROWS)
    assert len(read("early", "earliest", group="g")) == 100
    assert ML.Log(f"{base}/topic").names("groups/g")
    send(MORE)
    # Another query of the group, without the first one's checkpoint.
    assert sorted(v for *_, v in read("second", "group", group="g")) == sorted(v for _, v in MORE)
    assert len(read("fresh", "earliest")) == 140            # a full read again: every message is delivered twice
    ends = ML.Log(f"{base}/topic").head()["ends"]
    some = {str(p): n - 2 for p, n in enumerate(ends)}
    assert [(p, o) for p, o, *_ in read("tail", json.dumps(some))] == [(p, n - 2 + i) for p, n in enumerate(ends) for i in range(2)]


def test_a_batch_that_runs_again_is_published_once(log, spark):
    base, send, read = log
    send(ROWS)
    log_ = ML.Log(f"{base}/topic")
    before = log_.head()
    writer = ML.LogWriter({"path": f"{base}/topic", "writer": "w", "partitions": "3"})
    file = "data/again.parquet"
    with log_.fs.open_output_stream(f"{log_.root}/{file}") as f:
        pq.write_table(pa.table({"key": ["k"], "value": ["again"]}), f)
    writer.commit([ML.Written([(0, 1, file)]), None], before["batches"]["w"])
    assert log_.head() == before and len(read("r")) == 100
    with log_.fs.open_output_stream(f"{log_.root}/{file}") as f:
        pq.write_table(pa.table({"key": ["k"], "value": ["new"]}), f)
    writer.commit([ML.Written([(0, 1, file)]), None], before["batches"]["w"] + 1)
    assert len(read("r")) == 101


def test_two_writers_one_after_the_other(log):
    base, send, read = log
    send(ROWS, "one")
    send(MORE, "two")
    got = read("x")
    assert len(got) == 140 and len({(p, o) for p, o, *_ in got}) == 140


def test_an_empty_log(log):
    base, send, read = log
    send([])
    stream_rows = ML.LogReader({"path": f"{base}/nothing"})
    assert stream_rows.initialOffset() == {} and stream_rows.latestOffset() == {} and stream_rows.partitions({}, {}) == []

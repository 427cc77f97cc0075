"""Detection on a stream with all models, and the online model as one loop."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightjar.operators import anomaly as AN
from nightjar.plans.detect import detect_by_models, detect_full
from nightjar.plans.fixtures import sec_events, ti_table
from nightjar.plans.queries_streaming import stream_records
from nightjar.streaming import models as MS
from nightjar.streaming import pipeline as P

T0 = dt.datetime(2024, 1, 1)
SCORES = ("ueba_score", "seq_score", "online_score", "corr_score", "ti_score", "rule_score", "final_score")


def rows_of(df):
    return {r["event_id"]: (r["session_count"], r["session_unique"], r["prev_login_region"], r["detected"], r["identifier_type"],
                            *(r[c] for c in SCORES)) for r in df.collect()}


def same(a, b):
    """Equal but for the order of floating-point sums."""
    assert a.keys() == b.keys()
    for e, x in a.items():
        assert [v if not isinstance(v, float) else pytest.approx(v, abs=1e-5) for v in x] == list(b[e]), e


@pytest.mark.parametrize("partitions", [1, 6])
def test_running_score_equals_a_loop(spark, partitions):
    rng = np.random.default_rng(3)
    rows = [(i, T0 + dt.timedelta(seconds=int(rng.integers(0, 60))), float(rng.normal()), None if i % 17 == 0 else float(rng.integers(0, 9)))
            for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, a double, b double").withColumn("hst_score", F.lit("own"))
    trees = AN.HalfSpaceTrees(["a", "b"], AN.feature_limits(df, ["a", "b"]))
    got = {r["event_id"]: r["hst_score"] for r in AN.hst_running_score(df, trees, ["ts", "event_id"], partitions=partitions).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in ordered]), pa.array([r[3] for r in ordered], pa.float64())], names=["a", "b"])
    mass, want, half = np.zeros(trees.leaves), {}, None
    for i, (row, leaf) in enumerate(zip(ordered, trees.leaf(batch))):
        if i == 200:
            half = mass.astype(np.int64)
        want[row[0]] = 1 - mass[leaf].mean() / i if i else 0.0
        mass[leaf] += 1
    assert got == pytest.approx(want)
    assert (AN.hst_masses(df, trees) == mass).all()
    late = df.join(spark.createDataFrame([(r[0],) for r in ordered[200:]], "event_id long"), "event_id")
    again = {r["event_id"]: r["hst_score"] for r in AN.hst_running_score(late, trees, ["ts", "event_id"], half, partitions).collect()}
    assert again == pytest.approx({r[0]: want[r[0]] for r in ordered[200:]})
    assert AN.hst_running_score(df.limit(0), trees, ["ts", "event_id"]).count() == 0


def test_stream_with_models_equals_the_batch_chain(spark, sf):
    ev, ti = sec_events(spark, sf), ti_table(spark)
    got = rows_of(stream_records(spark, sf))
    same(got, rows_of(detect_by_models(ev, ti, MS.fit_models(ev))))
    # The models are those of the batch chain; only its online model goes by windows.
    full = rows_of(detect_full(ev, ti))
    shared = [5 + i for i, c in enumerate(SCORES) if c in ("ueba_score", "seq_score", "corr_score")]
    same({e: [v[i] for i in shared] for e, v in got.items()}, {e: [v[i] for i in shared] for e, v in full.items()})
    assert len({v[5 + SCORES.index("online_score")] for v in got.values()}) > 10


def test_stream_with_models_restarts_and_replays(spark, sf):
    """Half the events, a stop, a new version of the models, the other half; each batch comes twice."""
    ev, ti = sec_events(spark, sf).filter("event_id % 3 = 0"), ti_table(spark)
    base = P.stream_dir(spark, "models-restart")
    middle = ev.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    halves = [ev.filter(F.col("ts") <= F.lit(middle)), ev.filter(F.col("ts") > F.lit(middle))]
    first, second = MS.fit_models(halves[0]), MS.fit_models(ev)
    MS.save_models(first, f"{base}/models", 1)
    for nth, part in enumerate(halves):
        part.repartition(2).write.mode("append").parquet(f"{base}/in")
        stream = P.session_events(P.read_stream(spark, f"{base}/in", ev.schema, 2), last_n=MS.LAST_N)

        def twice(batch, batch_id, nth=nth):
            batch = batch.persist()
            write = lambda: MS.model_writer(f"{base}/models", f"{base}/state", f"{base}/records", ti)(batch, batch_id)
            write()
            once = rows_of(spark.read.parquet(f"{base}/records"))
            if nth == 0:        # a version that is published before the replay isn't read by it
                MS.save_models(second, f"{base}/models", 2)
            write()
            same(rows_of(spark.read.parquet(f"{base}/records")), once)
            batch.unpersist()

        P.run_available_now(stream, f"{base}/out", rocksdb=True, state_partitions=2, foreach_batch=twice)
    got = rows_of(spark.read.parquet(f"{base}/records"))
    whole = rows_of(detect_by_models(ev, ti, second))
    early = rows_of(detect_by_models(halves[0], ti, first))
    assert len(got) == ev.count()
    same({e: got[e] for e in early}, early)
    # Later events go on from the state before the stop; the online model starts anew with its version.
    online = 5 + SCORES.index("online_score")
    final = 5 + SCORES.index("final_score")
    cut = lambda v: tuple(x for i, x in enumerate(v) if i not in (online, final, 3, 4))
    same({e: cut(v) for e, v in got.items() if e not in early}, {e: cut(v) for e, v in whole.items() if e not in early})

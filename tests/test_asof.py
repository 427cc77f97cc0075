"""As-of joins and the settings in force, against sequential versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nightjar.operators import feedback as FB
from nightjar.operators.asof import as_of

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + dt.timedelta(seconds=n)


def rows_and_changes(seed=5, n=400, times=40):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    rows = [(i, key(), rng.choice([None, *range(times)]), f"r{i}") for i in range(n)]
    changes = [(1000 + i, rng.choice(["a", "b", "b", None]), rng.choice([None, *range(0, times, 3)]), i * 1.5, [i]) for i in range(90)]
    return rows, changes


@pytest.mark.parametrize("by", [(), ("k",)])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_as_of_matches_a_sequential_search(spark, by, inclusive, partitions):
    rows, changes = rows_and_changes()
    left = spark.createDataFrame([(i, k, at(t), s, -1.0) for i, k, t, s in rows],
                                 "event_id long, k string, ts timestamp_ntz, note string, v double")
    right = spark.createDataFrame([(i, k, at(t), v, x) for i, k, t, v, x in changes],
                                  "event_id long, k string, ts timestamp_ntz, v double, x array<int>")
    got = as_of(left.drop("v"), right, ["v", "x"], by=by, tie="event_id", inclusive=inclusive, partitions=partitions)
    assert got.columns == ["event_id", "k", "ts", "note", "v", "x"]
    want = set()
    for i, k, t, s in rows:
        found = [(ct, ci, v, tuple(x)) for ci, ck, ct, v, x in changes if ct is not None and t is not None
                 and (ct <= t if inclusive else ct < t) and (not by or (k is not None and ck == k))]
        want.add((i, k, at(t), s, *(max(found)[2:] if found else (None, None))))
    assert {(*r[:5], None if r["x"] is None else tuple(r["x"])) for r in got.collect()} == want
    replaced = as_of(left, right, ["v"], by=by, tie="event_id", inclusive=inclusive, partitions=partitions)
    assert sorted(replaced.columns) == sorted(left.columns) and replaced.schema["v"].dataType.simpleString() == "double"


def test_as_of_with_an_empty_side(spark):
    rows, changes = rows_and_changes()
    left = spark.createDataFrame([(i, at(t)) for i, _, t, _ in rows], "event_id long, ts timestamp_ntz")
    right = spark.createDataFrame([(at(t), v) for _, _, t, v, _ in changes], "ts timestamp_ntz, v double")
    assert as_of(left, right.limit(0), ["v"]).where("v is not null").count() == 0
    assert as_of(left, right.limit(0), ["v"]).count() == len(rows)
    assert as_of(left.limit(0), right, ["v"]).count() == 0


def test_as_of_with_all_rows_at_one_instant(spark):
    """One key and one time hold all rows: they still go over many partitions."""
    left = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("a").alias("k"), F.lit(at(5)).cast("timestamp_ntz").alias("ts"))
    right = spark.createDataFrame([("a", at(5), 1.0, 1), ("a", at(5), 2.0, 2), ("a", at(6), 3.0, 3)],
                                  "k string, ts timestamp_ntz, v double, event_id long")
    got = as_of(left, right, ["v"], by=("k",), tie="event_id", partitions=8)
    assert {tuple(r) for r in got.groupBy("v").count().collect()} == {(2.0, 2000)}
    assert got.rdd.glom().map(len).filter(lambda n: n > 0).count() > 4


@pytest.mark.parametrize("partitions", [1, 5])
def test_weights_history_matches_a_loop(spark, partitions):
    rng = random.Random(9)
    rows = [(rng.choice(["c1", "c1", "c2", "c3"]), at(rng.randrange(50)), i,
             rng.choice([None, [], [rng.randrange(9) for _ in range(rng.choice([2, 4, 6]))], [3, 3, 3, 3]])) for i in range(120)]
    df = spark.createDataFrame(rows, "client_id string, ts timestamp_ntz, event_id long, weights array<bigint>")
    got = {r["event_id"]: tuple(round(x, 9) for x in r[2:]) for r in FB.weights_history(df, partitions=partitions).collect()}
    held, want = {}, {}
    for client, ts, i, w in sorted(rows, key=lambda r: (r[1], r[2])):
        held[client] = w or []
        known = [v for v in held.values() if v]
        mean = []
        for d in range(max(map(len, known), default=0)):
            xs = [v[d] for v in known if len(v) > d]
            mean.append(sum(xs) / len(xs))
        default = list(FB.DEFAULT_FUSION.values())
        if mean:
            scaled = [(m - min(mean)) / (max(mean) - min(mean) + FB.NORM_EPS) for m in mean][:4]
            four = scaled + default[len(scaled):]
            whole = sum(four) or 1.0
            want[i] = tuple(round(x / whole, 9) for x in four)
        else:
            want[i] = tuple(default)
    assert got == want


def test_weights_history_of_no_updates(spark):
    df = spark.createDataFrame([], "client_id string, ts timestamp_ntz, event_id long, weights array<bigint>")
    assert FB.weights_history(df).count() == 0

"""Steps whose cost once grew faster than their input."""

import datetime as dt
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nightjar.operators import sequences, sessions
from nightjar.operators import templates as TM
from nightjar.streaming import pipeline as P


def made_events(spark, n=600, entities=12):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 3), f"user_{i % entities}" if i % 29 else None,
             [None, "ConsoleLogin", "GetObject", "CreateUser", "AuthFailure"][i % 7 % 5], f"r{i % 3}" if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, entity_id string, event_type string, region string")


@pytest.mark.parametrize("step", [sessions.last_n_events, sequences.sequence_surprise])
def test_lists_of_types_are_not_broadcast(spark, step):
    """They are small in a shuffle and large in memory."""
    df = step(made_events(spark))
    assert len(df.collect()) == 600
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search(r"BroadcastHashJoin \[entity_id", plan) and re.search(r"SortMergeJoin \[entity_id", plan)


@pytest.mark.parametrize("max_key_rows", [sessions.MAX_KEY_ROWS, 49, 0])
def test_lists_of_types_do_not_depend_on_the_cut(spark, max_key_rows):
    """Busy entities (more than 49 rows: some) are cut into hours, and so are rows of no entity."""
    ev = made_events(spark)
    df = sessions.last_n_events(ev, n=5, max_key_rows=max_key_rows)
    got = {r["event_id"]: r["last_events"] for r in df.collect()}
    assert len(got) == 600 and set(df.columns) == {*ev.columns, "last_events"}
    seen = defaultdict(list)
    for r in ev.orderBy("ts", "event_id").collect():
        of = seen[r["entity_id"] or r["ts"]]
        of.append(r["event_type"] or "UnknownEvent")
        assert got[r["event_id"]] == of[-5:]


def test_classifier_reads_its_events_few_times(spark, tmp_path, monkeypatch):
    """Once for the lists of types; each row of an event_id gets all labels of that id."""
    from nightjar.plans import queries_models as QM
    from nightjar.plans.fixtures import sec_events

    ids = [*range(300), *range(0, 60, 2), None, None, 4]
    rows = [(x, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), i % 7 if i % 23 else None, "view", 1.0, "{}") for i, x in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(
        f"{tmp_path}/events.parquet")
    made = spark.sparkContext.accumulator(0)

    def seen(v):
        made.add(1)
        return v

    monkeypatch.setattr(QM, "sec_events", lambda s, d: sec_events(s, d).withColumn("event_type", F.udf(seen, "string")("event_type")))
    got = defaultdict(list)
    for r in QM.q_seq_classifier(spark, str(tmp_path)).collect():
        got[r["event_id"]].append(r["label"])
    assert {x: len(v) for x, v in got.items()} == {x: ids.count(x) ** 2 for x in ids if x is not None}
    det = QM.D.detect(sec_events(spark, str(tmp_path)), QM.ti_table(spark)).where("event_id IS NOT NULL").collect()
    assert {x: sum(v) for x, v in got.items()} == {
        x: ids.count(x) * sum(r["detected"] for r in det if r["event_id"] == x) for x in got}
    assert made.value <= 8 * len(ids)


def test_classifier_trains_on_parts_of_few_rows(spark, tmp_path, monkeypatch):
    """A training task holds its rows in memory, however small their files are."""
    from pyspark.ml import Pipeline

    from nightjar.plans import queries_models as QM

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), i % 7, "view", 1.0, "{}") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(
        f"{tmp_path}/events.parquet")
    parts, fit = [], Pipeline.fit

    def seen(self, data):
        parts.extend(r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect())
        return fit(self, data)

    monkeypatch.setattr(Pipeline, "fit", seen)
    monkeypatch.setattr(QM, "CLASSIFIER_ROWS", 30, raising=False)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert QM.q_seq_classifier(spark, str(tmp_path)).count() == 400
    assert sum(parts) == 400 and max(parts) <= 30
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


LINES = ["a b c", "a b d", "a x c", "a b c", "b <*> c", "b <*> d", "", "", "one", "a", "z  y", "z  x", "z q x", None,
         *[f"k {i} {i % 2} end" for i in range(12)], *[f"k 1 0 {'end' if i % 4 else i}" for i in range(9)],
         " ".join(f"t{i}" for i in range(3_000)), " ".join(f"t{i - i % 7 // 6}" for i in range(3_000))]


def brute_templates():
    lines, groups = defaultdict(int), defaultdict(list)
    for x in LINES:
        if x is not None:
            lines[x] += 1
    for x in lines:
        groups[len(x.split(" ")), x.split(" ")[0]].append(x)
    merged, clusters = set(), set()
    for (k, first), members in groups.items():
        cols = list(zip(*(m.split(" ") for m in members)))
        general = " ".join(c[0] if len(set(c)) == 1 else "<*>" for c in cols)
        total = sum(lines[m] for m in members)
        merged.add((k, first, general, len(members), total))
        for m in members:
            const = [sum(lines[o] for o, t in zip(members, c) if t == mine) >= 0.2 * total for c, mine in zip(cols, m.split(" "))]
            s = sum(const) / k
            out = " ".join(t if ok else "<*>" for t, ok in zip(m.split(" "), const)) if s >= 0.4 else m
            clusters.add((m, lines[m], out, s))
    return merged, clusters


def test_tokens_travel_without_their_template(spark):
    mined = spark.createDataFrame([(x,) for x in LINES], "template string")
    merged, clusters = brute_templates()
    for df, want in ((TM.merge_templates(mined), merged), (TM.cluster_templates(mined).drop("cluster_id"), clusters)):
        assert {tuple(r) for r in df.collect()} == want and df.count() == len(want)
        plan = df._jdf.queryExecution().executedPlan().toString()
        kept = re.findall(r"Generate (?:pos)?explode\(.*\), \[([^\]]*)\], ", plan)
        assert kept and not any("template#" in names for names in kept)


@pytest.mark.parametrize("group_bytes", [TM.GROUP_BYTES, 1_000, 0])
def test_lines_are_dealt_once_for_their_clusters(spark, group_bytes):
    """By group, where they stay; the lines of large groups by template."""
    mined = spark.createDataFrame([(x,) for x in LINES], "template string")
    df = TM.cluster_templates(mined, group_bytes=group_bytes).drop("cluster_id")
    got = [tuple(r) for r in df.collect()]
    assert set(got) == brute_templates()[1] and len(got) == len(set(got))
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = re.findall(r"(?m)^[ :]*[+:]- Exchange hashpartitioning\(([^)]*)\)", plan)
    if group_bytes == TM.GROUP_BYTES:
        assert [re.sub(r"#\d+L?", "", x) for x in dealt] == ["n_tokens, first_token, 4"]
    else:
        assert len(dealt) > 1


def test_no_lines_have_no_clusters(spark):
    for rows in ([], [(None,)]):
        assert TM.cluster_templates(spark.createDataFrame(rows, "template string")).count() == 0


@pytest.mark.parametrize("groups", [3, 1_024])
def test_state_is_kept_for_groups_of_entities(spark, groups):
    """The state store holds a row per group, whatever the number of entities."""
    ev = made_events(spark)
    base = P.stream_dir(spark, f"groups{groups}")
    for part in (ev.filter("event_id < 300"), ev.filter("event_id >= 300")):
        part.repartition(2).write.mode("append").parquet(f"{base}/in")
    out = P.session_events(P.read_stream(spark, f"{base}/in", ev.schema, 2), last_n=4, groups=groups)
    P.run_available_now(out, f"{base}/out", rocksdb=True, state_partitions=2)
    got = {r["event_id"]: r for r in spark.read.parquet(f"{base}/out/data").collect()}
    assert len(got) == 600
    seen = defaultdict(list)
    region = {}
    for r in ev.orderBy("ts", "event_id").collect():
        k, t = r["entity_id"], r["event_type"] or "UnknownEvent"
        seen[k].append(t)
        g = got[r["event_id"]]
        assert (g["entity_id"], g["session_count"], g["session_unique"], g["last_events"]) == (
            k, len(seen[k]), len(set(seen[k])), seen[k][-4:])
        assert g["prev_login_region"] == (region.get(k) if t == "ConsoleLogin" else None)
        if t == "ConsoleLogin":
            region[k] = r["region"]
    rows = spark.read.format("statestore").load(f"{base}/out/_checkpoint").count()
    assert 0 < rows <= min(groups, 13)


def test_idle_entities_expire_one_by_one():
    """An entity that writes keeps its state; one that doesn't for the TTL loses it, in the same group."""
    import pandas as pd

    class State:
        get, now, exists, hasTimedOut, after = None, 0, False, False, None

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.get, self.exists = None, False

        def setTimeoutDuration(self, ms):
            self.after = ms

    step, state = P._session_step("k", ["k"], 100), State()

    def run(at, keys):
        state.now = at
        pdf = pd.DataFrame({"k": keys, "event_type": "t", "region": None, "event_id": range(len(keys)), "ts": pd.Timestamp(at, unit="ms")})
        return [c for x in step((0,), iter([pdf]), state) for c in x["session_count"]]

    assert run(1_000, ["a", "b"]) == [1, 1] and state.after == 100
    assert run(1_060, ["a"]) == [2] and state.after == 40
    assert run(1_110, ["a", "b"]) == [3, 1]
    state.now, state.hasTimedOut = 1_300, True
    assert list(step((0,), iter([]), state)) == [] and not state.exists


def test_components_halve_in_each_round(spark):
    """A long path, a star and pairs: the links of all rounds together are few times those of the input."""
    import glob

    from nightjar.functions.components import connected_components
    from nightjar.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/nightjar-out/components-"
    before = set(glob.glob(folder + "*"))
    n = 20_000
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(spark.range(n).select(F.lit(-7).alias("a"), F.col("id") * 2 + 100_000))
    edges = edges.union(spark.range(n).select(F.col("id") * 2 + 1_000_000, F.col("id") * 2 + 1_000_001))
    edges = edges.union(spark.createDataFrame([(None, 3), (5, 5), (9_999_999, 9_999_999)], "a long, b long"))
    got = connected_components(edges.withColumn("a", F.col("a").cast("string")).withColumn("b", F.col("b").cast("string")))
    assert got.count() == got.select("node").distinct().count() == n + 1 + n + 1 + 2 * n
    sizes = {r["component"]: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes["0"] == sizes["-7"] == n + 1 and len(sizes) == n + 2
    (made,) = set(glob.glob(folder + "*")) - before
    assert spark.read.parquet(*glob.glob(f"{made}/links*")).count() < 3 * 3 * n


def test_pagerank_makes_its_edges_once(spark):
    from nightjar.operators import graph as G

    made = spark.sparkContext.accumulator(0)

    def seen(v):
        made.add(1)
        return v

    edges = spark.range(300).select(F.udf(seen, "string")((F.col("id") % 40).cast("string")).alias("src"),
                                    (F.col("id") * 7 % 90).cast("string").alias("dst"))
    vertices = spark.range(90).select(F.col("id").cast("string").alias("id"))
    got = {r["id"]: r["pagerank"] for r in G.pagerank(edges, vertices).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and len(got) == 90
    assert made.value <= 2 * 300


def test_json_lines_are_not_walked_to_their_end(monkeypatch):
    import pyarrow as pa

    from nightjar.sources import json_split as J

    walked = []
    line = J.Walk.line
    monkeypatch.setattr(J.Walk, "line", lambda self, text: (walked.append(1), line(self, text))[1])
    values = [b'{"a": {"b": "}"}', b""] + [b'\n{"a": {"c": 1}', b""] * 2_000
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(["f"] * len(values)),
                                        pa.array([0] * len(values), pa.int64()), pa.array([9] * len(values), pa.int64())],
                                       names=["value", "f", "at", "size"])
    (row,) = [r for b in J._summarise(iter([batch])) for r in b.to_pylist()]
    assert row["by_line"] and row["first"] == "{" and row["bytes"] == sum(len(v) + 1 for v in values)
    assert len(walked) < 20

"""Documents cut into records over any number of splits, against whole parsing."""

import json
import random

import pytest
from nightjar.sources import json_flex as JF
from nightjar.sources.json_split import INSIDE, OUTSIDE, ESCAPED, Walk, bare, shapes

ODD = ["}", "{", "[", "]", '"', "\\", '\\"', '"}', "},{", '{"Records":[', "Records", ",", "é漢", "a b", "", "\n", "\t", "]}"]


@pytest.fixture
def split_bytes(spark):
    """Small splits; each file is cut into many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def records(n, seed=1):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(5)))
        if kind < 3:
            return text
        if kind == 3:
            return rng.randrange(100)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {f"k{rng.randrange(3)}": value(depth - 1), "Records": [1]} if rng.random() < 0.3 else {"x": {}, "y": value(depth - 1)}

    return [{"id": i, "v": json.dumps(value(3)), "deep": {"a": [{"s": rng.choice(ODD)}], "b": {"c": rng.choice(ODD)}}} for i in range(n)]


SHAPES = {
    "array": lambda r: json.dumps(r),
    "pretty": lambda r: json.dumps(r, indent=1, ensure_ascii=False),
    "by_line": lambda r: "[" + ",\n".join(map(json.dumps, r)) + "]\n",
    "bom": lambda r: "﻿\n " + json.dumps(r, indent=0),
    "records": lambda r: json.dumps({"meta": {"a": [{"Records": [1, {"z": 1}]}]}, "Records": r, "after": [{"b": 1}, {"c": "}"}]}, indent=1),
    "records_first": lambda r: json.dumps({"Records": r}, indent=2) + "\n\n",
    "records_in_text": lambda r: json.dumps({"note": '"Records":[{', "Records": r}, indent=0),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("size", [60, 1 << 20])
def test_documents_in_many_splits(spark, tmp_path, split_bytes, shape, size):
    want = records(60 if size < 100 else 400)
    (tmp_path / "a.json").write_text(SHAPES[shape](want), encoding="utf-8")
    (tmp_path / "b.json").write_text(SHAPES[shape](records(5, 2))[:1 << 20], encoding="utf-8")
    split_bytes(size)
    schema = "id long, v string, deep struct<a: array<struct<s: string>>, b: struct<c: string>>, _corrupt_record string"
    df = JF.read_events_flex(spark, str(tmp_path), schema)
    rows = df.collect()
    assert all(r["_corrupt_record"] is None for r in rows)
    got = sorted((r["id"], r["v"], r["deep"]["a"][0]["s"], r["deep"]["b"]["c"]) for r in rows)
    assert got == sorted((r["id"], r["v"], r["deep"]["a"][0]["s"], r["deep"]["b"]["c"]) for r in want + records(5, 2))


def test_a_document_is_read_by_many_tasks(spark, tmp_path, split_bytes):
    (tmp_path / "a.json").write_text(json.dumps(records(2000)))
    split_bytes(10_000)
    lines, documents = shapes(spark, str(tmp_path))
    assert not lines and len(next(iter(documents.values())).starts) > 10


def test_one_long_record_over_many_splits(spark, tmp_path, split_bytes):
    long = {"id": 1, "v": "x{}" * 3000, "w": [{"a": i} for i in range(500)]}
    (tmp_path / "a.json").write_text(json.dumps([{"id": 0, "v": "", "w": []}, long, {"id": 2, "v": "}", "w": []}]))
    split_bytes(400)
    got = {r["id"]: (r["v"], len(r["w"])) for r in JF.read_events_flex(spark, str(tmp_path), "id long, v string, w array<struct<a: long>>").collect()}
    assert got == {0: ("", 0), 1: (long["v"], 500), 2: ("}", 0)}


@pytest.mark.parametrize("text,ids,bad", [
    ('[{"id": 1},\n {"id": tru},\n {"id": 3}]', {1, 3}, 1),           # one bad record of a document
    ('[1, {"id": 2}, "x", [{"id": 4}], null]', {2, 4}, 3),            # members that are no objects
    ('{"id": 1}\n{"id": 2\n{"id": 3}\n', {1, 3}, 1),                  # lines, one cut short
    ('[\n{"id": 1},\n{"id": 2}\n', {1, 2}, 1),                        # not closed: by line
    ('{\n"id": 7\n}', {7}, 0),
    ('[{"id": 1}]\n[{"id": 2}]\n', {1, 2}, 0),                        # arrays line by line
    ('[]', set(), 0),
    ('{"Records": []}', set(), 0),
    ('{"Records": {"id": 1}, "id": 5}', {5}, 0),                      # Records is no array
])
def test_what_does_not_parse_is_kept(spark, tmp_path, split_bytes, text, ids, bad):
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "ok.json").write_text('{"id": 99}\n')
    for size in (5, 1 << 20):
        split_bytes(size)
        df = JF.read_events_flex(spark, str(tmp_path), "id long, _corrupt_record string").collect()
        assert {r["id"] for r in df if r["id"] is not None} == ids | {99}
        assert sum(r["_corrupt_record"] is not None for r in df) >= bad


def test_states_compose():
    """A text cut anywhere ends where the whole ends."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(['"', "\\", "x", "[", "{", "]", " "]) for _ in range(30)).encode()
        cut = rng.randrange(31)
        for state in (OUTSIDE, INSIDE, ESCAPED):
            _, end = bare(text, state)
            _, middle = bare(text[:cut], state)
            assert bare(text[cut:], middle)[1] == end
            one, first = Walk(state), Walk(state)
            one.line(text)
            first.line(text[:cut])
            second = Walk(first.state)
            second.line(text[cut:])
            assert one.depth == first.depth + second.depth
            assert one.low == min(first.low, first.depth + second.low) or one.low > 1 << 50


def test_blank_files_are_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text(" \n ")
    with pytest.raises(JF.EmptyInputError):
        JF.read_events_flex(spark, str(tmp_path))

"""Reader tests on small files written by the tests themselves."""

import itertools
import json

import pytest

from nightjar.operators.mapping import map_cloudtrail
from nightjar.sources import files as FS
from nightjar.sources import json_flex as JF

REC = {"eventID": "e1", "eventTime": "2024-01-01T00:00:00Z", "eventName": "ConsoleLogin",
       "sourceIPAddress": "5.199.1.1", "userIdentity": {"type": "IAMUser", "userName": "bob",
                                                         "arn": "arn:aws:iam::1:user/bob"}}
REC2 = {"eventTime": "2024-01-01T00:01:00Z", "userIdentity": {"principalId": "AID1"}}


def _write(tmp_path, name, text):
    d = tmp_path / name
    d.mkdir()
    (d / "part.json").write_text(text)
    return str(d)


@pytest.mark.parametrize("shape", ["array", "records", "object", "ndjson", "array_pretty"])
def test_flex_shapes(spark, tmp_path, shape):
    texts = {
        "array": json.dumps([REC, REC2]),
        "records": json.dumps({"Records": [REC, REC2]}),
        "object": json.dumps(REC, indent=2),
        "ndjson": json.dumps(REC) + "\n\n" + json.dumps(REC2) + "\n",
        "array_pretty": json.dumps([REC, REC2], indent=2),
    }
    df = JF.read_events_flex(spark, _write(tmp_path, shape, texts[shape]))
    good, bad = JF.quarantine(df)
    m = {r.entity_id: r for r in map_cloudtrail(good).collect()}
    assert "arn:aws:iam::1:user/bob" in m
    assert m["arn:aws:iam::1:user/bob"].geo_ip == "5.199.1.1"
    if shape != "object":
        assert m["AID1"].event_type == "CloudTrailEvent"
    assert bad.count() == 0


SHAPES = {
    "ndjson": [json.dumps(dict(REC, eventID=f"n{i}")) for i in range(5)],
    "records": [json.dumps({"Records": [dict(REC, eventID=f"r{i}") for i in range(3)]})],
    "records_pretty": json.dumps({"Records": [dict(REC, eventID=f"q{i}") for i in range(3)]}, indent=1).split("\n"),
    "array": [json.dumps([dict(REC, eventID=f"a{i}") for i in range(3)])],
    "array_by_line": ["["] + [json.dumps(dict(REC, eventID=f"l{i}")) + "," for i in range(2)] + [json.dumps(dict(REC, eventID="l2")), "]"],
    "object_pretty": json.dumps(dict(REC, eventID="o"), indent=2).split("\n"),
}


@pytest.mark.parametrize("first,second", list(itertools.combinations(sorted(SHAPES), 2)))
def test_flex_mixed_shapes_lose_nothing(spark, tmp_path, first, second):
    for name in (first, second):
        (tmp_path / f"{name}.json").write_text("\n\n" + "\n".join(SHAPES[name]) + "\n")
    good, bad = JF.quarantine(JF.read_events_flex(spark, str(tmp_path)))
    size = {"ndjson": 5, "object_pretty": 1}
    assert good.select("eventID").distinct().count() == size.get(first, 3) + size.get(second, 3)
    assert bad.count() == 0


def test_flex_all_shapes_and_bad_lines_at_once(spark, tmp_path):
    for name, lines in SHAPES.items():
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    (tmp_path / "bad_first.json").write_text('{"eventID": \n' + json.dumps(dict(REC, eventID="b1")) + "\n")
    (tmp_path / "bad_later.json").write_text(json.dumps(dict(REC, eventID="b2")) + "\n{oops\n")
    good, bad = JF.quarantine(JF.read_events_flex(spark, str(tmp_path)))
    assert good.count() == 5 + 3 + 3 + 3 + 3 + 1 + 2 and bad.count() == 2


def test_flex_quarantines_bad_lines(spark, tmp_path):
    text = json.dumps(REC) + "\nnot json at all\n" + json.dumps(REC2) + "\n"
    good, bad = JF.quarantine(JF.read_events_flex(spark, _write(tmp_path, "bad", text)))
    assert good.count() == 2 and bad.count() == 1


def test_flex_empty_is_error(spark, tmp_path):
    with pytest.raises(Exception):
        JF.read_events_flex(spark, _write(tmp_path, "empty", ""))


def test_scenario_reader(spark, tmp_path):
    yaml = """name: basic_phish
victims:
  - alice@example.com
chain:
  - action: PhishingClick
    description: clicked
    mitre_technique: T1566
  - description: no action given
    mitre_technique: T1552
  - action: ConsoleLogin
    mitre_technique: T1078
"""
    p = tmp_path / "s.yaml"
    p.write_text(yaml)
    rows = sorted((r.step_no, r.action, r.technique) for r in FS.read_scenario(spark, str(p)).collect())
    assert rows == [(1, "PhishingClick", "T1566"), (2, "UnknownAction", "T1552"), (3, "ConsoleLogin", "T1078")]


def test_nodelink_reader(spark, tmp_path):
    g = {"directed": True, "multigraph": False, "graph": {},
         "nodes": [{"id": "bob", "type": "entity"}, {"id": "1.1.1.1", "type": "ip"}, {"id": "ConsoleLogin"}],
         "links": [{"source": "bob", "target": "1.1.1.1", "type": "used_ip", "ts": None},
                   {"source": "bob", "target": "ConsoleLogin", "type": "did_event", "ts": None}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(g))
    v, e = FS.read_nodelink(spark, str(p))
    assert v.count() == 3 and e.count() == 2
    assert {r.dst for r in e.collect()} == {"1.1.1.1", "ConsoleLogin"}

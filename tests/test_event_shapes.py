"""Event documents in every shape give the same rows; what cannot be read is a finding."""

import json

import pandas as pd

from touchline.plans import ingest
from touchline.sources import files

A = {"id": "a", "index": 1, "period": 1, "minute": 3, "location": [60, 40], "type": {"id": 30, "name": "Pass"}, "team": {"id": 5, "name": "T"}}
B = {"id": "b", "index": 2, "type": {"id": 16, "name": "Shot"}, "shot": {"freeze_frame": [{"player": {"id": 5}}]}}
SHAPES = {
    "array": json.dumps([A, B]),
    "wrapper": json.dumps({"meta": {"id": 1, "type": "x"}, "events": [A, B]}),
    "periods": json.dumps({"match_id": 3, "periods": [{"period": 1, "events": [A]}, {"period": 2, "events": [B]}]}),
    "deeper": json.dumps({"data": {"events": [A, B]}}),
    "lines": json.dumps(A) + "\n" + json.dumps(B) + "\n",
}


def test_shapes(spark):
    docs = spark.createDataFrame([*SHAPES.items(), ("lone", json.dumps(A)), ("lone_events", json.dumps({"events": A}))], "k string, raw string")
    got = {}
    for r in files.event_rows(docs, "k", "raw").collect():
        got.setdefault(r.k, []).append((r.event_id, r["index"], r.event_type, r.team_id, r.x_norm, r.location_quality))
    a, b = ("a", 1, "Pass", 5, 0.5, "valid"), ("b", 2, "Shot", None, None, "missing")
    assert got == dict.fromkeys(SHAPES, [a, b]) | {"lone": [a], "lone_events": [a]}


def test_findings(spark):
    texts = {"null": None, "empty": " ", "broken": '[{"id": "a"', "half_lines": json.dumps(A) + "\n{", "scalar": "7", "other": '{"a": [1]}', "none": "[]", "none_wrapped": '{"events": []}', "mixed": json.dumps([A, None, 7, {}, {"id": "c"}])}
    docs = spark.createDataFrame(list(texts.items()), "k string, raw string")
    got = {}
    for r in files.event_report(docs, "k", "raw").collect():
        got.setdefault(r.k, []).append(r.finding or r.event_id)
    assert got == {k: ["malformed"] for k in ("null", "empty", "broken", "half_lines")} | {"scalar": ["no_events"], "other": ["no_events"], "mixed": ["a", "not_an_event", "not_an_event", "not_an_event", "c"]}


def test_payload_event_types(spark, tmp_path):
    rows = [(f"r{i}", "events/1", t) for i, t in enumerate([*SHAPES.values(), "broken"])]
    pd.DataFrame([*rows, rows[0], ("l", "lineups/1", "[]")], columns=["resource_id", "resource_key", "raw"]).to_parquet(tmp_path / "provider_payload.parquet")
    got = {tuple(r) for r in ingest.payload_event_types(spark, str(tmp_path)).collect()}
    assert got == {("Pass", "valid", None, 5, 5), ("Shot", "missing", None, 5, 5), (None, None, "malformed", 0, 1)}

import json

from touchline.operators import shredding
from touchline.plans.problems import PAYLOAD_ENTITIES

TEAM = {"team_id": 1, "lineup": [{"player_id": "7", "positions": {"position_id": 3}, "cards": []}, {"player_id": None, "positions": [{"position_id": 1.0}, {"position_id": None}], "cards": [{"card_type": "Yellow"}]}]}
EVENT = {"id": "e1", "index": 1, "type": {"id": 9}, "player": {"id": 4}, "related_events": ["e2", None], "shot": {"freeze_frame": [{"player": {"id": 5}}, {"player": {}}]}}
WANT_TEAM = {("team", "", 0, "1"), ("player", "1", 0, "7"), ("player", "1", 1, ""), ("position", "7", 0, "3"), ("position", "", 0, "1"), ("position", "", 1, ""), ("card", "", 0, "Yellow")}
WANT_EVENT = {("event", "", 0, "e1"), ("related", "e1", 0, "e2"), ("related", "e1", 1, ""), ("frame_player", "e1", 0, "5"), ("frame_player", "e1", 1, "")}


def rows(spark, *texts):
    df = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "id string, raw string, level string")
    got = {}
    for r in shredding.entity_rows(df, "id", "raw", PAYLOAD_ENTITIES).collect():
        got.setdefault(r.id, set()).add(tuple(r)[1:])
    return got


def test_shapes(spark):
    away = {("team", "", 1, "2"), ("player", "2", 0, "9")}
    second = {"team_id": 2, "lineup": [{"player_id": 9, "positions": None}]}
    shapes = [json.dumps(x) for x in ([TEAM, second], {"home": TEAM, "away": second}, {"data": {"lineups": [TEAM, second]}}, {"get": "x", "response": [TEAM, second]})]
    assert all(v == WANT_TEAM | away for v in rows(spark, *shapes).values())
    shapes = [json.dumps([EVENT]), json.dumps({"meta": {}, "events": [EVENT]}), json.dumps({"match_id": 3, "periods": [{"period": 1, "events": [EVENT]}]}), json.dumps(EVENT)]
    got = rows(spark, *shapes)
    assert len(got) == 4 and all(v == WANT_EVENT for v in got.values())
    lines = json.dumps(EVENT) + "\n" + json.dumps({"id": "e9", "type": {}})
    assert rows(spark, lines)["0"] == WANT_EVENT | {("event", "", 1, "e9")}


def test_broken_and_empty(spark):
    assert rows(spark, None, "", "  ", "{}", "[]", "null", "<html>", '[{"id": "e1"', '{{"id": 1}', json.dumps(EVENT) + "\n{", "7", '"x"', "[" * 100_000) == {}
    df = spark.createDataFrame([], "id string, raw string")
    assert shredding.entity_rows(df, "id", "raw", PAYLOAD_ENTITIES).collect() == []


def test_adjacency_round_trip(spark):
    df = spark.createDataFrame([("k", json.dumps(EVENT))], "id string, raw string")
    nodes = {r.node: r for r in shredding.adjacency_table(df, "id", "raw").collect()}

    def build(n):
        kids = sorted((r for r in nodes.values() if r.parent == n), key=lambda r: r.ordinal)
        if nodes[n].kind == "object":
            return {r.label: build(r.node) for r in kids}
        if nodes[n].kind == "array":
            return [build(r.node) for r in kids]
        return nodes[n].scalar

    def text(x):
        return {k: text(v) for k, v in x.items()} if isinstance(x, dict) else [text(v) for v in x] if isinstance(x, list) else shredding.as_text(x)

    assert build(0) == text(EVENT)

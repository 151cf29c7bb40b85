"""Standings of every league, group and type, and sides chosen by name."""

import json

from touchline.sources import feeds


def found(spark, feed, *docs, columns):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, raw string")
    return [tuple(r[c] for c in columns) for r in feeds.observations(df, "id", "raw", feeds.REGISTRY[feed]).orderBy("id", *[c for c in ("entry", "group") if c in columns], "place").collect()]


def test_envelope(spark):
    row = lambda i: {"rank": i, "team": {"id": i, "name": f"T{i}"}, "points": 3, "all": {"played": 1}}
    two = {"response": [{"league": {"id": 1, "season": 2020, "standings": [[row(1), row(2)]]}}, {"league": {"id": 2, "season": 2020, "standings": [[row(3)]]}}]}
    groups = {"response": [{"league": {"id": 3, "standings": [[row(4)], [row(5)]]}}, {"league": {"id": 4}}, {"league": {"id": 5, "standings": []}}]}
    got = found(spark, ("envelope_api", "standings"), two, groups, "x", {}, {"response": []}, columns=("id", "league", "entry", "group", "place", "native_id", "finding"))
    assert got == [
        (0, "1", 0, 0, 0, "1", None), (0, "1", 0, 0, 1, "2", None), (0, "2", 1, 0, 0, "3", None),
        (1, "3", 0, 0, 0, "4", "unsupported_scope"), (1, "3", 0, 1, 0, "5", "unsupported_scope"), (1, "4", 1, None, None, None, "unsupported_scope"), (1, "5", 2, None, None, None, "unsupported_scope"),
        (2, None, None, None, None, None, "malformed"), (3, None, None, None, None, None, "no_records"),
    ]


def test_types(spark):
    row = lambda i: {"position": i, "team": {"id": i, "name": "T"}, "points": 3, "playedGames": 1}
    doc = {"standings": [{"type": "HOME", "table": [row(1)]}, {"type": "TOTAL", "group": "A", "table": [row(2)]}, {"type": "TOTAL", "group": "B", "table": [row(3), {"team": {"id": 4}}]}, {"type": "AWAY"}, {"type": "TOTAL"}]}
    got = found(spark, ("match_api", "standings"), doc, columns=("entry", "type", "group_name", "place", "native_id", "finding"))
    assert got == [(0, "HOME", None, 0, "1", "unsupported_scope"), (1, "TOTAL", "A", 0, "2", None), (2, "TOTAL", "B", 0, "3", None), (2, "TOTAL", "B", 1, "4", "missing_rank"), (3, "AWAY", None, None, None, "unsupported_scope"), (4, "TOTAL", None, None, None, "no_records")]


def test_sides(spark):
    side = lambda where, name: {"homeAway": where, "team": {"displayName": name}}
    event = lambda i, *c: {"id": i, "competitions": [{"competitors": list(c)}]}
    doc = {"events": [event(1, side("away", "B"), side("home", "A")), event(2, side("home", "A"), side("away", "B")), event(3, side("home", "A"), side("home", "B"))]}
    got = found(spark, ("scoreboard_api", "scoreboard"), doc, columns=("native_id", "home_name", "away_name", "finding"))
    assert got == [("1", "A", "B", None), ("2", "A", "B", None), ("3", None, None, "missing_home_name")]

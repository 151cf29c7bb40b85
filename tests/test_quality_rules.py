"""Each quality rule finds its case and nothing in sound rows."""

import json

from pyspark.sql import functions as F

from touchline.operators import quality
from touchline.plans import ingest
from touchline.sources import files

EVENT = "stage_id long, provider_event_id string, staged_at long, provider_match_id string, event_index int, period int, provider_event_type string, event_clock string"


def test_sequence(spark):
    rows = [
        (1, "a", 1, "m", 1, 1, "Pass", "00:00:01.5"), (2, "b", 1, "m", 2, 1, "Ball Receipt*", "00:00:01.4"), (3, "c", 1, "m", 2, 2, "Shot", "00:00:00"),
        (4, "d", 1, "m", 3, 1, "Juggle", "00:00:09"), (5, "a", 2, "m", 1, 1, "Pass", "00:00:01.0"), (6, "e", 1, None, 2, 1, "Pass", "00:00:00"), (7, None, 1, "n", 2, 1, None, "x"),
    ]
    found = {(r.stage_id, r.rule) for r in quality.sequence_rules(spark.createDataFrame(rows, EVENT)).collect()}
    # the second delivery of a is the one that counts, so b's clock does not go back
    assert found == {(2, "duplicate_index"), (3, "duplicate_index"), (4, "unknown_type"), (4, "unordered_index"), (7, "unknown_type")}
    found = {(r.stage_id, r.rule) for r in quality.sequence_rules(spark.createDataFrame(rows[:2], EVENT)).collect()}
    assert found == {(2, "backward_clock")}


def test_payloads(spark):
    good = {"id": "a", "index": 1, "period": 1, "timestamp": "00:01:02.5", "minute": 1, "second": 2, "type": {"id": 30, "name": "Pass"}, "location": [1, 2]}
    events = [good, good | {"id": "b", "index": 2, "location": [200, 2]}, good | {"id": "c", "index": 2, "location": [1]}, good | {"id": "c", "index": 3, "second": 9}, good | {"id": "d", "index": 4, "type": {"id": 9, "name": "Juggle"}}]
    docs = spark.createDataFrame([("r", json.dumps({"events": events})), ("s", json.dumps([good])), ("t", "broken"), ("t2", "broken")], "resource_id string, raw string")
    found = {(r.key, r.rule) for r in quality.payload_rules(files.event_report(docs, "resource_id", "raw")).collect()}
    assert found == {
        ("r#b", "location_out_of_bounds"), ("r#b", "duplicate_index"), ("r#c", "duplicate_index"), ("r#c", "invalid_coordinates"), ("r#c", "duplicate_event"), ("r#c", "impossible_timestamp"), ("r#d", "unknown_type"),
        ("t", "malformed_payload"), ("t2", "malformed_payload"),
    }


def test_stints(spark):
    rows = [(1, "10:00", "10:00.5", 1, 1), (2, "10:00", "10:00", 1, 1), (3, "50:00", "46:00", 1, 2), (4, "46:00", "47:00", 2, 1), (5, "46:00", None, 2, 1), (6, "9:00", "8:00", None, 1)]
    df = spark.createDataFrame(rows, "lineup_id long, from_clock string, to_clock string, from_period int, to_period int")
    assert {r.lineup_id for r in quality.stint_rules(df).collect()} == {2, 4}


def test_lineups(spark):
    lineups = spark.createDataFrame([("m", "h", "p"), ("M ", "a", "q"), ("m", "a", "p"), ("n", "h", "p"), ("n", "z", "q")], "match_id string, team_id string, player_id string")
    fixtures = spark.createDataFrame([(1, "m", "x", "a", 1, None), (2, "m", "h", "a", 2, 1), (3, "n", "h", "a", 1, 1)], "revision_id long, fixture_id string, home_team_id string, away_team_id string, updated_at long, known_at long")
    events = spark.createDataFrame([(1, "m", "h", "p"), (2, "m", "h", "q"), (3, "m", None, "p"), (4, "m", "h", None), (5, "k", "h", "p"), (6, None, "h", "p")], "stage_id long, match_id string, team_id string, player_id string")
    found = {(r.scope, r.key, r.rule) for r in quality.lineup_rules(events, lineups, fixtures).collect()}
    assert found == {("match", "n", "lineup_teams"), ("match", "m#70", "player_for_both_teams"), ("event", "2", "player_outside_lineup"), ("event", "3", "player_outside_lineup"), ("match", "k", "missing_lineup")}


def test_conflicts(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x ", None), ("b", "x", 1), ("b", "x", 2), ("c", None, 1)], "k string, name string, n int")
    assert [tuple(r) for r in quality.conflicts(df, F.col("k"), ["name", "n"], "r", "WARNING").collect()] == [("b", "r", "WARNING")]


def test_quality_findings(spark, sf):
    found = ingest.quality_findings(spark, sf)
    assert found.columns == ["scope", "key", "rule", "severity"] and found.count() == found.distinct().count()
    assert {r.scope for r in found.select("scope").distinct().collect()} >= {"event", "payload", "lineup"}

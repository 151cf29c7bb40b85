"""Data-quality rules over staged events, event payloads, lineups, matches and players as one findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.clocks import clock_seconds
from touchline.functions.keys import uuid_key, uuid_text
from touchline.operators import temporal

# What a finding of each rule means for its rows, worst first.
SEVERITIES = ("FATAL", "QUARANTINE", "WARNING", "INFO")
# The event types of the public event format, in lower case and without its asterisk.
EVENT_TYPES = (
    "50/50", "bad behaviour", "ball receipt", "ball recovery", "block", "camera on", "camera off", "carry", "clearance", "dispossessed", "dribble", "dribbled past", "duel", "error", "foul committed", "foul won",
    "goal keeper", "half end", "half start", "injury stoppage", "interception", "miscontrol", "offside", "own goal against", "own goal for", "pass", "player off", "player on", "pressure", "referee ball-drop",
    "shield", "shot", "starting xi", "substitution", "tactical shift",
)
_CLOCK = r"^([0-9]{2}):([0-5][0-9]):([0-5][0-9](?:\.[0-9]+)?)$"


def findings(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """key, rule, severity: a row per violated rule, all rules evaluated in one pass over the rows."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (severity, bad) in rules.items()]))
    return df.select(key, F.inline(hits))


def event_rules(events: DataFrame) -> DataFrame:
    """stage_id, rule, severity of staged events: repeated delivery, missing player or team, impossible clock, period and index."""
    clock = F.regexp_extract("event_clock", r"^([0-9]{2}):([0-5][0-9]):([0-5][0-9])", 0)
    # one sort serves both rules that look at a neighbour: it is by event, not by resource, so no key is hot
    w = Window.partitionBy("provider_event_id").orderBy("staged_at", "stage_id")
    df = events.withColumn("delivery", F.row_number().over(w))
    rules = {
        "repeated_delivery": ("WARNING", F.col("provider_event_id").isNotNull() & (F.col("delivery") > 1)),
        "missing_player": ("INFO", F.coalesce(F.trim("player_id"), F.lit("")) == ""),
        "missing_team": ("WARNING", F.coalesce(F.trim("team_id"), F.lit("")) == ""),
        "impossible_clock": ("QUARANTINE", F.coalesce(clock, F.lit("")) == ""),
        "impossible_period": ("FATAL", F.col("period").isNull() | ~F.col("period").between(1, 5)),
        "impossible_index": ("QUARANTINE", F.col("event_index").isNull() | (F.col("event_index") < 1)),
    }
    return findings(df, "stage_id", rules)


def unknown_type(name: Column) -> Column:
    """Whether an event type is missing or not one of the public format."""
    return ~F.coalesce(F.regexp_replace(F.lower(F.trim(name)), r"\*$", "").isin(*EVENT_TYPES), F.lit(False))


def _event_clock(text: Column) -> Column:
    """Seconds of hh:mm:ss with a fraction, to the microsecond; null for other text."""
    part = lambda i: F.regexp_extract(text, _CLOCK, i)
    return F.when(text.rlike(_CLOCK), part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("decimal(12,6)"))


def _stint_clock(text: Column) -> Column:
    fraction = F.coalesce(F.nullif(F.regexp_extract(F.trim(text), r"[.,]([0-9]+)$", 1), F.lit("")), F.lit("0"))
    return clock_seconds(text) + F.concat(F.lit("0."), fraction).cast("decimal(12,6)")


def sequence_rules(events: DataFrame) -> DataFrame:
    """stage_id, rule, severity of the latest delivery of each staged event: unknown type, index held by more than one event of a match, and, in the order of
    the indexes, a period before an earlier event's (``unordered_index``) or a clock before that of the event before it in its period (``backward_clock``).

    Events without match or index have no place in an order and are not compared.
    """
    event = F.coalesce("provider_event_id", F.concat(F.lit("stage "), F.col("stage_id").cast("string")))
    df = events.select("stage_id", "staged_at", event.alias("event"), "provider_match_id", "event_index", "period", "provider_event_type", "event_clock")
    df = temporal.latest_per_key(df, ["event"], ["staged_at", "stage_id"])
    # what can't be ordered is a series of its own, so that it meets no other event and no task gathers it
    df = df.withColumn("series", F.when(F.col("provider_match_id").isNull() | F.col("event_index").isNull(), F.concat(F.lit("event "), "event")).otherwise(F.col("provider_match_id").cast("string")))
    df = df.withColumn("clock", _event_clock(F.col("event_clock")))
    known = F.when(F.col("period").between(1, 5), F.col("period"))
    before = Window.partitionBy("series").orderBy("event_index", "stage_id").rowsBetween(Window.unboundedPreceding, -1)
    # partitioned by series alone, all three share one shuffle and a series is one match
    df = df.withColumns({"top": F.max(known).over(before), "same": F.count("*").over(Window.partitionBy("series", "event_index")), "last": F.last("clock", True).over(Window.partitionBy("series", "period").orderBy("event_index", "stage_id").rowsBetween(Window.unboundedPreceding, -1))})
    rules = {
        "unknown_type": ("WARNING", unknown_type(F.col("provider_event_type"))),
        "duplicate_index": ("QUARANTINE", F.col("same") > 1),
        "unordered_index": ("WARNING", known < F.col("top")),
        "backward_clock": ("WARNING", F.col("period").isNotNull() & (F.col("clock") < F.col("last"))),
    }
    return findings(df, "stage_id", rules)


def payload_rules(report: DataFrame) -> DataFrame:
    """key (resource and event), rule, severity of ``files.event_report``: unreadable payloads, coordinates, times, unknown types, ids and indexes that a payload holds twice."""
    key = F.concat_ws("#", "resource_id", "event_id")
    sound = F.col("finding").isNull()
    x, y = F.col("source_x"), F.col("source_y")
    clock = _event_clock(F.col("timestamp"))
    time = clock.isNotNull() & F.col("period").between(1, 5) & (F.col("minute") >= 0) & F.col("second").between(0, 59) & (F.floor(clock % 60) == F.col("second"))
    # unreadable rows have neither id nor index: they are a series each, not one
    own = F.when(~sound, F.monotonically_increasing_id())
    same = lambda c: F.count(c).over(Window.partitionBy("resource_id", "own", c))
    df = report.withColumns({"key": key, "own": own}).withColumns({"ids": same("event_id"), "indexes": same("index")})
    rules = {
        "malformed_payload": ("QUARANTINE", ~sound),
        "location_out_of_bounds": ("WARNING", F.col("location_quality") == "out_of_bounds"),
        "invalid_coordinates": ("QUARANTINE", x.isNull() != y.isNull()),
        "impossible_timestamp": ("WARNING", sound & ~F.coalesce(time, F.lit(False))),
        "unknown_type": ("WARNING", sound & unknown_type(F.col("event_type"))),
        "duplicate_event": ("QUARANTINE", F.col("ids") > 1),
        "duplicate_index": ("QUARANTINE", F.col("indexes") > 1),
    }
    return findings(df, "key", rules)


def stint_rules(lineups: DataFrame) -> DataFrame:
    """lineup_id, rule, severity: stints that do not end after their start. An open end or a start without period cannot be compared."""
    start, end = _stint_clock(F.col("from_clock")), _stint_clock(F.col("to_clock"))
    earlier = (F.col("to_period") < F.col("from_period")) | ((F.col("to_period") == F.col("from_period")) & (end <= start))
    return findings(lineups, "lineup_id", {"nonmonotonic_stint": ("WARNING", end.isNotNull() & earlier)})


def lineup_rules(events: DataFrame, lineups: DataFrame, fixtures: DataFrame) -> DataFrame:
    """scope, key, rule, severity where lineups, fixtures and staged events contradict each other.

    ``lineup_teams``: a match whose lineups are not of its two participants by the latest revision of its fixture; ``player_for_both_teams``; ``player_outside_lineup``:
    an event whose player is in no lineup of the event's team in that match; ``missing_lineup``: a match with events and without any lineup. Keys are compared in any spelling.
    """
    ids = [uuid_text(F.col("match_id")).alias("match"), *[uuid_key(F.col(c)).alias(c) for c in ("match_id", "team_id", "player_id")]]
    names = lineups.select(*ids).where("match_id is not null").distinct()
    order = F.struct(F.col("updated_at").isNotNull(), "updated_at", F.coalesce("known_at", "updated_at"), "revision_id")
    latest = fixtures.withColumn("match_id", uuid_key(F.col("fixture_id"))).groupBy("match_id").agg(F.max_by(F.array(uuid_key(F.col("home_team_id")), uuid_key(F.col("away_team_id"))), order).alias("sides"))
    found = lambda df, scope, key, rule: df.select(F.lit(scope).alias("scope"), key.alias("key"), F.lit(rule).alias("rule"), F.lit("QUARANTINE").alias("severity"))
    teams = names.groupBy("match_id").agg(F.collect_set("team_id").alias("teams"), F.min("match").alias("match")).join(latest, "match_id")
    wrong = teams.where(F.sort_array("teams") != F.sort_array(F.array_distinct("sides")))
    both = names.where("player_id is not null").groupBy("match_id", "player_id").agg(F.min("match").alias("match"), F.min("team_id").alias("lo"), F.max("team_id").alias("hi")).where("lo <> hi")
    e = events.select("stage_id", *ids).where("match_id is not null")
    held = names.select("match_id").distinct()
    outside = e.where("player_id is not null").join(names.select("match_id", "team_id", "player_id").distinct(), ["match_id", "team_id", "player_id"], "left_anti").join(held, "match_id", "left_semi")
    bare = e.groupBy("match_id").agg(F.min("match").alias("match")).join(held, "match_id", "left_anti")
    parts = (
        found(wrong, "match", F.col("match"), "lineup_teams"), found(both, "match", F.concat_ws("#", "match", F.lower(F.hex("player_id"))), "player_for_both_teams"),
        found(outside, "event", F.col("stage_id").cast("string"), "player_outside_lineup"), found(bare, "match", F.col("match"), "missing_lineup"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def conflicts(df: DataFrame, key: Column, facts: list[str], rule: str, severity: str) -> DataFrame:
    """key, rule, severity: keys whose rows hold more than one value of a fact; nulls are no values."""
    k = df.select(key.alias("key"), *[F.trim(F.col(c).cast("string")).alias(c) for c in facts]).where("key is not null")
    k = k.groupBy("key").agg(*[(F.min(c) != F.max(c)).alias(c) for c in facts])
    differs = F.lit(False)
    for c in facts:
        differs = differs | F.coalesce(F.col(c), F.lit(False))
    return findings(k, "key", {rule: (severity, differs)})


def roll_up(found: DataFrame, group: list[str]) -> DataFrame:
    """group, worst, findings: the worst severity of each group."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return found.groupBy(*group).agg(F.min_by("severity", rank).alias("worst"), F.count("*").alias("findings"))

"""Provider documents to typed observations by specification.

A feed names the array of records inside a provider's document and the path and type of each observed field. All feeds run through one reader over
parsed documents (variants), so a new provider is a table entry; what cannot be read as its type becomes a finding, never a guess.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A level of arrays above the records: ``name`` of the column of its position, ``path`` of the array below the level before, ``fields`` of an entry.

    An entry is supported if its array has one entry alone (``single``), and where its field ``only[0]`` is ``only[1]``.
    """

    name: str
    path: str
    fields: dict[str, tuple[str, str]]
    single: bool = False
    only: tuple[str, str] | None = None


@dataclass(frozen=True)
class Feed:
    """``records``: path of the array in the document, or below the last of ``scopes``; ``fields``: observed name -> (path in a record, type); ``required``: fields without which a record is a finding.

    A path may choose the one item of an array by a member: ``$.list[?member=value].rest``; it gives null where there is none or more than one.
    """

    provider: str
    resource: str
    records: str
    fields: dict[str, tuple[str, str]]
    required: tuple[str, ...]
    scopes: tuple[Scope, ...] = ()


def _team(prefix: str, home: str, away: str, kind: str = "string") -> dict[str, tuple[str, str]]:
    return {f"home_{prefix}": (home, kind), f"away_{prefix}": (away, kind)}


_FIXTURE = ("native_id", "home_name", "away_name")
# Where the public document formats keep their fields.
FEEDS = (
    Feed("open_events", "matches", "$", {"native_id": ("$.match_id", "string"), "date": ("$.match_date", "string"), "clock": ("$.kick_off", "string")} | _team("name", "$.home_team.home_team_name", "$.away_team.away_team_name") | _team("goals", "$.home_score", "$.away_score", "int"), _FIXTURE),
    Feed("open_events", "competitions", "$", {"native_id": ("$.competition_id", "string"), "season_id": ("$.season_id", "string"), "name": ("$.competition_name", "string"), "country": ("$.country_name", "string")}, ("native_id", "name")),
    Feed("envelope_api", "fixtures", "$.response", {"native_id": ("$.fixture.id", "string"), "kickoff": ("$.fixture.date", "string"), "status": ("$.fixture.status.short", "string"), "league": ("$.league.id", "string")} | _team("name", "$.teams.home.name", "$.teams.away.name") | _team("goals", "$.goals.home", "$.goals.away", "int"), _FIXTURE),
    Feed("envelope_api", "standings", "$", {"native_id": ("$.team.id", "string"), "name": ("$.team.name", "string"), "rank": ("$.rank", "int"), "points": ("$.points", "int"), "played": ("$.all.played", "int")}, ("native_id", "rank"), (Scope("entry", "$.response", {"league": ("$.league.id", "string"), "season": ("$.league.season", "string")}), Scope("group", "$.league.standings", {}, single=True))),
    Feed("envelope_api", "injuries", "$.response", {"native_id": ("$.player.id", "string"), "player": ("$.player.name", "string"), "reason": ("$.player.reason", "string"), "team_id": ("$.team.id", "string"), "fixture_id": ("$.fixture.id", "string")}, ("native_id", "fixture_id")),
    Feed("match_api", "matches", "$.matches", {"native_id": ("$.id", "string"), "kickoff": ("$.utcDate", "string"), "status": ("$.status", "string"), "matchday": ("$.matchday", "int")} | _team("name", "$.homeTeam.name", "$.awayTeam.name") | _team("goals", "$.score.fullTime.home", "$.score.fullTime.away", "int"), _FIXTURE),
    Feed("match_api", "standings", "$.table", {"native_id": ("$.team.id", "string"), "name": ("$.team.name", "string"), "rank": ("$.position", "int"), "points": ("$.points", "int"), "played": ("$.playedGames", "int")}, ("native_id", "rank"), (Scope("entry", "$.standings", {"type": ("$.type", "string"), "stage": ("$.stage", "string"), "group_name": ("$.group", "string")}, only=("type", "TOTAL")),)),
    Feed("scoreboard_api", "scoreboard", "$.events", {"native_id": ("$.id", "string"), "kickoff": ("$.date", "string"), "status": ("$.status.type.name", "string")} | _team("name", "$.competitions[0].competitors[?homeAway=home].team.displayName", "$.competitions[0].competitors[?homeAway=away].team.displayName"), _FIXTURE),
    Feed("score_app", "fixtures", "$.matches", {"native_id": ("$.id", "string"), "kickoff": ("$.status.utcTime", "string"), "finished": ("$.status.finished", "boolean")} | _team("name", "$.home.name", "$.away.name") | _team("goals", "$.home.score", "$.away.score", "int"), _FIXTURE),
    Feed("shot_site", "shots", "$", {"native_id": ("$.id", "string"), "player": ("$.player", "string"), "x": ("$.X", "double"), "y": ("$.Y", "double"), "xg": ("$.xG", "double"), "result": ("$.result", "string"), "minute": ("$.minute", "int")}, ("native_id", "xg")),
    Feed("rounds_file", "matches", "$.matches", {"date": ("$.date", "string"), "clock": ("$.time", "string"), "round": ("$.round", "string")} | _team("name", "$.team1", "$.team2") | _team("goals", "$.score.ft[0]", "$.score.ft[1]", "int"), ("date", "home_name", "away_name")),
    Feed("rating_service", "ratings", "$", {"native_id": ("$.Club", "string"), "rating": ("$.Elo", "double"), "valid_from": ("$.From", "string"), "valid_to": ("$.To", "string")}, ("native_id", "rating")),
)
REGISTRY = {(f.provider, f.resource): f for f in FEEDS}


def _get(v: Column, path: str, kind: str) -> Column:
    choice = re.fullmatch(r"(.*?)\[\?(\w+)=(\w+)\](.*)", path)
    if choice is None:
        return F.try_variant_get(v, path, kind)
    array, member, value, rest = choice.groups()
    items = F.filter(F.try_variant_get(v, array, "array<variant>"), lambda x: F.try_variant_get(x, f"$.{member}", "string") == value)
    return F.when(F.size(items) == 1, F.try_variant_get(F.get(items, F.lit(0)), f"${rest}", kind))


def observations(docs: DataFrame, key: str, raw: str, feed: Feed) -> DataFrame:
    """key, the positions and fields of the feed's scopes, place, the feed's fields, finding: one row per record of each document, in document order (positions from 0).

    finding names the first required field that is missing or not of its type; ``malformed`` (one row, null place) for a text that is no JSON
    value, ``no_records`` for one without the array, or for an entry without it; ``unsupported_scope`` for each record of an entry whose scope is not supported (one row
    with null place if it has none). Null texts are malformed. Strings are never read as truth values, nor truth values as numbers.
    """
    parsed = docs.select(F.col(key), F.try_parse_json(F.col(raw)).alias("__node"))
    at = parsed.select(key, "__node", F.when(F.col("__node").isNull(), "malformed").alias("finding"))
    kept = [key]
    for s in feed.scopes:
        at = at.select(*kept, "finding", F.try_variant_get("__node", s.path, "array<variant>").alias("__items"))
        n = F.when(F.col("__items").isNull(), "unsupported_scope" if s.single else "no_records")
        if s.single:
            n = n.when(F.size("__items") != 1, "unsupported_scope")
        at = at.withColumn("finding", F.coalesce("finding", n)).select(*kept, "finding", F.posexplode_outer("__items").alias(s.name, "__node"))
        at = at.where(F.col("finding").isNotNull() | F.col(s.name).isNotNull()).select("*", *[_get(F.col("__node"), path, kind).alias(name) for name, (path, kind) in s.fields.items()])
        kept += [s.name, *s.fields]
        if s.only:
            at = at.withColumn("finding", F.coalesce("finding", F.when(~F.col(s.only[0]).eqNullSafe(F.lit(s.only[1])), "unsupported_scope")))
    at = at.select(*kept, "finding", F.try_variant_get("__node", feed.records, "array<variant>").alias("__items"))
    at = at.withColumn("finding", F.coalesce("finding", F.when(F.col("__items").isNull(), "no_records")))
    rows = at.select(*kept, F.col("finding").alias("__finding"), F.posexplode_outer("__items").alias("place", "__record"))
    typed = rows.select(*kept, "place", *[_get(F.col("__record"), path, kind).alias(name) for name, (path, kind) in feed.fields.items()], "__finding")
    finding = F.when(F.col("__finding").isNotNull(), F.col("__finding"))
    for name in feed.required:
        finding = finding.when(F.col(name).isNull() & F.col("place").isNotNull(), f"missing_{name}")
    return typed.where(F.col("__finding").isNotNull() | F.col("place").isNotNull()).select(*kept, "place", *feed.fields, finding.alias("finding"))

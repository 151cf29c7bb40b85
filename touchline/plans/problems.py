"""The data-processing queries p1, p2, p3, p5 and p7 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.clocks import with_clock_seconds
from touchline.functions.keys import bare_uuid, hyphenated, uuid_key
from touchline.operators import asof, intervals, orphans, shredding, timestamps
from touchline.operators.shredding import Entity
from touchline.session import table

#: The match clock at which each period starts.
PERIOD_STARTS = (0, 2700, 5400, 6300)

#: The entity tables of the lineups and events payloads.
PAYLOAD_ENTITIES = (
    Entity("team", ("team_id",), need=("team_id", "lineup")),
    Entity("player", ("player_id",), ("lineup",), "team"),
    Entity("position", ("position_id",), ("positions",), "player"),
    Entity("card", ("card_type",), ("cards",), "player"),
    Entity("event", ("id",), ("", "events"), need=("id", "index", "type")),
    Entity("related", (), ("related_events",), "event", scalar=True),
    Entity("frame_player", ("player", "id"), ("freeze_frame",), "event", ("shot",)),
)

#: Fixed value: the country whose slashed dates are month first, and the prefix of its divisions.
MONTH_FIRST_COUNTRY, MONTH_FIRST_DIVISION = "Columbra", "US"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, row_key, normalised of every written time of the open matches, the results CSV and the payloads."""
    competitions = table(spark, sf_dir, "competitions").select("competition_id", "zone_name", "country_name").dropDuplicates(["competition_id"])
    matches = table(spark, sf_dir, "open_matches").select("match_id", "match_date", "kick_off", "time_zone", "competition_id").join(competitions, "competition_id", "left")
    matches = timestamps.normalise_instants(matches, "kick_off", "normalised", [F.col("time_zone"), F.col("zone_name")], "match_date", F.col("country_name") == MONTH_FIRST_COUNTRY)
    results = table(spark, sf_dir, "f3_ambiguous_identity_v1").select("row_no", "date_text", "div_code")
    results = timestamps.normalise_days(results, "date_text", "normalised", F.upper(F.trim("div_code")).startswith(MONTH_FIRST_DIVISION))
    payloads = table(spark, sf_dir, "provider_payload").select("resource_id", "acquired_at", "clock_zone")
    payloads = timestamps.normalise_instants(payloads, "acquired_at", "normalised", [F.col("clock_zone")])

    def tagged(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("row_key"), "normalised")

    return (
        tagged(matches, "open_matches", "match_id")
        .unionByName(tagged(results, "f3_ambiguous_identity_v1", "row_no"))
        .unionByName(tagged(payloads, "provider_payload", "resource_id"))
        .distinct()
    )


def _references(spark: SparkSession, sf_dir: str) -> list[orphans.Reference]:
    def registry(name: str, key: str):
        return table(spark, sf_dir, name).select(key, "registered_at", "removed_at")

    return [
        orphans.Reference("match_id", registry("open_matches", "match_id"), "match_id"),
        orphans.Reference("team_id", registry("product_teams", "team_id"), "team_id"),
        orphans.Reference("player_id", registry("product_players", "player_id"), "player_id"),
        orphans.Reference("source_resource_id", registry("provider_payload", "resource_id"), "resource_id"),
    ]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "football_event_stage").select("stage_id", "match_id", "team_id", "player_id", "source_resource_id", "staged_at")
    return orphans.orphan_references(events, "stage_id", "staged_at", _references(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stage_id, field, kind of every reference of a staged event whose key is not live when it was staged."""
    return _orphans(spark, sf_dir).select(F.col("row_id").alias("stage_id"), "field", "kind")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, kind, period, orphans: the same references counted per registry, kind and month."""
    return orphans.orphan_counts(_orphans(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """forecast_id, revision_id: the fixture revision valid and known at each forecast's moment."""
    forecasts = table(spark, sf_dir, "frozen_forecast").select("forecast_id", "match_id", "kickoff_at", "training_cutoff").withColumn("key", uuid_key(F.col("match_id")))
    moment = F.unix_micros(F.least("kickoff_at", "training_cutoff"))
    revisions = table(spark, sf_dir, "product_fixtures").select("revision_id", "fixture_id", "updated_at", "known_at").withColumn("key", uuid_key(F.col("fixture_id")))
    updated = F.unix_micros("updated_at")
    known = F.coalesce(F.unix_micros("known_at"), updated)
    visible = F.when(updated.isNotNull(), F.greatest(updated, known))
    found = asof.as_known(forecasts, "forecast_id", moment, revisions, {"key": "key"}, visible, [updated, known, F.col("revision_id")])
    return found.select(F.col("event_id").alias("forecast_id"), F.col("rank")["r2"].alias("revision_id"))


def stint_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, player_id, start, end: each stint on the played seconds of its match (start not before end where it covers nothing)."""
    ends = (
        table(spark, sf_dir, "open_matches")
        .where("size(period_end_seconds) > 0")
        .groupBy(bare_uuid(F.col("match_id")).alias("match"))
        .agg(F.max("period_end_seconds").alias("ends"))
    )
    starts = F.array(*[F.lit(s) for s in PERIOD_STARTS])
    # of each period its start and end on the clock, and the played seconds before it
    lengths = F.transform(F.slice(F.col("ends"), 1, len(PERIOD_STARTS)), lambda e, i: F.greatest(e - F.get(starts, i), F.lit(0)))
    periods = F.transform(lengths, lambda n, i: F.struct(F.get(starts, i).alias("a"), (F.get(starts, i) + n).alias("b"), F.aggregate(F.slice(F.col("lengths"), 1, i), F.lit(0), lambda x, y: x + y).alias("before")))
    ends = ends.withColumn("lengths", lengths).withColumn("periods", periods).withColumn("total", F.aggregate("lengths", F.lit(0), lambda x, y: x + y)).select("match", "periods", "total")
    stints = table(spark, sf_dir, "lineups").select("match_id", "player_id", "from_clock", "to_clock", "from_period", "to_period")
    stints = with_clock_seconds(stints, {"f": "from_clock", "t": "to_clock"}, "match_id", "player_id", "from_period", "to_period", F.col("to_clock").isNull().alias("open"))
    # sealed by a generator: the join would else push a filter on the key below its making, and make it several times
    keys = F.struct(bare_uuid(F.col("match_id")).alias("match"), bare_uuid(F.col("player_id")).alias("player"))
    joined = stints.select("f", "t", "from_period", "to_period", "open", F.inline(F.array(keys))).join(ends, "match")

    def only(clock: str):
        """The one period that holds the clock; null where none or more than one does."""
        # at most four periods: counted and numbered one by one
        at, none = F.col(clock), F.lit(0)
        inside = [F.coalesce((F.get("periods", F.lit(i))["a"] <= at) & (at < F.get("periods", F.lit(i))["b"]), F.lit(False)) for i in range(len(PERIOD_STARTS))]
        end = [F.coalesce(at == F.get("periods", F.lit(i))["b"], F.lit(False)) for i in range(len(PERIOD_STARTS))]
        count = lambda flags: sum((f.cast("int") for f in flags), none)
        number = lambda flags: sum((f.cast("int") * (i + 1) for i, f in enumerate(flags)), none)
        return F.when(count(inside) == 1, number(inside)).when((count(inside) == 0) & (count(end) == 1), number(end))

    def played(period, clock: str):
        p = F.get("periods", period - 1)
        return F.when(period > F.size("periods"), F.col("total")).otherwise(p["before"] + F.least(F.greatest(F.col(clock), p["a"]), p["b"]) - p["a"])

    joined = joined.withColumns({"fp": F.coalesce("from_period", only("f")), "tp": F.coalesce("to_period", only("t"))})
    last = F.get("periods", F.col("to_period") - 1)
    end = F.when(F.col("open"), F.coalesce(last["before"] + last["b"] - last["a"], F.col("total"))).otherwise(played(F.col("tp"), "t"))
    return joined.select(hyphenated(F.col("match")).alias("match_id"), hyphenated(F.col("player")).alias("player_id"), played(F.col("fp"), "f").alias("start"), end.alias("end"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, player_id, kind, start_second, end_second: each player's continuous periods on the field and the gaps between them."""
    merged = intervals.periods_and_gaps(stint_seconds(spark, sf_dir), ["match_id", "player_id"])
    return merged.select("match_id", "player_id", "kind", F.col("start").cast("int").alias("start_second"), F.col("end").cast("int").alias("end_second"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resource_id, level, parent_key, ordinal, item_key: the flat related rows of the raw lineups and events payloads."""
    payloads = table(spark, sf_dir, "provider_payload").select("resource_id", "raw")
    return shredding.entity_rows(payloads, "resource_id", "raw", PAYLOAD_ENTITIES).distinct()


def queries():
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p3_found, p5_found, p7_found)}

"""Ingest, quality, identity and serving queries over the football tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.functions.clocks import with_clock_seconds
from touchline.functions.keys import bare_uuid, uuid_text
from touchline.operators import quality, temporal, timestamps
from touchline.plans.registry import query
from touchline.session import table
from touchline.sources import files
from touchline.streaming import observations


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "f3_ambiguous_identity_v1")
    names = {"div_code": "Div", "date_text": "Date", "hometeam": "HomeTeam", "awayteam": "AwayTeam", "fthg": "FTHG", "ftag": "FTAG", "ftr": "FTR", "hthg": "HTHG", "htag": "HTAG"}
    return t.select(*[F.col(a).cast("string").alias(b) for a, b in names.items()])


_FIELDS = {"Div": "div_code", "Date": "date_text", "HomeTeam": "hometeam", "AwayTeam": "awayteam", "FTHG": "fthg", "FTAG": "ftag", "FTR": "ftr", "HTHG": "hthg", "HTAG": "htag"}


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE trim(coalesce({c}::VARCHAR, '')) <> '') AS filled, count(*) AS rows FROM f3_ambiguous_identity_v1" for f, c in _FIELDS.items()))
def results_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Filled values per field of the results CSV, in one pass."""
    return files.field_coverage(_csv(spark, sf))


@query("""WITH t AS (SELECT CASE WHEN trim(coalesce(div_code, '')) = '' OR trim(coalesce(date_text, '')) = '' OR trim(coalesce(hometeam, '')) = '' OR trim(coalesce(awayteam, '')) = '' THEN 'missing_required' WHEN (fthg IS NULL) <> (ftag IS NULL) THEN 'half_score'
WHEN fthg IS NOT NULL AND ftr IS NOT NULL AND upper(trim(ftr)) <> CASE WHEN fthg > ftag THEN 'H' WHEN fthg = ftag THEN 'D' ELSE 'A' END THEN 'result_contradicts_score' WHEN hthg > fthg OR htag > ftag THEN 'half_time_above_full_time' END AS finding FROM f3_ambiguous_identity_v1) SELECT coalesce(finding, 'none') AS finding, count(*) AS rows FROM t GROUP BY ALL""")
def results_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Typed results checked against themselves, counted per finding."""
    return files.typed_results(_csv(spark, sf)).groupBy(F.coalesce("finding", F.lit("none")).alias("finding")).agg(F.count("*").alias("rows"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY provider_event_id ORDER BY staged_at, stage_id) AS delivery FROM football_event_stage),
f AS (SELECT source_resource_id, unnest([CASE WHEN provider_event_id IS NOT NULL AND delivery > 1 THEN 'WARNING' END, CASE WHEN trim(coalesce(player_id, '')) = '' THEN 'INFO' END, CASE WHEN trim(coalesce(team_id, '')) = '' THEN 'WARNING' END, CASE WHEN NOT regexp_matches(coalesce(event_clock, ''), '^[0-9]{2}:[0-5][0-9]:[0-5][0-9]') THEN 'QUARANTINE' END, CASE WHEN period IS NULL OR period NOT BETWEEN 1 AND 5 THEN 'FATAL' END, CASE WHEN event_index IS NULL OR event_index < 1 THEN 'QUARANTINE' END]) AS severity,
 unnest(['repeated_delivery', 'missing_player', 'missing_team', 'impossible_clock', 'impossible_period', 'impossible_index']) AS rule FROM d) SELECT rule, any_value(severity) AS worst, count(*) AS findings FROM f WHERE severity IS NOT NULL GROUP BY rule""")
def event_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Quality rules over the staged events, all in one pass, rolled up per rule."""
    events = table(spark, sf, "football_event_stage").select("stage_id", "provider_event_id", "staged_at", "player_id", "team_id", "event_clock", "period", "event_index")
    return quality.roll_up(quality.event_rules(events), ["rule"])


@query()
def quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    """scope, key, rule, severity: every finding of the quality rules over staged events, event payloads, lineups, matches and players, each once."""
    read = lambda name: table(spark, sf, name)
    events, lineups = read("football_event_stage"), read("lineups")
    payloads = read("provider_payload").where("resource_key like 'events/%'").select("resource_id", "resource_key", "raw").distinct()
    players = read("product_players").select("player_id", "provider_player_id", "player_name")
    found = {
        "event": quality.event_rules(events).unionByName(quality.sequence_rules(events)),
        "payload": quality.payload_rules(files.event_report(payloads.select("resource_id", "raw").distinct(), "resource_id", "raw")).unionByName(quality.conflicts(payloads, F.col("resource_key"), ["resource_id"], "duplicate_match", "QUARANTINE")),
        "lineup": quality.stint_rules(lineups),
        "player": quality.conflicts(players, uuid_text(F.col("player_id")), ["provider_player_id", "player_name"], "conflicting_player_fact", "WARNING"),
    }
    out = quality.lineup_rules(events, lineups, read("product_fixtures"))
    for scope, df in found.items():
        key = df.columns[0]
        out = out.unionByName(df.select(F.lit(scope).alias("scope"), F.col(key).cast("string").alias("key"), "rule", "severity"))
    return out.distinct()


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY provider_event_id ORDER BY staged_at DESC, stage_id DESC) AS i FROM football_event_stage WHERE provider_event_id IS NOT NULL) SELECT provider_event_type, period::BIGINT AS period, count(*) AS events, count(DISTINCT provider_match_id) AS matches FROM l WHERE i = 1 GROUP BY ALL""")
def canonical_events(spark: SparkSession, sf: str) -> DataFrame:
    """Staged deliveries reduced to the latest per event, set-based, then counted."""
    e = table(spark, sf, "football_event_stage").where("provider_event_id is not null").select("provider_event_id", "staged_at", "stage_id", "provider_event_type", "period", "provider_match_id")
    latest = temporal.latest_per_key(e, ["provider_event_id"], ["staged_at", "stage_id"])
    return latest.groupBy("provider_event_type", F.col("period").cast("long").alias("period")).agg(F.count("*").alias("events"), F.count_distinct("provider_match_id").alias("matches"))


@query(r"""WITH m AS (SELECT DISTINCT provider_match_id, regexp_replace(lower(match_id), '[{}\- \t\n\r]', '', 'g') AS match_key FROM open_matches WHERE provider_match_id IS NOT NULL), k AS (SELECT * FROM m WHERE match_key <> ''), c AS (SELECT provider_match_id, count(*) AS fixtures FROM k GROUP BY ALL) SELECT match_key, provider_match_id, fixtures, CASE WHEN fixtures > 1 THEN 'QUARANTINED' ELSE 'UNIQUE' END AS state FROM k JOIN c USING (provider_match_id)""")
def provider_id_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """match_key, provider_match_id, fixtures, state: every open match with its provider id; where one id names more than one match, all of them are quarantined."""
    m = table(spark, sf, "open_matches").select(bare_uuid(F.col("match_id")).alias("match_key"), "provider_match_id").where("match_key is not null and provider_match_id is not null").distinct()
    counts = m.groupBy("provider_match_id").agg(F.count("*").alias("fixtures"))
    return m.join(counts, "provider_match_id").select("match_key", "provider_match_id", "fixtures", F.when(F.col("fixtures") > 1, "QUARANTINED").otherwise("UNIQUE").alias("state"))


@query()
def payload_event_types(spark: SparkSession, sf: str) -> DataFrame:
    """Typed event rows of the raw payloads, counted by type and quality of their location; texts without readable events by finding, with 0 events. Repeated payloads count once."""
    raw = table(spark, sf, "provider_payload").where("resource_key like 'events/%'").select("resource_id", "raw").distinct()
    rows = files.event_report(raw, "resource_id", "raw")
    return rows.groupBy("event_type", "location_quality", "finding").agg(F.count_if(F.col("finding").isNull()).alias("events"), F.count_distinct("resource_id").alias("payloads"))


@query(r"""SELECT DISTINCT team_id, trim(regexp_replace(regexp_replace(lower(canonical_name), '\b(fc|afc|cf|sc|ac|club|football|the)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS club_key FROM product_teams""")
def club_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised club names."""
    return table(spark, sf, "product_teams").select("team_id", text.club_key(F.col("canonical_name")).alias("club_key")).distinct()


@query("""WITH h AS (SELECT DISTINCT team_id, sha1(concat_ws('|', country_code, canonical_name)) AS h FROM product_teams) SELECT team_id, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS stable_id FROM h""")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Name-based identifiers built from hashes."""
    return table(spark, sf, "product_teams").select("team_id", text.stable_id(F.col("country_code"), F.col("canonical_name")).alias("stable_id")).distinct()


@query("""WITH r AS (SELECT DISTINCT fixture_id, revision_id, status, home_score, away_score, epoch_us(updated_at) AS src, epoch_us(coalesce(known_at, updated_at)) AS known FROM product_fixtures), p AS (SELECT *, lag(revision_id) OVER w AS before, lag(status) OVER w AS s0, lag(home_score) OVER w AS h0, lag(away_score) OVER w AS a0, CASE WHEN lag(src) OVER w <= lag(known) OVER w THEN lag(src) OVER w END AS c0, lag(known) OVER w AS k0, CASE WHEN src <= known THEN src END AS c1 FROM r WINDOW w AS (PARTITION BY fixture_id ORDER BY known, revision_id)),
o AS (SELECT *, CASE WHEN c0 IS NOT NULL AND c1 IS NOT NULL THEN sign(c1 - c0) WHEN c0 IS NOT NULL AND known < c0 THEN -1 WHEN c1 IS NOT NULL AND c1 > k0 THEN 1 END AS source, status IS NOT DISTINCT FROM s0 AND home_score IS NOT DISTINCT FROM h0 AND away_score IS NOT DISTINCT FROM a0 AS same FROM p WHERE before IS NOT NULL)
SELECT CASE WHEN source = 1 THEN 'NEWER' WHEN source = -1 THEN 'STALE' WHEN source = 0 THEN CASE WHEN same THEN 'SAME' ELSE 'CONFLICT' END WHEN same THEN 'SAME' WHEN status = 'FINISHED' AND s0 NOT IN ('FINISHED', 'CANCELLED', 'ABANDONED', 'AWARDED') THEN 'NEWER' WHEN s0 = 'SCHEDULED' AND status IN ('LIVE', 'HALF_TIME') THEN 'NEWER' ELSE 'UNORDERED' END AS verdict, count(*) AS updates FROM o GROUP BY ALL""")
def update_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every revision of a fixture against the one that was known before it, in the partial order of updates."""
    none = lambda t: F.lit(None).cast(t)
    known = F.unix_micros(F.coalesce("known_at", "updated_at"))
    update = F.struct(none("string").alias("provider"), F.unix_micros("updated_at").alias("source_time"), known.alias("known_by"), none("bigint").alias("minute"), none("bigint").alias("added"), "status", F.col("home_score").cast("bigint").alias("home"), F.col("away_score").cast("bigint").alias("away"))
    r = table(spark, sf, "product_fixtures").select("fixture_id", "revision_id", update.alias("new"), known.alias("t")).distinct()
    near = lambda w, _: {"old": F.lag("new").over(w)}
    r = temporal.with_neighbours(r, ["fixture_id"], "t", ["revision_id"], 30 * 86_400_000_000, near, 1).where("old is not null")
    return r.groupBy(observations.compare(F.col("old"), F.col("new")).alias("verdict")).agg(F.count("*").alias("updates"))


@query("""SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time windows over the table by the same code that runs on the stream."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    out = observations.windowed_counts(e, "ts", ["event_type"], "value")
    return out.select("event_type", F.substring(F.col("start").cast("string"), 1, 10).alias("day"), "n", F.round("total", 4).alias("total"))


@query("""WITH t AS (SELECT DISTINCT match_id, team_id, player_id FROM lineups WHERE start_reason = 'Starting XI'), o AS (SELECT fixture_id AS match_id, min(kickoff_at) AS ko FROM product_fixtures GROUP BY fixture_id),
x AS (SELECT team_id, match_id, ko, list(player_id) AS players FROM t JOIN o USING (match_id) GROUP BY ALL), p AS (SELECT *, lag(players) OVER (PARTITION BY team_id ORDER BY ko, match_id) AS before FROM x)
SELECT team_id, match_id, len(players) AS starters, len(list_intersect(players, before)) AS kept, round(len(list_intersect(players, before)) / len(before), 6) AS precision FROM p WHERE before IS NOT NULL""")
def repeated_lineups(spark: SparkSession, sf: str) -> DataFrame:
    """The last line-up as the prediction of the next: how many starters it names."""
    t = table(spark, sf, "lineups").where("start_reason = 'Starting XI'").select("match_id", "team_id", "player_id").groupBy("match_id", "team_id").agg(F.collect_set("player_id").alias("players"))
    o = table(spark, sf, "product_fixtures").groupBy(F.col("fixture_id").alias("match_id")).agg(F.min("kickoff_at").alias("ko"))
    x = t.join(o, "match_id").withColumn("before", F.lag("players").over(Window.partitionBy("team_id").orderBy("ko", "match_id"))).where("before is not null")
    kept = F.size(F.array_intersect("players", "before")).cast("long")
    return x.select("team_id", "match_id", F.size("players").cast("long").alias("starters"), kept.alias("kept"), F.round(kept / F.size("before"), 6).alias("precision"))


@query("""SELECT position_name, count(*) AS stints, count(DISTINCT player_id) AS players FROM lineups GROUP BY position_name""")
def position_use(spark: SparkSession, sf: str) -> DataFrame:
    """Stints and players per position."""
    return table(spark, sf, "lineups").groupBy("position_name").agg(F.count("*").alias("stints"), F.count_distinct("player_id").alias("players"))


@query()
def stint_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Clock readings of stints as seconds, counted by shape: what could not be read shows as null."""
    t = with_clock_seconds(table(spark, sf, "lineups").select("from_clock"), {"s": "from_clock"})
    return t.groupBy(timestamps.shape_mask(F.col("from_clock")).alias("shape")).agg(F.count("*").alias("rows"), F.count("s").alias("read"))


@query("""WITH a AS (SELECT mapping_id, canonical_team_id IS NOT NULL AS trusted, provider_code, country_code FROM (SELECT DISTINCT mapping_id, canonical_team_id, provider_code, country_code FROM provider_mapping)) SELECT provider_code, count(*) AS mappings, count(*) FILTER (WHERE trusted) AS trusted, bool_and(trusted) AS complete, round(avg(trusted::INT), 6) AS ratio, count(*) FILTER (WHERE country_code IS NULL) AS no_country FROM a GROUP BY provider_code""")
def mapping_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage ratios of mappings per provider."""
    a = table(spark, sf, "provider_mapping").select("mapping_id", F.col("canonical_team_id").isNotNull().alias("trusted"), "provider_code", "country_code", "canonical_team_id").distinct()
    return a.groupBy("provider_code").agg(F.count("*").alias("mappings"), F.count_if("trusted").alias("trusted"), F.bool_and("trusted").alias("complete"), F.round(F.avg(F.col("trusted").cast("int")), 6).alias("ratio"), F.count_if(F.col("country_code").isNull()).alias("no_country"))


@query("""WITH r AS (SELECT DISTINCT fixture_id, revision_id, status, updated_at, known_at FROM product_fixtures), x AS (SELECT status, date_diff('second', updated_at, coalesce(known_at, updated_at)) AS lag FROM r) SELECT status, count(*) AS revisions, max(lag) AS longest_lag FROM x GROUP BY status""")
def knowledge_lag(spark: SparkSession, sf: str) -> DataFrame:
    """How long after a revision it became known, per status."""
    sec = lambda c: F.floor(F.unix_micros(c) / 1_000_000)
    r = table(spark, sf, "product_fixtures").select("fixture_id", "revision_id", "status", "updated_at", "known_at").distinct()
    return r.groupBy("status").agg(F.count("*").alias("revisions"), F.max(sec(F.coalesce("known_at", "updated_at")) - sec(F.col("updated_at"))).alias("longest_lag"))

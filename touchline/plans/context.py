"""Context of matches: names and regions of mappings, tenures, claims, pages, provider pairs and corner counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import relations, text
from touchline.operators import temporal
from touchline.plans import forecasts, results
from touchline.plans.facts import CLEAN, clean_facts, sides
from touchline.plans.registry import ORACLES, query
from touchline.session import table
from touchline.sources import files

DAY = 86_400


@query()
def name_relations(spark: SparkSession, sf: str) -> DataFrame:
    """relation, mappings, least, most: how the two names of mappings that have both relate, with the range of their sequence ratio."""
    m = table(spark, sf, "provider_mapping").where("provider_team_name is not null and canonical_team_name is not null").select("mapping_id", "provider_team_name", "canonical_team_name").distinct()
    a, b = F.col("provider_team_name"), F.col("canonical_team_name")
    m = m.select("mapping_id", relations.name_form(a).alias("a"), relations.name_form(b).alias("b"), (text.club_key(a) == text.club_key(b)).alias("same"), relations.sequence_ratio(F.lower(a), F.lower(b)).alias("ratio"))
    return m.groupBy(F.coalesce(relations.name_relation(F.col("a"), F.col("b"), F.col("same")), F.lit("NONE")).alias("relation")).agg(F.count("*").alias("mappings"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))


@query("""WITH s AS (SELECT DISTINCT match_id, season_name FROM open_matches) SELECT season_name, CASE WHEN regexp_full_match(split_part(replace(replace(trim(season_name), '_', '/'), '-', '/'), '/', 1), '[0-9]{2}') THEN 2000 + split_part(replace(replace(trim(season_name), '_', '/'), '-', '/'), '/', 1)::INT WHEN regexp_full_match(split_part(replace(replace(trim(season_name), '_', '/'), '-', '/'), '/', 1), '[0-9]+') THEN split_part(replace(replace(trim(season_name), '_', '/'), '-', '/'), '/', 1)::INT END AS starts, count(*) AS matches FROM s GROUP BY ALL""")
def season_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Written seasons and the year each starts in."""
    s = table(spark, sf, "open_matches").select("match_id", "season_name").distinct()
    return s.groupBy("season_name", relations.season_start(F.col("season_name")).alias("starts")).agg(F.count("*").alias("matches"))


@query("""WITH c AS (SELECT country_code, min(country_name) AS country FROM (SELECT country_code, country_name FROM product_teams UNION ALL SELECT country_code, country_name FROM competitions) WHERE country_code IS NOT NULL GROUP BY country_code), k AS (SELECT country, min(country_code) AS code FROM c GROUP BY country),
m AS (SELECT DISTINCT mapping_id, country_code, canonical_team_id FROM provider_mapping), t AS (SELECT team_id, min(country_code) AS own FROM product_teams GROUP BY team_id),
f AS (SELECT m.mapping_id, coalesce(c.country_code, k.code, t.own) AS code, CASE WHEN c.country_code IS NOT NULL THEN 'CODE' WHEN k.code IS NOT NULL THEN 'NAME' WHEN t.own IS NOT NULL THEN 'CLUB' ELSE 'UNKNOWN' END AS source FROM m LEFT JOIN c ON c.country_code = upper(trim(m.country_code)) LEFT JOIN k ON lower(k.country) = lower(trim(m.country_code)) LEFT JOIN t ON t.team_id = m.canonical_team_id)
SELECT f.code, c.country, f.source, count(*) AS mappings FROM f LEFT JOIN c ON c.country_code = f.code GROUP BY ALL""")
def geography_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Countries of mappings by code, by written name or by their club, with the country's name: what is filled from where."""
    named = lambda n: table(spark, sf, n).select("country_code", "country_name")
    c = named("product_teams").unionByName(named("competitions")).where("country_code is not null").groupBy("country_code").agg(F.min("country_name").alias("country"))
    k = c.groupBy("country").agg(F.min("country_code").alias("by_name"))
    m = table(spark, sf, "provider_mapping").select("mapping_id", "country_code", "canonical_team_id").distinct().withColumns({"code": F.upper(F.trim("country_code")), "name": F.lower(F.trim("country_code"))})
    t = table(spark, sf, "product_teams").groupBy(F.col("team_id").alias("canonical_team_id")).agg(F.min("country_code").alias("own"))
    # countries are a fixed, small table
    m = m.join(F.broadcast(c.select(F.col("country_code").alias("code"), F.col("country_code").alias("by_code"))), "code", "left").join(F.broadcast(k.where("country is not null").select(F.lower("country").alias("name"), "by_name")), "name", "left").join(t, "canonical_team_id", "left")
    source = F.when(F.col("by_code").isNotNull(), "CODE").when(F.col("by_name").isNotNull(), "NAME").when(F.col("own").isNotNull(), "CLUB").otherwise("UNKNOWN")
    f = m.select(F.coalesce("by_code", "by_name", "own").alias("code"), source.alias("source"))
    return f.groupBy("code", "source").agg(F.count("*").alias("mappings")).join(F.broadcast(c.withColumnRenamed("country_code", "code")), "code", "left").select("code", "country", "source", "mappings")


@query(f"""{CLEAN}, s AS (SELECT team, match_id, ko, known, year(make_timestamp(ko * 1000000)) AS coach FROM sides), c AS (SELECT team, coach, min(ko) AS since FROM s GROUP BY ALL)
SELECT s.match_id, s.team, round((s.ko - c.since) / {DAY}.0, 6) AS tenure_days, (SELECT count(*) FROM s m WHERE m.team = s.team AND m.coach = s.coach AND m.ko < s.ko AND m.known <= s.ko) AS matches, (SELECT count(*) FROM s m WHERE m.team = s.team AND m.coach = s.coach AND m.ko < s.ko AND m.known <= s.ko) < 5 AS changed_recently FROM s JOIN c ON c.team = s.team AND c.coach = s.coach AND c.since < s.ko""")
def manager_tenure(spark: SparkSession, sf: str) -> DataFrame:
    """Tenure of each side's coach at a kick-off (here a new one each year), with his matches known by then, and whether he came lately: one running count, no range join."""
    s = sides(clean_facts(spark, sf)).select("match_id", "team", "ko", "known", F.year(F.timestamp_seconds("ko")).alias("coach"))
    since = s.groupBy("team", "coach").agg(F.min("ko").alias("since"))
    row = lambda t, n, id_: F.struct(t.alias("t"), F.lit(n).alias("n"), id_.cast("bigint").alias("id"), F.col("ko").alias("at"))
    # a result counts from the moment it is known, which is after its own kick-off
    e = s.select("team", "coach", F.inline(F.array(row(F.col("known") * 2, 1, F.lit(None)), row(F.col("ko") * 2 + 1, 0, F.col("match_id")))))
    e = temporal.running_sums(e, ["team", "coach"], "t", {"matches": "n"}, 180 * DAY).where("id is not null")
    out = e.join(since, ["team", "coach"]).where("since < at")
    return out.select(F.col("id").alias("match_id"), "team", F.round((F.col("at") - F.col("since")) / float(DAY), 6).alias("tenure_days"), F.col("matches"), (F.col("matches") < 5).alias("changed_recently"))


@query("""WITH m AS (SELECT DISTINCT provider_code, canonical_team_id AS team, country_code FROM provider_mapping WHERE canonical_team_id IS NOT NULL AND provider_code IS NOT NULL), t AS (SELECT DISTINCT provider_code, team FROM m), c AS (SELECT DISTINCT provider_code, country_code FROM m WHERE country_code IS NOT NULL),
p AS (SELECT a.provider_code AS one, b.provider_code AS other, count(*) AS clubs FROM t a JOIN t b ON a.team = b.team AND a.provider_code < b.provider_code GROUP BY ALL), q AS (SELECT a.provider_code AS one, b.provider_code AS other, count(*) AS countries FROM c a JOIN c b ON a.country_code = b.country_code AND a.provider_code < b.provider_code GROUP BY ALL)
SELECT one, other, coalesce(clubs, 0) AS clubs, coalesce(countries, 0) AS countries FROM p FULL OUTER JOIN q USING (one, other)""")
def provider_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence for each pair of providers: the clubs and the countries that both know, from the set of providers of each club and country (a handful each)."""
    m = table(spark, sf, "provider_mapping").where("canonical_team_id is not null and provider_code is not null")

    def pairs(key: str, name: str) -> DataFrame:
        per = m.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("provider_code")).alias("p"))
        both = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda b: F.struct(a.alias("one"), b.alias("other")))))
        return per.select(F.inline(both)).groupBy("one", "other").agg(F.count("*").alias(name))

    return pairs("canonical_team_id", "clubs").join(pairs("country_code", "countries"), ["one", "other"], "full").fillna(0, ["clubs", "countries"])


@query("""WITH w AS (SELECT DISTINCT provider_code, provider_team_id, country_code FROM provider_mapping WHERE canonical_team_id IS NOT NULL) SELECT DISTINCT m.mapping_id FROM provider_mapping m WHERE m.canonical_team_id IS NULL AND EXISTS (SELECT 1 FROM w WHERE w.provider_code = m.provider_code AND w.provider_team_id = m.provider_team_id AND w.country_code = m.country_code)""")
def known_native_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Semi join on a key of three columns: unmapped rows whose provider, native id and country are mapped elsewhere."""
    m = table(spark, sf, "provider_mapping").select("mapping_id", "provider_code", "provider_team_id", "country_code", "canonical_team_id")
    keys = ["provider_code", "provider_team_id", "country_code"]
    return m.where("canonical_team_id is null").join(m.where("canonical_team_id is not null").select(*keys), keys, "left_semi").select("mapping_id").distinct()


@query(results._DUE + f""", w AS (SELECT *, 1 + ko // 60 % 6 AS attempts FROM due) SELECT fixture_id, ko, attempts FROM w WHERE attempts < 6 ORDER BY attempts, ko, fixture_id LIMIT 1""")
def next_claim(spark: SparkSession, sf: str) -> DataFrame:
    """The one piece of work to take next, in a total order of priority; locking has no counterpart on tables."""
    d = results.due(spark, sf).withColumn("attempts", 1 + F.floor(F.col("ko") / 60) % 6).where("attempts < 6")
    return d.select("fixture_id", "ko", "attempts").orderBy("attempts", "ko", "fixture_id").limit(1)


@query(f"WITH rated AS ({ORACLES['league_ratings']}) SELECT competition_id, forecasts, rating FROM rated WHERE rating IN ('STRONG', 'GOOD', 'WATCH') ORDER BY forecasts DESC, competition_id LIMIT 3 OFFSET 1")
def rated_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of competitions filtered by rating, in a total order."""
    return filtered(forecasts.league_ratings(spark, sf), rating=("STRONG", "GOOD", "WATCH")).select("competition_id", "forecasts", "rating").orderBy(F.desc("forecasts"), "competition_id").offset(1).limit(3)


def filtered(df: DataFrame, **wanted: object) -> DataFrame:
    """``df`` where each named column equals its value, or is one of its values; None asks for nothing. Unknown columns are an error."""
    for column, value in wanted.items():
        if column not in df.columns:
            raise ValueError(f"no column {column}")
        if value is not None:
            df = df.where(F.col(column).isin(*value) if isinstance(value, (tuple, list, set)) else F.col(column) == F.lit(value))
    return df


@query("""WITH c AS (SELECT DISTINCT match_id, home_team_name, away_team_name, md5(match_id) AS h FROM open_matches), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY home_team_name, away_team_name) AS i FROM c) SELECT match_id, count(*) AS spellings FROM r GROUP BY match_id HAVING count(*) > 1""")
def spelling_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Matches whose rows spell the sides differently: what a review sheet lists."""
    c = table(spark, sf, "open_matches").select("match_id", "home_team_name", "away_team_name").distinct()
    return c.groupBy("match_id").agg(F.count("*").alias("spellings")).where("spellings > 1")


@query()
def corner_counts(spark: SparkSession, sf: str) -> DataFrame:
    """resource_id, team_id, corners, conflicts, repeated: corners per payload and team by the exact rule, events whose corner words contradict each other, and event ids that occur more than once. Repeated payloads count once."""
    raw = table(spark, sf, "provider_payload").where("resource_key like 'events/%'").select("resource_id", "raw").distinct()
    e = files.event_objects(raw, "resource_id", "raw").where("event is not null")
    e = e.select("resource_id", F.get_json_object("event", "$.id").alias("id"), F.get_json_object("event", "$.team.id").alias("team_id"), relations.corner_state(F.col("event")).alias("state")).where("state in ('CORNER', 'CONFLICT')")
    # an event given twice in a payload is one corner and one finding
    once = e.groupBy("resource_id", "team_id", "id", "state").agg(F.count("*").alias("n"))
    return once.groupBy("resource_id", "team_id").agg(F.count_if(F.col("state") == "CORNER").alias("corners"), F.count_if(F.col("state") == "CONFLICT").alias("conflicts"), F.count_if(F.col("n") > 1).alias("repeated"))


#: Fixed moments of the history query: the cutoff (1997-06-30 12:00) and what was known thirty days later, in seconds.
CUTOFF, KNOWN_BY = 867_672_000, 870_264_000


@query(f"""{CLEAN} SELECT competition_id, count(*) FILTER (WHERE match_id % 2 = 0 AND ko < {CUTOFF}) AS exact, count(*) FILTER (WHERE match_id % 2 = 1 AND ko // {DAY} < {CUTOFF} // {DAY}) AS by_day FROM facts WHERE known <= {KNOWN_BY} GROUP BY competition_id HAVING count(*) FILTER (WHERE (match_id % 2 = 0 AND ko < {CUTOFF}) OR (match_id % 2 = 1 AND ko // {DAY} < {CUTOFF} // {DAY})) > 0""")
def usable_history(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that may be used at a cutoff: kicked off strictly before it, by the instant or, where only the day is known, by the day, and known by the knowledge cutoff."""
    m = clean_facts(spark, sf).withColumn("exact", F.col("match_id") % 2 == 0)
    m = m.where(temporal.strictly_before(F.col("ko"), F.lit(CUTOFF), F.col("known"), F.lit(KNOWN_BY), F.col("exact")))
    return m.groupBy("competition_id").agg(F.count_if("exact").alias("exact"), F.count_if(~F.col("exact")).alias("by_day"))

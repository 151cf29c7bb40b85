"""Form windows and result recovery over the fixture revisions, the open matches and the competitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import form, recovery
from touchline.plans.registry import query
from touchline.session import cut, table

#: A fixed moment of the recovery queries: 2026-06-01 in seconds.
NOW = 1_780_272_000


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """fixture_id, competition_id, ko (seconds), home, away, hg, ag, status: the latest revision of each fixture."""
    r = table(spark, sf, "product_fixtures").where("fixture_id is not null")
    order = F.struct("updated_at", F.col("known_at").isNotNull(), "known_at", "revision_id")
    row = F.struct("competition_id", F.floor(F.unix_micros("kickoff_at") / 1_000_000).alias("ko"), F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.col("home_score").cast("int").alias("hg"), F.col("away_score").cast("int").alias("ag"), "status")
    return r.groupBy("fixture_id").agg(F.max_by(row, order).alias("r")).select("fixture_id", "r.*")


def qualified(spark: SparkSession, sf: str) -> DataFrame:
    """fixture_id, hg, ag of open matches with a score: the qualified history."""
    m = table(spark, sf, "open_matches").where("home_score is not null and away_score is not null")
    return m.groupBy(F.col("match_id").alias("fixture_id")).agg(F.max(F.struct(F.col("home_score").alias("hg"), F.col("away_score").alias("ag"))).alias("s")).select("fixture_id", "s.*")


@query()
def form_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every named form window of both teams of every fixture, at its kick-off, with coverage, flags, results and the fixtures it rests on."""
    f = cut(fixtures(spark, sf))
    official = f.where("status in ('FINISHED', 'AWARDED') and hg is not null and ag is not null").withColumn("basis", F.when(F.col("hg") + F.col("ag") > 7, "UNKNOWN").otherwise("REGULATION_90"))
    played = qualified(spark, sf).join(f.select("fixture_id", "competition_id", "ko", "home", "away"), "fixture_id").withColumn("exact", F.col("ko") % 1800 == 0)
    kinds = table(spark, sf, "competitions").select("competition_id", form.competition_scope(F.when(F.col("competition_name").contains("Cup"), "CUP").when(F.col("competition_name").rlike("League|Division"), "LEAGUE"), F.col("competition_name")).alias("scope")).dropDuplicates(["competition_id"])
    sides = cut(form.candidates(official, played, kinds))
    targets = f.select("fixture_id", "competition_id", "ko", F.explode(F.array("home", "away")).alias("team")).where("team is not null")
    pending = f.where("status not in ('FINISHED', 'AWARDED', 'CANCELLED', 'ABANDONED')").select("ko", F.explode(F.array("home", "away")).alias("team"))
    return form.form(targets, sides, pending)


def due(spark: SparkSession, sf: str) -> DataFrame:
    f = fixtures(spark, sf).select("fixture_id", "ko", "status", F.col("hg").alias("home_score"), F.col("ag").alias("away_score"), F.when(F.col("ko") % 7 == 0, "UNKNOWN").otherwise("REGULATION_90").alias("basis"))
    none = f.where("false").select("fixture_id")
    return recovery.candidates(f, qualified(spark, sf), none, F.lit(NOW))


_R = """r AS (SELECT * FROM (SELECT fixture_id, epoch_us(kickoff_at) // 1000000 AS ko, status, home_score, away_score, row_number() OVER (PARTITION BY fixture_id ORDER BY updated_at DESC, known_at DESC NULLS LAST, revision_id DESC) AS i FROM (SELECT DISTINCT fixture_id, kickoff_at, status, home_score, away_score, updated_at, known_at, revision_id FROM product_fixtures)) WHERE i = 1),
q AS (SELECT DISTINCT match_id FROM open_matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL)"""
_DUE = f"""WITH {_R}, due AS (
 SELECT fixture_id, ko, status, 'OVERDUE_UNFINISHED' AS reason FROM r WHERE status IN ('SCHEDULED', 'LIVE', 'HALF_TIME', 'SUSPENDED', 'INTERRUPTED', 'POSTPONED') AND ko < {NOW} - 14400
 UNION ALL SELECT fixture_id, ko, status, 'MISSING_SCORE' FROM r WHERE status = 'FINISHED' AND (home_score IS NULL OR away_score IS NULL)
 UNION ALL SELECT fixture_id, ko, status, CASE WHEN ko % 7 = 0 THEN 'SCORE_BASIS_UNKNOWN' ELSE 'HISTORY_UNQUALIFIED' END FROM r WHERE status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q WHERE q.match_id = r.fixture_id))"""


@query(f"{_DUE} SELECT fixture_id, ko, status, reason FROM due")
def recovery_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Fixtures whose result is overdue, has no score, an unknown basis or no qualified history."""
    return due(spark, sf)


@query(f"""{_DUE}, d AS (SELECT ko // 86400 AS day, count(*) AS fixtures, min(CASE WHEN ko % 3 = 0 THEN ko + 86400 * 30 ELSE ko END) AS since FROM due GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY day DESC) <= 10 AS recent FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY recent ORDER BY since, day) AS t FROM n) SELECT day, fixtures, CASE WHEN recent THEN 'RECENT' ELSE 'WAITING' END AS turn FROM k WHERE recent OR t <= 10""")
def recovery_days(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty days to look at next: the ten newest, then those that have waited longest."""
    checked = due(spark, sf).withColumn("last_checked", F.when(F.col("ko") % 3 == 0, F.col("ko") + 86_400 * 30))
    return recovery.days_to_check(checked, 20)


_AGE = f"({NOW} - ko)"


@query(f"""{_DUE}, w AS (SELECT *, 1 + ko // 60 % 6 AS attempts FROM due) SELECT fixture_id, attempts, {NOW} + CASE WHEN {_AGE} < 172800 THEN least(7200, 900 * (1 << (attempts - 1)::INT)) WHEN {_AGE} < 1209600 THEN least(43200, 7200 * (1 << (attempts - 1)::INT)) WHEN {_AGE} < 7776000 THEN least(86400, 43200 * (1 << (attempts - 1)::INT)) ELSE least(604800, 172800 * (1 << (attempts - 1)::INT)) END AS next_check FROM w""")
def recovery_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """When to look again at each fixture whose result has not come: doubling waits by its age."""
    d = due(spark, sf).withColumn("attempts", 1 + F.floor(F.col("ko") / 60) % 6)
    return d.select("fixture_id", "attempts", recovery.next_check(F.lit("NOT_RETURNED"), F.col("ko"), F.lit(NOW).cast("long"), F.col("attempts")).alias("next_check"))

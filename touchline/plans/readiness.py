"""What keeps a match from being forecast or scored: histories, identities, fits; strengths of teams with little history; states of scored forecasts; vector scaling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import models, temporal
from touchline.plans import forecasts, results
from touchline.plans.facts import CLEAN, clean_facts, sides
from touchline.plans.registry import query
from touchline.session import table

DAY = 86_400
#: Matches that each side must have before a fixture, forecasts a fit must rest on, and the strength of shrinkage and the weight of matches in other competitions.
LEAST_HISTORY, LEAST_TRAINING, SHRINKAGE, TRANSFER, EPSILON = 10, 3000, 8.0, 0.5, 0.05
#: The cutoff of the cold starts: 1999-01-01 in seconds.
CUTOFF = 915_148_800

_LATEST = """r AS (SELECT * FROM (SELECT fixture_id, competition_id, home_team_id AS home, away_team_id AS away, epoch_us(kickoff_at) // 1000000 AS ko, status, home_score, away_score, row_number() OVER (PARTITION BY fixture_id ORDER BY updated_at DESC, known_at DESC NULLS LAST, revision_id DESC) AS i FROM (SELECT DISTINCT * FROM product_fixtures)) WHERE i = 1)"""


@query(f"""WITH {_LATEST}, q AS (SELECT DISTINCT match_id FROM open_matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL), s AS (SELECT ko, unnest([home, away]) AS team FROM r JOIN q ON q.match_id = r.fixture_id), c AS (SELECT DISTINCT competition_id, country_code FROM competitions),
n AS (SELECT r.fixture_id, c.country_code, (SELECT count(*) FROM s WHERE s.team = r.home AND s.ko < r.ko) AS home_history, (SELECT count(*) FROM s WHERE s.team = r.away AND s.ko < r.ko) AS away_history FROM r LEFT JOIN c USING (competition_id) WHERE status <> 'FINISHED')
SELECT fixture_id, home_history, away_history, CASE WHEN country_code IS NULL THEN 'CANONICAL_FIXTURE_GEOGRAPHY_REQUIRED' WHEN home_history < {LEAST_HISTORY} THEN 'HOME_HISTORY_BELOW_CHAMPION_MINIMUM' WHEN away_history < {LEAST_HISTORY} THEN 'AWAY_HISTORY_BELOW_CHAMPION_MINIMUM' ELSE 'HISTORY_PREREQUISITE_MET' END AS reason FROM n""")
def history_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per fixture that is not over the qualified matches of both sides before it, and the first thing it lacks; one running count over the merged matches and fixtures of each team."""
    f = results.fixtures(spark, sf)
    q = results.qualified(spark, sf).select("fixture_id").withColumn("done", F.lit(1))
    rows = f.join(q, "fixture_id", "left").select("fixture_id", "ko", "status", F.coalesce("done", F.lit(0)).alias("done"), F.inline(F.array(F.struct(F.col("home").alias("team"), F.lit(True).alias("first")), F.struct(F.col("away").alias("team"), F.lit(False).alias("first")))))
    counted = temporal.running_sums(rows.where("team is not null and ko is not null"), ["team"], "ko", {"before": "done"}, 180 * DAY, strict=True).where("status <> 'FINISHED'")
    pick = lambda home: F.coalesce(F.max(F.when(F.col("first") == F.lit(home), F.col("before"))), F.lit(0))
    n = counted.groupBy("fixture_id").agg(pick(True).alias("home_history"), pick(False).alias("away_history"))
    c = table(spark, sf, "competitions").select("competition_id", "country_code").distinct()
    n = f.where("status <> 'FINISHED'").select("fixture_id", "competition_id").join(n, "fixture_id", "left").join(c, "competition_id", "left").fillna(0, ["home_history", "away_history"])
    reason = F.when(F.col("country_code").isNull(), "CANONICAL_FIXTURE_GEOGRAPHY_REQUIRED").when(F.col("home_history") < LEAST_HISTORY, "HOME_HISTORY_BELOW_CHAMPION_MINIMUM").when(F.col("away_history") < LEAST_HISTORY, "AWAY_HISTORY_BELOW_CHAMPION_MINIMUM").otherwise("HISTORY_PREREQUISITE_MET")
    return n.select("fixture_id", "home_history", "away_history", reason.alias("reason"))


@query(f"""WITH {_LATEST}, m AS (SELECT provider_code, canonical_team_id AS team, bool_and(country_code IS NOT NULL AND source_snapshot_id IS NOT NULL) AS ok FROM provider_mapping WHERE canonical_team_id IS NOT NULL AND provider_code IS NOT NULL GROUP BY ALL), p AS (SELECT DISTINCT provider_code FROM m), k AS (SELECT DISTINCT competition_id FROM competitions WHERE zone_name IS NOT NULL),
c AS (SELECT r.fixture_id, CASE WHEN NOT coalesce(h.ok, false) THEN 0 WHEN NOT coalesce(a.ok, false) THEN 1 WHEN k.competition_id IS NULL THEN 2 ELSE 3 END AS progress FROM r CROSS JOIN p LEFT JOIN m h ON h.provider_code = p.provider_code AND h.team = r.home LEFT JOIN m a ON a.provider_code = p.provider_code AND a.team = r.away LEFT JOIN k ON k.competition_id = r.competition_id)
SELECT fixture_id, CASE max(progress) WHEN 0 THEN 'HOME_IDENTITY_NOT_ADMITTED' WHEN 1 THEN 'AWAY_IDENTITY_NOT_ADMITTED' WHEN 2 THEN 'COMPETITION_IDENTITY_NOT_ADMITTED' END AS blocker FROM c GROUP BY fixture_id""")
def identity_blockers(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps each fixture's identity from being admitted, by the provider that comes furthest: all mappings of a side must be trusted. A side's providers are sets that meet in the fixture's row, not a product of providers and fixtures."""
    f = results.fixtures(spark, sf).select("fixture_id", "competition_id", "home", "away")
    m = table(spark, sf, "provider_mapping").where("canonical_team_id is not null and provider_code is not null")
    trusted = m.groupBy(F.col("canonical_team_id").alias("team"), "provider_code").agg(F.bool_and(F.col("country_code").isNotNull() & F.col("source_snapshot_id").isNotNull()).alias("ok")).where("ok")
    sets = trusted.groupBy("team").agg(F.collect_set("provider_code").alias("p"))
    k = table(spark, sf, "competitions").where("zone_name is not null").select("competition_id").distinct().withColumn("known", F.lit(True))
    side = lambda name: sets.select(F.col("team").alias(name), F.col("p").alias(f"p_{name}"))
    x = f.join(side("home"), "home", "left").join(side("away"), "away", "left").join(F.broadcast(k), "competition_id", "left")
    both = F.coalesce(F.arrays_overlap("p_home", "p_away"), F.lit(False))
    blocker = F.when(F.col("p_home").isNull(), "HOME_IDENTITY_NOT_ADMITTED").when(~both, "AWAY_IDENTITY_NOT_ADMITTED").when(F.col("known").isNull(), "COMPETITION_IDENTITY_NOT_ADMITTED")
    return x.select("fixture_id", blocker.alias("blocker"))


@query(f"""WITH f AS (SELECT DISTINCT forecast_id, match_id, kickoff_at, training_cutoff, training_count, lambda_home, lambda_away, rho FROM frozen_forecast), m AS (SELECT match_id, max(competition_id) AS competition_id FROM open_matches GROUP BY match_id), k AS (SELECT DISTINCT competition_id FROM competitions WHERE competition_name LIKE '%Division%')
SELECT CASE WHEN training_cutoff IS NULL THEN 'MODEL_FIT_UNAVAILABLE' WHEN training_cutoff >= kickoff_at THEN 'ARTIFACT_TRAINING_NOT_BEFORE_FOOTBALL_CUTOFF' WHEN k.competition_id IS NULL THEN 'COMPETITION_NOT_ELIGIBLE' WHEN coalesce(training_count, 0) < {LEAST_TRAINING} THEN 'MINIMUM_TEAM_HISTORY_{LEAST_TRAINING}_NOT_MET' WHEN lambda_home IS NULL OR lambda_away IS NULL THEN 'XG_UNAVAILABLE' ELSE 'ELIGIBLE' END AS state, count(*) AS forecasts FROM f LEFT JOIN m USING (match_id) LEFT JOIN k USING (competition_id) GROUP BY ALL""")
def fit_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a fit may be used for a forecast: its training lies before the match, its competition and history are covered, its inputs are there; the first reason counts."""
    f = table(spark, sf, "frozen_forecast").select("forecast_id", "match_id", "kickoff_at", "training_cutoff", "training_count", "lambda_home", "lambda_away", "rho").distinct()
    m = table(spark, sf, "open_matches").groupBy("match_id").agg(F.max("competition_id").alias("competition_id"))
    k = table(spark, sf, "competitions").where("competition_name like '%Division%'").select("competition_id").distinct().withColumn("covered", F.lit(True))
    x = f.join(m, "match_id", "left").join(F.broadcast(k), "competition_id", "left")
    state = (
        F.when(F.col("training_cutoff").isNull(), "MODEL_FIT_UNAVAILABLE").when(F.col("training_cutoff") >= F.col("kickoff_at"), "ARTIFACT_TRAINING_NOT_BEFORE_FOOTBALL_CUTOFF").when(F.col("covered").isNull(), "COMPETITION_NOT_ELIGIBLE")
        .when(F.coalesce("training_count", F.lit(0)) < LEAST_TRAINING, f"MINIMUM_TEAM_HISTORY_{LEAST_TRAINING}_NOT_MET").when(F.col("lambda_home").isNull() | F.col("lambda_away").isNull(), "XG_UNAVAILABLE").otherwise("ELIGIBLE")
    )
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("forecasts"))


@query("""WITH f AS (SELECT DISTINCT forecast_id, match_id, batch_index, lambda_home AS lh, lambda_away AS la, rho FROM frozen_forecast), o AS (SELECT match_id, max(season_name) AS season FROM open_matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL GROUP BY match_id)
SELECT o.season, CASE WHEN lh IS NULL OR la IS NULL OR NOT (lh > 0 AND la > 0) THEN 'UNSCORABLE' WHEN rho IS NULL THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, count(*) AS forecasts, count(DISTINCT match_id) AS matches, count(*) < 30 AS review_small FROM f JOIN o USING (match_id) GROUP BY ALL""")
def postmatch_states(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of matches with a result by season and by how far they can be scored: COMPLETE, PARTIAL without a count distribution, UNSCORABLE without rates; segments too small to judge are marked."""
    f = table(spark, sf, "frozen_forecast").select("forecast_id", "match_id", "batch_index", F.col("lambda_home").alias("lh"), F.col("lambda_away").alias("la"), "rho").distinct()
    o = table(spark, sf, "open_matches").where("home_score is not null and away_score is not null").groupBy("match_id").agg(F.max("season_name").alias("season"))
    status = F.when(~F.coalesce((F.col("lh") > 0) & (F.col("la") > 0), F.lit(False)), "UNSCORABLE").when(F.col("rho").isNull(), "PARTIAL").otherwise("COMPLETE")
    g = f.join(o, "match_id").groupBy("season", status.alias("status")).agg(F.count("*").alias("forecasts"), F.count_distinct("match_id").alias("matches"))
    return g.withColumn("review_small", F.col("forecasts") < 30)


@query(f"""{CLEAN}, s AS (SELECT * FROM sides WHERE ko < {CUTOFF} AND known <= {CUTOFF}), now AS (SELECT team, max_by(competition_id, (ko, match_id)) AS comp FROM s GROUP BY team), mean AS (SELECT competition_id, avg(gf) AS goals FROM s GROUP BY competition_id),
w AS (SELECT s.team, now.comp, CASE WHEN s.competition_id = now.comp THEN 1.0 ELSE {TRANSFER} END AS w, gf, ga FROM s JOIN now USING (team)), t AS (SELECT team, comp, sum(w) AS n, sum(w * gf) / sum(w) AS gf, sum(w * ga) / sum(w) AS ga FROM w GROUP BY ALL)
SELECT team, comp AS competition_id, round(n, 6) AS effective, round(n / (n + {SHRINKAGE}), 6) AS history_weight, round(n / (n + {SHRINKAGE}) * ln((gf + {EPSILON}) / (goals + {EPSILON})), 6) AS attack, round(n / (n + {SHRINKAGE}) * ln((ga + {EPSILON}) / (goals + {EPSILON})), 6) AS defence FROM t JOIN mean ON mean.competition_id = t.comp""")
def cold_start_strengths(spark: SparkSession, sf: str) -> DataFrame:
    """Strengths of teams at a cutoff from what they scored and conceded against their competition's mean, matches elsewhere counting half, shrunk by how much history there is."""
    s = sides(clean_facts(spark, sf)).where((F.col("ko") < CUTOFF) & (F.col("known") <= CUTOFF))
    now = s.groupBy("team").agg(F.max_by("competition_id", F.struct("ko", "match_id")).alias("comp"))
    mean = s.groupBy(F.col("competition_id").alias("comp")).agg(F.avg("gf").alias("goals"))
    # combined per team and competition before the team's own competition is known
    per = s.groupBy("team", "competition_id").agg(F.count("*").alias("n"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga")).join(now, "team")
    w = F.when(F.col("competition_id") == F.col("comp"), 1.0).otherwise(TRANSFER)
    t = per.groupBy("team", "comp").agg(F.sum(w * F.col("n")).alias("n"), F.sum(w * F.col("gf")).alias("f"), F.sum(w * F.col("ga")).alias("a")).join(mean, "comp")
    weight = F.col("n") / (F.col("n") + SHRINKAGE)
    strength = lambda c: F.round(weight * F.ln((F.col(c) / F.col("n") + EPSILON) / (F.col("goals") + EPSILON)), 6)
    return t.select("team", F.col("comp").alias("competition_id"), F.round("n", 6).alias("effective"), F.round(weight, 6).alias("history_weight"), strength("f").alias("attack"), strength("a").alias("defence"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC NULLS LAST, (ts >= TIMESTAMP '2024-01-20 00:00:00') DESC NULLS LAST, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_type, ts DESC NULLS LAST, event_id DESC) AS i FROM events) WHERE i = 1""")
def live_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The live row of each key in priority order: match clock, freshness, provider, source clock, id, nulls last; an aggregate, so a hot key is no sort."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    # providers of one rank go by name, the first one first: the letters are turned about
    turned = F.transform(F.split("event_type", ""), lambda c: -F.ascii(c))
    name = F.concat(turned, F.array(F.lit(1)))
    last = lambda c: F.struct(c.isNotNull().alias("a"), c.alias("b"))
    order = F.struct(last(F.floor("value")), (F.col("ts") >= F.expr("timestamp_ntz'2024-01-20 00:00:00'")).alias("fresh"), rank.alias("rank"), name.alias("name"), last(F.col("ts")), F.col("event_id"))
    return e.groupBy("user_id").agg(F.max_by("event_id", order).alias("event_id"))


@query()
def vector_scaling(spark: SparkSession, sf: str) -> DataFrame:
    """Intercepts and scales of the log probabilities of the three results, drawn to leaving them as they are, with standard errors; fitted on counts per cell of a fine grid of the probabilities."""
    s = forecasts.scored(spark, sf)
    cell = lambda c: F.least(F.floor(F.col(c) * 200), F.lit(199)).cast("int").alias(c)
    counts = s.groupBy(cell("ph"), cell("pd"), cell("pa")).agg(*[F.count_if(F.col("outcome") == c).alias(c) for c in forecasts.CLASSES])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = (pdf[["ph", "pd", "pa"]].to_numpy(float) + 0.5) / 200
        x, se = models.vector_scaling(np.log(p / p.sum(1, keepdims=True)), pdf[forecasts.CLASSES].to_numpy(float), 10.0)
        return pd.DataFrame({"parameter": list(models.SCALING), "value": x, "error": se})

    # at most 200 x 200 cells, as the three probabilities of a forecast sum to about 1
    return counts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: fit(pdf), "parameter string, value double, error double")

"""Typed picks of several sources: labels, settlement, agreement with a forecast, consensus and the sources' record.

The picks are read off the frozen forecasts: each batch of forecasts speaks as one of seven sources, and names what its goals make likeliest by a typed label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import markets
from touchline.functions import probability as P
from touchline.plans.registry import query
from touchline.session import table

# The picks as SQL, with the label table spelt out there again.
_LABELS_SQL = ", ".join(f"('{k}', '{m}', '{s}')" for k, (m, s) in markets.LABELS.items())
_PICKS = f"""f AS (SELECT DISTINCT forecast_id, match_id, batch_index, lambda_home AS lh, lambda_away AS la, rho, epoch_us(kickoff_at) AS ko, epoch_us(training_cutoff) AS made FROM frozen_forecast WHERE lambda_home > 0 AND lambda_away > 0 AND rho IS NOT NULL),
labels(label, market, selection) AS (VALUES {_LABELS_SQL}),
raw AS (SELECT *, 'S' || (batch_index % 7) AS source, CASE WHEN lh > la + 0.4 THEN ' Home  Win' WHEN la > lh + 0.4 THEN 'AWAY' ELSE 'Draw(X)' END AS label FROM f
 UNION ALL SELECT *, 'S' || (batch_index % 7), CASE WHEN lh + la > 2.6 THEN 'over 2.5' ELSE 'Under 2.5' END FROM f
 UNION ALL SELECT *, 'S' || (batch_index % 7), CASE WHEN lh > la THEN '1x' ELSE 'X2' END FROM f
 UNION ALL SELECT *, 'S' || (batch_index % 7), CASE WHEN least(lh, la) > 1.1 THEN 'GG' ELSE 'no goal' END FROM f),
picks AS (SELECT raw.*, labels.market, labels.selection FROM raw LEFT JOIN labels ON labels.label = regexp_replace(lower(trim(raw.label)), '\\s+', ' ', 'g'))"""


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """forecast_id, match_id, source, label, market, selection, made, ko (microseconds), lh, la, rho: the picks; market and selection null for labels that name none."""
    f = table(spark, sf, "frozen_forecast").select("forecast_id", "match_id", "batch_index", F.col("lambda_home").alias("lh"), F.col("lambda_away").alias("la"), "rho", F.unix_micros("kickoff_at").alias("ko"), F.unix_micros("training_cutoff").alias("made"))
    f = f.where("lh > 0 and la > 0 and rho is not null").distinct()
    lh, la = F.col("lh"), F.col("la")
    labels = F.array(
        F.when(lh > la + 0.4, " Home  Win").when(la > lh + 0.4, "AWAY").otherwise("Draw(X)"), F.when(lh + la > 2.6, "over 2.5").otherwise("Under 2.5"),
        F.when(lh > la, "1x").otherwise("X2"), F.when(F.least(lh, la) > 1.1, "GG").otherwise("no goal"),
    )
    out = f.select("*", F.concat(F.lit("S"), (F.col("batch_index") % 7).cast("string")).alias("source"), F.explode(labels).alias("label")).withColumn("m", markets.market(F.col("label")))
    return out.select("forecast_id", "match_id", "source", "label", "m.market", "m.selection", "made", "ko", "lh", "la", "rho")


@query(f"WITH {_PICKS} SELECT label, market, selection, count(*) AS picks FROM picks GROUP BY ALL")
def pick_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Typed labels mapped to markets and selections; those that name none stay visible."""
    return picks(spark, sf).groupBy("label", "market", "selection").agg(F.count("*").alias("picks"))


@query(f"""WITH {_PICKS}, v AS (SELECT match_id, market, selection, count(DISTINCT source) AS votes FROM picks WHERE selection IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(votes) OVER (PARTITION BY match_id, market)::BIGINT AS total FROM v)
SELECT match_id, market, selection, votes, total FROM t WHERE votes >= 2 AND votes * 2 > total ORDER BY votes DESC, match_id, market LIMIT 3""")
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    """The three surest consensus picks: at least two sources, and more than half of a market's votes (a source votes once for a selection)."""
    v = picks(spark, sf).where("selection is not null").groupBy("match_id", "market", "selection").agg(F.count_distinct("source").alias("votes"))
    # a market has at most a handful of selections: its total is summed over their rows, and there is no hot key
    t = v.withColumn("total", F.sum("votes").over(Window.partitionBy("match_id", "market")))
    return t.where("votes >= 2 and votes * 2 > total").select("match_id", "market", "selection", "votes", "total").orderBy(F.desc("votes"), "match_id", "market").limit(3)


_FINAL = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY updated_at DESC, known_at DESC NULLS LAST, revision_id DESC) AS i FROM (SELECT DISTINCT fixture_id, revision_id, status, home_score, away_score, updated_at, known_at FROM product_fixtures)) WHERE i = 1)"""
_WON = """CASE selection WHEN 'HOME_WIN' THEN home_score > away_score WHEN 'DRAW' THEN home_score = away_score WHEN 'AWAY_WIN' THEN away_score > home_score WHEN 'HOME_OR_DRAW' THEN home_score >= away_score WHEN 'DRAW_OR_AWAY' THEN away_score >= home_score
 WHEN 'BTTS_YES' THEN home_score > 0 AND away_score > 0 WHEN 'TOTAL_OVER_1_5' THEN home_score + away_score > 1 WHEN 'TOTAL_OVER_2_5' THEN home_score + away_score > 2 WHEN 'TOTAL_UNDER_2_5' THEN home_score + away_score <= 2 WHEN 'TOTAL_UNDER_3_5' THEN home_score + away_score <= 3 END"""
_SETTLED = f"""{_PICKS}, {_FINAL}, s AS (SELECT picks.*, status, CASE WHEN status IN ('CANCELLED', 'ABANDONED', 'AWARDED') THEN 'VOID' WHEN status IS DISTINCT FROM 'FINISHED' OR home_score IS NULL OR away_score IS NULL OR {_WON} IS NULL THEN 'PENDING' WHEN {_WON} THEN 'WON' ELSE 'LOST' END AS state FROM picks LEFT JOIN r ON r.fixture_id = picks.match_id)"""


def settled_picks(spark: SparkSession, sf: str) -> DataFrame:
    """The picks with ``state`` by the latest revision of their fixture; a final score is one after regulation time."""
    cols = ["revision_id", "status", "home_score", "away_score", "updated_at", "known_at"]
    r = table(spark, sf, "product_fixtures").select(F.col("fixture_id").alias("match_id"), *cols)
    order = F.struct("updated_at", F.col("known_at").isNotNull(), "known_at", "revision_id")
    r = r.groupBy("match_id").agg(F.max_by(F.struct("status", F.col("home_score").cast("int").alias("home_score"), F.col("away_score").cast("int").alias("away_score")), order).alias("r")).select("match_id", "r.*")
    p = picks(spark, sf).join(r, "match_id", "left")
    return p.withColumn("state", markets.settled(F.col("market"), F.col("selection"), F.col("status"), F.col("home_score"), F.col("away_score"), F.lit("REGULATION_90")))


@query(f"WITH {_SETTLED} SELECT market, selection, state, count(*) AS picks FROM s GROUP BY ALL")
def pick_settlement(spark: SparkSession, sf: str) -> DataFrame:
    """Settlement of picks: WON, LOST, VOID or PENDING, per selection."""
    return settled_picks(spark, sf).groupBy("market", "selection", "state").agg(F.count("*").alias("picks"))


_MASS = """g AS (SELECT unnest(range(0, 31)) AS k), cells AS (SELECT forecast_id, h.k AS h, a.k AS a, exp(h.k * ln(lh) - lh - lgamma(h.k + 1.0)) * exp(a.k * ln(la) - la - lgamma(a.k + 1.0)) * CASE WHEN h.k = 0 AND a.k = 0 THEN 1 - lh * la * rho WHEN h.k = 0 AND a.k = 1 THEN 1 + lh * rho WHEN h.k = 1 AND a.k = 0 THEN 1 + la * rho WHEN h.k = 1 AND a.k = 1 THEN 1 - rho ELSE 1 END AS p FROM f, g h, g a),
m AS (SELECT forecast_id, sum(p) FILTER (WHERE h > a) AS ph, sum(p) FILTER (WHERE h = a) AS pd, sum(p) FILTER (WHERE h < a) AS pa, sum(p) FILTER (WHERE h > 0 AND a > 0) AS pb, sum(p) FILTER (WHERE h + a >= 3) AS po FROM cells GROUP BY forecast_id)"""
_AGREES = f"""{_SETTLED}, {_MASS}, j AS (SELECT s.*, CASE selection WHEN 'HOME_WIN' THEN ph WHEN 'DRAW' THEN pd WHEN 'AWAY_WIN' THEN pa WHEN 'HOME_OR_DRAW' THEN ph + pd WHEN 'DRAW_OR_AWAY' THEN pd + pa WHEN 'BTTS_YES' THEN pb WHEN 'TOTAL_OVER_2_5' THEN po WHEN 'TOTAL_UNDER_2_5' THEN 1 - po END AS p, greatest(ph, pd, pa) AS top FROM s JOIN m USING (forecast_id)),
q AS (SELECT *, CASE WHEN p IS NULL THEN 'UNABLE_TO_EVALUATE' WHEN p >= 0.5 AND (market <> 'RESULT_1X2' OR p >= top) THEN 'AGREES' WHEN p >= 0.4 THEN 'WEAK_SUPPORT' ELSE 'DISAGREES' END AS agreement FROM j)"""


def agreeing_picks(spark: SparkSession, sf: str) -> DataFrame:
    """The settled picks with ``agreement`` (by market and selection) and ``public_agreement`` (by selection alone) of the forecast of the same id."""
    s = settled_picks(spark, sf).withColumn("cells", P.score_cells(F.col("lh"), F.col("la"), F.col("rho"), 30))
    # the masses in columns of their own: each is summed once
    kept = [c for c in s.columns if c != "cells"]
    s = s.select(*kept, *[P.mass(F.col("cells"), rule).alias(f"m_{name}") for name, rule in markets.WINS.items()])
    of = {id(rule): F.col(f"m_{name}") for name, rule in markets.WINS.items()}
    mass = lambda rule: of[id(rule)]
    return s.select(*kept, *[markets.agreement(F.col("market"), F.col("selection"), mass, strict).alias(n) for n, strict in (("agreement", True), ("public_agreement", False))])


@query(f"WITH {_AGREES} SELECT market, selection, agreement, agreement AS public_agreement, count(*) AS picks FROM q GROUP BY ALL")
def pick_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How the forecasts stand to the picks, by both policies (which differ only where a pick bears a foreign market)."""
    return agreeing_picks(spark, sf).groupBy("market", "selection", "agreement", "public_agreement").agg(F.count("*").alias("picks"))


@query(f"""WITH {_AGREES}, w AS (SELECT *, coalesce(made < ko, false) AS prospective FROM q) SELECT source, count(*) AS tracked, count(*) FILTER (WHERE prospective AND state IN ('WON', 'LOST')) AS settled, count(*) FILTER (WHERE prospective AND state = 'WON') AS correct,
round(avg((state = 'WON')::INT) FILTER (WHERE prospective AND state IN ('WON', 'LOST')), 6) AS hit_rate, round(avg((agreement = 'AGREES')::INT) FILTER (WHERE prospective AND agreement <> 'UNABLE_TO_EVALUATE'), 6) AS agreement_rate, count(*) FILTER (WHERE prospective) AS prospective, count(*) FILTER (WHERE made >= ko) AS retrospective FROM w GROUP BY source""")
def source_scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    """Record of each source: hit rate and agreement rate over picks made before the kick-off, and how many were made after it."""
    w = agreeing_picks(spark, sf).withColumn("prospective", F.coalesce(F.col("made") < F.col("ko"), F.lit(False)))
    done = F.col("prospective") & F.col("state").isin("WON", "LOST")
    judged = F.col("prospective") & (F.col("agreement") != "UNABLE_TO_EVALUATE")
    rate = lambda cond, hit: F.round(F.avg(F.when(cond, hit.cast("int"))), 6)
    return w.groupBy("source").agg(
        F.count("*").alias("tracked"), F.count_if(done).alias("settled"), F.count_if(done & (F.col("state") == "WON")).alias("correct"), rate(done, F.col("state") == "WON").alias("hit_rate"),
        rate(judged, F.col("agreement") == "AGREES").alias("agreement_rate"), F.count_if("prospective").alias("prospective"), F.count_if(F.col("made") >= F.col("ko")).alias("retrospective"),
    )

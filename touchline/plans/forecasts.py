"""Probability, market, scoring, calibration, rating, fitting and simulation queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import probability as P
from touchline.operators import models, ratings, score_models, scoring, simulation, temporal
from touchline.plans.facts import ALL, CLEAN, clean_facts, facts, sides
from touchline.plans.registry import query
from touchline.plans.relational import PRIOR, running_priors
from touchline.session import table

DAY = 86_400
CLASSES = ["HOME", "DRAW", "AWAY"]


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """forecast_id, match_id, lh, la, rho of each distinct forecast with usable rates."""
    f = table(spark, sf, "frozen_forecast").select("forecast_id", "match_id", F.col("lambda_home").alias("lh"), F.col("lambda_away").alias("la"), "rho")
    return f.where("lh > 0 and la > 0 and rho is not null").dropDuplicates(["forecast_id"])


_F = "f AS (SELECT forecast_id, min(match_id) AS match_id, min(lambda_home) AS lh, min(lambda_away) AS la, min(rho) AS rho FROM frozen_forecast WHERE lambda_home > 0 AND lambda_away > 0 AND rho IS NOT NULL GROUP BY forecast_id)"
_K = "g AS (SELECT unnest(range(0, 11)) AS k)"
_POIS = "exp({k} * ln({l}) - {l} - ln(factorial({k}::INT)::DOUBLE))"
_CELLS = f"""{_F}, {_K}, cells AS (SELECT forecast_id, match_id, h.k AS h, a.k AS a, {_POIS.format(k='h.k', l='lh')} * {_POIS.format(k='a.k', l='la')} *
 CASE WHEN h.k = 0 AND a.k = 0 THEN 1 - lh * la * rho WHEN h.k = 0 AND a.k = 1 THEN 1 + lh * rho WHEN h.k = 1 AND a.k = 0 THEN 1 + la * rho WHEN h.k = 1 AND a.k = 1 THEN 1 - rho ELSE 1 END AS p FROM f, g h, g a)"""


def gridded(spark: SparkSession, sf: str) -> DataFrame:
    f = forecasts(spark, sf)
    return f.withColumn("cells", P.score_cells(F.col("lh"), F.col("la"), F.col("rho")))


@query(f"""WITH {_CELLS} SELECT forecast_id, round(sum(p) FILTER (WHERE h > a), 6) AS home, round(sum(p) FILTER (WHERE h = a), 6) AS draw, round(sum(p) FILTER (WHERE h < a), 6) AS away, round(sum(p) FILTER (WHERE h + a > 1), 6) AS over_15, round(sum(p) FILTER (WHERE h + a > 2), 6) AS over_25, round(sum(p) FILTER (WHERE h + a > 3), 6) AS over_35,
round(sum(p) FILTER (WHERE h > 0 AND a > 0), 6) AS both_score, round(sum(p) FILTER (WHERE a = 0), 6) AS home_clean, round(sum(p) FILTER (WHERE h = 0), 6) AS away_clean, round(sum(p) FILTER (WHERE h >= a), 6) AS home_or_draw, round(1 - sum(p), 6) + 0.0 AS tail FROM cells GROUP BY forecast_id""")
def markets(spark: SparkSession, sf: str) -> DataFrame:
    """Markets from the score grid; what the grid leaves out stays an explicit tail."""
    m = lambda f: F.round(P.mass(F.col("cells"), f), 6)
    return gridded(spark, sf).select(
        "forecast_id", m(lambda h, a: h > a).alias("home"), m(lambda h, a: h == a).alias("draw"), m(lambda h, a: h < a).alias("away"),
        *[m(lambda h, a, n=n: h + a > n).alias(f"over_{n}5") for n in (1, 2, 3)], m(lambda h, a: (h > 0) & (a > 0)).alias("both_score"), m(lambda h, a: a == 0).alias("home_clean"), m(lambda h, a: h == 0).alias("away_clean"),
        m(lambda h, a: h >= a).alias("home_or_draw"), (F.round(1 - P.mass(F.col("cells"), lambda h, a: F.lit(True)), 6) + 0.0).alias("tail"),
    )


@query(f"""WITH {_F}, b AS (SELECT unnest(range(0, 6)) AS k), m AS (SELECT forecast_id, k, CASE WHEN k < 5 THEN {_POIS.format(k='k', l='lh')} ELSE 1 - (SELECT sum({_POIS.format(k='i', l='lh')}) FROM (SELECT unnest(range(0, 5)) AS i)) END AS ph, CASE WHEN k < 5 THEN {_POIS.format(k='k', l='la')} ELSE 1 - (SELECT sum({_POIS.format(k='i', l='la')}) FROM (SELECT unnest(range(0, 5)) AS i)) END AS pa FROM f, b)
SELECT x.forecast_id, x.k || CASE WHEN x.k = 5 THEN '+' ELSE '' END AS home, y.k || CASE WHEN y.k = 5 THEN '+' ELSE '' END AS away, round(x.ph * y.pa, 6) AS p FROM m x JOIN m y ON x.forecast_id = y.forecast_id""")
def score_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The censored 6 x 6 matrix: the last bucket of each side is what the first five leave."""
    f = forecasts(spark, sf)
    ks = F.sequence(F.lit(0), F.lit(5))
    side = lambda rate: F.transform(ks, lambda k: F.when(k < 5, P.poisson(k, F.col(rate))).otherwise(1 - P.poisson_cdf(F.lit(4), F.col(rate))))
    f = f.select("forecast_id", side("lh").alias("ph"), side("la").alias("pa"))
    label = lambda k: F.concat(k.cast("string"), F.when(k == 5, "+").otherwise(""))
    cells = F.flatten(F.transform(ks, lambda h: F.transform(ks, lambda a: F.struct(label(h).alias("home"), label(a).alias("away"), F.round(F.get("ph", h) * F.get("pa", a), 6).alias("p")))))
    return f.select("forecast_id", F.inline(cells))


@query(f"""WITH {_CELLS}, t AS (SELECT forecast_id, (h + a)::BIGINT AS total, sum(p) AS p FROM cells GROUP BY ALL) SELECT forecast_id, 'EXACT' AS kind, total, round(p, 6) AS p FROM t UNION ALL SELECT forecast_id, 'BEYOND_GRID', NULL, round(1 - sum(p), 6) + 0.0 FROM t GROUP BY forecast_id""")
def total_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of total goals per forecast over the whole grid, and what lies beyond it: summed in the row, one cell array in, one total array out."""
    row = lambda kind, total, p: F.struct(F.lit(kind).alias("kind"), total.cast("long").alias("total"), F.round(p, 6).alias("p"))
    totals = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda t: row("EXACT", t, P.mass(F.col("cells"), lambda h, a: h + a == t)))
    tail = row("BEYOND_GRID", F.lit(None), 1 - P.mass(F.col("cells"), lambda h, a: F.lit(True)))
    return gridded(spark, sf).select("forecast_id", F.inline(F.concat(totals, F.array(F.struct(tail["kind"].alias("kind"), tail["total"].alias("total"), (tail["p"] + 0.0).alias("p"))))))


@query(f"""WITH {_F}, {_K}, nb AS (SELECT forecast_id, k, exp(lgamma(k + 5.0) - lgamma(5.0) - ln(factorial(k::INT)::DOUBLE)) * pow(5.0 / (5.0 + lh), 5.0) * pow(lh / (5.0 + lh), k) AS p FROM f, g) SELECT forecast_id, k::BIGINT AS k, round(p, 6) AS p FROM nb""")
def negative_binomial_goals(spark: SparkSession, sf: str) -> DataFrame:
    """NB2 goal distribution with dispersion 0.2, by recursion."""
    pmf = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct(k.cast("long").alias("k"), F.round(P.negative_binomial(k, F.col("lh"), F.lit(0.2)), 6).alias("p")))
    return forecasts(spark, sf).select("forecast_id", F.inline(pmf))


@query(f"""WITH {_F}, {_K}, j AS (SELECT forecast_id, k, sum({_POIS.format(k='k', l='(0.7 * (lh + la))')} - {_POIS.format(k='k', l='(1.3 * (lh + la))')}) OVER (PARTITION BY forecast_id ORDER BY k) / (0.6 * (lh + la)) AS p FROM f, g) SELECT forecast_id, k::BIGINT AS k, round(p, 6) AS p FROM j""")
def shared_pace_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Total goals when the pace of a match is uniform around the mean: the integral of Poisson weights is a difference of two cumulative sums."""
    mu = F.col("lh") + F.col("la")
    pmf = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct(k.cast("long").alias("k"), F.round((P.poisson_cdf(k, 0.7 * mu) - P.poisson_cdf(k, 1.3 * mu)) / (0.6 * mu), 6).alias("p")))
    return forecasts(spark, sf).select("forecast_id", F.inline(pmf))


@query(f"""WITH {_F}, {_K}, h AS (SELECT forecast_id, k, exp(lgamma(k + 5.0) - lgamma(5.0) - ln(factorial(k::INT)::DOUBLE)) * pow(5.0 / (5.0 + lh), 5.0) * pow(lh / (5.0 + lh), k) AS p FROM f, g), a AS (SELECT forecast_id, k, exp(lgamma(k + 5.0) - lgamma(5.0) - ln(factorial(k::INT)::DOUBLE)) * pow(5.0 / (5.0 + la), 5.0) * pow(la / (5.0 + la), k) AS p FROM f, g),
c AS (SELECT h.forecast_id, h.k + a.k AS k, sum(h.p * a.p) AS p FROM h JOIN a USING (forecast_id) GROUP BY ALL) SELECT forecast_id, k::BIGINT AS k, round(p / sum(p) OVER (PARTITION BY forecast_id), 6) AS p FROM c""")
def convolved_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of two count distributions by convolution of their arrays, scaled to 1 over its support."""
    ks = F.sequence(F.lit(0), F.lit(10))
    pmf = lambda rate: F.transform(ks, lambda k: P.negative_binomial(k, F.col(rate), F.lit(0.2)))
    f = forecasts(spark, sf).select("forecast_id", pmf("lh").alias("h"), pmf("la").alias("a"))
    terms = lambda t: F.aggregate(F.sequence(F.greatest(t - 10, F.lit(0)), F.least(t, F.lit(10))), F.lit(0.0), lambda s, i: s + F.get("h", i) * F.get("a", t - i))
    f = f.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(20)), terms)).withColumn("s", F.aggregate("c", F.lit(0.0), lambda s, x: s + x))
    return f.select("forecast_id", F.posexplode("c").alias("k", "p"), "s").select("forecast_id", F.col("k").cast("long").alias("k"), F.round(F.col("p") / F.col("s"), 6).alias("p"))


_ROLL = f"""{CLEAN}, n AS (SELECT match_id, team, at_home, row_number() OVER (PARTITION BY team ORDER BY ko) - 1 AS prior, avg(gf) OVER w AS gf, avg(ga) OVER w AS ga FROM sides WINDOW w AS (PARTITION BY team ORDER BY ko ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
r AS (SELECT h.match_id, exp({P.HOME_INTERCEPT} + {P.ATTACK} * ln(greatest(h.gf, 0.1) / {P.MEAN_GOALS}) + {P.DEFENSE} * ln(greatest(a.ga, 0.1) / {P.MEAN_GOALS})) AS lh, exp({P.AWAY_INTERCEPT} + {P.ATTACK} * ln(greatest(a.gf, 0.1) / {P.MEAN_GOALS}) + {P.DEFENSE} * ln(greatest(h.ga, 0.1) / {P.MEAN_GOALS})) AS la FROM n h JOIN n a ON h.match_id = a.match_id AND h.at_home AND NOT a.at_home WHERE h.prior >= 10 AND a.prior >= 10)"""


def champion_rates(spark: SparkSession, sf: str) -> DataFrame:
    """match_id, lh, la, outcome columns: expected goals of every match whose sides both have ten matches before it."""
    s = sides(clean_facts(spark, sf)).select("match_id", "team", "ko", "at_home", "gf", "ga")
    last = lambda w, number: {"prior": number - 1, "mf": F.avg("gf").over(w.rowsBetween(-10, -1)), "ma": F.avg("ga").over(w.rowsBetween(-10, -1))}
    s = temporal.with_neighbours(s, ["team"], "ko", [], 90 * DAY, last, 10).where("prior >= 10")
    # the two sides of a match meet in one aggregate, not in a self-join
    pick = lambda c, home: F.max(F.when(F.col("at_home") == F.lit(home), F.col(c)))
    m = s.groupBy("match_id").agg(F.count("*").alias("n"), pick("mf", True).alias("hf"), pick("ma", True).alias("hc"), pick("mf", False).alias("af"), pick("ma", False).alias("ac"), pick("gf", True).alias("hg"), pick("gf", False).alias("ag")).where("n = 2")
    return m.select("match_id", P.champion_rate(P.HOME_INTERCEPT, F.col("hf"), F.col("ac")).alias("lh"), P.champion_rate(P.AWAY_INTERCEPT, F.col("af"), F.col("hc")).alias("la"), "hg", "ag")


@query(f"""{_ROLL}, {_K}, c AS (SELECT match_id, lh, la, h.k AS h, a.k AS a, {_POIS.format(k='h.k', l='lh')} * {_POIS.format(k='a.k', l='la')} AS p FROM r, g h, g a)
SELECT match_id, round(min(lh), 6) AS lh, round(min(la), 6) AS la, round(sum(p) FILTER (WHERE h > a), 6) AS home, round(sum(p) FILTER (WHERE h = a), 6) AS draw, round(sum(p) FILTER (WHERE h < a), 6) AS away, round(sum(p) FILTER (WHERE h + a > 2), 6) AS over_25, round(1 - sum(p), 6) + 0.0 AS tail FROM c GROUP BY match_id""")
def champion_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: strict last-ten form to expected goals to the score grid to markets, for every match."""
    cells = P.score_cells(F.col("lh"), F.col("la"), F.lit(0.0))
    m = lambda f: F.round(P.mass(F.col("cells"), f), 6)
    r = champion_rates(spark, sf).withColumn("cells", cells)
    return r.select("match_id", F.round("lh", 6).alias("lh"), F.round("la", 6).alias("la"), m(lambda h, a: h > a).alias("home"), m(lambda h, a: h == a).alias("draw"), m(lambda h, a: h < a).alias("away"), m(lambda h, a: h + a > 2).alias("over_25"), (F.round(1 - P.mass(F.col("cells"), lambda h, a: F.lit(True)), 6) + 0.0).alias("tail"))


_BASE = f"""{_ROLL}, {_K}, c AS (SELECT match_id, h.k AS h, a.k AS a, {_POIS.format(k='h.k', l='lh')} * {_POIS.format(k='a.k', l='la')} AS p FROM r, g h, g a), m AS (SELECT match_id, sum(p) FILTER (WHERE h > a) AS ph, sum(p) FILTER (WHERE h = a) AS pd, sum(p) FILTER (WHERE h < a) AS pa FROM c GROUP BY match_id),
{PRIOR.replace('facts', 'raw_facts')}, o AS (SELECT f.competition_id, f.match_id, f.ko, ph, pd, pa, (hs + 1.0) / (seen + 3) AS bh, (ds + 1.0) / (seen + 3) AS bd, (as_ + 1.0) / (seen + 3) AS ba, (hg > ag)::INT AS h, (hg = ag)::INT AS d, (hg < ag)::INT AS a FROM m JOIN facts f USING (match_id) JOIN prior USING (match_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY ko DESC, match_id DESC) AS i, pow(ph - h, 2) + pow(pd - d, 2) + pow(pa - a, 2) AS brier, -ln(ph * h + pd * d + pa * a) AS loss, pow(bh - h, 2) + pow(bd - d, 2) + pow(ba - a, 2) AS base_brier, -ln(bh * h + bd * d + ba * a) AS base_loss FROM o),
q AS (SELECT competition_id, count(*) AS forecasts, {', '.join(f'avg({c}) AS {c}, avg({c}) FILTER (WHERE i <= 50) AS recent_{c}' for c in ('brier', 'loss', 'base_brier', 'base_loss'))} FROM l GROUP BY competition_id)"""
_RATED = ("brier", "loss", "base_brier", "base_loss")


@query(f"""{_BASE} SELECT competition_id, forecasts, {', '.join(f'round({c}, 6) AS {c}, round(recent_{c}, 6) AS recent_{c}' for c in _RATED)}, CASE WHEN forecasts < 50 THEN 'UNRATED' WHEN NOT (brier < base_brier AND loss < base_loss) THEN 'WATCH' WHEN forecasts >= 100 AND recent_brier < recent_base_brier AND recent_loss < recent_base_loss THEN 'STRONG' ELSE 'GOOD' END AS rating FROM q""")
def league_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Per competition the forecasts' losses against those of the running prior, over all matches and the latest fifty, and the rating that follows: better over all of at least fifty is good, and of at least a hundred also lately strong."""
    m = lambda f: P.mass(F.col("cells"), f)
    r = champion_rates(spark, sf).withColumn("cells", P.score_cells(F.col("lh"), F.col("la"), F.lit(0.0)))
    r = r.select("match_id", m(lambda h, a: h > a).alias("ph"), m(lambda h, a: h == a).alias("pd"), m(lambda h, a: h < a).alias("pa"))
    f = clean_facts(spark, sf).select("match_id", "competition_id", "ko", "hg", "ag")
    o = f.join(r, "match_id").join(running_priors(spark, sf), "match_id")
    seen = F.col("hs") + F.col("ds") + F.col("as_") + 3
    hits = [F.when(c, 1.0).otherwise(0.0) for c in (F.col("hg") > F.col("ag"), F.col("hg") == F.col("ag"), F.col("hg") < F.col("ag"))]
    own, base = [F.col(c) for c in ("ph", "pd", "pa")], [(F.col(c) + 1.0) / seen for c in ("hs", "ds", "as_")]
    given = lambda ps: sum((p * h for p, h in zip(ps, hits, strict=True)), F.lit(0.0))
    o = o.select("competition_id", (-F.col("ko")).alias("t"), (-F.col("match_id")).alias("id"), scoring.brier(own, hits).alias("brier"), (-F.ln(given(own))).alias("loss"), scoring.brier(base, hits).alias("base_brier"), (-F.ln(given(base))).alias("base_loss"))
    o = temporal.numbered(o, ["competition_id"], "t", ["id"], 90 * DAY, "i")
    q = o.groupBy("competition_id").agg(F.count("*").alias("forecasts"), *[F.avg(c).alias(c) for c in _RATED], *[F.avg(F.when(F.col("i") <= 50, F.col(c))).alias(f"recent_{c}") for c in _RATED])
    return q.select("competition_id", "forecasts", *[F.round(c, 6).alias(c) for x in _RATED for c in (x, f"recent_{x}")], league_rating(F.col("forecasts"), *[F.col(c) for x in _RATED for c in (x, f"recent_{x}")]).alias("rating"))


def league_rating(n, brier, recent_brier, loss, recent_loss, base_brier, recent_base_brier, base_loss, recent_base_loss):
    """UNRATED below fifty forecasts; WATCH where they are not better than the prior on both losses, or a loss is missing; GOOD where they are; STRONG where a hundred or more are, the latest fifty included."""
    better = lambda a, b, c, d: F.coalesce((a < b) & (c < d), F.lit(False))
    full, recent = better(brier, base_brier, loss, base_loss), better(recent_brier, recent_base_brier, recent_loss, recent_base_loss)
    return F.when(n < 50, "UNRATED").when(~full, "WATCH").when((n >= 100) & recent, "STRONG").otherwise("GOOD")


@query(f"""WITH {_F} SELECT forecast_id, round(exp(ln(lh)) / (exp(ln(lh)) + 0.9 * exp((ln(lh) + ln(la)) / 2) + exp(ln(la))), 6) AS home, round(0.9 * exp((ln(lh) + ln(la)) / 2) / (exp(ln(lh)) + 0.9 * exp((ln(lh) + ln(la)) / 2) + exp(ln(la))), 6) AS draw, round(1 / (1 + pow(10, greatest(least((la - lh), 700), -700))), 6) AS elo, round(1500 + 100 * lh * pow(0.5, 30.0 / 365), 6) AS decayed FROM f""")
def strength_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Draw-aware and logistic probabilities from two strengths, and a decayed rating."""
    home, draw, _ = P.davidson(F.ln("lh"), F.ln("la"), 0.9)
    return forecasts(spark, sf).select("forecast_id", F.round(home, 6).alias("home"), F.round(draw, 6).alias("draw"), F.round(P.elo_expected(400 * F.col("lh"), 400 * F.col("la")), 6).alias("elo"), F.round(P.elo_decay(1500 + 100 * F.col("lh"), 1500, F.lit(30.0)), 6).alias("decayed"))


@query(f"""{ALL}, t AS (SELECT DISTINCT home, away FROM facts) SELECT home, away, round(2 * {P.EARTH_KM} * asin(sqrt(least(pow(sin(radians((away % 90 - 45) - (home % 90 - 45)) / 2), 2) + cos(radians(home % 90 - 45)) * cos(radians(away % 90 - 45)) * pow(sin(radians((away * 7 % 360 - 180) - (home * 7 % 360 - 180)) / 2), 2), 1.0))), 3) AS km FROM t""")
def travel(spark: SparkSession, sf: str) -> DataFrame:
    """Great-circle distance of every pairing."""
    t = facts(spark, sf).select("home", "away").distinct()
    lat, lon = (lambda x: F.col(x) % 90 - 45), (lambda x: F.col(x) * 7 % 360 - 180)
    return t.select("home", "away", F.round(P.haversine_km(lat("home"), lon("home"), lat("away"), lon("away")), 3).alias("km"))


_Z = P.WILSON_Z


@query(f"""{ALL}, c AS (SELECT competition_id, count(*) AS n, count(*) FILTER (WHERE hg > ag) AS k FROM facts GROUP BY competition_id) SELECT competition_id, n, k, round((k / n + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 6) AS low, round((k / n + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 6) AS high FROM c""")
def win_rate_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Wilson intervals of home-win rates."""
    c = facts(spark, sf).groupBy("competition_id").agg(F.count("*").alias("n"), F.count_if(F.col("hg") > F.col("ag")).alias("k"))
    low, high = P.wilson(F.col("k"), F.col("n"))
    return c.select("competition_id", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_LINES = (-4, -3, -2, -1, 0, 1, 2, 3, 4)


@query(f"""WITH {_CELLS}, l AS (SELECT unnest([{', '.join(map(str, _LINES))}]) AS line4) SELECT forecast_id, line4::BIGINT AS line4, CASE WHEN 4 * (h - a) + line4 >= 2 THEN 'FULL_WIN' WHEN 4 * (h - a) + line4 = 1 THEN 'HALF_WIN' WHEN 4 * (h - a) + line4 = 0 THEN 'PUSH' WHEN 4 * (h - a) + line4 = -1 THEN 'HALF_LOSS' ELSE 'FULL_LOSS' END AS settlement, round(sum(p), 6) AS p FROM cells, l GROUP BY ALL""")
def handicaps(spark: SparkSession, sf: str) -> DataFrame:
    """Asian handicap settlements on quarter lines, in whole quarter units, from the distribution of margins."""
    margins = F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda m: F.struct(m.alias("margin"), P.mass(F.col("cells"), lambda h, a: h - a == m).alias("p")))
    g = gridded(spark, sf).select("forecast_id", F.inline(margins))
    g = g.withColumn("line4", F.explode(F.array(*[F.lit(x).cast("long") for x in _LINES])))
    return g.groupBy("forecast_id", "line4", P.settle_quarters(4 * F.col("margin"), F.col("line4")).alias("settlement")).agg(F.round(F.sum("p"), 6).alias("p"))


_TOTAL_LINES, _EURO, _RANGES = (6, 8, 9, 10, 11, 14), (-2, -1, 1, 2), ((0, 1), (2, 3), (4, 6))


def _settle_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 2 THEN 'FULL_WIN' WHEN {x} = 1 THEN 'HALF_WIN' WHEN {x} = 0 THEN 'PUSH' WHEN {x} = -1 THEN 'HALF_LOSS' ELSE 'FULL_LOSS' END"


_AXES = "(SELECT forecast_id, 'TOTAL' AS axis, h + a AS n, p FROM cells UNION ALL SELECT forecast_id, 'HOME', h, p FROM cells UNION ALL SELECT forecast_id, 'AWAY', a, p FROM cells)"
_RESULT = "CASE WHEN {0} > 0 THEN 'HOME' WHEN {0} = 0 THEN 'DRAW' ELSE 'AWAY' END"


@query(f"""WITH {_CELLS}, t AS (SELECT forecast_id, greatest(1 - sum(p), 0) AS tail FROM cells GROUP BY forecast_id), q AS (SELECT unnest([{', '.join(map(str, _LINES))}]) AS line4), e AS (SELECT unnest([{', '.join(map(str, _EURO))}]) AS line), tl AS (SELECT unnest([{', '.join(map(str, _TOTAL_LINES))}]) AS line4), r(lo, hi) AS (VALUES {', '.join(map(str, _RANGES))}), axes AS {_AXES},
u AS (SELECT forecast_id, 'ASIAN_AWAY' AS family, (-line4)::BIGINT AS line4, {_settle_sql('4 * (a - h) - line4')} AS outcome, p FROM cells, q
 UNION ALL SELECT forecast_id, 'EUROPEAN', 4 * line, {_RESULT.format('(h - a + line)')}, p FROM cells, e
 UNION ALL SELECT forecast_id, axis || '_OVER', line4, {_settle_sql('4 * n - line4')}, p FROM axes, tl UNION ALL SELECT forecast_id, axis || '_UNDER', line4, {_settle_sql('line4 - 4 * n')}, p FROM axes, tl
 UNION ALL SELECT forecast_id, 'RESULT_TOTAL', line4, {_RESULT.format('(h - a)')} || CASE WHEN 4 * (h + a) > line4 THEN '_OVER' WHEN 4 * (h + a) = line4 THEN '_EQUAL' ELSE '_UNDER' END, p FROM cells, tl
 UNION ALL SELECT forecast_id, axis || '_RANGE', 100 * lo + hi, CASE WHEN n BETWEEN lo AND hi THEN 'INSIDE' ELSE 'OUTSIDE' END, p FROM axes, r
 UNION ALL SELECT forecast_id, 'MARGIN', NULL, (h - a)::VARCHAR, p FROM cells
 UNION ALL SELECT forecast_id, 'RESULT_BTTS', NULL, {_RESULT.format('(h - a)')} || CASE WHEN h > 0 AND a > 0 THEN '_YES' ELSE '_NO' END, p FROM cells)
SELECT forecast_id, family, line4, outcome, round(sum(p), 6) AS p, round(least(1.0, sum(p) + any_value(tail)), 6) AS upper FROM u JOIN t USING (forecast_id) GROUP BY ALL""")
def derived_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products derived from a score grid: handicaps from the away side, European handicaps, totals of match and sides over and under quarter lines, goal ranges, margins, results with totals and with both scoring.

    Probabilities are of resolved scores, with an upper bound that adds what the grid leaves open; nothing is scaled up. A line is in quarter goals, a range its bounds as 100 low + high. A grid is first
    reduced to its distributions of margin, totals and result, and these meet the lines.
    """
    g = gridded(spark, sf)
    mass = lambda where: P.mass(F.col("cells"), where)
    row = lambda axis, n, result, p: F.struct(F.lit(axis).alias("axis"), n.cast("int").alias("n"), result.cast("string").alias("result"), p.alias("p"))
    none = F.lit(None)
    signs = {"HOME": lambda h, a: h > a, "DRAW": lambda h, a: h == a, "AWAY": lambda h, a: h < a}
    by_result = lambda name: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda t: row("RESULT_TOTAL", t, F.lit(name), mass(lambda h, a: signs[name](h, a) & (h + a == t))))
    both = lambda name, yes: row("RESULT_BTTS", F.lit(int(yes)), F.lit(name), mass(lambda h, a: signs[name](h, a) & (((h > 0) & (a > 0)) == F.lit(yes))))
    rows = F.concat(
        F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda m: row("MARGIN", m, none, mass(lambda h, a: h - a == m))), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda t: row("TOTAL", t, none, mass(lambda h, a: h + a == t))),
        F.transform(F.sequence(F.lit(0), F.lit(10)), lambda n: row("HOME", n, none, mass(lambda h, a: h == n))), F.transform(F.sequence(F.lit(0), F.lit(10)), lambda n: row("AWAY", n, none, mass(lambda h, a: a == n))),
        *[by_result(name) for name in signs], F.array(*[both(name, yes) for name in signs for yes in (True, False)]),
    )
    tail = F.greatest(1 - mass(lambda h, a: F.lit(True)), F.lit(0.0))
    d = g.select("forecast_id", tail.alias("tail"), F.inline(rows))
    n, axis, result = F.col("n"), F.col("axis"), F.col("result")
    item = lambda family, line, outcome: F.struct(F.lit(family).alias("family") if isinstance(family, str) else family.alias("family"), line.cast("bigint").alias("line4"), outcome.alias("outcome"))
    sign = lambda x: F.when(x > 0, "HOME").when(x == 0, "DRAW").otherwise("AWAY")
    margin = F.array(item("MARGIN", none, n.cast("string")), *[item("ASIAN_AWAY", F.lit(-q), P.settle_quarters(-4 * n, F.lit(-q))) for q in _LINES], *[item("EUROPEAN", F.lit(4 * e), sign(n + e)) for e in _EURO])
    counted = F.array(
        *[item(F.concat(axis, F.lit("_OVER")), F.lit(q), P.settle_quarters(4 * n, F.lit(-q))) for q in _TOTAL_LINES], *[item(F.concat(axis, F.lit("_UNDER")), F.lit(q), P.settle_quarters(-4 * n, F.lit(q))) for q in _TOTAL_LINES],
        *[item(F.concat(axis, F.lit("_RANGE")), F.lit(100 * lo + hi), F.when(n.between(lo, hi), "INSIDE").otherwise("OUTSIDE")) for lo, hi in _RANGES],
    )
    joint = F.array(*[item("RESULT_TOTAL", F.lit(q), F.concat(result, F.when(4 * n > q, "_OVER").when(4 * n == q, "_EQUAL").otherwise("_UNDER"))) for q in _TOTAL_LINES])
    scoring_both = F.array(item("RESULT_BTTS", none, F.concat(result, F.when(n == 1, "_YES").otherwise("_NO"))))
    items = F.when(axis == "MARGIN", margin).when(axis == "RESULT_TOTAL", joint).when(axis == "RESULT_BTTS", scoring_both).otherwise(counted)
    out = d.select("forecast_id", "tail", "p", F.inline(items)).groupBy("forecast_id", "family", "line4", "outcome").agg(F.sum("p").alias("s"), F.max("tail").alias("tail"), F.max("p").alias("some"))
    # outcomes that no score of the grid has are left out
    return out.where("some > 0").select("forecast_id", "family", "line4", "outcome", F.round("s", 6).alias("p"), F.round(F.least(F.lit(1.0), F.col("s") + F.col("tail")), 6).alias("upper"))


_SCORED = f"""{_CELLS}, o AS (SELECT match_id, max(home_score) AS hs, max(away_score) AS as_ FROM open_matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL GROUP BY match_id),
p AS (SELECT forecast_id, match_id, sum(p) FILTER (WHERE h > a) AS ph, sum(p) FILTER (WHERE h = a) AS pd, sum(p) FILTER (WHERE h < a) AS pa, sum(p) FILTER (WHERE h + a > 2) AS over25 FROM cells GROUP BY ALL),
s AS (SELECT p.*, hs, as_, CASE WHEN hs > as_ THEN 'HOME' WHEN hs = as_ THEN 'DRAW' ELSE 'AWAY' END AS outcome FROM p JOIN o USING (match_id))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """forecast_id, match_id, ph, pd, pa, over25, hs, as_, outcome of every forecast of a match with a score."""
    o = table(spark, sf, "open_matches").where("home_score is not null and away_score is not null").groupBy("match_id").agg(F.max("home_score").alias("hs"), F.max("away_score").alias("as_"))
    m = lambda f: P.mass(F.col("cells"), f)
    g = gridded(spark, sf).select("forecast_id", "match_id", "cells", m(lambda h, a: h > a).alias("ph"), m(lambda h, a: h == a).alias("pd"), m(lambda h, a: h < a).alias("pa"), m(lambda h, a: h + a > 2).alias("over25"))
    outcome = F.when(F.col("hs") > F.col("as_"), "HOME").when(F.col("hs") == F.col("as_"), "DRAW").otherwise("AWAY")
    return g.join(o, "match_id").withColumn("outcome", outcome)


@query(f"""WITH {_SCORED} SELECT forecast_id, round(-ln(CASE outcome WHEN 'HOME' THEN ph WHEN 'DRAW' THEN pd ELSE pa END), 6) AS log_loss, round(pow(ph - (outcome = 'HOME')::INT, 2) + pow(pd - (outcome = 'DRAW')::INT, 2) + pow(pa - (outcome = 'AWAY')::INT, 2), 6) AS brier, round((pow(ph - (outcome = 'HOME')::INT, 2) + pow(ph + pd - (outcome <> 'AWAY')::INT, 2)) / 2, 6) AS rps, CASE WHEN ph >= pd AND ph >= pa THEN 'HOME' WHEN pd >= pa THEN 'DRAW' ELSE 'AWAY' END = outcome AS hit, round(-(ph * ln(ph) + pd * ln(pd) + pa * ln(pa)), 6) AS entropy FROM s""")
def proper_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Log loss, Brier, ranked probability score, hit with ties to the first class, and entropy of each forecast."""
    ps = [F.col(x) for x in ("ph", "pd", "pa")]
    hits = [F.when(F.col("outcome") == c, 1.0).otherwise(0.0) for c in CLASSES]
    given = F.when(F.col("outcome") == "HOME", F.col("ph")).when(F.col("outcome") == "DRAW", F.col("pd")).otherwise(F.col("pa"))
    return scored(spark, sf).select("forecast_id", F.round(scoring.log_loss(given), 6).alias("log_loss"), F.round(scoring.brier(ps, hits), 6).alias("brier"), F.round(scoring.ranked_score(ps, hits), 6).alias("rps"), (scoring.first_argmax(ps, CLASSES) == F.col("outcome")).alias("hit"), F.round(P.entropy(ps), 6).alias("entropy"))


def _long(s: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(p).alias("p"), (F.col("outcome") == c).alias("hit")) for c, p in zip(CLASSES, ("ph", "pd", "pa"), strict=True)])
    return s.select("forecast_id", "match_id", F.inline(rows))


_LONG = "l AS (SELECT forecast_id, 'HOME' AS class, ph AS p, outcome = 'HOME' AS hit FROM s UNION ALL SELECT forecast_id, 'DRAW', pd, outcome = 'DRAW' FROM s UNION ALL SELECT forecast_id, 'AWAY', pa, outcome = 'AWAY' FROM s)"


@query(f"""WITH {_SCORED}, {_LONG}, b AS (SELECT class, least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mean_p, avg(hit::INT) AS rate FROM l GROUP BY ALL) SELECT class, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(n * abs(mean_p - rate) / sum(n) OVER (), 6) AS ece_share FROM b""")
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability bins per class with each bin's share of the pooled calibration error."""
    b = _long(scored(spark, sf)).groupBy("class", scoring.bins(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("m"), F.avg(F.col("hit").cast("int")).alias("r"))
    total = b.agg(F.sum("n").alias("total"))
    return b.join(F.broadcast(total), F.lit(True)).select("class", "bin", "n", F.round("m", 6).alias("mean_p"), F.round("r", 6).alias("rate"), F.round(F.col("n") * F.abs(F.col("m") - F.col("r")) / F.col("total"), 6).alias("ece_share"))


@query(f"""WITH {_SCORED}, {_LONG}, b AS (SELECT class, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(hit::INT) AS r FROM l GROUP BY ALL), t AS (SELECT class, avg(hit::INT) AS base, count(*) AS total FROM l GROUP BY class) SELECT t.class, round(any_value(base) * (1 - any_value(base)), 6) AS uncertainty, round(sum(n * pow(r - base, 2)) / any_value(total), 6) AS resolution, round(sum(n * pow(m - r, 2)) / any_value(total), 6) AS reliability FROM b JOIN t USING (class) GROUP BY t.class""")
def brier_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Uncertainty, resolution and reliability per class, from the bins alone."""
    b = _long(scored(spark, sf)).groupBy("class", scoring.bins(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("m"), F.sum(F.col("hit").cast("int")).alias("k"))
    w = Window.partitionBy("class")
    b = b.withColumns({"total": F.sum("n").over(w), "base": F.sum("k").over(w) / F.sum("n").over(w), "r": F.col("k") / F.col("n")})
    sq = lambda x: x * x
    return b.groupBy("class").agg(F.round(F.max(F.col("base") * (1 - F.col("base"))), 6).alias("uncertainty"), F.round(F.sum(F.col("n") * sq(F.col("r") - F.col("base"))) / F.max("total"), 6).alias("resolution"), F.round(F.sum(F.col("n") * sq(F.col("m") - F.col("r"))) / F.max("total"), 6).alias("reliability"))


@query(f"""WITH {_SCORED}, {_LONG}, r AS (SELECT class, p, hit, rank() OVER (PARTITION BY class ORDER BY p) AS lo, count(*) OVER (PARTITION BY class, p) AS same FROM l), k AS (SELECT class, sum(CASE WHEN hit THEN lo + (same - 1) / 2.0 END) AS ranks, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM r GROUP BY class) SELECT class, round((ranks - pos * (pos + 1) / 2.0) / (pos * neg), 6) AS auc FROM k WHERE pos > 0 AND neg > 0""")
def ranking_quality(spark: SparkSession, sf: str) -> DataFrame:
    """AUC per class with ties counting half, without pairs."""
    return scoring.auc(_long(scored(spark, sf)), ["class"], "p", "hit").where("auc is not null").select("class", F.round("auc", 6).alias("auc"))


@query(f"""WITH {_SCORED}, x AS (SELECT c.forecast_id, c.h, c.a, row_number() OVER (PARTITION BY c.forecast_id ORDER BY c.p DESC, c.h, c.a) AS i, s.hs, s.as_ FROM cells c JOIN s USING (forecast_id)) SELECT forecast_id, coalesce(bool_or(h = hs AND a = as_) FILTER (WHERE i <= 1), false) AS hit1, coalesce(bool_or(h = hs AND a = as_) FILTER (WHERE i <= 3), false) AS hit3, coalesce(bool_or(h = hs AND a = as_) FILTER (WHERE i <= 5), false) AS hit5 FROM x GROUP BY forecast_id""")
def exact_score_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the score was among the 1, 3 and 5 likeliest cells: the rank of one cell counted in the row, no sort."""
    mine = F.get(F.filter("cells", lambda x: (x["home"] == F.col("hs")) & (x["away"] == F.col("as_"))), F.lit(0))
    s = scored(spark, sf).withColumn("mine", mine)
    m = F.col("mine")
    ahead = F.size(F.filter("cells", lambda x: (x["p"] > m["p"]) | ((x["p"] == m["p"]) & ((x["home"] < m["home"]) | ((x["home"] == m["home"]) & (x["away"] < m["away"]))))))
    rank = F.when(m.isNotNull(), ahead + 1)
    return s.select("forecast_id", *[F.coalesce(rank <= n, F.lit(False)).alias(f"hit{n}") for n in (1, 3, 5)])


@query(f"""WITH {_SCORED}, t AS (SELECT forecast_id, h + a AS k, sum(p) AS p FROM cells GROUP BY ALL), c AS (SELECT forecast_id, k, sum(p) OVER (PARTITION BY forecast_id ORDER BY k) AS cdf FROM t) SELECT c.forecast_id, round(sum(pow(cdf - (k >= hs + as_)::INT, 2)), 6) AS crps, min(k) FILTER (WHERE cdf >= 0.1)::BIGINT AS q10, min(k) FILTER (WHERE cdf >= 0.9)::BIGINT AS q90 FROM c JOIN s USING (forecast_id) GROUP BY c.forecast_id""")
def total_crps(spark: SparkSession, sf: str) -> DataFrame:
    """CRPS and an 80% interval of total goals, over the array of totals in the row."""
    pmf = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda t: P.mass(F.col("cells"), lambda h, a: h + a == t))
    s = scored(spark, sf).select("forecast_id", pmf.alias("pmf"), (F.col("hs") + F.col("as_")).alias("seen"))
    cdf = F.transform(F.sequence(F.lit(1), F.lit(21)), lambda n: F.aggregate(F.slice("pmf", F.lit(1), n), F.lit(0.0), lambda a, x: a + x))
    first = lambda q: F.array_min(F.filter(F.transform("cdf", lambda c, k: F.when(c >= q, k)), lambda k: k.isNotNull())).cast("long")
    s = s.withColumn("cdf", cdf)
    return s.select("forecast_id", F.round(scoring.crps(F.col("pmf"), F.col("seen")), 6).alias("crps"), first(0.1).alias("q10"), first(0.9).alias("q90"))


@query(f"""WITH {_SCORED}, l AS (SELECT forecast_id, -ln(CASE outcome WHEN 'HOME' THEN ph WHEN 'DRAW' THEN pd ELSE pa END) AS loss, outcome, hs, as_, ph FROM s), u AS (SELECT 'overall' AS kind, 'all' AS value, loss FROM l UNION ALL SELECT 'outcome', outcome, loss FROM l UNION ALL SELECT 'total', (hs + as_)::VARCHAR, loss FROM l UNION ALL SELECT 'decile', least(floor(ph * 10), 9)::INT::VARCHAR, loss FROM l) SELECT kind, value, count(*) AS n, round(avg(loss), 6) AS loss FROM u GROUP BY ALL""")
def subgroup_losses(spark: SparkSession, sf: str) -> DataFrame:
    """One forecast in many subgroups at once: exploded and aggregated in one pass."""
    given = F.when(F.col("outcome") == "HOME", F.col("ph")).when(F.col("outcome") == "DRAW", F.col("pd")).otherwise(F.col("pa"))
    g = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    groups = F.array(g("overall", F.lit("all")), g("outcome", F.col("outcome")), g("total", (F.col("hs") + F.col("as_")).cast("string")), g("decile", scoring.bins(F.col("ph")).cast("string")))
    return scored(spark, sf).select(scoring.log_loss(given).alias("loss"), F.inline(groups)).groupBy("kind", "value").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


@query("""WITH f AS (SELECT DISTINCT forecast_id, epoch_us(kickoff_at) // 1000000 - epoch_us(training_cutoff) // 1000000 AS lead FROM frozen_forecast WHERE training_cutoff IS NOT NULL AND kickoff_at IS NOT NULL) SELECT CASE WHEN lead < 0 THEN 'after' WHEN lead < 900 THEN '<15M' WHEN lead < 3600 THEN '15M' WHEN lead < 21600 THEN '1H' WHEN lead < 86400 THEN '6H' WHEN lead < 259200 THEN '24H' WHEN lead < 604800 THEN '3D' ELSE '7D' END AS horizon, count(*) AS n, round(quantile_cont(lead, 0.5), 3) AS median_lead FROM f GROUP BY ALL""")
def lead_times(spark: SparkSession, sf: str) -> DataFrame:
    """Horizon buckets of forecasts and their interpolated median lead."""
    sec = lambda c: F.floor(F.unix_micros(c) / 1_000_000)
    f = table(spark, sf, "frozen_forecast").where("training_cutoff is not null and kickoff_at is not null").select("forecast_id", (sec("kickoff_at") - sec("training_cutoff")).alias("lead")).distinct()
    x = F.col("lead")
    bucket = F.when(x < 0, "after").when(x < 900, "<15M").when(x < 3600, "15M").when(x < 21600, "1H").when(x < 86400, "6H").when(x < 259200, "24H").when(x < 604800, "3D").otherwise("7D")
    return f.groupBy(bucket.alias("horizon")).agg(F.count("*").alias("n"), F.round(F.percentile("lead", 0.5), 3).alias("median_lead"))


@query(f"""{ALL} SELECT competition_id, round(avg(hg), 6) AS mean, round(greatest(var_pop(hg), 1e-12), 6) AS variance FROM facts GROUP BY competition_id""")
def standardised(spark: SparkSession, sf: str) -> DataFrame:
    """Population moments for standardising, with a floor on the variance."""
    return facts(spark, sf).groupBy("competition_id").agg(F.round(F.avg("hg"), 6).alias("mean"), F.round(F.greatest(F.var_pop("hg"), F.lit(1e-12)), 6).alias("variance"))


@query(f"""{ALL}, k AS (SELECT ko, count(*) AS n FROM facts GROUP BY ko), c AS (SELECT ko, coalesce(sum(n) OVER (ORDER BY ko ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM k) SELECT CASE WHEN before < 0.6 * total THEN 'development' WHEN before < 0.8 * total THEN 'calibration' ELSE 'test' END AS part, count(*) AS matches, min(f.ko) AS first_ko, max(f.ko) AS last_ko FROM facts f JOIN c USING (ko) GROUP BY ALL""")
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    """A 60/20/20 split in time that keeps batches of equal kick-off whole."""
    m = facts(spark, sf).groupBy("ko").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("ko") / (90 * DAY)))
    per = m.groupBy("part").agg(F.sum("n").alias("pn"))
    per = per.withColumns({"offset": F.coalesce(F.sum("pn").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("pn").over(Window.partitionBy())})
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("ko").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = m.withColumn("inside", inside).join(F.broadcast(per), "part").withColumn("before", F.col("offset") + F.col("inside"))
    name = F.when(F.col("before") < 0.6 * F.col("total"), "development").when(F.col("before") < 0.8 * F.col("total"), "calibration").otherwise("test")
    return c.groupBy(name.alias("part")).agg(F.sum("n").alias("matches"), F.min("ko").alias("first_ko"), F.max("ko").alias("last_ko"))


@query(f"""{ALL}, e AS (SELECT known * 2 + 1 AS t, competition_id, home AS team, away AS other, NULL::BIGINT AS id FROM facts), q AS (SELECT match_id, competition_id, home, away, ko FROM facts)
SELECT q.match_id, (SELECT count(*) FROM sides s WHERE s.team = q.home AND s.known < q.ko) AS home_history, (SELECT count(*) FROM sides s WHERE s.team = q.away AND s.known < q.ko) AS away_history, (SELECT count(*) FROM facts s WHERE s.competition_id = q.competition_id AND s.known < q.ko) AS competition_history FROM q""")
def walk_forward_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of a match whose outcomes were known strictly before its kick-off: three running counts over merged streams of results and kick-offs."""
    m = facts(spark, sf)
    groups = ("team", "home"), ("team", "away"), ("competition", "competition_id")
    row = lambda kind, column, t, n, id_: F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key"), t.alias("t"), F.lit(n).alias("n"), id_.cast("bigint").alias("id"))
    # a result counts from the moment after it is known; a kick-off asks, and bears its match and group
    results = [row(kind, column, F.col("known") * 2 + 1, 1, F.lit(None)) for kind, column in groups]
    asks = [row(kind, column, F.col("ko") * 2, 0, F.col("match_id") * 4 + i) for i, (kind, column) in enumerate(groups)]
    # results are combined by group and moment first, so that a competition's history has a row per moment
    known = m.select(F.inline(F.array(*results))).groupBy("kind", "key", "t").agg(F.sum("n").alias("n")).withColumn("id", F.lit(None).cast("bigint"))
    rows = known.unionByName(m.select(F.inline(F.array(*asks))).select(*known.columns))
    counted = temporal.running_sums(rows, ["kind", "key"], "t", {"seen": "n"}, 180 * DAY).where("id is not null")
    pick = lambda n: F.max(F.when(F.col("id") % 4 == n, F.col("seen")))
    return counted.groupBy(F.floor(F.col("id") / 4).alias("match_id")).agg(pick(0).alias("home_history"), pick(1).alias("away_history"), pick(2).alias("competition_history"))


@query(f"""{ALL}, b AS (SELECT min(ko) // {DAY} AS lo, max(ko) // {DAY} AS hi FROM facts), w AS (SELECT lo + 365 + 90 * i AS start FROM b, unnest(range(0, (hi - lo - 365) // 90 + 1)) AS u(i)) SELECT w.start::BIGINT AS start_day, least(w.start + 90, (SELECT hi + 1 FROM b))::BIGINT AS end_day, (SELECT count(*) FROM facts WHERE ko // {DAY} < w.start AND ko // {DAY} >= w.start - 365) AS training, (SELECT count(*) FROM facts WHERE ko // {DAY} >= w.start AND ko // {DAY} < w.start + 90) AS targets FROM w""")
def rolling_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward windows of 90 days with a rolling year before each, from counts per day."""
    days = facts(spark, sf).groupBy(F.floor(F.col("ko") / DAY).alias("day")).agg(F.count("*").alias("n"))
    ends = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    starts = ends.select("hi", F.explode(F.sequence(F.col("lo") + 365, F.greatest(F.col("hi"), F.col("lo") + 365), F.lit(90))).alias("start")).where("start <= hi")
    # a day belongs to at most six windows: it goes to each of them by equality
    lo = F.broadcast(ends.select("lo"))
    d = days.join(lo, F.lit(True)).withColumn("slot", F.explode(F.expr("sequence(-5, 0)"))).withColumn("start", F.col("lo") + 365 + 90 * (F.floor((F.col("day") - F.col("lo") - 365) / 90) - F.col("slot")))
    d = d.withColumns({"t": F.when((F.col("day") < F.col("start")) & (F.col("day") >= F.col("start") - 365), F.col("n")), "g": F.when((F.col("day") >= F.col("start")) & (F.col("day") < F.col("start") + 90), F.col("n"))})
    sums = d.groupBy("start").agg(F.sum("t").alias("t"), F.sum("g").alias("g"))
    return starts.join(sums, "start", "left").select(F.col("start").alias("start_day"), F.least(F.col("start") + 90, F.col("hi") + 1).alias("end_day"), F.coalesce("t", F.lit(0)).alias("training"), F.coalesce("g", F.lit(0)).alias("targets"))


@query()
def elo_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings before and after each match, one chronological fold per competition."""
    return ratings.elo(clean_facts(spark, sf), "competition_id")


@query()
def ratings_at_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Each team's rating at the start of 1999, decayed since its last match before it."""
    return ratings.ratings_at(elo_ratings(spark, sf), "competition_id", F.lit(915_148_800))


@query()
def dixon_coles_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Attack, defence, home advantage and rho per competition, fitted together on time-decayed results."""
    return score_models.fit_models(facts(spark, sf), "competition_id", ("poisson",))


@query()
def score_model_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The same with goals that vary more than Poisson, or at a pace that both sides share, and the shape that fits best."""
    return score_models.fit_models(facts(spark, sf), "competition_id", ("nb2", "shared_pace"))


@query()
def loss_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Moving-block bootstrap intervals of the log loss per class that happened, in the order of the matches' kick-offs by their latest revision (the forecasts' own where a match has none)."""
    given = F.when(F.col("outcome") == "HOME", F.col("ph")).when(F.col("outcome") == "DRAW", F.col("pd")).otherwise(F.col("pa"))
    order = F.struct(F.col("updated_at").isNotNull(), "updated_at", F.coalesce("known_at", "updated_at"), "revision_id")
    latest = table(spark, sf, "product_fixtures").where("kickoff_at is not null").groupBy(F.col("fixture_id").alias("match_id")).agg(F.max_by("kickoff_at", order).alias("latest"))
    own = table(spark, sf, "frozen_forecast").groupBy("forecast_id").agg(F.max("kickoff_at").alias("own"))
    s = scored(spark, sf).select("outcome", "forecast_id", "match_id", scoring.log_loss(given).alias("loss")).join(own, "forecast_id").join(latest, "match_id", "left")
    s = s.withColumn("kickoff_at", F.coalesce("latest", "own"))
    return scoring.bootstrap_intervals(s, "outcome", ["kickoff_at", "forecast_id"], "loss")


@query()
def paired_loss_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The forecasts' log loss against that of a base rate on the same matches: per competition by blocks of kick-off batches, over all competitions, and as if independent, with the conclusion."""
    given = lambda h, d, a: F.when(F.col("outcome") == "HOME", h).when(F.col("outcome") == "DRAW", d).otherwise(a)
    s = scored(spark, sf).select("forecast_id", "match_id", scoring.log_loss(given(F.col("ph"), F.col("pd"), F.col("pa"))).alias("own"), scoring.log_loss(given(F.lit(0.45), F.lit(0.27), F.lit(0.28))).alias("base"))
    ko = table(spark, sf, "frozen_forecast").groupBy("forecast_id").agg(F.max(F.unix_micros("kickoff_at")).alias("ko"))
    comp = table(spark, sf, "open_matches").groupBy("match_id").agg(F.max("competition_id").alias("competition_id"))
    country = table(spark, sf, "competitions").select("competition_id", "country_code").dropDuplicates(["competition_id"])
    rows = s.join(ko.where("ko is not null"), "forecast_id").join(comp, "match_id").join(country, "competition_id")
    return scoring.paired_intervals(rows, "country_code", "ko", "forecast_id", "own", "base")


def _simulated(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.simulate_events(gridded(spark, sf).select("forecast_id", "cells"), "forecast_id", "cells")


@query()
def simulated_events(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the 62 derived events in deterministic simulations of every forecast, with the probability of each."""
    return simulation.event_rates(_simulated(spark, sf), "forecast_id")


@query()
def simulation_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of every simulation with its exact interval and the verdict on stability, precision and parity."""
    return simulation.gates(simulated_events(spark, sf), "forecast_id")


@query()
def recalibration(spark: SparkSession, sf: str) -> DataFrame:
    """Intercept and slope of a logistic recalibration per class, and the isotonic curve over fine bins, fitted on counts per bin."""
    b = _long(scored(spark, sf)).groupBy("class", scoring.bins(F.col("p"), 200).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("k"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        p = (pdf["bin"].to_numpy() + 0.5) / 200
        a, s = models.platt(np.log(p / (1 - p)), pdf["k"].to_numpy(float), pdf["n"].to_numpy(float))
        curve = models.pool_adjacent((pdf["k"] / pdf["n"]).to_numpy(), pdf["n"].to_numpy(float))
        return pd.DataFrame({"class": pdf["class"].iloc[0], "intercept": a, "slope": s, "bin": pdf["bin"].to_numpy(), "isotonic": curve})

    return b.groupBy("class").applyInPandas(fit, "class string, intercept double, slope double, bin long, isotonic double")


@query()
def ensemble_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Simplex weights of two forecasters with the best joint log score, from likelihoods rounded to a grid and counted."""
    s = scored(spark, sf)
    pick = lambda h, d, a: F.when(F.col("outcome") == "HOME", h).when(F.col("outcome") == "DRAW", d).otherwise(a)
    base = F.round(pick(F.lit(0.45), F.lit(0.27), F.lit(0.28)), 4)
    g = s.groupBy(F.lit(1).alias("one"), F.greatest(F.round(pick(F.col("ph"), F.col("pd"), F.col("pa")), 4), F.lit(1e-4)).alias("a"), base.alias("b")).agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w = models.mixture_weights(pdf[["a", "b"]].to_numpy(), pdf["n"].to_numpy(float))
        return pd.DataFrame({"model": ["grid", "base rate"], "weight": w})

    return g.groupBy("one").applyInPandas(fit, "model string, weight double")


@query(f"""WITH {_SCORED}, t AS (SELECT match_id, ph, CASE WHEN ph >= pd AND ph >= pa THEN 'HOME' WHEN pd >= pa THEN 'DRAW' ELSE 'AWAY' END AS pick FROM s), v AS (SELECT match_id, count(*) AS models, count(DISTINCT pick) AS picks, max(ph) - min(ph) AS spread FROM t GROUP BY match_id),
m AS (SELECT match_id, max(n) AS top FROM (SELECT match_id, pick, count(*) AS n FROM t GROUP BY ALL) GROUP BY match_id) SELECT match_id, models, round(spread, 6) AS spread, CASE WHEN top = models AND spread <= 0.08 THEN 'HIGH' WHEN top / models >= 0.67 AND spread <= 0.15 THEN 'MODERATE' WHEN top / models >= 0.5 THEN 'MIXED' ELSE 'LOW' END AS agreement FROM v JOIN m USING (match_id)""")
def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How far the forecasts of a match agree: share of the commonest pick, and the spread of the home probability; one aggregate."""
    pick = scoring.first_argmax([F.col("ph"), F.col("pd"), F.col("pa")], CLASSES)
    s = scored(spark, sf).select("match_id", "ph", pick.alias("pick"))
    v = s.groupBy("match_id").agg(F.count("*").alias("models"), (F.max("ph") - F.min("ph")).alias("spread"), *[F.count_if(F.col("pick") == c).alias(c) for c in CLASSES])
    share = F.greatest(*CLASSES) / F.col("models")
    agreement = F.when((share == 1) & (F.col("spread") <= 0.08), "HIGH").when((share >= 0.67) & (F.col("spread") <= 0.15), "MODERATE").when(share >= 0.5, "MIXED").otherwise("LOW")
    return v.select("match_id", "models", F.round("spread", 6).alias("spread"), agreement.alias("agreement"))


_RESIDUAL = f"""{CLEAN}, p AS (SELECT *, least(home, away) AS a, greatest(home, away) AS b FROM facts), j AS (SELECT x.match_id, x.ko, y.ko AS yko, CASE WHEN y.home = x.home THEN 1.0 ELSE 0.9 END AS orientation, CASE WHEN y.home = x.home THEN y.hg - y.ag ELSE y.ag - y.hg END AS margin, row_number() OVER (PARTITION BY x.match_id ORDER BY y.ko DESC, y.match_id DESC) AS i
 FROM p x JOIN p y ON x.a = y.a AND x.b = y.b AND y.ko < x.ko AND y.ko >= x.ko - 730 * {DAY} AND y.known <= x.ko), w AS (SELECT match_id, pow(2, -((ko - yko) / {DAY}.0) / 180) * exp(-greatest(0, ((coalesce(lag(yko) OVER (PARTITION BY match_id ORDER BY i), ko) - yko) / {DAY}.0) - 270) / 365) * orientation AS w, greatest(-1.5, least(1.5, margin)) AS m FROM j WHERE i <= 5)"""


@query(f"""{_RESIDUAL} SELECT match_id, count(*) AS meetings, round(sum(w * m) / sum(w), 6) AS residual, round(least(1, sum(w) / 1.5), 6) AS relevance FROM w GROUP BY match_id HAVING count(*) >= 2""")
def residual_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Prior from the last meetings of a pair: decayed, discounted for long breaks and swapped sides, clipped."""
    m = clean_facts(spark, sf).select("match_id", "ko", "known", "home", "away", "hg", "ag", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"))
    x, y = m.alias("x"), m.alias("y")
    c = F.col
    joined = x.join(y, [c("x.a") == c("y.a"), c("x.b") == c("y.b"), c("y.ko") < c("x.ko"), c("y.ko") >= c("x.ko") - 730 * DAY, c("y.known") <= c("x.ko")])
    same = c("y.home") == c("x.home")
    margin = F.when(same, c("y.hg") - c("y.ag")).otherwise(c("y.ag") - c("y.hg"))
    order = Window.partitionBy("match_id").orderBy(F.desc("yko"), F.desc("yid"))
    j = joined.select(c("x.match_id").alias("match_id"), c("x.ko").alias("ko"), c("y.ko").alias("yko"), c("y.match_id").alias("yid"), F.when(same, 1.0).otherwise(0.9).alias("o"), margin.alias("m"))
    j = j.withColumns({"i": F.row_number().over(order), "later": F.coalesce(F.lag("yko").over(order), c("ko"))}).where("i <= 5")
    days = lambda s: s / float(DAY)
    w = F.pow(F.lit(2.0), -days(c("ko") - c("yko")) / 180) * F.exp(-F.greatest(F.lit(0.0), days(c("later") - c("yko")) - 270) / 365) * c("o")
    clipped = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), c("m")))
    out = j.groupBy("match_id").agg(F.count("*").alias("meetings"), F.sum(w).alias("s"), F.sum(w * clipped).alias("sm")).where("meetings >= 2")
    return out.select("match_id", "meetings", F.round(c("sm") / c("s"), 6).alias("residual"), F.round(F.least(F.lit(1.0), c("s") / 1.5), 6).alias("relevance"))


@query()
def goal_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Poisson regression of home goals on the sides' mean form per competition, on form rounded to tenths."""
    m = clean_facts(spark, sf).select("match_id", "competition_id")
    r = champion_rates(spark, sf).join(m, "match_id").select("competition_id", "hg", F.round(F.ln("lh"), 1).alias("own"), F.round(F.ln("la"), 1).alias("other"))
    return models.fit_poisson(r, "competition_id", "hg", ["own", "other"])


@query()
def simulation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Distance between simulated and analytic scores of each forecast, its worst event, and the verdict."""
    return simulation.variation_gate(_simulated(spark, sf), "forecast_id")


@query()
def exact_win_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Exact intervals of home-win rates per team."""
    c = facts(spark, sf).groupBy("home").agg(F.count("*").alias("n"), F.count_if(F.col("hg") > F.col("ag")).alias("k"))
    return scoring.exact_intervals(c, "k", "n")


@query()
def forward_recalibration(spark: SparkSession, sf: str) -> DataFrame:
    """Per period of 90 days the recalibration of home wins fitted only on what was known before the period, and the losses it gives and replaces within it.

    Forecasts and outcomes are counted per period and fine bin first; a period's training set is a running sum over those counts, so no forecast is read twice.
    """
    period, bins_ = 90 * DAY, 100
    m = champion_rates(spark, sf).join(clean_facts(spark, sf).select("match_id", "ko", "known"), "match_id")
    cells = P.score_cells(F.col("lh"), F.col("la"), F.lit(0.0), 8)
    m = m.select("ko", "known", scoring.bins(P.mass(cells, lambda h, a: h > a), bins_).alias("bin"), (F.col("hg") > F.col("ag")).cast("int").alias("hit"))
    train = m.groupBy((F.floor(F.col("known") / period) + 1).alias("period"), "bin").agg(F.count("*").alias("tn"), F.sum("hit").alias("tk"))
    test = m.groupBy(F.floor(F.col("ko") / period).alias("period"), "bin").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    counts = train.join(test, ["period", "bin"], "full").fillna(0, ["tn", "tk", "n", "k"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        periods = np.arange(pdf["period"].min(), pdf["period"].max() + 1)
        grid = lambda c: pdf.pivot_table(index="period", columns="bin", values=c, aggfunc="sum").reindex(index=periods, columns=range(bins_)).fillna(0).to_numpy()
        tn, tk, n, k = grid("tn").cumsum(0), grid("tk").cumsum(0), grid("n"), grid("k")
        p = (np.arange(bins_) + 0.5) / bins_
        z = np.log(p / (1 - p))
        rows = []
        for i, at in enumerate(periods):
            if tn[i].sum() >= 100 and n[i].sum():
                a, s = models.platt(z, tk[i], tn[i])
                q = np.clip(1 / (1 + np.exp(-(a + s * z))), 1e-15, 1 - 1e-15)
                loss = lambda r: float(-(k[i] * np.log(r) + (n[i] - k[i]) * np.log(1 - r)).sum() / n[i].sum())  # noqa: B023, E731
                rows.append((int(at), int(tn[i].sum()), int(n[i].sum()), a, s, loss(p), loss(q)))
        return pd.DataFrame(rows, columns=["period", "training", "targets", "intercept", "slope", "loss_before", "loss_after"])

    # periods times bins rows in one task: bounded by the calendar
    return counts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: fit(pdf), "period long, training long, targets long, intercept double, slope double, loss_before double, loss_after double")

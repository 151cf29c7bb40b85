"""Match facts over the order tables: a match per order with lines, in the shape of a match history.

Goals are counts of lines by return flag, expected goals their discounts, and a result is known once its last line has shipped. Times are whole
seconds since 1970, so that nothing depends on a session's zone. ``FACTS`` is the same projection as a chain of SQL common tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import table

TEAMS = 100


def seconds(ntz: str) -> Column:
    """A timestamp without zone as seconds since 1970."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ntz})")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, competition_id, season, ko, home, away, hg, ag, hx, ax, known, provider: one row per order with lines."""
    flag = F.col("l_returnflag")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("match_id"))
        .agg(
            F.count_if(flag == "A").alias("hg"), F.count_if(flag == "R").alias("ag"),
            F.round(20 * F.sum(F.when(flag == "A", F.col("l_discount"))), 6).alias("hx"), F.round(20 * F.sum(F.when(flag == "R", F.col("l_discount"))), 6).alias("ax"),
            F.max(seconds("l_shipdate")).alias("shipped"),
        )
    )
    # 25 nations: a fixed table
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("competition_id")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "competition_id")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    home = F.col("o_custkey") % TEAMS
    orders = orders.select(
        F.col("o_orderkey").alias("match_id"), F.col("competition_id").cast("long").alias("competition_id"), F.year("o_orderdate").cast("long").alias("season"),
        (seconds("o_orderdate") + 10800 * (F.col("o_orderkey") % 4)).alias("ko"), home.alias("home"), ((home + 1 + F.col("o_orderkey") % (TEAMS - 1)) % TEAMS).alias("away"),
        F.substring("o_orderpriority", 1, 1).alias("provider"),
    )
    joined = orders.join(lines, "match_id")
    return joined.select("match_id", "competition_id", "season", "ko", "home", "away", "hg", "ag", "hx", "ax", F.greatest("shipped", F.col("ko") + 7200).alias("known"), "provider")


FACTS = f"""
lines AS (SELECT l_orderkey AS match_id, count(*) FILTER (WHERE l_returnflag = 'A') AS hg, count(*) FILTER (WHERE l_returnflag = 'R') AS ag,
  round(20 * sum(l_discount) FILTER (WHERE l_returnflag = 'A'), 6) AS hx, round(20 * sum(l_discount) FILTER (WHERE l_returnflag = 'R'), 6) AS ax,
  max(epoch(l_shipdate)::BIGINT) AS shipped FROM lineitem GROUP BY l_orderkey),
facts AS (SELECT o_orderkey AS match_id, n_regionkey::BIGINT AS competition_id, year(o_orderdate)::BIGINT AS season, epoch(o_orderdate)::BIGINT + 10800 * (o_orderkey % 4) AS ko,
  o_custkey % {TEAMS} AS home, (o_custkey % {TEAMS} + 1 + o_orderkey % {TEAMS - 1}) % {TEAMS} AS away, hg, ag, hx, ax,
  greatest(shipped, epoch(o_orderdate)::BIGINT + 10800 * (o_orderkey % 4) + 7200) AS known, left(o_orderpriority, 1) AS provider
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lines ON o_orderkey = match_id)"""


def sides(matches: DataFrame) -> DataFrame:
    """match_id, competition_id, ko, known, team, opponent, at_home, gf, ga, xf, xa, points: a row for each side of a match; one pass, no self-union."""
    home = F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.lit(True).alias("at_home"), F.col("hg").alias("gf"), F.col("ag").alias("ga"), F.col("hx").alias("xf"), F.col("ax").alias("xa"))
    away = F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.lit(False).alias("at_home"), F.col("ag").alias("gf"), F.col("hg").alias("ga"), F.col("ax").alias("xf"), F.col("hx").alias("xa"))
    long = matches.select("match_id", "competition_id", "ko", "known", F.inline(F.array(home, away)))
    return long.withColumn("points", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0).cast("long"))


SIDES = """
sides AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END::BIGINT AS points FROM (
  SELECT match_id, competition_id, ko, known, home AS team, away AS opponent, true AS at_home, hg AS gf, ag AS ga, hx AS xf, ax AS xa FROM facts
  UNION ALL SELECT match_id, competition_id, ko, known, away, home, false, ag, hg, ax, hx FROM facts))"""


def quarantined(matches: DataFrame) -> DataFrame:
    """match_id of matches in which a team plays twice at the same moment: the schedule is impossible and none of them is trusted."""
    both = matches.select("match_id", "ko", F.explode(F.array("home", "away")).alias("team"))
    clash = both.groupBy("team", "ko").agg(F.count("*").alias("n")).where("n > 1").select("team", "ko")
    return both.join(clash, ["team", "ko"], "left_semi").select("match_id").distinct()


QUARANTINED = """
clash AS (SELECT team, ko FROM sides GROUP BY team, ko HAVING count(*) > 1),
quarantined AS (SELECT DISTINCT match_id FROM sides SEMI JOIN clash USING (team, ko))"""


def clean_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without quarantined matches: a team has one match at a moment."""
    all_ = facts(spark, sf_dir)
    return all_.join(quarantined(all_), "match_id", "left_anti")


CLEAN = f"WITH{FACTS.replace('facts AS (SELECT', 'raw_facts AS (SELECT', 1)},{SIDES.replace('sides AS', 'raw_sides AS', 1).replace('FROM facts', 'FROM raw_facts')}," + QUARANTINED.replace("FROM sides", "FROM raw_sides") + f""",
facts AS (SELECT * FROM raw_facts ANTI JOIN quarantined USING (match_id)),{SIDES}"""
ALL = f"WITH{FACTS},{SIDES}"

"""Temporal, join, aggregate, window, ordering and set queries of the match history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import graphs, temporal
from touchline.plans.facts import ALL, CLEAN, clean_facts, facts, quarantined, sides
from touchline.plans.registry import query
from touchline.session import table

DAY = 86_400
#: A fixed moment of the registries: 2015-01-01 in seconds.
MOMENT = 1_420_070_400
#: Length of the periods that running sums are split by: 90 days in seconds.
PERIOD = 90 * DAY


@query(f"{ALL} SELECT team, at_home, count(*) AS played, sum(points)::BIGINT AS points, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga, count(*) FILTER (WHERE gf > ga) AS won FROM sides GROUP BY ALL")
def team_table(spark: SparkSession, sf: str) -> DataFrame:
    """Side expansion with points from each side's view, summed per team and side."""
    return sides(facts(spark, sf)).groupBy("team", "at_home").agg(F.count("*").alias("played"), F.sum("points").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.count_if(F.col("gf") > F.col("ga")).alias("won"))


@query(f"SELECT team_id, count(*) AS live FROM product_players WHERE epoch(registered_at) <= {MOMENT} AND (removed_at IS NULL OR epoch(removed_at) > {MOMENT}) GROUP BY team_id")
def live_players(spark: SparkSession, sf: str) -> DataFrame:
    """Half-open knowledge predicate: registry rows live at a moment, per team."""
    p = table(spark, sf, "product_players").select("team_id", "registered_at", "removed_at")
    moment = F.timestamp_seconds(F.lit(MOMENT))
    return p.where(temporal.known_at(F.col("registered_at"), F.col("removed_at"), moment)).groupBy("team_id").agg(F.count("*").alias("live"))


@query(f"{ALL}, s AS (SELECT match_id, team, ko FROM sides), prior AS (SELECT s.match_id, s.team, (SELECT count(*) FROM sides p WHERE p.team = s.team AND p.ko < s.ko) AS earlier FROM s) SELECT match_id, team, earlier FROM prior")
def earlier_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Strict-before count: matches of a team before a kick-off; matches of the same moment do not see each other."""
    s = sides(facts(spark, sf)).select("match_id", "team", "ko", F.lit(1).cast("long").alias("one"))
    return temporal.running_sums(s, ["team"], "ko", {"earlier": "one"}, PERIOD, strict=True).select("match_id", "team", "earlier")


@query("""SELECT fixture_id, revision_id, status FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY updated_at DESC, known_at DESC NULLS LAST, revision_id DESC) AS i FROM (SELECT DISTINCT fixture_id, revision_id, status, updated_at, known_at FROM product_fixtures)) WHERE i = 1""")
def latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    """Latest row per key under a total order with nulls last."""
    r = table(spark, sf, "product_fixtures").select("fixture_id", "revision_id", "status", "updated_at", "known_at")
    return temporal.latest_per_key(r, ["fixture_id"], ["updated_at", "known_at", "revision_id"]).select("fixture_id", "revision_id", "status")


@query("""SELECT fixture_id, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY updated_at DESC, known_at DESC NULLS LAST, revision_id DESC) AS i FROM (SELECT DISTINCT fixture_id, revision_id, status, updated_at, known_at FROM product_fixtures)) WHERE i = 1 AND status = 'FINISHED'""")
def latest_then_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Latest decision first, then the filter, so that a revocation wins over what it revokes."""
    return latest_revision(spark, sf).where("status = 'FINISHED'").select("fixture_id", "revision_id")


_HORIZONS = (0, 3600, 86_400, 604_800)


@query(f"""WITH f AS (SELECT DISTINCT forecast_id, match_id, epoch_us(kickoff_at) AS ko, epoch_us(training_cutoff) AS made FROM frozen_forecast WHERE training_cutoff IS NOT NULL),
h AS (SELECT unnest([{', '.join(map(str, _HORIZONS))}])::BIGINT AS horizon)
SELECT match_id, horizon, forecast_id FROM (SELECT match_id, horizon, forecast_id, row_number() OVER (PARTITION BY match_id, horizon ORDER BY made DESC, forecast_id DESC) AS i FROM f, h WHERE made <= ko - horizon * 1000000) WHERE i = 1""")
def forecast_at_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Per match and horizon the latest forecast made at least that long before its kick-off."""
    f = table(spark, sf, "frozen_forecast").where("training_cutoff is not null").select("match_id", "forecast_id", F.unix_micros("kickoff_at").alias("ko"), F.unix_micros("training_cutoff").alias("made"))
    f = f.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in _HORIZONS]))).where(F.col("made") <= F.col("ko") - F.col("horizon") * 1_000_000)
    return temporal.latest_per_key(f, ["match_id", "horizon"], ["made", "forecast_id"]).select("match_id", "horizon", "forecast_id")


@query(f"""{CLEAN}, q AS (SELECT match_id, home AS team, ko FROM facts), r AS (SELECT team, known, match_id, gf FROM sides),
j AS (SELECT q.match_id, r.match_id AS last_known, r.gf, row_number() OVER (PARTITION BY q.match_id ORDER BY r.known DESC, r.match_id::VARCHAR DESC) AS i FROM q JOIN r ON q.team = r.team AND r.known <= q.ko)
SELECT q.match_id, j.last_known, j.gf FROM q LEFT JOIN j ON q.match_id = j.match_id AND j.i = 1""")
def last_known_result(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join: the home team's result that was known last at kick-off, by one merged sort instead of pairs."""
    m = clean_facts(spark, sf)
    left = m.select("match_id", F.col("home").alias("team"), "ko")
    right = sides(m).select("team", "known", F.col("match_id").alias("last_known"), "gf")
    return temporal.asof_join(left, right, ["team"], "ko", "known", ["last_known", "gf"], tie="last_known", width=PERIOD).select("match_id", "last_known", "gf")


@query(f"""{CLEAN} SELECT match_id, team, lead(match_id) OVER w AS next_match, (lead(ko) OVER w - ko) // {DAY} AS days_to_next, (ko - lag(ko) OVER w) // {DAY} AS days_since_last FROM sides WINDOW w AS (PARTITION BY team ORDER BY ko)""")
def next_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """Next-after and rest days per team."""
    days = lambda x: F.floor(x / DAY)
    near = lambda w, _: {"next_match": F.lead("match_id").over(w), "days_to_next": days(F.lead("ko").over(w) - F.col("ko")), "days_since_last": days(F.col("ko") - F.lag("ko").over(w))}
    return temporal.with_neighbours(sides(clean_facts(spark, sf)).select("match_id", "team", "ko"), ["team"], "ko", [], PERIOD, near, 1, 1).drop("ko")


@query(f"""{ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY team, at_home ORDER BY ko DESC, match_id DESC) AS i FROM sides), t AS (SELECT team, match_id, at_home, ko, row_number() OVER (PARTITION BY team ORDER BY ko DESC, match_id DESC) AS place FROM r WHERE i <= 5)
SELECT team, match_id, at_home, place FROM t WHERE place <= 5""")
def last_five(spark: SparkSession, sf: str) -> DataFrame:
    """Top n per key twice: the last five at home and away, then the last five of both."""
    s = sides(facts(spark, sf)).select("team", "match_id", "at_home", "ko")
    both = temporal.top_n_per_key(s, ["team", "at_home"], [F.desc("ko"), F.desc("match_id")], 5)
    place = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("ko"), F.desc("match_id"))).cast("long")
    return both.withColumn("place", place).where("place <= 5").select("team", "match_id", "at_home", "place")


@query("""SELECT DISTINCT t.team_id FROM product_teams t WHERE EXISTS (SELECT 1 FROM product_players p WHERE p.team_id = t.team_id AND p.removed_at IS NULL) AND NOT EXISTS (SELECT 1 FROM provider_mapping m WHERE m.canonical_team_id = t.team_id)""")
def unmapped_teams(spark: SparkSession, sf: str) -> DataFrame:
    """Semi and anti join: clubs with a live player and no provider mapping."""
    teams = table(spark, sf, "product_teams").select("team_id").distinct()
    players = table(spark, sf, "product_players").where("removed_at is null").select("team_id")
    mapped = table(spark, sf, "provider_mapping").where("canonical_team_id is not null").select(F.col("canonical_team_id").alias("team_id"))
    return teams.join(players, "team_id", "left_semi").join(mapped, "team_id", "left_anti")


@query("""WITH r AS (SELECT DISTINCT fixture_id, revision_id, updated_at FROM product_fixtures), c AS (SELECT revision_id, lag(revision_id) OVER (PARTITION BY fixture_id ORDER BY updated_at, revision_id) AS replaces FROM r)
SELECT revision_id FROM c WHERE revision_id NOT IN (SELECT replaces FROM c WHERE replaces IS NOT NULL)""")
def revision_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of revision chains: rows that no other row replaces."""
    r = table(spark, sf, "product_fixtures").select("fixture_id", "revision_id", "updated_at").distinct()
    chain = r.select("revision_id", F.lag("revision_id").over(Window.partitionBy("fixture_id").orderBy("updated_at", "revision_id")).alias("replaces"))
    return temporal.chain_heads(chain, "revision_id", "replaces").select("revision_id")


@query("""WITH r AS (SELECT DISTINCT fixture_id, revision_id, updated_at FROM product_fixtures), c AS (SELECT revision_id, lag(revision_id) OVER (PARTITION BY fixture_id ORDER BY updated_at, revision_id) AS prior, first_value(revision_id) OVER (PARTITION BY fixture_id ORDER BY updated_at, revision_id) AS root, row_number() OVER (PARTITION BY fixture_id ORDER BY updated_at, revision_id) - 1 AS hops FROM r)
SELECT revision_id, root AS final, hops FROM c WHERE prior IS NOT NULL""")
def redirect_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Transitive redirects: every revision followed back to the first of its chain, by pointer doubling."""
    r = table(spark, sf, "product_fixtures").select("fixture_id", "revision_id", "updated_at").distinct()
    chain = r.select("revision_id", F.lag("revision_id").over(Window.partitionBy("fixture_id").orderBy("updated_at", "revision_id")).alias("prior"))
    return graphs.resolve_chains(chain, "revision_id", "prior")


_H2H = f"""{CLEAN}, p AS (SELECT *, least(home, away) AS a, greatest(home, away) AS b FROM facts)"""


@query(f"""{_H2H} SELECT x.match_id, count(y.match_id) AS meetings, round(sum(pow(0.5, (x.ko - y.ko) / {DAY}.0 / 730)), 6) AS weight, round(pow(sum(pow(0.5, (x.ko - y.ko) / {DAY}.0 / 730)), 2) / sum(pow(0.5, 2 * (x.ko - y.ko) / {DAY}.0 / 730)), 6) AS effective,
 round(sum(pow(0.5, (x.ko - y.ko) / {DAY}.0 / 730) * CASE WHEN y.home = x.home THEN y.hg - y.ag ELSE y.ag - y.hg END) / sum(pow(0.5, (x.ko - y.ko) / {DAY}.0 / 730)), 6) + 0.0 AS margin
 FROM p x JOIN p y ON x.a = y.a AND x.b = y.b AND y.ko < x.ko AND y.known <= x.ko GROUP BY x.match_id""")
def head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    """Decayed weights and margins of a pair's earlier meetings and their effective sample: a weight is a power of the later time times one of the earlier, so running sums over the merged results and kick-offs of an unordered pair do, without pairs."""
    m = clean_facts(spark, sf).select("match_id", "ko", "known", "home", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b"), (F.col("hg") - F.col("ag")).alias("gap"))
    half = 730.0 * DAY
    origin = 10 * 365 * DAY + 15 * 365 * DAY  # any fixed moment: it keeps the powers near 1
    w = F.pow(F.lit(2.0), (F.col("ko") - origin) / half)
    margin = F.when(F.col("home") == F.col("a"), F.col("gap")).otherwise(-F.col("gap"))
    # a result is known after its own kick-off, so what is known by a kick-off was played before it
    result = F.struct((F.col("known") * 2).alias("t"), F.lit(1).alias("n"), w.alias("w"), (w * w).alias("w2"), (w * margin).alias("wm"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("boolean").alias("first"))
    ask = F.struct((F.col("ko") * 2 + 1).alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("w"), F.lit(0.0).alias("w2"), F.lit(0.0).alias("wm"), F.col("match_id").alias("id"), F.col("ko").alias("at"), (F.col("home") == F.col("a")).alias("first"))
    e = m.select("a", "b", F.inline(F.array(result, ask)))
    e = temporal.running_sums(e, ["a", "b"], "t", {"meetings": "n", "s": "w", "s2": "w2", "sm": "wm"}, 8 * PERIOD).where("id is not null and meetings > 0")
    decay = F.pow(F.lit(2.0), (F.col("at") - origin) / half)
    return e.select(F.col("id").alias("match_id"), "meetings", F.round(F.col("s") / decay, 6).alias("weight"), F.round(F.col("s") * F.col("s") / F.col("s2"), 6).alias("effective"), (F.round(F.when(F.col("first"), 1).otherwise(-1) * F.col("sm") / F.col("s"), 6) + 0.0).alias("margin"))


@query("""SELECT DISTINCT b.player_id, epoch_us(b.registered_at) AS start FROM (SELECT DISTINCT player_id, registered_at, removed_at FROM product_players) b WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT player_id, registered_at, removed_at FROM product_players) a WHERE a.player_id = b.player_id AND (a.registered_at < b.registered_at OR (a.registered_at = b.registered_at AND coalesce(a.removed_at, TIMESTAMPTZ '9999-01-01 00:00:00+00') < coalesce(b.removed_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'))) AND (a.removed_at IS NULL OR a.removed_at > b.registered_at))""")
def overlapping_registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Interval overlap per key by a running maximum end: no pair of rows is formed."""
    p = table(spark, sf, "product_players").select("player_id", F.unix_micros("registered_at").alias("start"), F.coalesce(F.unix_micros("removed_at"), F.lit(2**62)).alias("end")).distinct()
    return temporal.overlapping(p, ["player_id"], "start", "end", "end").select("player_id", "start").distinct()


@query(f"""{ALL}, u AS (UNPIVOT (SELECT match_id, hg, ag FROM facts) ON hg, ag INTO NAME measure VALUE goals), k AS (SELECT DISTINCT measure FROM u), g AS (SELECT unnest(range(0, (SELECT max(goals) FROM u) + 1))::BIGINT AS goals)
SELECT k.measure, g.goals, count(u.match_id) AS matches FROM k CROSS JOIN g LEFT JOIN u ON u.measure = k.measure AND u.goals = g.goals GROUP BY ALL""")
def goal_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Unpivot, then a dense grid of measures and values, up to the greatest there is, with zero fill."""
    long = facts(spark, sf).select("match_id", "hg", "ag").unpivot("match_id", ["hg", "ag"], "measure", "goals")
    counts = long.groupBy("measure", "goals").agg(F.count("*").alias("n"))
    # the grid is as wide as the distinct goals: one row of bounds
    bounds = counts.agg(F.max("goals").alias("top"), F.collect_set("measure").alias("measures"))
    grid = bounds.select(F.explode("measures").alias("measure"), "top").select("measure", F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("goals"))
    return grid.join(counts, ["measure", "goals"], "left").select("measure", "goals", F.coalesce("n", F.lit(0)).alias("matches"))


@query("""WITH r AS (SELECT DISTINCT fixture_id, revision_id, home_score, away_score, updated_at FROM product_fixtures), p AS (SELECT *, lag(home_score) OVER w AS h, lag(away_score) OVER w AS a, lag(revision_id) OVER w AS before FROM r WINDOW w AS (PARTITION BY fixture_id ORDER BY updated_at, revision_id))
SELECT fixture_id, count(*) FILTER (WHERE home_score IS NOT DISTINCT FROM h AND away_score IS NOT DISTINCT FROM a) AS unchanged, count(*) FILTER (WHERE home_score IS DISTINCT FROM h OR away_score IS DISTINCT FROM a) AS changed FROM p WHERE before IS NOT NULL GROUP BY fixture_id""")
def score_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Null-safe comparison of consecutive revisions."""
    w = Window.partitionBy("fixture_id").orderBy("updated_at", "revision_id")
    r = table(spark, sf, "product_fixtures").select("fixture_id", "revision_id", "home_score", "away_score", "updated_at").distinct()
    p = r.select("fixture_id", "home_score", "away_score", F.lag("home_score").over(w).alias("h"), F.lag("away_score").over(w).alias("a"), F.lag("revision_id").over(w).alias("before")).where("before is not null")
    same = F.col("home_score").eqNullSafe(F.col("h")) & F.col("away_score").eqNullSafe(F.col("a"))
    return p.groupBy("fixture_id").agg(F.count_if(same).alias("unchanged"), F.count_if(~same).alias("changed"))


@query("""WITH f AS (SELECT DISTINCT match_id FROM frozen_forecast), m AS (SELECT DISTINCT match_id FROM open_matches) SELECT CASE WHEN f.match_id IS NULL THEN 'no forecast' WHEN m.match_id IS NULL THEN 'no match' ELSE 'aligned' END AS state, count(*) AS matches FROM f FULL OUTER JOIN m ON f.match_id = m.match_id GROUP BY ALL""")
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one alignment of forecasts and matches with what is missing on either side."""
    f = table(spark, sf, "frozen_forecast").select("match_id").distinct().withColumn("f", F.lit(True))
    m = table(spark, sf, "open_matches").select("match_id").distinct().withColumn("m", F.lit(True))
    state = F.when(F.col("f").isNull(), "no forecast").when(F.col("m").isNull(), "no match").otherwise("aligned")
    return f.join(m, "match_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("matches"))


@query(f"""{ALL}, e AS (SELECT DISTINCT home AS a, away AS b FROM facts WHERE hg - ag >= 4), w AS (WITH RECURSIVE r(node, depth) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 12) SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT node, depth FROM w""")
def beaten_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Reachability by breadth-first search: who is reached from team 0 over wins by four or more, and in how many steps."""
    e = facts(spark, sf).where("hg - ag >= 4").select("home", "away").distinct()
    return graphs.reachable(e, "home", "away", spark.createDataFrame([(0,)], "node bigint"))


@query(f"""{ALL}, e AS (SELECT DISTINCT home AS a, away AS b FROM facts WHERE hg = 6 OR ag = 6), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS node FROM d),
c AS (WITH RECURSIVE r(node, seen) AS (SELECT node, node FROM n UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node) SELECT node, component FROM c""")
def team_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the graph of teams that met in a match with six goals on a side."""
    e = facts(spark, sf).where("hg = 6 or ag = 6").select("home", "away").distinct()
    return graphs.components(e, "home", "away")


@query("""WITH m AS (SELECT match_id, min(provider_match_id) AS provider_match_id FROM open_matches GROUP BY match_id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY updated_at DESC, revision_id DESC) AS i FROM (SELECT DISTINCT fixture_id, revision_id, status, updated_at FROM product_fixtures)) WHERE i = 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY training_cutoff DESC NULLS LAST, forecast_id DESC) AS i FROM (SELECT DISTINCT match_id, forecast_id, training_cutoff, lambda_home FROM frozen_forecast)) WHERE i = 1),
l AS (SELECT match_id, count(*) AS stints FROM lineups GROUP BY match_id)
SELECT m.match_id, m.provider_match_id, r.status, f.forecast_id, round(f.lambda_home, 6) AS lambda_home, coalesce(l.stints, 0) AS stints FROM m LEFT JOIN r ON r.fixture_id = m.match_id LEFT JOIN f ON f.match_id = m.match_id LEFT JOIN l ON l.match_id = m.match_id""")
def fixture_board(spark: SparkSession, sf: str) -> DataFrame:
    """The serving join: one row per match with its latest revision, latest forecast and stint count."""
    m = table(spark, sf, "open_matches").groupBy("match_id").agg(F.min("provider_match_id").alias("provider_match_id"))
    r = temporal.latest_per_key(table(spark, sf, "product_fixtures").select(F.col("fixture_id").alias("match_id"), "revision_id", "status", "updated_at"), ["match_id"], ["updated_at", "revision_id"]).select("match_id", "status")
    f = temporal.latest_per_key(table(spark, sf, "frozen_forecast").select("match_id", "forecast_id", "training_cutoff", "lambda_home"), ["match_id"], ["training_cutoff", "forecast_id"])
    n = table(spark, sf, "lineups").groupBy("match_id").agg(F.count("*").alias("stints"))
    out = m.join(r, "match_id", "left").join(f, "match_id", "left").join(n, "match_id", "left")
    return out.select("match_id", "provider_match_id", "status", "forecast_id", F.round("lambda_home", 6).alias("lambda_home"), F.coalesce("stints", F.lit(0)).alias("stints"))


@query(f"""{ALL} SELECT competition_id, season, count(*) AS matches, count(DISTINCT home) AS hosts, count(*) FILTER (WHERE hg > ag) AS home_wins, round(avg(CASE WHEN hg > ag THEN 1.0 ELSE 0.0 END), 6) AS home_rate, round(avg(hx), 6) AS mean_hx, bool_and(known > ko) AS all_later, bool_or(hx IS NULL) AS any_missing, min(ko) AS first_ko, max(known) AS last_known FROM facts GROUP BY ALL HAVING count(*) >= 10""")
def competition_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped, filtered and distinct aggregates with having and boolean folds."""
    return (
        facts(spark, sf)
        .groupBy("competition_id", "season")
        .agg(
            F.count("*").alias("matches"), F.count_distinct("home").alias("hosts"), F.count_if(F.col("hg") > F.col("ag")).alias("home_wins"), F.round(F.avg(F.when(F.col("hg") > F.col("ag"), 1.0).otherwise(0.0)), 6).alias("home_rate"),
            F.round(F.avg("hx"), 6).alias("mean_hx"), F.bool_and(F.col("known") > F.col("ko")).alias("all_later"), F.bool_or(F.col("hx").isNull()).alias("any_missing"), F.min("ko").alias("first_ko"), F.max("known").alias("last_known"),
        )
        .where("matches >= 10")
    )


@query(f"""{ALL} SELECT home, sha256(string_agg(match_id || ':' || hg || ':' || ag, ',' ORDER BY match_id)) AS fingerprint, count(*) AS matches, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM facts GROUP BY home""")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered documents and their SHA-256 per group, with ordered distinct sets."""
    line = F.concat_ws(":", "match_id", "hg", "ag")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("match_id", line.alias("line")))), lambda x: x["line"]), ",")
    return facts(spark, sf).groupBy("home").agg(F.sha2(ordered, 256).alias("fingerprint"), F.count("*").alias("matches"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))


@query(f"""{CLEAN}, n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ko) - 1 AS prior FROM sides)
SELECT match_id, team, round(avg(gf) OVER w, 6) AS gf10, round(avg(ga) OVER w, 6) AS ga10, round(avg(xf) OVER w, 6) AS xf10, round(avg(points) OVER w, 6) AS ppg10, round(avg(CASE WHEN ga = 0 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS clean10, prior >= 10 AS enough FROM n WINDOW w AS (PARTITION BY team ORDER BY ko ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def rolling_form(spark: SparkSession, sf: str) -> DataFrame:
    """Means of a team's last ten matches before each kick-off, nulls left out, with whether there were ten."""
    s = sides(clean_facts(spark, sf)).select("match_id", "team", "ko", "gf", "ga", "xf", "points", F.when(F.col("ga") == 0, 1.0).otherwise(0.0).alias("clean"))
    means = {"gf": "gf10", "ga": "ga10", "xf": "xf10", "points": "ppg10", "clean": "clean10"}
    last = lambda w, number: {out: F.round(F.avg(c).over(w.rowsBetween(-10, -1)), 6) for c, out in means.items()} | {"enough": number > 10}
    return temporal.with_neighbours(s, ["team"], "ko", [], PERIOD, last, 10).drop("ko", *means)


@query(f"""{CLEAN}, r AS (SELECT team, match_id, ko, at_home, points, row_number() OVER (PARTITION BY team ORDER BY ko DESC, match_id) AS i, row_number() OVER (PARTITION BY team, at_home ORDER BY ko DESC, match_id) AS j FROM sides),
f AS (SELECT team, 'LAST_5' AS form, i AS place, ko, points FROM r WHERE i <= 5 UNION ALL SELECT team, 'LAST_10', i, ko, points FROM r WHERE i <= 10 UNION ALL SELECT team, 'HOME_5', j, ko, points FROM r WHERE at_home AND j <= 5 UNION ALL SELECT team, 'AWAY_5', j, ko, points FROM r WHERE NOT at_home AND j <= 5)
SELECT team, form, string_agg(CASE points WHEN 3 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END, '' ORDER BY place) AS results, sum(points)::BIGINT AS points, count(*) AS played, max(ko) AS latest FROM f GROUP BY ALL""")
def form_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Four windows of a team's latest matches with their result strings; each sorted partition is cut to ten rows per key before the shuffle."""
    s = sides(clean_facts(spark, sf)).select("team", "ko", "match_id", "points", F.explode(F.array(F.lit("ALL"), F.when(F.col("at_home"), "HOME").otherwise("AWAY"))).alias("venue"))
    top = temporal.top_n_per_key(s, ["team", "venue"], [F.desc("ko"), F.col("match_id")], 10)
    letter = F.when(F.col("points") == 3, "W").when(F.col("points") == 1, "D").otherwise("L")
    rows = top.groupBy("team", "venue").agg(F.array_sort(F.collect_list(F.struct((-F.col("ko")).alias("t"), "match_id", letter.alias("r"), "points", "ko"))).alias("rows"))
    forms = F.when(F.col("venue") == "ALL", F.array(F.struct(F.lit("LAST_5").alias("form"), F.lit(5).alias("n")), F.struct(F.lit("LAST_10").alias("form"), F.lit(10).alias("n")))).otherwise(F.array(F.struct(F.concat("venue", F.lit("_5")).alias("form"), F.lit(5).alias("n"))))
    long = rows.select("team", "rows", F.inline(forms)).withColumn("taken", F.slice("rows", F.lit(1), F.col("n")))
    total = F.aggregate("taken", F.lit(0).cast("bigint"), lambda a, x: a + x["points"])
    return long.select("team", "form", F.array_join(F.transform("taken", lambda x: x["r"]), "").alias("results"), total.alias("points"), F.size("taken").cast("long").alias("played"), F.get("taken", F.lit(0))["ko"].alias("latest"))


_SPANS = (3, 7, 14, 30)


@query(f"""{CLEAN} SELECT match_id, team, {', '.join(f'count(*) OVER (PARTITION BY team ORDER BY ko RANGE BETWEEN {d * DAY} PRECEDING AND 1 PRECEDING) AS last_{d}' for d in _SPANS)} FROM sides""")
def congestion(spark: SparkSession, sf: str) -> DataFrame:
    """Matches in the 3, 7, 14 and 30 days before each kick-off: time-range frames over periods that begin with the end of the one before."""
    counts = lambda w: {f"last_{d}": F.count("*").over(w.rangeBetween(-d * DAY, -1)) for d in _SPANS}
    return temporal.with_recent(sides(clean_facts(spark, sf)).select("match_id", "team", "ko"), ["team"], "ko", max(_SPANS) * DAY, PERIOD, counts).drop("ko")


@query(f"""{ALL}, g AS (SELECT avg(CASE WHEN hg > ag THEN 1.0 ELSE 0.0 END) AS p FROM facts) SELECT competition_id, count(*) AS n, round(avg(hg), 6) AS mean_home, round(avg(ag), 6) AS mean_away, round(count(*) / (count(*) + 50.0) * avg(CASE WHEN hg > ag THEN 1.0 ELSE 0.0 END) + 50.0 / (count(*) + 50.0) * (SELECT p FROM g), 6) AS shrunk_home FROM facts GROUP BY competition_id""")
def shrunk_priors(spark: SparkSession, sf: str) -> DataFrame:
    """Competition means, and rates shrunk towards the overall rate by sample size."""
    m = facts(spark, sf)
    win = F.when(F.col("hg") > F.col("ag"), 1.0).otherwise(0.0)
    per = m.groupBy("competition_id").agg(F.count("*").alias("n"), F.avg("hg").alias("h"), F.avg("ag").alias("a"), F.sum(win).alias("w"))
    every = per.agg((F.sum("w") / F.sum("n")).alias("p"))
    share = F.col("n") / (F.col("n") + 50.0)
    return per.join(F.broadcast(every), F.lit(True)).select("competition_id", "n", F.round("h", 6).alias("mean_home"), F.round("a", 6).alias("mean_away"), F.round(share * F.col("w") / F.col("n") + (1 - share) * F.col("p"), 6).alias("shrunk_home"))


@query(f"""{ALL} SELECT match_id, dense_rank() OVER (ORDER BY ko) AS batch FROM facts""")
def chronological_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of equal kick-off, numbered in time: ranks of the distinct moments, joined back, so that matches are not sorted in one task."""
    m = facts(spark, sf).select("match_id", "ko")
    # distinct moments in range partitions, counted per partition: the offsets are one row per partition
    moments = m.select("ko").distinct().withColumn("part", F.floor(F.col("ko") / (90 * DAY)))
    before = moments.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = moments.join(before, "part").select("ko", (F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("ko"))).alias("batch"))
    return m.join(ranked, "ko").select("match_id", "batch")


PRIOR = """e AS (SELECT competition_id, known * 2 AS t, (hg > ag)::INT AS h, (hg = ag)::INT AS d, (hg < ag)::INT AS a, NULL::BIGINT AS id FROM facts UNION ALL SELECT competition_id, ko * 2 + 1, 0, 0, 0, match_id FROM facts),
prior AS (SELECT id AS match_id, hs, ds, as_, hs + ds + as_ AS seen FROM (SELECT id, sum(h) OVER p AS hs, sum(d) OVER p AS ds, sum(a) OVER p AS as_ FROM e WINDOW p AS (PARTITION BY competition_id ORDER BY t RANGE UNBOUNDED PRECEDING)) WHERE id IS NOT NULL)"""


def running_priors(spark: SparkSession, sf: str) -> DataFrame:
    """match_id, hs, ds, as_: home wins, draws and away wins of a match's competition that were known by its kick-off; results and kick-offs merged in one running sum, no range join."""
    m = facts(spark, sf)
    one = lambda cond: F.when(cond, 1).otherwise(0)
    results = F.struct((F.col("known") * 2).alias("t"), one(F.col("hg") > F.col("ag")).alias("h"), one(F.col("hg") == F.col("ag")).alias("d"), one(F.col("hg") < F.col("ag")).alias("a"), F.lit(None).cast("bigint").alias("id"))
    asks = F.struct((F.col("ko") * 2 + 1).alias("t"), F.lit(0).alias("h"), F.lit(0).alias("d"), F.lit(0).alias("a"), F.col("match_id").alias("id"))
    e = m.select("competition_id", F.inline(F.array(results, asks)))
    # combined by moment first: a running sum then has a row per competition and moment, however many matches share it
    known = e.where("id is null").groupBy("competition_id", "t").agg(F.sum("h").alias("h"), F.sum("d").alias("d"), F.sum("a").alias("a")).withColumn("id", F.lit(None).cast("bigint"))
    e = temporal.running_sums(known.unionByName(e.where("id is not null").select(*known.columns)), ["competition_id"], "t", {"hs": "h", "ds": "d", "as_": "a"}, 2 * PERIOD).where("id is not null")
    return e.select(F.col("id").alias("match_id"), "hs", "ds", "as_")


@query(f"""{ALL}, {PRIOR} SELECT match_id, round((hs + 1.0) / (seen + 3.0), 6) AS prior_home, round((ds + 1.0) / (seen + 3.0), 6) AS prior_draw, round((as_ + 1.0) / (seen + 3.0), 6) AS prior_away, seen::BIGINT AS seen FROM prior""")
def running_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed rates of the three results among those known by a kick-off."""
    seen = F.col("hs") + F.col("ds") + F.col("as_")
    p = lambda c: F.round((F.col(c) + 1.0) / (seen + 3.0), 6)
    return running_priors(spark, sf).select("match_id", p("hs").alias("prior_home"), p("ds").alias("prior_draw"), p("as_").alias("prior_away"), seen.alias("seen"))


@query(f"""{ALL}, r AS (SELECT home, away, row_number() OVER (PARTITION BY home ORDER BY ko DESC, match_id DESC) - 1 AS i FROM facts) SELECT home, away, round(sum(pow(0.85, i)), 6) AS preference, count(*) AS times FROM r GROUP BY ALL""")
def recency_preference(spark: SparkSession, sf: str) -> DataFrame:
    """Preference by geometrically decaying weight of all appearances, the latest first."""
    r = temporal.numbered(facts(spark, sf).select("home", "away", (-F.col("ko")).alias("t"), (-F.col("match_id")).alias("id")), ["home"], "t", ["id"], PERIOD, "i")
    return r.groupBy("home", "away").agg(F.round(F.sum(F.pow(F.lit(0.85), F.col("i") - 1)), 6).alias("preference"), F.count("*").alias("times"))


@query("""WITH m AS (SELECT DISTINCT provider_code, provider_team_id, provider_team_name, last_seen_at, mapping_id FROM provider_mapping), w AS (SELECT *, row_number() OVER (PARTITION BY provider_code, provider_team_id ORDER BY last_seen_at DESC NULLS LAST, mapping_id DESC) AS i, min(provider_team_name) OVER p AS lo, max(provider_team_name) OVER p AS hi, count(*) OVER (PARTITION BY provider_code, provider_team_id) AS rows FROM m WINDOW p AS (PARTITION BY provider_code, provider_team_id, last_seen_at))
SELECT provider_code, provider_team_id, mapping_id, lo IS DISTINCT FROM hi AS conflict, rows FROM w WHERE i = 1""")
def conflicting_names(spark: SparkSession, sf: str) -> DataFrame:
    """Latest row per key, whether rows of its very moment contradict each other, and how many rows the key has."""
    m = table(spark, sf, "provider_mapping").select("provider_code", "provider_team_id", "provider_team_name", "last_seen_at", "mapping_id").distinct()
    at = m.groupBy("provider_code", "provider_team_id", "last_seen_at").agg(F.max("mapping_id").alias("mapping_id"), F.min("provider_team_name").alias("lo"), F.max("provider_team_name").alias("hi"), F.count("*").alias("n"))
    order = F.struct(F.col("last_seen_at").isNotNull(), "last_seen_at")
    out = at.groupBy("provider_code", "provider_team_id").agg(F.max_by(F.struct("mapping_id", "lo", "hi"), order).alias("r"), F.sum("n").alias("rows"))
    return out.select("provider_code", "provider_team_id", "r.mapping_id", (~F.col("r.lo").eqNullSafe(F.col("r.hi"))).alias("conflict"), "rows")


@query(f"""{ALL} SELECT match_id, ko FROM facts ORDER BY ko DESC, match_id LIMIT 21 OFFSET 40""")
def page_of_matches(spark: SparkSession, sf: str) -> DataFrame:
    """A page of twenty with one row of look-ahead, in a total order."""
    return facts(spark, sf).select("match_id", "ko").orderBy(F.desc("ko"), "match_id").offset(40).limit(21)


@query(f"""{ALL}, h AS (SELECT DISTINCT home AS team FROM facts WHERE hg >= 5), a AS (SELECT DISTINCT away AS team FROM facts WHERE ag >= 5) SELECT 'both' AS part, team FROM (SELECT team FROM h INTERSECT SELECT team FROM a) UNION ALL SELECT 'home only', team FROM (SELECT team FROM h EXCEPT SELECT team FROM a) UNION ALL SELECT 'either', team FROM (SELECT team FROM h UNION SELECT team FROM a)""")
def set_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection, difference and union of two sets of teams, from one aggregate instead of three set operations."""
    m = facts(spark, sf)
    long = m.select(F.inline(F.array(F.struct(F.col("home").alias("team"), (F.col("hg") >= 5).alias("h"), F.lit(False).alias("a")), F.struct(F.col("away").alias("team"), F.lit(False).alias("h"), (F.col("ag") >= 5).alias("a")))))
    s = long.groupBy("team").agg(F.bool_or("h").alias("h"), F.bool_or("a").alias("a")).where("h or a")
    parts = F.array_compact(F.array(F.when(F.col("h") & F.col("a"), "both"), F.when(F.col("h") & ~F.col("a"), "home only"), F.lit("either")))
    return s.select(F.explode(parts).alias("part"), "team")


@query(f"""{ALL}, {'''clash AS (SELECT team, ko FROM sides GROUP BY team, ko HAVING count(*) > 1)'''} SELECT DISTINCT match_id FROM sides SEMI JOIN clash USING (team, ko)""")
def impossible_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Matches in which a team plays twice at one moment."""
    return quarantined(facts(spark, sf))


@query(f"""{ALL}, k AS (SELECT home, away, ko // {DAY} AS day, count(*) AS n, count(DISTINCT provider) AS providers, count(DISTINCT hg * 100 + ag) AS scores, min(match_id) AS kept FROM facts GROUP BY ALL) SELECT kept, n, CASE WHEN n = 1 THEN 'UNIQUE' WHEN scores > 1 THEN 'AMBIGUOUS' ELSE 'DUPLICATE' END AS state FROM k""")
def fixture_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Exact clustering of fixtures by teams and day, with the reason of each cluster."""
    k = facts(spark, sf).groupBy("home", "away", F.floor(F.col("ko") / DAY).alias("day")).agg(F.count("*").alias("n"), F.count_distinct(F.col("hg") * 100 + F.col("ag")).alias("scores"), F.min("match_id").alias("kept"))
    return k.select("kept", "n", F.when(F.col("n") == 1, "UNIQUE").when(F.col("scores") > 1, "AMBIGUOUS").otherwise("DUPLICATE").alias("state"))


@query(f"""{ALL} SELECT home, season, count(DISTINCT provider) AS providers, (max(hg) - min(hg))::BIGINT AS spread, CASE WHEN count(DISTINCT provider) < 2 THEN 'SINGLE' WHEN max(hg) - min(hg) <= 3 THEN 'CORROBORATED' ELSE 'REVIEW' END AS state FROM facts GROUP BY ALL""")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Reconciliation of a field over providers: within tolerance or for review, never a chosen winner."""
    k = facts(spark, sf).groupBy("home", "season").agg(F.count_distinct("provider").alias("providers"), (F.max("hg") - F.min("hg")).alias("spread"))
    return k.withColumn("state", F.when(F.col("providers") < 2, "SINGLE").when(F.col("spread") <= 3, "CORROBORATED").otherwise("REVIEW"))

"""Recent form by named windows: which results count, in what order, on which score, and what is doubtful about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import temporal
from touchline.session import cut

# The windows (basis, scope, venue, matches asked for), and how long ago the oldest match may lie before a window is stale.
WINDOWS = {
    "OFFICIAL_ALL_5": ("OFFICIAL", "ALL_COMPETITIONS", "ALL", 5),
    "OFFICIAL_ALL_10": ("OFFICIAL", "ALL_COMPETITIONS", "ALL", 10),
    "OFFICIAL_COMPETITION_5": ("OFFICIAL", "SAME_COMPETITION", "ALL", 5),
    "OFFICIAL_HOME_5": ("OFFICIAL", "ALL_COMPETITIONS", "HOME", 5),
    "OFFICIAL_AWAY_5": ("OFFICIAL", "ALL_COMPETITIONS", "AWAY", 5),
    "PLAYED_ALL_5": ("PLAYED", "ALL_COMPETITIONS", "ALL", 5),
    "FORECAST_ELIGIBLE_ALL_5": ("FORECAST_ELIGIBLE", "ALL_COMPETITIONS", "ALL", 5),
}
STALE_DAYS = 180
_DAY = 86_400
#: Length of the periods by which the numbering of a team's matches is split, in seconds.
PERIOD = 90 * _DAY


def competition_scope(kind: Column, name: Column) -> Column:
    """FRIENDLY by its name, else LEAGUE or CUP by its kind, else UNCLASSIFIED."""
    return F.when(F.coalesce(name.rlike(r"(?i)\bfriendl(y|ies)\b"), F.lit(False)), "FRIENDLY").when(kind.isin("LEAGUE", "CUP"), kind).otherwise("UNCLASSIFIED")


def candidates(official: DataFrame, played: DataFrame, scopes: DataFrame) -> DataFrame:
    """A row per side of each match that has an official result or a qualified played one, the two scores kept apart.

    ``official``: fixture_id, competition_id, ko (seconds), home, away, hg, ag, status, basis; ``played``: fixture_id, competition_id, ko, home, away, hg, ag, exact (whether its
    kick-off is more than a day); ``scopes``: competition_id, scope. One row per fixture in each. Columns: team, fixture_id, ko, at_home, competition_id, scope, gf, ga (official, if there
    is one), pf, pa (played, else official), qualified, awarded, only_awarded, basis, day_only.
    """
    o = official.select("fixture_id", F.struct("competition_id", "ko", "home", "away", "hg", "ag", "status", "basis").alias("o"))
    p = played.select("fixture_id", F.struct("competition_id", "ko", "home", "away", "hg", "ag", "exact").alias("p"))
    m = o.join(p, "fixture_id", "full")
    first = lambda f: F.coalesce(F.col(f"o.{f}"), F.col(f"p.{f}"))
    has_p = F.col("p").isNotNull()
    awarded = F.coalesce(F.col("o.status") == "AWARDED", F.lit(False))
    m = m.select(
        "fixture_id", first("ko").alias("ko"), first("competition_id").alias("competition_id"), first("home").alias("home"), first("away").alias("away"), first("hg").alias("hg"), first("ag").alias("ag"),
        F.coalesce("p.hg", "o.hg").alias("ph"), F.coalesce("p.ag", "o.ag").alias("pa_"), has_p.alias("qualified"), awarded.alias("awarded"), (awarded & ~has_p).alias("only_awarded"),
        F.when(has_p & ~awarded, "REGULATION_90").otherwise(F.coalesce("o.basis", F.lit("REGULATION_90"))).alias("basis"), F.coalesce(~F.col("p.exact"), F.lit(False)).alias("day_only"),
    )
    m = m.join(scopes, "competition_id", "left").withColumn("scope", F.coalesce("scope", F.lit("UNCLASSIFIED")))
    side = lambda team, home, a, b, c, d: F.struct(F.col(team).alias("team"), F.lit(home).alias("at_home"), F.col(a).alias("gf"), F.col(b).alias("ga"), F.col(c).alias("pf"), F.col(d).alias("pa"))
    rows = F.array(side("home", True, "hg", "ag", "ph", "pa_"), side("away", False, "ag", "hg", "pa_", "ph"))
    return m.select("fixture_id", "ko", "competition_id", "scope", "qualified", "awarded", "only_awarded", "basis", "day_only", F.inline(rows)).where("team is not null")


def _letter(a: Column, b: Column) -> Column:
    return F.when(a > b, "W").when(a < b, "L").otherwise("D")


def _any(flag: str) -> Column:
    return F.exists("taken", lambda r: r[flag])


def form(targets: DataFrame, sides: DataFrame, pending: DataFrame) -> DataFrame:
    """fixture_id, team, form, actual, coverage, flags (sorted), results (newest first), fixtures, oldest: every window of every team of a target.

    ``targets``: fixture_id, team, competition_id, ko; ``sides``: see ``candidates``; ``pending``: team, ko of matches whose result is awaited (for the target's team, before the target).
    Candidates are those that kicked off strictly before the target; one more than asked for is looked at for the order. Targets without a kick-off have no windows.
    A target without candidates has empty windows. Repeated targets count once.
    """
    t = targets.select("fixture_id", "team", F.coalesce("competition_id", F.lit("")).alias("t_comp"), F.col("ko").alias("t_ko")).where("t_ko is not null").distinct()
    official = F.col("scope") != "FRIENDLY"
    in_basis = {
        "OFFICIAL": official,
        "PLAYED": official & ~F.col("only_awarded") & (F.col("qualified") | (F.col("basis") != "UNKNOWN")),
        "FORECAST_ELIGIBLE": F.col("qualified") & ~F.col("awarded"),
    }

    def member(name: str) -> Column:
        basis, scope, venue, _ = WINDOWS[name]
        fits = in_basis[basis]
        if venue != "ALL":
            fits = fits & (F.col("at_home") == F.lit(venue == "HOME"))
        same = scope == "SAME_COMPETITION"
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(name).alias("form"), (F.coalesce("competition_id", F.lit("")) if same else F.lit("")).alias("within"), F.lit(basis != "OFFICIAL").alias("on_field")))

    def asked(name: str) -> Column:
        _, scope, _, n = WINDOWS[name]
        return F.struct(F.lit(name).alias("form"), (F.col("t_comp") if scope == "SAME_COMPETITION" else F.lit("")).alias("within"), F.lit(n).alias("asked"))

    # the candidates of each window of a team are numbered in time; a target asks for the last numbers before it, so that no pair of a target and an older match is formed
    keys = ["team", "form", "within"]
    long = sides.where("ko is not null").select("team", F.col("fixture_id").alias("match"), F.col("ko").alias("m_ko"), "scope", "gf", "ga", "pf", "pa", "qualified", "awarded", "basis", "day_only", F.inline(F.array_compact(F.array(*[member(n) for n in WINDOWS]))))
    long = cut(temporal.numbered(long, keys, "m_ko", [F.desc("match")], PERIOD, "number"))
    asks = t.select("fixture_id", "team", "t_ko", F.inline(F.array(*[asked(n) for n in WINDOWS])))
    merged = asks.select(*keys, "fixture_id", "asked", F.col("t_ko").alias("m_ko"), F.lit(0).alias("one")).unionByName(long.select(*keys, F.lit(None).cast("string").alias("fixture_id"), F.lit(None).cast("int").alias("asked"), "m_ko", F.lit(1).alias("one")))
    asks = cut(temporal.running_sums(merged, keys, "m_ko", {"before": "one"}, PERIOD, strict=True).where("asked is not null").withColumnRenamed("m_ko", "t_ko").drop("one"))
    wanted = asks.where("before > 0").withColumn("number", F.explode(F.sequence(F.greatest(F.col("before") - F.col("asked"), F.lit(1)), F.col("before"))))
    top = wanted.join(long, [*keys, "number"]).withColumn("place", (F.col("before") - F.col("number") + 1).cast("int"))
    shootout = F.col("basis") == "PENALTY_SHOOTOUT"
    result = F.when(F.col("on_field"), _letter(F.col("pf"), F.col("pa"))).otherwise(F.when(shootout, "D").otherwise(_letter(F.col("gf"), F.col("ga"))))
    row = F.struct("place", "match", "m_ko", result.alias("result"), "day_only", *[v.alias(k) for k, v in {
        "SCORE_CONFLICT": ~F.col("awarded") & ((F.col("gf") != F.col("pf")) | (F.col("ga") != F.col("pa"))), "UNQUALIFIED_RESULT": ~F.col("qualified"), "AWARDED_INCLUDED": F.col("awarded"),
        "UNKNOWN_SCORE_BASIS": F.col("basis") == "UNKNOWN", "UNCLASSIFIED_COMPETITION": F.col("scope") == "UNCLASSIFIED",
    }.items()])
    lists = top.groupBy("fixture_id", "team", "form").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    every = asks.select("fixture_id", "team", "t_ko", "form", "asked").join(lists, ["fixture_id", "team", "form"], "left")
    taken = F.coalesce(F.filter("rows", lambda r: r["place"] <= F.col("asked")), F.array().cast(lists.schema["rows"].dataType))
    every = every.withColumn("taken", taken).withColumn("oldest", F.element_at(F.transform("taken", lambda r: r["m_ko"]), F.when(F.size("taken") > 0, -1)))
    awaited = pending.select("team", F.col("ko").alias("p_ko"), F.lit(True).alias("p")).where("p_ko is not null").distinct()
    latest = temporal.asof_join(t.select("fixture_id", "team", "t_ko").distinct(), awaited.withColumn("awaited", F.col("p_ko")), ["team"], "t_ko", "p_ko", ["awaited"], inclusive=False)
    every = every.join(latest, ["fixture_id", "team", "t_ko"], "left")
    day = lambda x: F.floor(x / _DAY)
    doubtful = F.exists(F.transform(F.sequence(F.lit(2), F.size("rows")), lambda i: F.struct(F.get("rows", i - 2).alias("a"), F.get("rows", i - 1).alias("b"))), lambda p: (p["a"]["m_ko"] == p["b"]["m_ko"]) | ((day(p["a"]["m_ko"]) == day(p["b"]["m_ko"])) & (p["a"]["day_only"] | p["b"]["day_only"])))
    flags = {
        "ORDER_AMBIGUOUS": F.when(F.size("rows") >= 2, doubtful),
        "STALE": F.col("t_ko") - F.col("oldest") > STALE_DAYS * _DAY,
        "RESULT_PENDING": F.col("awaited").isNotNull() & ((F.size("taken") < F.col("asked")) | F.col("oldest").isNull() | (F.col("awaited") >= F.col("oldest"))),
        **{k: _any(k) for k in ("SCORE_CONFLICT", "UNQUALIFIED_RESULT", "AWARDED_INCLUDED", "UNKNOWN_SCORE_BASIS", "UNCLASSIFIED_COMPETITION")},
    }
    raised = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags.items()])))
    n = F.size("taken")
    return every.select(
        "fixture_id", "team", "form", n.alias("actual"), F.when(n == 0, "EMPTY").when(n == F.col("asked"), "COMPLETE").otherwise("PARTIAL").alias("coverage"), F.array_join(raised, ",").alias("flags"),
        F.array_join(F.transform("taken", lambda r: r["result"]), "").alias("results"), F.array_join(F.transform("taken", lambda r: r["match"]), ",").alias("fixtures"), "oldest",
    )

"""Matching records of two sources without a key by soft logic.

Candidate pairs come from the pigeonhole join of the two sides' name words within neighbouring days. Each pair is a variable in [0, 1], and so is
each pair of spellings; weighted rules bind them:

    similar names                        ->  link                       (similarity)
    link                                 ->  days and scores agree      (similarity)
    link                                 ->  the spellings are aliases  (transitivity: a link carries over to the names)
    both aliases                         ->  link                       (transitivity: and back to other records with these names)
    alias                                <-> similar spellings
    links of one record together at most 1                              (exclusivity)

With Lukasiewicz logic their violation is a sum of hinges, convex in all variables, and is minimised by the alternating direction method
of multipliers: the rules of a record are solved together, given what all records think of the aliases, then the aliases are
averaged over the records, until both agree and stand still. The values reached are the confidences.

Exclusivity binds the left records only: a match of the right source may well be listed in several left rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import canonical, names
from touchline.session import cut, sized_join


@dataclass(frozen=True)
class Rules:
    """Weights of the rules, the steps of the method within and between records, the residual at which it ends (root mean square; rounds: at the latest), and the least confidence and similarity of a match."""

    similar: float = 1.0
    agree: float = 1.0
    carry: float = 0.3
    back: float = 0.2
    alias: float = 1.0
    prior: float = 0.05
    step: float = 1.0
    inner: int = 40
    tolerance: float = 1e-3
    rounds: int = 60
    accept: float = 0.45
    least_similar: float = 0.5


#: Pairs that one task solves at once; it changes no result.
PAIRS_AT_ONCE = 50_000


def folded(text: Column) -> Column:
    """A plain word for comparison: marked letters spelt as one or as two (ae, oe, ue, ny) come out alike, and so do i and l."""
    return names.look_alike(F.regexp_replace(F.regexp_replace(text, "([aou])e", "$1"), "ny", "n"))


def similar_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """look, dot, word: each typed word of ``left`` (look, fold; dot: cut short) with the words of ``right`` (word, fold) it may stand for, by the pigeonhole join over both spellings of either."""
    typed = left.select("look", "dot", F.explode(F.array_distinct(F.array("look", "fold"))).alias("typed"))
    meant = right.select("word", F.explode(F.array_distinct(F.array("word", "fold"))).alias("meant"))
    beginnings = meant.select("word", "meant", F.explode(F.sequence(F.lit(3), F.greatest(F.length("meant") - 1, F.lit(3)))).alias("n")).select("word", F.substr("meant", F.lit(1), F.col("n")).alias("form"), F.lit(True).alias("form_dot"))
    forms = meant.select("word", F.col("meant").alias("form"), F.lit(False).alias("form_dot")).unionByName(beginnings).groupBy("form", "form_dot").agg(F.collect_set("word").alias("owners"))
    found = canonical.probes_of(typed, "typed").join(canonical.segments_of(forms, "form"), "segment").where("dot = form_dot")
    d, n = F.levenshtein("typed", "form", canonical.EDITS), F.least(F.length("typed"), F.length("form"))
    # the slips that make two words alike at all, see word_likeness
    alike = (d == 0) | ((d == 1) & (n >= canonical.LEAST_LENGTH)) | ((d == 2) & ((n >= 9) | ((n >= canonical.LEAST_LENGTH) & names.swapped(F.col("typed"), F.col("form")))))
    found = found.where(alike).select("look", "dot", F.explode("owners").alias("word"))
    # words too short for segments only stand for themselves
    short = left.where("length(look) <= 2").join(right.select("word", F.col("word").alias("look")), "look").select("look", "dot", "word")
    return found.unionByName(short).distinct()


def word_likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two words (struct look, fold, dot): 1 if equal, less by slips, exchanged letters and cut ends; in the spelling in which they are more alike.

    Step by step through arrays of one: a lambda's argument is computed once, however often it is used.
    """
    spellings = F.array_distinct(F.array(*[F.struct(a[k].alias("x"), b[k].alias("y")) for k in ("look", "fold")]))
    measured = F.transform(spellings, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.levenshtein(p["x"], p["y"], canonical.EDITS).alias("d"), F.least(F.length(p["x"]), F.length(p["y"])).alias("n")))

    def cut_short(dot: Column, p: Column, q: Column) -> Column:
        start = F.substr(q, F.lit(1), F.length(p))
        return F.when(dot & (F.length(p) >= 3), F.when(start == p, 0.92).when((F.length(p) >= 5) & (F.levenshtein(start, p, 1) == 1), 0.84))

    def likeness(m: Column) -> Column:
        d, n = m["d"], m["n"]
        whole = F.when(d == 0, 1.0).when((d == 1) & (n >= 5), 0.94).when((d == 2) & (n >= 5) & names.swapped(m["x"], m["y"]), 0.94).when((d == 2) & (n >= 9), 0.82)
        return F.greatest(F.coalesce(whole, F.lit(0.0)), F.coalesce(cut_short(a["dot"], m["x"], m["y"]), F.lit(0.0)), F.coalesce(cut_short(b["dot"], m["y"], m["x"]), F.lit(0.0)))

    return F.array_max(F.transform(measured, likeness))


def _common_likeness(ra: Column, rb: Column) -> Column:
    """How well the words beside the own ones agree (``ra``, ``rb``: the rest of either name)."""
    x, y = F.get(ra, F.lit(0)), F.get(rb, F.lit(0))
    text = lambda r: F.array_join(F.transform(r, lambda t: t["look"]), " ")
    initials = lambda r: F.array_join(F.transform(r, lambda t: F.substring(t["t"], 1, 1)), "")
    one = (F.size(ra) == 1) & (F.size(rb) == 1)
    short = lambda k: names.short_for(x[k], x["dot"], y[k]) | names.short_for(y[k], y["dot"], x[k])
    return (
        F.when((F.size(ra) == 0) & (F.size(rb) == 0), 1.0)
        .when((F.size(ra) == 0) | (F.size(rb) == 0), 0.93)
        .when(text(ra) == text(rb), 1.0)
        .when(one & (short("look") | short("fold")), 0.98)
        .when(one & (canonical.distance(x["look"], y["look"]).isNotNull() | F.arrays_overlap(x["stands"], y["stands"])), 0.96)
        .when(((F.size(ra) > 1) & (initials(ra) == text(rb))) | ((F.size(rb) > 1) & (initials(rb) == text(ra))), 0.98)
        .otherwise(0.35)
    )


def name_likenesses(pairs: Column) -> Column:
    """Per pair of names (struct a, b: struct words of t, look, fold, dot, own, stands; side) 0 to 1: the likeness of their own words, less where the common words clash; 0 for different sides."""

    def best(p: Column) -> Column:
        words = F.flatten(F.transform(p["a"]["words"], lambda x, i: F.transform(F.filter(p["b"]["words"], lambda y: x["own"] & y["own"]), lambda y: F.struct(word_likeness(x, y).alias("s"), (-i).alias("i"), y["look"].alias("y")))))
        top = F.array_max(words)
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), F.when(p["a"]["side"] == p["b"]["side"], top).alias("top"))

    def rest(q: Column) -> Column:
        at = F.array_position(F.transform(q["b"]["words"], lambda w: w["look"]), q["top"]["y"])
        return F.struct(q["top"]["s"].alias("s"), F.filter(q["a"]["words"], lambda _, i: i != -q["top"]["i"]).alias("ra"), F.filter(q["b"]["words"], lambda _, j: j + 1 != at).alias("rb"))

    return F.transform(F.transform(F.transform(pairs, best), rest), lambda r: F.coalesce(r["s"] * _common_likeness(r["ra"], r["rb"]), F.lit(0.0)))


def named_parts(texts: DataFrame, common: DataFrame) -> DataFrame:
    """name, parts (struct of words: t, look, fold, dot, own, stands; and side) of the distinct names of ``texts`` (column name); ``common`` (column word) are words that are no name by themselves.

    A name of common words only has them as its own. ``stands`` are the common words that a word may stand for. Every distinct word is looked at once. Written.
    """
    split = texts.select("name").distinct().withColumn("toks", names.tokens(F.col("name")))
    split = cut(split.select("name", names.sides(F.col("toks")).alias("side"), names.core(F.col("toks")).alias("words")))
    words = split.select(F.explode("words").alias("w")).select("w.t", "w.dot").distinct().withColumns({"look": names.look_alike(F.col("t")), "fold": folded(F.col("t"))})
    words = cut(words)
    common = cut(common.select("word").where("word is not null").distinct().withColumn("look", names.look_alike(F.col("word"))))
    first = lambda c: F.substring(c, 1, 1)
    short = words.join(common.select("word"), first(F.col("t")) == first(F.col("word"))).where((F.col("t") == F.col("word")) | names.short_for(F.col("t"), F.col("dot"), F.col("word"))).select("t", "dot", "word")
    probes = canonical.probes_of(words.where("not dot"), "look").withColumnRenamed("look", "typed")
    slips = probes.join(canonical.segments_of(common, "look"), "segment").where(canonical.distance(F.col("typed"), F.col("look")).isNotNull()).select("t", "dot", "word")
    stands = short.unionByName(slips).groupBy("t", "dot").agg(F.collect_set("word").alias("stands"))
    # a word cut short is always a name's own, any other is unless it is common
    known = words.join(stands, ["t", "dot"], "left").join(common.select(F.col("word").alias("t"), F.lit(True).alias("common")), "t", "left")
    known = cut(known.select("t", "dot", "look", "fold", (F.col("dot") | F.col("common").isNull()).alias("own"), F.coalesce("stands", F.array().cast("array<string>")).alias("stands")))
    long = split.select("name", F.posexplode("words").alias("at", "w")).select("name", "at", "w.t", "w.dot")
    ordered = F.array_sort(F.collect_list(F.struct("at", "t", "look", "fold", "dot", "own", "stands")))
    whole = sized_join(long, known, ["t", "dot"]).groupBy("name").agg(ordered.alias("w"), (~F.bool_or("own")).alias("alone"))
    item = lambda w: F.struct(w["t"].alias("t"), w["look"].alias("look"), w["fold"].alias("fold"), w["dot"].alias("dot"), (w["own"] | F.col("alone")).alias("own"), w["stands"].alias("stands"))
    return cut(split.select("name", "side").join(whole, "name").select("name", F.struct(F.transform("w", item).alias("words"), "side").alias("parts")))


def _own(side: Column) -> Column:
    return F.transform(F.filter(side["words"], lambda w: w["own"]), lambda w: F.struct(w["look"].alias("look"), w["fold"].alias("fold"), w["dot"].alias("dot")))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """i, j: the pairs of records (columns i or j, home, away as parts, day, season) that share a similar word of their own on both sides, in either order, and lie at most a day apart; where ``right`` has no day, in the same season."""
    lw = left.select("i", "day", "season", F.explode(F.array_distinct(_own(F.col("home")))).alias("h"), "away").select("i", "day", "season", "h", F.explode(F.array_distinct(_own(F.col("away")))).alias("a"))
    rw = right.select("j", "day", "season", F.explode(F.array_distinct(_own(F.col("home")))).alias("h"), "away").select("j", "day", "season", "h", F.explode(F.array_distinct(_own(F.col("away")))).alias("a"))
    lw, rw = cut(lw), cut(rw)
    typed, meant = (df.select(F.inline(F.array("h", "a"))).distinct() for df in (lw, rw))
    similar = cut(similar_words(typed, meant.select(F.col("look").alias("word"), "fold").distinct()).groupBy("look", "dot").agg(F.collect_set("word").alias("words")))
    for side in ("h", "a"):
        lw = sized_join(lw.withColumns({"look": F.col(side)["look"], "dot": F.col(side)["dot"]}), similar.withColumnRenamed("words", f"{side}_words"), ["look", "dot"]).drop("look", "dot")
    lw = lw.select("i", "day", "season", F.explode("h_words").alias("h"), "a_words").select("i", "day", "season", "h", F.explode("a_words").alias("a"))
    rw = rw.select("j", "day", "season", F.col("h.look").alias("h"), F.col("a.look").alias("a"))
    ordered = lambda df, key: df.select(key, "day", "season", F.least("h", "a").alias("w1"), F.greatest("h", "a").alias("w2")).distinct()
    lw, rw = ordered(lw, "i"), ordered(rw, "j")
    near = lw.select("i", "w1", "w2", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)).alias("day"))
    dated = near.join(rw.where("day is not null").select("j", "w1", "w2", "day"), ["w1", "w2", "day"]).select("i", "j")
    undated = lw.select("i", "w1", "w2", "season").join(rw.where("day is null and season is not null").select("j", "w1", "w2", "season"), ["w1", "w2", "season"]).select("i", "j")
    return dated.unionByName(undated).distinct()


def evidence(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """i, j, similar, agree, home_key, away_key, home_like, away_like: what the rules know of each pair, in its better order of sides."""
    l = left.select("i", F.struct("home", "away", "day", "home_goals", "away_goals", "home_text", "away_text").alias("l"))  # noqa: E741
    r = right.select("j", F.struct("home", "away", "day", "home_goals", "away_goals", "home_text", "away_text").alias("r"))
    df = pairs.join(l, "i").join(r, "j")
    orders = ("home", "home"), ("away", "away"), ("home", "away"), ("away", "home")
    likes = name_likenesses(F.array(*[F.struct(F.col(f"l.{a}").alias("a"), F.col(f"r.{b}").alias("b")) for a, b in orders]))
    df = df.withColumn("likes", likes).select("i", "j", "l", "r", *[F.col("likes")[n].alias(a[0] + b[0]) for n, (a, b) in enumerate(orders)])
    both = lambda x, y: F.greatest(F.col(x) + F.col(y) - 1, F.lit(0.0))
    # written here: the likenesses are long expressions, and each is used several times below
    df = cut(df).withColumn("crossed", both("ha", "ah") > both("hh", "aa"))
    goals = F.when(F.col("crossed"), F.struct(F.col("r.away_goals").alias("h"), F.col("r.home_goals").alias("a"))).otherwise(F.struct(F.col("r.home_goals").alias("h"), F.col("r.away_goals").alias("a")))
    unknown = F.col("l.home_goals").isNull() | F.col("l.away_goals").isNull() | goals["h"].isNull() | goals["a"].isNull()
    same = (F.col("l.home_goals") == goals["h"]) & (F.col("l.away_goals") == goals["a"])
    undated = F.col("r.day").isNull()
    doubt = (
        F.when(undated, 0.15).when(F.col("l.day") == F.col("r.day"), 0.0).otherwise(0.1)
        + F.when(unknown, F.when(undated, 0.15).otherwise(0.05)).when(same, 0.0).otherwise(F.when(undated, 0.25).otherwise(0.1))
        + F.when(F.col("crossed"), F.when(undated, 0.25).otherwise(0.05)).otherwise(0.0)
    )
    key = lambda a, b: F.xxhash64(F.col(f"l.{a}"), F.col(f"r.{b}"))
    crossed = F.col("crossed")
    return df.select(
        "i", "j", F.when(crossed, both("ha", "ah")).otherwise(both("hh", "aa")).alias("similar"), (1 - doubt).alias("agree"),
        F.when(crossed, key("home_text", "away_text")).otherwise(key("home_text", "home_text")).alias("home_key"), F.when(crossed, key("away_text", "home_text")).otherwise(key("away_text", "away_text")).alias("away_key"),
        F.when(crossed, F.col("ha")).otherwise(F.col("hh")).alias("home_like"), F.when(crossed, F.col("ah")).otherwise(F.col("aa")).alias("away_like"),
    ).where("similar > 0")


def _hinge(values: np.ndarray, signs: tuple[int, ...], offset: np.ndarray | float, weight: float, step: float) -> np.ndarray:
    """Column-wise, where weight * max(0, signs . x + offset) + step / 2 * |x - values|^2 is least: untouched, moved fully, or on the edge of the hinge."""
    c = np.array(signs, dtype=float)[:, None]
    at = (values * c).sum(0) + offset
    move = np.where(at <= 0, 0.0, np.where(at - len(signs) * weight / step >= 0, weight / step, at / len(signs)))
    return values - move * c


#: The variable that each copy of a rule is a copy of: the link (x) or the alias of either side (h, a).
_COPIES = "xxxxhxahax"
_STATE = "part int, i bigint, j string, similar double, agree double, home_key bigint, away_key bigint, home_like double, away_like double, x double, h double, a double, zh double, za double, yh double, ya double, u array<double>, primal double, dual double"


def at_most_one(values: np.ndarray, record: np.ndarray) -> np.ndarray:
    """The closest values that are not negative and sum to at most 1 in each record (numbers from 0): all less by the same amount, which the largest few decide."""
    order = np.lexsort((-values, record))
    v, r = values[order], record[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    total = np.cumsum(v)
    before = np.r_[0.0, total[starts[1:] - 1]]
    segment = np.cumsum(np.r_[True, r[1:] != r[:-1]]) - 1
    rank = np.arange(len(v)) - starts[segment] + 1
    over = np.maximum(np.maximum.reduceat((total - before[segment] - 1) / rank, starts), 0)
    out = np.empty_like(values)
    out[order] = np.maximum(v - over[segment], 0)
    return out


def _local_round(pairs: pd.DataFrame, z: dict[str, np.ndarray], rules: Rules) -> pd.DataFrame:
    """The rules of whole records, solved for their links and their own values of the aliases, which are drawn to what all records together think of them (``z``: h, a)."""
    rho = rules.step
    u = np.stack(pairs["u"].to_numpy()).T
    now = {k: pairs[k].to_numpy(float) for k in "xha"}
    similar, agree = pairs["similar"].to_numpy(), pairs["agree"].to_numpy()
    _, record = np.unique(pairs["i"].to_numpy(), return_inverse=True)
    started = pairs["zh"].notna().to_numpy()
    y = {k: pairs[f"y{k}"].to_numpy() + np.where(started, now[k] - z[k], 0) for k in "ha"}
    primal = np.where(started, sum((now[k] - z[k]) ** 2 for k in "ha"), np.nan)
    dual = np.where(started, sum((pairs[f"z{k}"].to_numpy(float) - z[k]) ** 2 for k in "ha"), np.nan)
    c = np.empty_like(u)
    places = {k: [n for n, x in enumerate(_COPIES) if x == k] for k in "xha"}
    for _ in range(rules.inner):
        v = np.stack([now[k] for k in _COPIES]) - u
        c[0] = _hinge(v[0:1] - rules.prior / rho, (-1,), similar, rules.similar, rho)[0]
        c[1] = _hinge(v[1:2], (1,), -agree, rules.agree, rho)[0]
        c[2] = at_most_one(v[2], record)
        c[[3, 4]] = _hinge(v[[3, 4]], (1, -1), 0.0, rules.carry, rho)
        c[[5, 6]] = _hinge(v[[5, 6]], (1, -1), 0.0, rules.carry, rho)
        c[[7, 8, 9]] = _hinge(v[[7, 8, 9]], (1, 1, -1), agree - 2, rules.back, rho)
        total = c + u
        now["x"] = np.clip(total[places["x"]].mean(0), 0, 1)
        for k in "ha":
            now[k] = np.clip((total[places[k]].sum(0) + z[k] - y[k]) / (len(places[k]) + 1), 0, 1)
        u = total - np.stack([now[k] for k in _COPIES])
    return pairs.assign(x=now["x"], h=now["h"], a=now["a"], zh=z["h"], za=z["a"], yh=y["h"], ya=y["a"], u=list(u.T), primal=primal, dual=dual)


def solve(pairs: DataFrame, rules: Rules, trace: list[float] | None = None) -> DataFrame:
    """i, j, similar, agree, confidence: the values of the links where the method stands still, or after the last of its rounds.

    The pairs of a record lie in one part, where all its rules are solved; only the values of the aliases, one row per pair of spellings, are exchanged between
    the parts. ``trace`` receives the residual of each round: the greater of how far the records are from the aliases' common values, and of how far these moved.
    """
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_AT_ONCE))
    start = {"x": F.least("similar", "agree"), "h": F.col("home_like"), "a": F.col("away_like"), "yh": F.lit(0.0), "ya": F.lit(0.0), "u": F.array_repeat(F.lit(0.0), len(_COPIES))}
    state = pairs.withColumns({"part": F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int")} | start | {c: F.lit(None).cast("double") for c in ("zh", "za", "primal", "dual")})
    columns = [c.strip().split(" ")[0] for c in _STATE.split(",")]
    state = cut(state.select(*columns))
    sides = lambda value: F.inline(F.array(*[F.struct(F.col(f"{side}_key").alias("key"), F.col(f"{side}_like").alias("like"), value(k).alias("t")) for side, k in (("home", "h"), ("away", "a"))]))
    # the parts in which each alias is asked for
    routing = cut(state.select("part", F.explode(F.array("home_key", "away_key")).alias("key")).distinct())
    aliases = state.select(sides(lambda k: F.col(k))).groupBy("key").agg(F.max("like").alias("z"))

    def step(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns})
        value = known.set_index("key")["z"]
        return _local_round(pdf, {"h": pdf["home_key"].map(value).to_numpy(), "a": pdf["away_key"].map(value).to_numpy()}, rules)[columns]

    for n in range(rules.rounds):
        routed = routing.join(aliases, "key")
        state = cut(state.groupBy("part").cogroup(routed.groupBy("part")).applyInPandas(step, _STATE))
        if n:
            r = state.agg(F.avg("primal").alias("p"), F.avg("dual").alias("d")).first()
            residual = max(r.p or 0.0, r.d or 0.0) ** 0.5
            if trace is not None:
                trace.append(residual)
            if residual < rules.tolerance:
                break
        # an alias: where the copies of all records and the likeness of its spellings pull it together
        value = (rules.step * F.sum("t") + rules.alias * F.max("like")) / (rules.step * F.count("*") + rules.alias)
        aliases = cut(state.select(sides(lambda k: F.col(k) + F.col(f"y{k}"))).groupBy("key").agg(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("z")))
    return state.select("i", "j", "similar", "agree", F.col("x").alias("confidence"))


def link(left: DataFrame, right: DataFrame, common: DataFrame, rules: Rules = Rules(), trace: list[float] | None = None) -> DataFrame:  # noqa: B008
    """i, j, confidence: each record of ``left`` with the record of ``right`` that is the same real thing, and how sure that is.

    ``left`` has i, ``right`` j, both home_text, away_text, day (days since 1970), season, home_goals, away_goals. Records of ``left`` without a day
    have no match, nor do those whose names share no words with any record in reach. Null and empty names match nothing; repeated
    records of ``left`` are solved once and each have the match; of equal candidates the surer, then the one that agrees better, then the smaller j
    wins. Empty tables give no rows. ``common`` (column word) are words that are no name by themselves.
    """
    content = ["home_text", "away_text", "day", "home_goals", "away_goals"]
    # written first: what the dates and names come from is not computed again with every step
    rows = cut(left.where("day is not null and home_text is not null and away_text is not null").select("i", "season", *content))
    # repeated records are one
    single = cut(rows.groupBy(*content, "season").agg(F.min("i").alias("rep")))
    others = cut(right.where("home_text is not null and away_text is not null").select("j", "season", *content).distinct())
    texts = single.select(F.explode(F.array("home_text", "away_text")).alias("name")).unionByName(others.select(F.explode(F.array("home_text", "away_text")).alias("name")))
    parts = named_parts(texts, common)

    def with_parts(df: DataFrame) -> DataFrame:
        for side in ("home", "away"):
            df = sized_join(df, parts.select(F.col("name").alias(f"{side}_text"), F.col("parts").alias(side)), [f"{side}_text"])
        return cut(df)

    l, r = with_parts(single.withColumnRenamed("rep", "i")), with_parts(others)  # noqa: E741
    known = cut(evidence(l, r, cut(candidates(l, r))))
    pairs = cut(known.groupBy("i", "j").agg(F.max_by(F.struct("similar", "agree", "home_key", "away_key", "home_like", "away_like"), F.struct("similar", "agree")).alias("e")).select("i", "j", "e.*"))
    solved = solve(pairs, rules, trace).where((F.col("confidence") >= rules.accept) & (F.col("similar") >= rules.least_similar))
    # values that differ by less than the residual are equal
    order = F.struct(F.round("confidence", 2).alias("c"), "similar", "agree")
    best = solved.groupBy("i").agg(F.max(order).alias("top")).join(solved.withColumn("order", order), "i").where(F.col("order") == F.col("top")).groupBy("i").agg(F.min("j").alias("j"), F.max("confidence").alias("confidence"))
    again = rows.select(F.col("i").alias("row"), "season", *content).alias("a").join(single.alias("s"), [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*content, "season")]).select("row", F.col("rep").alias("i"))
    return again.join(best, "i").select(F.col("row").alias("i"), "j", "confidence")

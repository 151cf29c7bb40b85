"""How a typed pick relates to a match: names, competitions, days and seasons, as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Words of clubs that tell none apart, words of sides, spellings of one word and of whole names, and words of cups.
AFFIXES = "fc cf afc sc club fk sk ac as cd ud sv if bk nk ks sd ca cfc kv kfc calcio".split()
WOMEN = "w women womens woman ladies fem femenino feminine".split()
RESERVE = "ii reserve reserves res jong".split()
WORD_SPELLINGS = {"utd": "united", "turkiye": "turkey", "czechia": "czech"}
NAME_SPELLINGS = {
    "czech republic": "czech", "fyr macedonia": "north macedonia", "macedonia": "north macedonia", "korea republic": "south korea", "united states": "usa", "cote d ivoire": "ivory coast", "bosnia and herzegovina": "bosnia",
}
# Letters with marks and their plain forms, as a decomposition without the marks gives them.
MARKED, PLAIN = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįľñńňòóôõöōőŕřśšşťùúûüūůűųýÿźżž", "aaaaaaaaacccdeeeeeeeegiiiiiilnnnooooooorrssstuuuuuuuuyyzzz"


def fold(text: Column) -> Column:
    """Lower case, without marks on letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def name_form(text: Column) -> Column:
    """struct(core, markers): the words that tell a name apart (array of struct word, cut: ended by a stop), and its sides (WOMEN, RESERVE, U17 ...), sorted.

    A number with a stop is an ordinal. Words of sides and of clubs are left out unless cut short or alone; a leading 1 counts as a club's word; "under 19" and "u 19" are one side.
    """
    raw = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(fold(text), "&", " and "), r"\b(?:under|u)\.*[^a-z0-9]+([0-9]+)\b", "under$1"), F.lit(r"[a-z0-9]+\.*"), F.lit(0))

    def token(t: Column, i: Column) -> Column:
        word = F.rtrim(t, F.lit("."))
        cut = (word != t) & ~word.rlike("^[0-9]+$")
        side = F.when(word.rlike("^under[0-9]+$"), F.concat(F.lit("U"), F.substring(word, 6, 9))).when(cut, F.lit(None)).when(word.isin(*WOMEN), "WOMEN").when(word.rlike("^u(1[5-9]|2[0-3])$"), F.upper(word))
        side = side.when(word.isin(*RESERVE) | ((word == "b") & (i > 0) & (i == F.size(raw) - 1)), "RESERVE")
        idle = ~(cut | (F.size(raw) == 1)) & (word.isin(*AFFIXES) | ((word == "1") & (i == 0)))
        return F.struct(F.coalesce(F.try_element_at(_map(WORD_SPELLINGS), word), word).alias("word"), cut.alias("cut"), side.alias("side"), idle.alias("idle"))

    tokens = F.transform(raw, token)
    core = F.transform(F.filter(tokens, lambda t: t["side"].isNull() & ~t["idle"]), lambda t: F.struct(t["word"].alias("word"), t["cut"].alias("cut")))
    markers = F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: t["side"]), lambda s: s.isNotNull())))
    spelt = F.try_element_at(_map(NAME_SPELLINGS), F.array_join(F.transform(core, lambda t: t["word"]), " "))
    whole = F.when(spelt.isNotNull() & ~F.exists(core, lambda t: t["cut"]), F.transform(F.split(spelt, " "), lambda w: F.struct(w.alias("word"), F.lit(False).alias("cut")))).otherwise(core)
    return F.struct(whole.alias("core"), markers.alias("markers"))


def aligned(short: Column, long: Column) -> Column:
    """Whether every word of ``short`` meets a word of ``long`` in order, a word cut short meeting any it begins, and their first words each other."""

    def step(at: Column, w: Column) -> Column:
        meets = lambda k: (F.get(long, k)["word"] == w["word"]) | (w["cut"] & F.get(long, k)["word"].startswith(w["word"]))
        ahead = F.array_min(F.filter(F.sequence(F.lit(0), F.size(long) - 1), lambda k: (k >= at) & meets(k)))
        return F.when(at < 0, F.lit(-1)).when((at == 0) & ~F.coalesce(meets(F.lit(0)), F.lit(False)), F.lit(-1)).otherwise(F.coalesce(ahead + 1, F.lit(-1)))

    found = F.aggregate(short, F.lit(0), step)
    return (F.size(short) > 0) & (F.size(short) <= F.size(long)) & (found > 0)


def name_relation(a: Column, b: Column, same_key: Column | None = None) -> Column:
    """EXACT for forms (see ``name_form``) of the same words, or of the same key where that is given; VARIANT where either is the other with words cut short or left out; null else, and always for different sides."""
    words = lambda x: F.transform(x["core"], lambda t: t["word"])
    open_ = (a["markers"] == b["markers"]) & (F.size(a["core"]) > 0) & (F.size(b["core"]) > 0)
    exact = (words(a) == words(b)) | (F.lit(False) if same_key is None else F.coalesce(same_key, F.lit(False)))
    return F.when(open_ & exact, "EXACT").when(open_ & (aligned(a["core"], b["core"]) | aligned(b["core"], a["core"])), "VARIANT")


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts (twice the matched characters over all); null where either is null. It is no edit distance, and not symmetric in ties."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def competition_relation(source: Column, target: Column) -> Column:
    """MATCH, COMPATIBLE, CONFLICT or UNKNOWN for what a text says of a competition (struct known, country, international, division, cup, words) and a competition (struct country, international, kind, division, words).

    Only facts can conflict: the country, being international, a cup against a league, the division. A name never does; it matches if its words stand together within the competition's.
    """
    open_ = target["country"] != "unknown"
    conflict = open_ & (
        (source["country"].isNotNull() & (target["international"] | (source["country"] != target["country"])))
        | (source["international"] & ~target["international"])
        | (source["cup"] & ~target["international"] & (target["kind"] == "LEAGUE"))
        | F.coalesce(source["division"] != target["division"], F.lit(False))
    )
    n = F.size(source["words"])
    within = F.exists(F.sequence(F.lit(1), F.greatest(F.size(target["words"]) - n + 1, F.lit(1))), lambda i: F.slice(target["words"], i, n) == source["words"])
    return (
        F.when(~source["known"], "UNKNOWN").when(F.coalesce(conflict, F.lit(False)), "CONFLICT").when((n > 0) & within, "MATCH")
        .when(source["country"].isNotNull() | source["international"], "COMPATIBLE").otherwise("UNKNOWN")
    )


def date_relation(day: Column, exact: Column, kickoff: Column, zones: Column, earlier: Column, edge_hours: int = 3) -> Column:
    """How a match's kick-off relates to the day of a pick: EXACT_KICKOFF, KICKOFF_MISMATCH, SAME_DAY, MIDNIGHT_ADJACENT, ADJACENT_DAY, RESCHEDULED, or null.

    ``day`` is the pick's date, ``exact`` its kick-off if it names one, ``kickoff`` the match's (both instants without zone, in UTC), ``zones`` the zones its source may write in, of
    which the kindest counts, ``earlier`` the match's former kick-offs. Midnight is adjacent within ``edge_hours`` of the day's edge.
    """
    utc = lambda t, z: F.from_utc_timestamp(t.cast("timestamp"), z)
    off = lambda t, z: F.datediff(utc(t, z).cast("date"), day)
    nearest = lambda t: F.array_min(F.transform(zones, lambda z: F.struct(F.abs(off(t, z)).alias("n"), off(t, z).alias("d"))))["d"]
    seconds = lambda t: F.unix_seconds(t.cast("timestamp"))
    start = F.unix_date(day).cast("long") * 86_400
    edge = edge_hours * 3600
    near = F.exists(zones, lambda z: (seconds(utc(kickoff, z)) >= start - edge) & (seconds(utc(kickoff, z)) < start + 86_400 + edge))
    offset = nearest(kickoff)
    return (
        F.when(exact.isNotNull() & (exact == kickoff), "EXACT_KICKOFF").when(exact.isNotNull() & (offset == 0), "KICKOFF_MISMATCH").when(offset == 0, "SAME_DAY")
        .when((F.abs(offset) == 1) & near, "MIDNIGHT_ADJACENT").when(F.abs(offset) == 1, "ADJACENT_DAY").when(F.exists(earlier, lambda t: nearest(t) == 0), "RESCHEDULED")
    )


def in_search_window(day: Column, kickoff_day: Column, days: int = 2) -> Column:
    """Whether a match's day lies in the half-open window of ``days`` around a pick's: [day - days, day + days + 1)."""
    return F.datediff(kickoff_day, day).between(-days, days)


def season_start(label: Column) -> Column:
    """The year in which a season of a written label (24/25, 2024-25, 2024_2025, 2024) starts; null for other text."""
    first = F.split(F.regexp_replace(F.trim(label), "[_-]", "/"), "/")[0]
    return F.when(first.rlike("^[0-9]{2}$"), F.concat(F.lit("20"), first)).when(first.rlike("^[0-9]+$"), first).cast("int")


def corner_state(event: Column) -> Column:
    """CORNER, OTHER or CONFLICT for one event's JSON: a corner is a pass (type 30) whose own type is 61, both by number and by name; an event that names a corner otherwise contradicts itself. MALFORMED for text that is no object."""
    at = lambda path: F.get_json_object(event, path)
    named = F.coalesce(at("$.pass.type.id") == "61", F.lit(False)) | F.coalesce(at("$.pass.type.name") == "Corner", F.lit(False))
    exact = (at("$.type.id") == "30") & (at("$.type.name") == "Pass") & (at("$.pass.type.id") == "61") & (at("$.pass.type.name") == "Corner")
    sound = F.coalesce(F.try_parse_json(event).isNotNull() & event.rlike(r"^\s*\{"), F.lit(False))
    return F.when(~sound, "MALFORMED").when(F.coalesce(exact, F.lit(False)), "CORNER").when(named, "CONFLICT").otherwise("OTHER")

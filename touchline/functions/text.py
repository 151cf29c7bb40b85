"""Vocabulary and strict value readers of provider texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of measurements and events, and words of club names that say nothing.
MEASUREMENTS = {
    "ballpossession": "possession", "possession": "possession", "totalshots": "shots", "shots": "shots", "shotsontarget": "shots_on_target", "shotsongoal": "shots_on_target",
    "cornerkicks": "corners", "corners": "corners", "fouls": "fouls", "foulscommitted": "fouls", "offsides": "offsides", "yellowcards": "yellow_cards", "redcards": "red_cards",
}
CLUB_WORDS = r"\b(fc|afc|cf|sc|ac|club|football|the)\b"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def measurement_key(label: Column) -> Column:
    """The measure that a label names; null for unknown labels, which callers report."""
    return F.try_element_at(_map(MEASUREMENTS), F.regexp_replace(F.lower(label), "[^a-z]", ""))


def measurement_value(text: Column) -> Column:
    """A number, a percentage (as its number) or a fraction like 12/20; null for anything else."""
    t = F.trim(text)
    number = F.when(t.rlike(r"^-?[0-9]+([.][0-9]+)?%?$"), F.regexp_replace(t, "%", "").cast("double"))
    top, bottom = F.regexp_extract(t, r"^([0-9]+)\s*/\s*([0-9]+)", 1), F.regexp_extract(t, r"^([0-9]+)\s*/\s*([0-9]+)", 2)
    fraction = F.when(t.rlike(r"^[0-9]+\s*/\s*[0-9]+"), F.try_divide(F.when(top != "", top).cast("double"), F.when(bottom != "", bottom).cast("double")))
    return F.coalesce(number, fraction)


def strict_count(text: Column) -> Column:
    """A whole number of zero or more; null for signs, fractions, words and truth values."""
    return F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text).cast("long"))


def event_kind(text: Column) -> Column:
    """GOAL, DISALLOWED, CARD, SUB or OTHER of an event's words; a disallowed goal is looked for first."""
    t = F.lower(text)
    return F.when(t.contains("disallow") | t.contains("cancel"), "DISALLOWED").when(t.contains("goal"), "GOAL").when(t.contains("card"), "CARD").when(t.contains("sub"), "SUB").otherwise("OTHER")


def club_key(name: Column) -> Column:
    """A name for comparison: lower case, without the usual club words and all but letters and digits."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), CLUB_WORDS, " "), "[^a-z0-9]+", " "))


def score_bucket(label: Column) -> Column:
    """struct(goals, kind) of a score label: EXACT for a number, AT_LEAST for a number with a plus; null else."""
    t = F.trim(label)
    kind = F.when(t.rlike("^[0-9]+$"), "EXACT").when(t.rlike(r"^[0-9]+\+$"), "AT_LEAST")
    return F.when(kind.isNotNull(), F.struct(F.regexp_extract(t, "^([0-9]+)", 1).cast("long").alias("goals"), kind.alias("kind")))


def stable_id(*parts: Column) -> Column:
    """A name-based uuid (version 5 layout) of parts joined by a bar: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat_ws("|", *parts))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def backoff_seconds(attempt: Column, base: float = 30.0, multiplier: float = 2.0, cap: float = 3600.0) -> Column:
    """Wait before the next attempt: exponential, with a cap."""
    return F.least(F.lit(cap), base * F.pow(F.lit(multiplier), attempt - 1))

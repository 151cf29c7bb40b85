"""Markets of typed picks: their labels, what a forecast says of them, and how they settle, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of picks, with the market and the selection each stands for, in the codes of the stored picks.
LABELS = {
    "1": ("RESULT_1X2", "HOME_WIN"), "home": ("RESULT_1X2", "HOME_WIN"), "home win": ("RESULT_1X2", "HOME_WIN"), "home(1)": ("RESULT_1X2", "HOME_WIN"),
    "x": ("RESULT_1X2", "DRAW"), "draw": ("RESULT_1X2", "DRAW"), "draw(x)": ("RESULT_1X2", "DRAW"),
    "2": ("RESULT_1X2", "AWAY_WIN"), "away": ("RESULT_1X2", "AWAY_WIN"), "away win": ("RESULT_1X2", "AWAY_WIN"), "away(2)": ("RESULT_1X2", "AWAY_WIN"),
    "1x": ("DOUBLE_CHANCE", "HOME_OR_DRAW"), "home win or draw(1x)": ("DOUBLE_CHANCE", "HOME_OR_DRAW"), "x2": ("DOUBLE_CHANCE", "DRAW_OR_AWAY"), "away win or draw(x2)": ("DOUBLE_CHANCE", "DRAW_OR_AWAY"),
    "gg": ("BTTS", "BTTS_YES"), "btts": ("BTTS", "BTTS_YES"),
    "over 1.5": ("TOTAL_GOALS", "TOTAL_OVER_1_5"), "over 2.5": ("TOTAL_GOALS", "TOTAL_OVER_2_5"), "ov2.5": ("TOTAL_GOALS", "TOTAL_OVER_2_5"), "under 2.5": ("TOTAL_GOALS", "TOTAL_UNDER_2_5"), "under 3.5": ("TOTAL_GOALS", "TOTAL_UNDER_3_5"),
}
# States of a fixture in which a pick is void.
VOID_STATES = ("CANCELLED", "ABANDONED", "AWARDED")
#: For each selection the scores (home, away) that it wins on; the mass of these is what a forecast gives it.
WINS = {
    "HOME_WIN": lambda h, a: h > a,
    "DRAW": lambda h, a: h == a,
    "AWAY_WIN": lambda h, a: h < a,
    "HOME_OR_DRAW": lambda h, a: h >= a,
    "DRAW_OR_AWAY": lambda h, a: h <= a,
    "BTTS_YES": lambda h, a: (h > 0) & (a > 0),
    "TOTAL_OVER_1_5": lambda h, a: h + a >= 2,
    "TOTAL_OVER_2_5": lambda h, a: h + a >= 3,
    "TOTAL_UNDER_2_5": lambda h, a: h + a <= 2,
    "TOTAL_UNDER_3_5": lambda h, a: h + a <= 3,
}
#: The market that each selection belongs to.
MARKET_OF = {selection: market for market, selection in LABELS.values()}


def market(label: Column) -> Column:
    """struct(market, selection) of a typed label; null for unknown ones."""
    known = F.create_map(*[x for k, (m, s) in LABELS.items() for x in (F.lit(k), F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection")))])
    return F.try_element_at(known, F.regexp_replace(F.lower(F.trim(label)), r"\s+", " "))


def _per_selection(selection: Column, value, known_market: Column | None = None) -> Column:
    """``value`` of the selection's rule; null for an unknown selection, and for one of another market if that is given."""
    out = F.lit(None)
    for name, rule in WINS.items():
        fits = selection == name
        out = F.when(fits if known_market is None else fits & (known_market == MARKET_OF[name]), value(rule)).otherwise(out)
    return out


def settled(market_: Column, selection: Column, status: Column, home: Column, away: Column, basis: Column) -> Column:
    """VOID for a match that was not played out, WON or LOST on its score after regulation time, PENDING for all else."""
    won = _per_selection(selection, lambda rule: rule(home, away), market_)
    final = (status == "FINISHED") & home.isNotNull() & away.isNotNull() & (basis == "REGULATION_90") & won.isNotNull()
    return F.when(status.isin(*VOID_STATES), "VOID").when(~F.coalesce(final, F.lit(False)), "PENDING").when(won, "WON").otherwise("LOST")


def selection_mass(selection: Column, mass, market_: Column | None = None) -> Column:
    """The probability that ``mass`` (a function of a rule over scores) gives a selection."""
    return _per_selection(selection, mass, market_)


def agreement(market_: Column, selection: Column, mass, strict_market: bool = True) -> Column:
    """AGREES, WEAK_SUPPORT, DISAGREES or UNABLE_TO_EVALUATE: how a forecast stands to a pick.

    A pick is agreed with from one half, and in the market of results only where no result is likelier; four tenths are weak support. There are two policies: by market and
    selection (``strict_market``), and the public one by selection alone, whatever market a pick bears. Double chances are looked up by selection in both.
    """
    double = selection.isin("HOME_OR_DRAW", "DRAW_OR_AWAY")
    p = F.when(double, selection_mass(selection, mass)).otherwise(selection_mass(selection, mass, market_ if strict_market else None))
    top = F.greatest(*[mass(WINS[r]) for r in ("HOME_WIN", "DRAW", "AWAY_WIN")])
    known = p.isNotNull() & ~F.isnan(p) & p.between(0, 1.0000000001)
    return F.when(~F.coalesce(known, F.lit(False)), "UNABLE_TO_EVALUATE").when((p >= 0.5) & ((market_ != "RESULT_1X2") | (p >= top)), "AGREES").when(p >= 0.4, "WEAK_SUPPORT").otherwise("DISAGREES")

"""Match clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHAPE = r"^[0-9]{1,3}(?:\+[0-9]{1,2})?:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?$"


def _whole(clean: Column) -> Column:
    """A clock without its fraction; null for text that is no clock."""
    return F.when(clean.rlike(_SHAPE), F.substring_index(F.translate(clean, ",", "."), ".", 1))


def _seconds(parts: Column, added: Column) -> Column:
    n = lambda i: F.get(parts, F.lit(i)).cast("int")
    # mm+m:ss:cc has no meaning of its own: hours, with the minutes that follow
    three = F.when(added, F.when(F.size(parts) == 3, (n(0) + n(1)) * 60 + n(2)).otherwise(n(0) * 3600 + n(2) * 60 + n(3))).otherwise(n(0) * 3600 + n(1) * 60 + n(2))
    return F.when(F.size(parts) == 2, n(0) * 60 + n(1)).when(F.size(parts) >= 3, three)


def clock_seconds(text: Column) -> Column:
    """``with_clock_seconds`` of one text as an expression."""
    whole = _whole(F.trim(text))
    return _seconds(F.split(F.translate(whole, "+", ":"), ":"), whole.contains("+"))


def with_clock_seconds(df: DataFrame, clocks: dict[str, str], *columns: str | Column) -> DataFrame:
    """``columns`` (default: all) and, per entry of ``clocks`` (new column: text column), the whole seconds of a match clock.

    mm:ss, hh:mm:ss, mm+m:ss (added time), each with or without a fraction, which is cut off; null for other text. Each text is matched once and
    split at single characters, in steps of their own, so that no expression is evaluated twice.
    """
    kept = df.columns
    df = df.withColumns({f"__w_{n}": _whole(F.trim(F.col(text))) for n, text in clocks.items()})
    df = df.withColumns({f"__p_{n}": F.split(F.translate(F.col(f"__w_{n}"), "+", ":"), ":") for n in clocks})
    return df.select(*(columns or kept), *[_seconds(F.col(f"__p_{n}"), F.col(f"__w_{n}").contains("+")).alias(n) for n in clocks])

"""Typed names of clubs as comparable parts, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms; digits typed for letters; decorations that name no side; words and codes of sides.
MARKED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįłľñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiillnnnoooooooorrssstuuuuuuuuyyzzz"
TYPED_DIGITS, MEANT_LETTERS = "013458", "oleasb"
DECORATIONS = r"\b(1st|first) team\b|\bsenior( squad| side| team)?\b|[\[(](club|see sheet|official)[\])]|\*"
WOMEN = ("w", "women", "womens", "ladies", "feminas", "femenino", "femenina", "feminines", "frauen", "damen", "fem")
YOUTH = ("youth", "academy", "juniors", "junior", "juvenil", "jugend", "jeunes", "primavera")
RESERVE = ("b", "ii", "iii", "reserves", "reserve", "amateure")


def plain(text: Column) -> Column:
    """Lower case, without marks on letters, blanks of any kind as single spaces."""
    low = F.regexp_replace(F.lower(text), "\\u00df", "ss")
    return F.trim(F.regexp_replace(F.translate(low, MARKED, PLAIN), "[\\s\\u00a0\\u2007\\u202f_]+", " "))


def spelt_out(text: Column) -> Column:
    """``plain`` with marked letters written as two where that is usual (ae, oe, ue, ny)."""
    low = F.lower(text)
    for marked, pair in zip("äöüñ", ("ae", "oe", "ue", "ny"), strict=True):
        low = F.regexp_replace(low, marked, pair)
    return plain(low)


def bracketed(text: Column) -> Column:
    """array<string>: the plain contents of square and round brackets."""
    return F.regexp_extract_all(plain(text), F.lit(r"[\[(]\s*([^\])]*?)\s*[\])]"), F.lit(1))


def tokens(text: Column, spell=None) -> Column:
    """array<struct<t, dot>>: the words of a name and whether each is cut short by a full stop.

    Decorations and bracketed remarks other than those for women's sides are left out; initials with stops become one word; digits typed for letters inside a word are mended.
    """
    s = F.regexp_replace((spell or plain)(text), DECORATIONS, " ")
    s = F.regexp_replace(s, r"[\[(]\s*(w|women|ladies)\s*[\])]", " $1 ")
    s = F.regexp_replace(s, r"[\[(][^\])]*[\])]", " ")
    s = F.regexp_replace(s, r"\bu[- ]?([0-9]{2})\b", "u$1")
    s = F.regexp_replace(F.regexp_replace(s, "[-/,;:&+]", " "), "[^a-z0-9. ]", "")
    words = F.filter(F.split(s, " +"), lambda w: F.length(F.translate(w, ".", "")) > 0)

    def word(w: Column) -> Column:
        bare = F.translate(w, ".", "")
        initials = w.rlike(r"^([a-z0-9]\.){2,}[a-z0-9]?$|^([a-z]\.)+[a-z]$")
        mended = F.when(bare.rlike("[0-9]") & bare.rlike("[a-z]") & ~bare.rlike("^u[0-9]{2}$"), F.translate(bare, TYPED_DIGITS, MEANT_LETTERS)).otherwise(bare)
        return F.struct(mended.alias("t"), (w.endswith(".") & ~initials).alias("dot"))

    return F.transform(words, word)


def side_of(token: Column) -> Column:
    """women, youth or reserve for a word that names such a side, else null."""
    t = token["t"]
    return F.when(~token["dot"] & t.isin(*WOMEN), "women").when((~token["dot"] & t.isin(*YOUTH)) | t.rlike("^u[0-9]{2}$"), "youth").when(~token["dot"] & t.isin(*RESERVE), "reserve")


def sides(toks: Column) -> Column:
    """The sides that a name's words (see ``tokens``) name, as one text; empty for a first team."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(toks, side_of), lambda s: s.isNotNull()))), "+")


def core(toks: Column) -> Column:
    """The words that name no side."""
    return F.filter(toks, lambda t: side_of(t).isNull())


def look_alike(text: Column) -> Column:
    """i and l written the same, as a typed 1 may stand for either."""
    return F.translate(text, "i", "l")


def swapped(a: Column, b: Column) -> Column:
    """Whether two texts at edit distance 2 differ by exchanged letters only."""
    return (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))


def short_for(short: Column, dotted: Column, word: Column) -> Column:
    """Whether ``short`` abbreviates ``word``: a beginning cut by a stop, or some of its letters in order with the first one kept."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(short, "([a-z0-9])", "$1.*"), F.lit("$"))
    letters = (F.length(short) >= 2) & (F.length(short) < F.length(word)) & (F.substring(short, 1, 1) == F.substring(word, 1, 1)) & F.rlike(word, pattern)
    return (dotted & word.startswith(short)) | letters

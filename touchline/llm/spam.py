"""Keyword-stuffed and link-list pages by the shapes of their lines.

A page's lines are cut at sentence ends into segments. Each segment is reduced to a shape: classes of its number of words, of its
capitals, of its separators and links, of how fresh its words are and of how it ends. Equal shapes of a page are grouped, each group is a kind of
sentence, of record or of neither, and a page is flagged where a few shapes that are no sentences hold most of its text. Everything is an
expression over one row: no shuffle, no group of pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of line ends, sentence ends, links, words, separators, and of records (numbered, tabular or JSON lines) and scores; characters that end sentences and that close quotations.
LINE_ENDS = "[\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029]+"
STOPS, CLOSERS = ".!?…", "\"»”)"
SENTENCE_END = "([.!?\\u2026](?<![.!?\\u2026]{2})[\"\\u00bb\\u201d)]*)\\s+"
LINK = "(?:https?://|www\\.)\\S+"
WORD = "[\\p{L}\\p{N}\\p{M}]+(?:['\\u2019-][\\p{L}\\p{N}\\p{M}]+)*"
SEPARATOR = "(?:[|,;\\u2022/\\u00bb\\u00b7>]|!!+|-(?=>)|\\bwww\\b|[-\\u2013\\u2014](?= ))\\s*(?:[|,;\\u2022/\\u00bb\\u00b7>]\\s*)*"
EDGES = " |,;•/»·>!-"
RECORD = "^[^\\p{L}\\p{N}_<]*[0-9]{1,3}\\+?[0-9]?(?:['\\u2019.):]|\\s*\\|)|^\\||^[\\[{]+\\s*\""
SCORE = "[0-9]\\s*[-\\u2013:]\\s*[0-9]|\\([A-Z]{2,3}\\)"


@dataclass(frozen=True)
class Bounds:
    """The bounds between classes of shapes. They were set on sf0.1 (10,000 pages) and hold for any page."""

    #: Words up to which a line or a sentence is short, and from which it is long; words of a separated piece; words that come with a link.
    line: int = 6
    sentence: int = 10
    long: int = 14
    piece: float = 5.5
    link: int = 12
    #: Pieces from which a segment is a list, and those that no sentence has.
    pieces: int = 4
    many: int = 7
    #: Share of distinct words up to which a segment repeats itself, up to which short sentences repeat each other, and up to which longer ones and lines do.
    stale: float = 0.7
    stock: float = 0.42
    worn: float = 0.25
    #: A page is flagged where its ``few`` largest shapes that are no sentences hold more than ``share`` of its characters.
    share: float = 0.5
    few: int = 6


BOUNDS = Bounds()


def segments(text: Column) -> Column:
    """array<string>: the lines of a text cut at sentence ends; numbered, tabular and JSON lines stay whole."""
    lines = F.transform(F.split(text, LINE_ENDS), F.trim)
    cut_up = lambda x: F.split(F.regexp_replace(x, SENTENCE_END, "$1\n"), "\n")
    parts = F.transform(lines, lambda x: F.when(x.rlike(RECORD), F.array(x)).otherwise(cut_up(x)))
    return F.filter(F.transform(F.flatten(parts), F.trim), lambda x: F.length(x) > 0)


def shapes(segs: Column, b: Bounds = BOUNDS) -> Column:
    """array<struct>: per segment its shape (``words``, ``capitals``, ``separators``, ``links``, ``stale``, ``ending``, ``mark`` as small numbers) and what is summed over equal shapes: n (characters), w (words), own (the words)."""

    def first(s: Column) -> Column:
        linked = s.contains("http") | s.contains("www.")
        body = F.when(linked, F.regexp_replace(s, LINK, " ")).otherwise(s)
        return F.struct(s.alias("s"), F.when(body.contains("<"), F.regexp_replace(body, "<[^>]*>", " ")).otherwise(body).alias("body"), F.when(linked, F.regexp_count(s, F.lit(LINK))).otherwise(0).alias("links"))

    def second(a: Column) -> Column:
        s, body = a["s"], a["body"]
        bare = F.rtrim(s, F.lit(CLOSERS))
        last, before = F.right(bare, F.lit(1)), F.left(F.right(bare, F.lit(2)), F.lit(1))
        stops = [F.lit(c) for c in STOPS]
        return F.struct(
            F.length(s).alias("n"), a["links"].alias("links"), F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0)).alias("own"),
            # pieces between separators: one that begins or ends the segment parts nothing
            (F.regexp_count(F.trim(body, F.lit(EDGES)), F.lit(SEPARATOR)) + 1).alias("pieces"),
            F.when(body.contains("#"), F.length(body) - F.length(F.replace(body, F.lit("#"), F.lit("")))).otherwise(0).alias("tags"), F.regexp_count(body, F.lit("\\p{Lu}")).alias("capitals"),
            (last.isin(*stops) & ((F.length(bare) < 2) | ~before.isin(*stops))).alias("terminal"), s.endswith(")").alias("closing"), s.startswith(">").alias("quote"),
            (s.rlike(RECORD) | s.contains('":')).alias("record"), s.alias("s"),
        )

    def third(m: Column) -> Column:
        w = F.size(m["own"])
        per = lambda x: w / F.greatest(x, F.lit(1))
        stale = F.size(F.array_distinct(m["own"])) <= b.stale * w
        # a link with a sentence of its own is content
        alone = (m["terminal"] | m["quote"]) & (w >= 5) & (m["links"] == 1) & ~m["closing"]
        listed = (m["pieces"] >= b.pieces) & (per(m["pieces"]) <= b.piece)
        record = m["record"] | ((w <= 16) & m["s"].rlike(SCORE))
        return F.struct(
            F.when(w == 0, 0).when(w < 5, 1).when(w <= b.line, 2).when(w <= b.sentence, 3).when(w < b.long, 4).otherwise(5).alias("words"),
            F.when(m["capitals"] == 0, 0).when(2 * m["capitals"] < w, 1).when(m["capitals"] <= 2 * w, 2).otherwise(3).alias("capitals"),
            F.when(listed, F.when(m["pieces"] >= b.many, 2).otherwise(1)).otherwise(0).alias("separators"),
            F.when(m["links"] == 0, 0).when(alone | (per(m["links"]) >= b.link), 1).otherwise(2).alias("links"),
            stale.cast("int").alias("stale"), m["terminal"].cast("int").alias("ending"),
            F.when(m["tags"] >= 2, 1).when(record, 2).when(m["quote"] & (w >= 5), 3).otherwise(0).alias("mark"),
            m["n"].alias("n"), w.alias("w"), m["own"].alias("own"),
        )

    return F.transform(F.transform(F.transform(segs, first), second), third)


_CODE = ("words", "capitals", "separators", "links", "stale", "ending", "mark")


def _kind(x: Column) -> Column:
    """The kind of a shape: link, tag, list and run are no sentences; record and quote are content; line and sentence depend on the page."""
    return (
        F.when(x["links"] == 2, "link")
        .when(x["mark"] == 1, "tag")
        .when(x["mark"] == 2, "record")
        # behind a quotation mark stands a sentence, unless it is a list or repeats itself
        .when((x["separators"] > 0) & ((x["ending"] == 0) | (x["stale"] == 1) | (x["separators"] == 2)), "list")
        .when((x["words"] == 5) & (x["stale"] == 1), "run")
        .when(x["mark"] == 3, "quote")
        .when(x["words"] == 0, "mark")
        .when(x["ending"] == 0, "line")
        .otherwise("sentence")
    )


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, x: acc + value(x))


def page_groups(pages: DataFrame, key: str, text: str, b: Bounds = BOUNDS) -> DataFrame:
    """key, chars (all characters in segments), groups: per distinct shape of a page shape (its numbers as text), kind, lines, n (characters) and bad (whether it is no sentence).

    Short lines are no sentences where there are at least three; longer open lines and short sentences are none where they repeat each other's words. Null, empty and
    blank texts have no groups. One row per row of ``pages``, repeated and null keys included.
    """
    coded = F.transform(shapes(segments(F.coalesce(F.col(text), F.lit(""))), b), lambda x: F.struct(F.concat_ws("", *[x[c] for c in _CODE]).alias("shape"), _kind(x).alias("kind"), (x["words"] <= 2).alias("brief"), x["n"].alias("n"), x["w"].alias("w"), x["own"].alias("own")))
    # sealed by a generator: the shapes are made once, whatever is asked of them
    df = pages.select(F.col(key), F.explode(F.array(coded)).alias("x"))
    lines, short = F.filter("x", lambda s: s["kind"] == "line"), F.filter("x", lambda s: (s["kind"] == "sentence") & (s["w"] <= b.sentence))
    df = df.withColumns({"lines": lines, "short": short, "sentences": F.array_sort(F.transform(F.filter("x", lambda s: s["kind"] == "sentence"), lambda s: s["w"]))})
    words = lambda c: F.transform(c, lambda s: s["own"])
    share = lambda w: F.size(F.array_distinct(F.flatten(w))) / F.greatest(F.size(F.flatten(w)), F.lit(1))
    different = lambda c: F.size(F.array_distinct(words(c)))
    median, fresh = F.get("sentences", F.floor((F.size("sentences") - 1) / 2).cast("int")), share(words("short"))
    df = df.withColumns({
        "brief_lines": (F.size("lines") >= 3) & (_sum(F.col("lines"), lambda s: s["w"]) <= (b.line + 0.2) * F.size("lines")),
        # a few lines or sentences said over and over are a chant or a plea, not phrases around changing keywords: each line counts once, and most lines differ
        "stale_lines": (different("lines") >= 4) & (3 * different("lines") >= 2 * F.size("lines")) & (share(F.array_distinct(words("lines"))) <= b.worn),
        "stock": (different("short") >= 4) & (((median <= b.line) & (fresh <= b.stock)) | ((median <= b.line + 1) & (fresh <= b.worn))),
    })

    def group(code: Column) -> Column:
        members = F.filter("x", lambda s: s["shape"] == code)
        one = F.get(members, F.lit(0))
        bad = (
            F.when(one["kind"].isin("link", "tag", "list", "run"), True)
            .when(one["kind"] == "line", (F.col("brief_lines") & one["brief"]) | F.col("stale_lines"))
            .when(one["kind"] == "sentence", F.col("stock") & (F.exists(members, lambda s: s["w"] <= b.sentence) | (F.substring(code, 5, 1) == "1")))
            .otherwise(False)
        )
        return F.struct(code.alias("shape"), one["kind"].alias("kind"), F.size(members).alias("lines"), _sum(members, lambda s: s["n"]).alias("n"), bad.alias("bad"))

    groups = F.transform(F.array_distinct(F.transform("x", lambda s: s["shape"])), group)
    return df.select(key, _sum(F.col("x"), lambda s: s["n"]).alias("chars"), groups.alias("groups"))


def page_shapes(pages: DataFrame, key: str, text: str, b: Bounds = BOUNDS) -> DataFrame:
    """key, chars, shape, kind, lines, n, bad: a row per page and distinct shape of its segments; see ``page_groups``."""
    return page_groups(pages, key, text, b).select(key, "chars", F.inline("groups"))


def spam_pages(pages: DataFrame, key: str, text: str, b: Bounds = BOUNDS) -> DataFrame:
    """key of each page whose few largest shapes that are no sentences hold more than half of its characters; see ``page_groups`` and ``Bounds``. Pages without text are none."""
    largest = F.slice(F.reverse(F.array_sort(F.transform(F.filter("groups", lambda g: g["bad"]), lambda g: g["n"]))), 1, b.few)
    flagged = F.aggregate(largest, F.lit(0), lambda acc, n: acc + n) > b.share * F.col("chars")
    # a filter would be pushed below the shapes and compute each of them again; a generator is not
    return page_groups(pages, key, text, b).select(F.explode(F.when(flagged, F.array(key))).alias(key))

"""Mixed timestamp formats and zones to one unambiguous UTC form.

A text is tokenised into a mask of its length (letters A, digits 9, all else itself). Each distinct mask of the data is mapped once to a
parser, that is, to where each field lies in the text; all rows are then converted by cutting their fields out at those places. Local times
go through transition tables of the zones and local years in use, which bear the version of the zone database: a time that
a clock change skips lies in no span of its zone and one that it repeats lies in two, and both come out as unresolved.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import importlib.metadata
import re
import zoneinfo
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import cut, sized_join

UNRESOLVED = "UNRESOLVED"

# Month and weekday names, and the offsets in minutes that zone abbreviations stand for.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
SHORT_FORMS = {"sept": "september", "tues": "tuesday", "thur": "thursday", "thurs": "thursday"}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "SAST": 120, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "COT": -300, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BRT": -180, "ART": -180,
}
#: Day 0 of the spreadsheet day count.
SERIAL_ORIGIN = -25569
#: Blanks and dashes of other kinds than the plain ones. The longest text that a parser reads has 51 characters.
BLANKS, DASHES, LONGEST = "\t\n\x0b\x0c\r\u00a0\u2007\u202f", "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", 64


def tidy(text: Column) -> Column:
    """Surrounding and repeated blanks of any kind removed, typographic minus signs made plain."""
    plain = F.translate(text, BLANKS + DASHES, " " * len(BLANKS) + "-" * len(DASHES))
    return F.trim(F.when(plain.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain))


def _mask(clean: Column) -> Column:
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return F.when(F.length(clean) <= LONGEST, F.translate(clean, letters + digits, "A" * len(letters) + "9" * len(digits)))


def shape_mask(text: Column) -> Column:
    """The mask of a text: letters as A, digits as 9, all else as it is; null for null and for texts longer than any parser reads."""
    return _mask(F.upper(tidy(text)))


# The forms of the parts of a mask; a full timestamp is a date and a clock joined by a letter (a T, which the rows are asked for) or a blank.
_FORMS = {
    "date": (
        r"(?:(?P<wd>A{3,9})\.?,? )?(?:(?P<d>99?)(?P<s>[- ])(?P<mw>A{3,9})\.?(?P=s)(?P<y>9999|99)|(?P<mw>A{3,9})\.? (?P<d>99?),? (?P<y>9999|99))",
        r"(?P<d>99?)(?P<s>[-/.])(?P<mo>99?)(?P=s)(?P<y>9999|99)",
        r"(?P<y>9999)(?P<s>[-/.])(?P<mo>99?)(?P=s)(?P<d>99?)",
        r"(?P<y>9999)(?P<mo>99)(?P<d>99)",
    ),
    "clock": (r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<ap>A\.?A\.?)(?!A))?", r"(?P<h>99?)\.(?P<mi>99)(?: ?(?P<ap>A\.?A\.?)(?!A))?", r"(?P<h>99?)(?P<hs>A)(?P<mi>99)", r"(?P<h>99)(?P<mi>99)(?P<s>99)?"),
    "zone": (r" ?(?:(?P<z>A{1,5})|(?P<sg>[-+])(?P<oh>99)(?::?(?P<om>99))?)",),
}
#: The kinds of masks, and the fields that a parser places.
KINDS = {"date": 1, "instant": 2, "clock": 3, "serial": 4, "epoch": 5}
FIELDS = ("y", "mo", "d", "mw", "wd", "t", "h", "mi", "s", "f", "ap", "hs", "z", "sg", "oh", "om", "n")


@lru_cache(1)
def _grammar() -> tuple[tuple[tuple[str, ...], re.Pattern], ...]:
    """The parts that a whole mask may consist of, with their pattern; names that recur in alternatives are told apart by a number."""
    count = iter(range(10_000))

    def unique(pattern: str) -> str:
        n = next(count)
        # each alternative of a form has its own copy of a name
        seen: dict[str, int] = {}

        def named(m: re.Match) -> str:
            seen[m[1]] = seen.get(m[1], 0) + 1
            return f"(?P<{m[1]}_{n}_{seen[m[1]]}>"

        out = re.sub(r"\(\?P<([a-z]+)>", named, pattern)
        return re.sub(r"\(\?P=([a-z]+)\)", lambda m: f"(?P={m[1]}_{n}_1)", out)

    dates, clocks, zones = ([unique(f) for f in _FORMS[k]] for k in ("date", "clock", "zone"))
    zone = f"(?:{zones[0]})?"
    out = [(("date",), re.compile(d)) for d in dates]
    out += [(("instant",), re.compile(f"{d}(?: |(?P<t_0_0>A)){c}{zone}")) for d in dates for c in clocks]
    out += [(("clock",), re.compile(f"{c}{zone}")) for c in clocks]
    return (*out, (("serial",), re.compile(r"(?P<n_0_0>9{5})")), (("epoch",), re.compile(r"(?P<n_0_0>9{9,10}|9{13}|9{16}|9{19})")))


def parser_of(mask: str | None) -> dict | None:
    """The parser of a mask: its kind, whether the date is slashed, and of each of ``FIELDS`` its start (from 1; 0: none) and length in the text. None if the mask has none."""
    if mask is None:
        return None
    for (kind,), pattern in _grammar():
        m = pattern.fullmatch(mask)
        if not m:
            continue
        at = {f: (0, 0) for f in FIELDS}
        slashed = 0
        for name, value in m.groupdict().items():
            field, form, _ = name.split("_")
            if value is None:
                continue
            # in dates s is the separator, in clocks the second
            if field == "s" and not value.isdigit():
                slashed = int(value == "/")
            else:
                at[field] = (m.start(name) + 1, len(value))
        return {"kind": KINDS[kind], "slashed": bool(slashed), "fields": [{"at": at[f][0], "n": at[f][1]} for f in FIELDS]}
    return None


def mask_parsers(masks: DataFrame) -> DataFrame:
    """mask, parser (kind, slashed, fields): each distinct mask of the data (the one column of ``masks``) that has a parser, parsed once. Written."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(parser=[parser_of(m) for m in pdf["mask"]])
            yield pdf[pdf["parser"].notna()]

    distinct = masks.toDF("mask").where("mask is not null").distinct()
    return cut(distinct.mapInPandas(build, "mask string, parser struct<kind:int,slashed:boolean,fields:array<struct<at:int,n:int>>>"))


def _spans_of_zone(name: str, first: int, last: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Of each local year, the spans (local start, local end, offset) in seconds that reach into it."""
    zone = zoneinfo.ZoneInfo(name)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)

    def offset(second: int) -> int:
        return int((epoch + dt.timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    # the calendar of the library ends with the years 1 and 9999
    earliest, latest = (int((dt.datetime(*d, tzinfo=dt.UTC) - epoch).total_seconds()) for d in ((1, 1, 3), (9999, 12, 29)))
    at = max(int((dt.datetime(first, 1, 1, tzinfo=dt.UTC) - epoch).total_seconds()) - 5 * 86400, earliest)
    end = min(int((dt.datetime(last, 12, 31, tzinfo=dt.UTC) - epoch).total_seconds()) + 6 * 86400, latest)
    step, spans, start, now = 10 * 86400, [], at, offset(at)
    while at < end:
        ahead = min(at + step, end)
        then = offset(ahead)
        if then != now:
            low, high = at, ahead
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == now else (low, mid)
            spans.append((start, high, now))
            start, now = high, offset(high)
            at = high
        else:
            at = ahead
    spans.append((start, end, now))
    local = [(a + o, b + o, o) for a, b, o in spans]
    out = []
    for year in range(first, last + 1):
        a = int((dt.datetime(year, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds())
        b = int((dt.datetime(year, 12, 31) - dt.datetime(1970, 1, 1)).total_seconds()) + 86400
        out.append((year, [s for s in local if s[0] < b and s[1] > a]))
    return out


def zone_table(used: DataFrame) -> DataFrame:
    """zone_name, local_year, spans (array of local start, local end, offset in seconds), tz_version: the zone database as offsets by local year, for the pairs of ``used`` (zone_name, local_year).

    Names that the database does not know have no rows. It is built on the executors, and written.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, version = zoneinfo.available_timezones(), zone_version()
        for batch in batches:
            rows = []
            for name, years in batch.groupby("zone_name")["local_year"]:
                if name in known:
                    wanted = set(years)
                    rows += [(name, year, [{"a": a, "b": b, "o": o} for a, b, o in spans], version) for year, spans in _spans_of_zone(name, min(wanted), max(wanted)) if year in wanted]
            yield pd.DataFrame(rows, columns=["zone_name", "local_year", "spans", "tz_version"])

    pairs = used.toDF("zone_name", "local_year").where("zone_name is not null and local_year is not null").distinct().repartition("zone_name")  # each zone is worked through once
    return cut(pairs.mapInPandas(build, "zone_name string, local_year int, spans array<struct<a:bigint,b:bigint,o:int>>, tz_version string"))


@lru_cache(1)
def zone_version() -> str:
    """The release of the zone database in use: as its distribution or its files name it, else a digest of the files."""
    for folder in map(Path, zoneinfo.TZPATH):
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)"), ("version", r"(\S+)")):
            file = folder / name
            if file.is_file() and (m := re.match(pattern, file.read_text(errors="replace"))):
                return m[1]
        if folder.is_dir():
            digest = hashlib.sha256()
            for name in sorted(zoneinfo.available_timezones()):
                file = folder / name
                digest.update(name.encode() + (file.read_bytes() if file.is_file() else b""))
            return f"sha256:{digest.hexdigest()[:16]}"
    return importlib.metadata.version("tzdata")


def _names(values: list[str]) -> Column:
    """A constant map of names, their first three letters and their other short forms, in capitals, to their number from 1."""
    numbers = {form.upper(): i + 1 for i, v in enumerate(values) for form in (v, v[:3])}
    numbers |= {s.upper(): values.index(v) + 1 for s, v in SHORT_FORMS.items() if v in values}
    return F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])


def _parsed(df: DataFrame, text: str, prefix: str, month_first: Column) -> DataFrame:
    """Adds ``{prefix}kind`` (a number of KINDS), day (days since 1970), clock (microseconds of the day), zoned, offset (seconds), epoch (microseconds)."""
    p = prefix
    c = lambda name: F.col(f"{p}{name}")
    df = df.withColumn(f"{p}text", F.upper(tidy(F.col(text)))).withColumn(f"{p}mask", _mask(c("text")))
    parsers = mask_parsers(df.select(f"{p}mask")).toDF(f"{p}mask", f"{p}parser")
    df = sized_join(df, parsers, [f"{p}mask"], "left")
    # all fields are cut out in one step
    pieces = F.transform(c("parser")["fields"], lambda x: F.when(x["at"] > 0, F.substr(c("text"), x["at"], x["n"])))
    df = df.withColumns({f"{p}f": pieces, f"{p}kind": c("parser")["kind"], f"{p}slash": c("parser")["slashed"]})
    field = lambda f: c("f")[FIELDS.index(f)]
    number = lambda f: field(f).cast("int")
    swap = c("slash") & month_first
    year = F.when(F.length(field("y")) <= 2, number("y") + 2000).otherwise(number("y"))
    month = F.when(field("mw").isNotNull(), F.try_element_at(_names(MONTHS), field("mw"))).when(swap, number("d")).otherwise(number("mo"))
    ap = F.translate(field("ap"), ".", "")
    df = df.withColumns({f"{p}y": year, f"{p}mo": month, f"{p}d": F.when(swap, number("mo")).otherwise(number("d")), f"{p}hh": number("h"), f"{p}ap": ap})
    leap = ((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0)
    last = F.when(c("mo") == 2, F.when(leap, 29).otherwise(28)).when(c("mo").isin(4, 6, 9, 11), 30).otherwise(31)
    # words that stand where a weekday, a T or an h should must be that
    fits = (field("wd").isNull() | F.try_element_at(_names(WEEKDAYS), field("wd")).isNotNull()) & (field("t").isNull() | (field("t") == "T"))
    real = c("mo").between(1, 12) & c("d").between(1, last) & (c("y") >= 1) & fits
    civil = F.unix_date(F.make_date(F.when(real, c("y")), F.when(real, c("mo")), F.when(real, c("d"))))
    serial = F.when(c("kind") == KINDS["serial"], number("n") + SERIAL_ORIGIN)
    hour = F.when(c("ap").isNull(), F.when(c("hh") <= 23, c("hh"))).when(c("ap").isin("AM", "PM") & c("hh").between(1, 12), c("hh") % 12 + F.when(c("ap") == "PM", 12).otherwise(0))
    minute, second = number("mi"), F.coalesce(number("s"), F.lit(0))
    micro = F.coalesce(F.rpad(F.substring(field("f"), 1, 6), 6, "0").cast("int"), F.lit(0))
    plain = (minute <= 59) & (second <= 59) & (field("hs").isNull() | (field("hs") == "H"))
    clock = F.when(plain, (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + micro)
    abbreviations = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    om = F.coalesce(number("om"), F.lit(0))
    written = F.when((number("oh") <= 18) & (om <= 59), F.when(field("sg") == "-", -1).otherwise(1) * (number("oh") * 60 + om) * 60).otherwise(F.try_element_at(abbreviations, field("z")) * 60)
    size = F.length(field("n"))
    count = F.when(c("kind") == KINDS["epoch"], field("n")).cast("decimal(20,0)")
    scale = F.when(size <= 10, F.lit(1_000_000)).when(size == 13, F.lit(1_000)).otherwise(F.lit(1))
    epoch = F.when(size == 19, F.floor(count / 1000)).otherwise(count * scale).cast("long")
    df = df.withColumns({f"{p}day": F.coalesce(serial, civil), f"{p}clock": clock, f"{p}zoned": field("z").isNotNull() | field("oh").isNotNull(), f"{p}offset": written, f"{p}epoch": epoch})
    return df.drop(*[f"{p}{x}" for x in ("text", "mask", "parser", "f", "slash", "y", "mo", "d", "hh", "ap")])


def _iso_instant(us: Column) -> Column:
    """Microseconds since 1970 as yyyy-MM-ddTHH:mm:ss.SSSSSSZ, whatever the session's zone."""
    day = F.floor(us / F.lit(86_400_000_000)).cast("int")
    rest = us - day.cast("long") * 86_400_000_000
    second = F.floor(rest / 1_000_000)

    def two(x: Column) -> Column:
        return F.lpad(x.cast("int").cast("string"), 2, "0")

    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60),
        F.lit("."), F.lpad((rest % 1_000_000).cast("int").cast("string"), 6, "0"), F.lit("Z"),
    )


def _sealed(df: DataFrame, columns: list[str], values: dict[str, Column]) -> DataFrame:
    """``columns`` and ``values``, through a generator: a filter on a value would else be pushed below the parsing and repeat it in full."""
    return df.select(*columns, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def normalise_days(df: DataFrame, text: str, out: str, month_first: Column | None = None) -> DataFrame:
    """Adds ``out``: the day written in column ``text`` as yyyy-MM-dd, or UNRESOLVED.

    Null, empty and unknown forms, and days the calendar does not have, are UNRESOLVED. Slashed dates are day first but where
    ``month_first`` holds; years of two digits are 20yy; five digits are a spreadsheet day count. Other columns are kept.
    """
    month_first = F.lit(False) if month_first is None else F.coalesce(month_first, F.lit(False))
    parsed = _parsed(df, text, "__d", month_first)
    day = F.when(F.col("__dkind").isin(KINDS["date"], KINDS["serial"], KINDS["instant"]), F.col("__dday"))
    return _sealed(parsed, df.columns, {out: F.coalesce(F.date_from_unix_date(day).cast("string"), F.lit(UNRESOLVED))})


def normalise_instants(df: DataFrame, clock_text: str, out: str, zones: list[Column], day_text: str | None = None, month_first: Column | None = None, version: str | None = None) -> DataFrame:
    """Adds ``out``: the UTC instant of ``clock_text`` (with its day in ``day_text``, if that is given) as yyyy-MM-ddTHH:mm:ss.SSSSSSZ, or UNRESOLVED.

    A full timestamp or an epoch count in ``clock_text`` stands alone. A written offset or zone abbreviation goes before
    ``zones``, of which the first that is neither null nor blank counts. UNRESOLVED where a part is null, empty, of unknown form or
    impossible, where no zone is known or the zone is not in the zone database, and where the local time is skipped or repeated by a
    clock change. Digits finer than microseconds are cut off. Other columns are kept. With ``version``, a column of that name tells the
    release of the zone database where a row went through it.
    """
    columns = df.columns
    month_first = F.lit(False) if month_first is None else F.coalesce(month_first, F.lit(False))
    zone = F.coalesce(*[F.when(F.trim(z) != "", F.trim(z)) for z in zones]) if zones else F.lit(None).cast("string")
    df = _parsed(df.withColumn("__zone", zone), clock_text, "__c", month_first)
    day = F.when(F.col("__ckind") == KINDS["instant"], F.col("__cday"))
    if day_text is not None:
        df = _parsed(df, day_text, "__d", month_first)
        day = F.coalesce(day, F.when((F.col("__ckind") == KINDS["clock"]) & F.col("__dkind").isin(KINDS["date"], KINDS["serial"]), F.col("__dday")))
    df = df.withColumn("__local", day.cast("long") * 86_400_000_000 + F.col("__cclock"))
    needs = F.col("__local").isNotNull() & ~F.col("__czoned")
    df = df.withColumn("__year", F.when(needs, F.year(F.date_from_unix_date(F.floor(F.col("__local") / F.lit(86_400_000_000)).cast("int")))))
    table = zone_table(df.select("__zone", "__year")).toDF("__zone", "__year", "__spans", "__version")
    df = sized_join(df, table, ["__zone", "__year"], "left")
    hits = F.filter(F.col("__spans"), lambda s: (s["a"] * 1_000_000 <= F.col("__local")) & (F.col("__local") < s["b"] * 1_000_000))
    offset = F.when(F.col("__czoned"), F.col("__coffset")).otherwise(F.when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1))["o"]))
    instant = F.when(F.col("__ckind") == KINDS["epoch"], F.col("__cepoch")).otherwise(F.col("__local") - offset.cast("long") * 1_000_000)
    return _sealed(df, columns, {out: F.coalesce(_iso_instant(instant), F.lit(UNRESOLVED))} | ({version: F.col("__version")} if version else {}))


def unknown_shapes(df: DataFrame, text: str) -> DataFrame:
    """shape, rows: the masks of ``text`` that have no parser (null: longer than any), for extending the forms; counted with a map-side combine."""
    shapes = df.where(F.col(text).isNotNull()).select(shape_mask(F.col(text)).alias("shape")).groupBy("shape").agg(F.count("*").alias("rows"))
    return shapes.join(mask_parsers(shapes.select("shape")).select(F.col("mask").alias("shape")), "shape", "left_anti")

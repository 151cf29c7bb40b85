"""Readers of provider files: results CSV, zipped CSV, event and lineup JSON, HTML tables, delimited feeds and script-embedded JSON.

All of them read in parallel: text formats through Spark's own readers, archives and pages a file (or row) at a time on the executors.
"""

from __future__ import annotations

import html.parser
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.shredding import parse_document
from touchline.session import cut

RESULTS_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "HTHG", "HTAG", "HTR", "_corrupt")])
REQUIRED = ("Div", "Date", "HomeTeam", "AwayTeam")
#: Limits of archives: members, bytes of one member unpacked, how many times larger than packed, and bytes of all members.
MAX_MEMBERS, MAX_BYTES, MAX_RATIO, MAX_TOTAL = 1000, 256 * 2**20, 200, 2**30

_NAMED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("period", T.ShortType()), T.StructField("timestamp", T.StringType()),
        T.StructField("minute", T.ShortType()), T.StructField("second", T.ShortType()), T.StructField("type", _NAMED), T.StructField("possession_team", _NAMED), T.StructField("team", _NAMED), T.StructField("player", _NAMED),
        T.StructField("location", T.ArrayType(T.DoubleType())), T.StructField("related_events", T.ArrayType(T.StringType())),
    ]
)
EVENT_FIELDS = tuple(EVENT_SCHEMA.names)
#: Fields of an object that make it an event wherever one may stand.
EVENT_NEED = ("id", "index", "type")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of results files, all text, header-driven; lines with fewer or more fields than the header are kept in _corrupt. Gzip is read as it is."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in reader.csv(path).columns], T.StructField("_corrupt", T.StringType())])
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).csv(path)
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in RESULTS_SCHEMA.names])


def typed_results(raw: DataFrame) -> DataFrame:
    """Typed results with a finding per row: null where a required field is missing, a score is no count, or the result letter contradicts the score."""
    count = lambda c: F.when(F.trim(c).rlike("^[0-9]{1,2}$"), F.trim(c).cast("int"))
    typed = raw.select(*[F.trim(c).alias(c) for c in REQUIRED], count("FTHG").alias("home_goals"), count("FTAG").alias("away_goals"), count("HTHG").alias("ht_home"), count("HTAG").alias("ht_away"), F.upper(F.trim("FTR")).alias("result"))
    missing = F.greatest(*[F.coalesce(F.col(c), F.lit("")) == "" for c in REQUIRED])
    letter = F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") == F.col("away_goals"), "D").otherwise("A")
    finding = (
        F.when(missing, "missing_required")
        .when(F.col("home_goals").isNull() != F.col("away_goals").isNull(), "half_score")
        .when(F.col("home_goals").isNotNull() & F.col("result").isNotNull() & (F.col("result") != letter), "result_contradicts_score")
        .when((F.col("ht_home") > F.col("home_goals")) | (F.col("ht_away") > F.col("away_goals")), "half_time_above_full_time")
    )
    return typed.withColumn("finding", finding)


def field_coverage(df: DataFrame) -> DataFrame:
    """field, filled, rows: how many rows have a non-empty value, for all fields in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) != "").alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("filled"), F.col("rows")) for i, c in enumerate(df.columns)])
    return counts.select(F.inline(cells))


def _member_finding(m: zipfile.ZipInfo, seen: set[str], taken: int, max_bytes: int, max_ratio: int, max_total: int) -> str | None:
    """What forbids reading a member of an archive, if anything does."""
    name = m.filename.replace("\\", "/")
    if name.startswith("/") or ":" in name or ".." in name.split("/"):
        return "unsafe_path"
    if name.lower() in seen:
        return "duplicate_member"
    if m.flag_bits & 1:
        return "encrypted_member"
    if m.file_size > max_bytes or m.file_size > max_ratio * max(1, m.compress_size):
        return "member_too_large"
    return "archive_too_large" if taken + m.file_size > max_total else None


def read_zipped_results(spark: SparkSession, path: str, max_members: int = MAX_MEMBERS, max_bytes: int = MAX_BYTES, max_ratio: int = MAX_RATIO, max_total: int = MAX_TOTAL) -> DataFrame:
    """archive, member, line, text, finding: lines of the CSV members of archives; an archive or a member that breaks a rule gives one row with a finding instead.

    Refused are too many members, paths that lead out of the archive, names that occur twice, encrypted members, and members or archives beyond the limits of size and ratio. Members are
    unpacked as they are read, and never beyond the size they state.
    """
    columns = ["archive", "member", "line", "text", "finding"]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members, seen, taken = [m for m in z.infolist() if not m.is_dir()], set(), 0
                        if len(members) > max_members:
                            rows.append((name, None, None, None, "too_many_members"))
                            members = []
                        for m in members:
                            finding = _member_finding(m, seen, taken, max_bytes, max_ratio, max_total)
                            seen.add(m.filename.replace("\\", "/").lower())
                            if finding:
                                rows.append((name, m.filename, None, None, finding))
                            elif m.filename.lower().endswith(".csv"):
                                taken += m.file_size
                                with z.open(m) as packed, io.TextIOWrapper(packed, "utf-8-sig", "replace") as lines:
                                    for i, line in enumerate(lines):
                                        rows.append((name, m.filename, i, line.rstrip("\r\n"), None))
                                        if len(rows) >= 10_000:
                                            yield pd.DataFrame(rows, columns=columns)
                                            rows = []
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                    rows.append((name, None, None, None, "no_archive"))
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "archive string, member string, line long, text string, finding string")


def located_values(spark: SparkSession, path: str) -> DataFrame:
    """file, row, field, name, value: every cell of delimited files with its place, from 0, as the key by which it can be found again. The header is row 0; quoted fields are read as such.

    Rows are numbered by their place in the file, so a number does not depend on partitions; a file is read by one task.
    """
    import csv

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                header: list[str] = []
                rows: list[tuple] = []
                for i, cells in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")))):
                    header = header or cells
                    rows += [(name, i, j, header[j] if j < len(header) else None, v) for j, v in enumerate(cells)]
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=["file", "row", "field", "name", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "row", "field", "name", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(locate, "file string, row long, field int, name string, value string")


def store_raw(spark: SparkSession, path: str, store: str) -> DataFrame:
    """digest, bytes: the files under ``path`` by their SHA-256, written once to ``store``: content that it holds already, or that occurs twice, is not written again. Returns what was new."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"), "content").dropDuplicates(["digest"])
    try:
        held = spark.read.parquet(store).select("digest")
        new = found.join(held, "digest", "left_anti")
    except AnalysisException:  # no store yet
        new = found
    new = cut(new)
    new.write.mode("append").parquet(store)
    return new.select("digest", "bytes")


def _holds_events(value: object) -> bool:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if "events" in v:
                return True
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)
    return False


def event_items(value: object) -> list[tuple[dict | None, str | None]]:
    """(event, finding) of a parsed document, in document order: the objects of a root array and of arrays (or lone objects) labelled ``events`` at any depth, or a lone root event.

    The finding is ``not_an_event`` for something else at the place of an event, and ``no_events`` (one item) for a document without such a place; an empty array is sound.
    """
    if not isinstance(value, list) and not _holds_events(value) and not (isinstance(value, dict) and all(k in value for k in EVENT_NEED)):
        return [(None, "no_events")]
    items: list[tuple[dict | None, str | None]] = []
    todo: list[tuple[object, str]] = [(value, "")]
    while todo:
        v, label = todo.pop()
        place = label in ("", "events")
        if isinstance(v, list):
            todo.extend((x, label) for x in reversed(v))
        elif isinstance(v, dict) and place and (all(k in v for k in EVENT_NEED) or not _holds_events(v) and any(k in v for k in EVENT_FIELDS)):
            items.append(({k: v[k] for k in (*EVENT_FIELDS, "pass") if k in v}, None))
        elif isinstance(v, dict) and (not place or _holds_events(v)):
            todo.extend((x, k) for k, x in reversed(v.items()) if k == "events" or isinstance(x, dict | list))
        elif place:
            items.append((None, "not_an_event"))
    return items


def event_objects(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, event (the JSON of one event, with its known fields), finding: the events of every text, or what is wrong with it; see ``event_report``."""
    kind = dict(df.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for k, text in zip(pdf["k"], pdf["raw"], strict=True):
                ok, value = parse_document(text)
                out += [(k, json.dumps(e) if f is None else None, f) for e, f in event_items(value)] if ok else [(k, None, "malformed")]
            yield pd.DataFrame(out, columns=["k", "event", "finding"])

    pairs = df.select(F.col(key).alias("k"), F.col(raw).alias("raw"))
    return pairs.mapInPandas(parse, f"k {kind}, event string, finding string").withColumnRenamed("k", key)


def event_report(df: DataFrame, key: str, raw: str) -> DataFrame:
    """The rows of ``event_rows`` with a finding, null for an event: one row per text that is null, empty or does not parse as a whole (``malformed``), and per finding of ``event_items``."""
    items = event_objects(df, key, raw)
    e = items.select(key, "finding", F.from_json("event", EVENT_SCHEMA).alias("e")).select(key, "finding", "e.*")
    x, y = F.try_element_at("location", F.lit(1)), F.try_element_at("location", F.lit(2))
    quality = F.when(F.col("finding").isNotNull(), None).when(x.isNull() | y.isNull(), "missing").when(x.between(0, 120) & y.between(0, 80), "valid").otherwise("out_of_bounds")
    return e.select(
        key, F.col("id").alias("event_id"), "index", "period", "timestamp", "minute", "second", F.col("type.name").alias("event_type"), F.col("team.id").alias("team_id"), F.col("player.id").alias("player_id"),
        x.alias("source_x"), y.alias("source_y"), F.when(quality == "valid", x / 120).alias("x_norm"), F.when(quality == "valid", y / 80).alias("y_norm"), quality.alias("location_quality"), "finding",
    )


def event_rows(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key and the typed columns of every event of a raw event document, in any shape of ``event_items``; what gives no event is in ``event_report``. Coordinates outside the field are marked."""
    return event_report(df, key, raw).where("finding is null").drop("finding")


class _Tables(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int, str]] = []
        self.table, self.row, self.cell, self.text, self.inside = -1, -1, -1, "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.cell = self.row + 1, -1
        elif tag in ("td", "th"):
            self.cell, self.text, self.inside = self.cell + 1, "", True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.inside:
            self.rows.append((self.table, self.row, self.cell, " ".join(self.text.split())))
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.text += data


def html_cells(df: DataFrame, key: str, page: str) -> DataFrame:
    """key, table, row, cell, text of every cell of the tables in HTML pages."""
    kind = dict(df.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for k, text in zip(pdf["k"], pdf["page"], strict=True):
                if text:
                    p = _Tables()
                    p.feed(text)
                    out += [(k, *r) for r in p.rows]
            yield pd.DataFrame(out, columns=["k", "table", "row", "cell", "text"])

    pairs = df.select(F.col(key).alias("k"), F.col(page).alias("page"))
    return pairs.mapInPandas(parse, f"k {kind}, table int, row int, cell int, text string").withColumnRenamed("k", key)


def delimited_feed(text: Column, record: str = "~", field: str = "¬", pair: str = "÷") -> Column:
    """array<map>: the records of a delimiter feed as maps of their keys."""
    records = F.filter(F.split(text, re.escape(record)), lambda r: F.length(F.trim(r)) > 0)
    fields = lambda r: F.filter(F.transform(F.split(r, re.escape(field)), lambda f: F.split(f, re.escape(pair), 2)), lambda kv: F.size(kv) == 2)
    # of a key that occurs twice in a record the first counts
    return F.transform(records, lambda r: F.map_from_entries(F.aggregate(fields(r), F.array().cast("array<struct<key:string,value:string>>"), lambda acc, kv: F.when(F.exists(acc, lambda e: e["key"] == kv[0]), acc).otherwise(F.array_append(acc, F.struct(kv[0].alias("key"), kv[1].alias("value")))))))


def embedded_json(page: Column, variable: str) -> Column:
    """The JSON text assigned to a script variable as JSON.parse('...') with hex escapes, or directly; null where there is none."""
    escaped = F.regexp_extract(page, rf"{re.escape(variable)}\s*=\s*JSON\.parse\('([^']*)'\)", 1)
    plain = F.regexp_extract(page, rf"{re.escape(variable)}\s*=\s*([\[{{].*?[\]}}])\s*;", 1)
    decoded = F.aggregate(
        F.filter(F.split(escaped, r"(?=\\x[0-9a-fA-F]{2})"), lambda s: F.length(s) > 0),
        F.lit(""),
        lambda acc, s: F.concat(acc, F.when(s.rlike(r"^\\x[0-9a-fA-F]{2}"), F.concat(F.char(F.conv(F.substring(s, 3, 2), 16, 10).cast("int")), F.substring(s, 5, 2**30))).otherwise(s)),
    )
    return F.when(escaped != "", decoded).when(plain != "", plain)


def json_is_sound(text: str | None) -> bool:
    """Whether a text is one JSON value."""
    try:
        json.loads(text or "")
        return True
    except ValueError:
        return False

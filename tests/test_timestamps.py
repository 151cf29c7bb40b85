"""Normalised instants and days against an independent reading in plain Python, and the edge cases of the docstrings."""

import datetime as dt
import re
import zoneinfo

import pytest
from pyspark.sql import functions as F

from touchline.operators import timestamps as ts
from touchline.session import sized_join

CASES = [
    ("2020-01-02T03:04:05Z", None, "2020-01-02T03:04:05.000000Z"),
    ("2020-01-02 03:04:05,678", "Europe/Berlin", "2020-01-02T02:04:05.678000Z"),
    ("2020-07-02T03:04:05.123456789+0530", None, "2020-07-01T21:34:05.123456Z"),
    ("1577934245", None, "2020-01-02T03:04:05.000000Z"),
    ("1577934245678", None, "2020-01-02T03:04:05.678000Z"),
    ("1577934245678901", None, "2020-01-02T03:04:05.678901Z"),
    ("1577934245678901234", None, "2020-01-02T03:04:05.678901Z"),
    ("Sun, 31 Jul 2022 00:18:22 +0200", None, "2022-07-30T22:18:22.000000Z"),
    ("20250319T020354Z", None, "2025-03-19T02:03:54.000000Z"),
    ("2014-04-03 12:07:53 am", "America/New_York", "2014-04-03T04:07:53.000000Z"),
    ("2014-04-03 12:07:53 pm", "America/New_York", "2014-04-03T16:07:53.000000Z"),
    ("12.09.2023 05:46", "Europe/Athens", "2023-09-12T02:46:00.000000Z"),
    ("2021-03-28 02:30:00", "Europe/Berlin", ts.UNRESOLVED),  # skipped
    ("2021-10-31 02:30:00", "Europe/Berlin", ts.UNRESOLVED),  # repeated
    ("2021-10-31 02:30:00 CEST", "Europe/Berlin", "2021-10-31T00:30:00.000000Z"),
    ("2021-02-29T10:00:00Z", None, ts.UNRESOLVED),
    ("2021-02-28T25:00:00Z", None, ts.UNRESOLVED),
    ("2021-02-28 10:00:00", None, ts.UNRESOLVED),
    ("2021-02-28 10:00:00", "Nowhere/Atall", ts.UNRESOLVED),
    ("yesterday", "Europe/Berlin", ts.UNRESOLVED),
    ("", "Europe/Berlin", ts.UNRESOLVED),
    (None, None, ts.UNRESOLVED),
    ("9" * 5000, "Europe/Berlin", ts.UNRESOLVED),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, z, "x") for i, (t, z, _) in enumerate(CASES)], "i int, at string, zone string, __zone string")
    got = {r.i: r.out for r in ts.normalise_instants(df.drop("__zone"), "at", "out", [F.col("zone")]).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


@pytest.mark.parametrize(
    ("day", "clock", "zone", "month_first", "want"),
    [
        ("Wed 30 Mar 2022", "15:00 BST", None, False, "2022-03-30T14:00:00.000000Z"),
        ("06/11/2013", "3:00 PM", "Europe/London", False, "2013-11-06T15:00:00.000000Z"),
        ("06/11/2013", "15h00", "Europe/London", True, "2013-06-11T14:00:00.000000Z"),
        ("30.3.2021", "1945", "Asia/Tokyo", False, "2021-03-30T10:45:00.000000Z"),
        ("02-NOV-22", "16.00", "Europe/Lisbon", False, "2022-11-02T16:00:00.000000Z"),
        ("Mar 18, 2010", "20:45:00-05:00", "Europe/Lisbon", False, "2010-03-19T01:45:00.000000Z"),
        ("nonsense", "2021-12-16T12:30:00+01:00", None, False, "2021-12-16T11:30:00.000000Z"),
        ("2021-12-16", "TBC", "Europe/Lisbon", False, ts.UNRESOLVED),
        ("2021-12-16", None, "Europe/Lisbon", False, ts.UNRESOLVED),
        (None, "12:00", "Europe/Lisbon", False, ts.UNRESOLVED),
    ],
)
def test_day_and_clock(spark, day, clock, zone, month_first, want):
    df = spark.createDataFrame([(day, clock, zone)], "d string, c string, z string")
    assert ts.normalise_instants(df, "c", "out", [F.col("z")], "d", F.lit(month_first)).first().out == want


def test_days(spark):
    cases = {"41203": "2012-10-21", "7/8/19": "2019-08-07", "31/02/2010": ts.UNRESOLVED, "00/00/0000": ts.UNRESOLVED, "n/a": ts.UNRESOLVED, " 29 Jul 2019": "2019-07-29", "20091213": "2009-12-13", "29.2.20": "2020-02-29"}
    df = spark.createDataFrame([(k, "kept") for k in cases], "t string, other string")
    assert {r.t: r.out for r in ts.normalise_days(df, "t", "out").collect()} == cases
    assert ts.normalise_days(df.limit(0), "t", "out").collect() == []


def test_payload_times_against_plain_python(spark, sf):
    formats = ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%a, %d %b %Y %H:%M:%S %z", "%Y%m%dT%H%M%S%z", "%Y-%m-%d %H:%M:%S,%f", "%d.%m.%Y %H:%M", "%Y-%m-%d %I:%M:%S %p", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S%z")
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)

    def plain(text, zone):
        if text is None:
            return ts.UNRESOLVED
        if re.fullmatch(r"\d{10}|\d{13}|\d{16}", text):
            us = int(text) * 10 ** (16 - len(text))
        else:
            text = re.sub(r"(\.\d{6})\d+", r"\1", text)
            for f in formats:
                try:
                    x = dt.datetime.strptime(text, f)
                    break
                except ValueError:
                    continue
            else:
                return ts.UNRESOLVED
            if x.tzinfo is None:
                if zone is None:
                    return ts.UNRESOLVED
                a = x.replace(tzinfo=zoneinfo.ZoneInfo(zone))
                if a.utcoffset() != a.replace(fold=1).utcoffset():
                    return ts.UNRESOLVED
                x = a
            us = (x - epoch) // dt.timedelta(microseconds=1)
        return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    df = spark.read.parquet(f"{sf}/provider_payload.parquet").select("acquired_at", "clock_zone")
    for r in ts.normalise_instants(df, "acquired_at", "out", [F.col("clock_zone")]).collect():
        assert r.out == plain(r.acquired_at, r.clock_zone), r


def test_unknown_shapes(spark):
    df = spark.createDataFrame([("12:30",), ("someday",), ("someday",), (None,)], "t string")
    assert {(r.shape, r.rows) for r in ts.unknown_shapes(df, "t").collect()} == {("AAAAAAA", 2)}


def test_years_far_off_and_the_version_of_the_zones(spark):
    """Local years that the zone tables of an hour ago did not hold; a row that needed no zone has no version."""
    cases = [("1890-06-01 12:00:00", "UTC", "1890-06-01T12:00:00.000000Z"), ("2150-07-01 12:00:00", "Europe/Berlin", "2150-07-01T10:00:00.000000Z"), ("0001-01-05 00:00:00", "UTC", "0001-01-05T00:00:00.000000Z"), ("9999-12-20 00:00:00", "Asia/Tokyo", "9999-12-19T15:00:00.000000Z"), ("2020-01-01T00:00:00Z", "Europe/Berlin", "2020-01-01T00:00:00.000000Z")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, z string")
    rows = {r.t: r for r in ts.normalise_instants(df, "t", "out", [F.col("z")], version="tz").collect()}
    assert [rows[c[0]].out for c in cases] == [c[2] for c in cases]
    assert all(rows[c[0]].tz == ts.zone_version() for c in cases[:4]) and rows[cases[4][0]].tz is None


def test_words_that_only_look_like_parts(spark):
    cases = ["Foo 30 Mar 2022", "30 Mai 2022", "2022-03-30X10:00:00Z", "10:00 XM", "12:30PMCET", "Wed, 30 Mar 2022", "Sept. 3, 2022", "3-Sep-22"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.out for r in sorted(ts.normalise_days(df, "t", "out").collect(), key=lambda r: cases.index(r.t))] == [ts.UNRESOLVED] * 5 + ["2022-03-30", "2022-09-03", "2022-09-03"]


def test_joins_beyond_the_broadcast_bound(spark):
    """The same rows whichever way a table is joined; one key holds a third of the rows, some are null, some meet nothing."""
    left = spark.createDataFrame([(None if i % 11 == 0 else 1 if i % 3 == 0 else i % 50, i) for i in range(600)], "k int, i int")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "k int, v string")
    for how in ("inner", "left"):
        want = sorted((r.i, r.k, r.v) for r in left.join(right, "k", how).collect()) if how == "inner" else {(r.i, r.k, r.v) for r in left.join(right, "k", how).collect()}
        for bound in (0, 2**20):
            got = [(r.i, r.k, r.v) for r in sized_join(left, right, ["k"], how, bound).collect()]
            assert len(got) == len(want) and set(got) == set(want)

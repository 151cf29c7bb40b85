"""Typed names of many words, and clubs whose own name has several."""

import pytest

pytest.importorskip("touchline.llm.canonical")
from pyspark.sql import functions as F

from touchline.llm import canonical

OWN = ["Zorban", "Mivelka", "Truskot", "Palendor", "Quesbury", "Holvarde", "Niptown", "Ybrelund", "Dorcastle", "Grenfall"]


def matched(spark, names, entries):
    clubs = spark.createDataFrame([(e, e, None, "AA", "Aland") for e in entries], "entry string, name string, short string, country string, country_name string")
    df = spark.createDataFrame(list(enumerate(names)), "id int, a string")
    got = {r.id: r.entry for r in canonical.map_names(df, "id", ["a"], F.lit("AA"), clubs).collect()}
    return [got[i] for i in range(len(names))]


def test_many_words(spark):
    entries = [f"{o} Alpha Bravo Gamma Delta Omega" for o in OWN]
    assert matched(spark, [entries[0], entries[3].lower(), "Nowhere Alpha Bravo Gamma Delta Omega"], entries) == [entries[0], entries[3], "UNMATCHED"]


def test_own_name_of_two_words(spark):
    entries = [f"{o} Rovers" for o in OWN] + ["Selkirk Lomond Rovers"]
    typed = ["Selkirk Lomond Rovers", "Selkirk Lomnd Rovers", "Rovers Selkirk Lomond", "SelkirkLomond Rovers", "Lomond Rovers", "Zorban Mivelka Rovers"]
    assert matched(spark, typed, entries) == [entries[-1]] * 4 + ["UNMATCHED"] * 2

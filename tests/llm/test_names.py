import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("touchline.llm.canonical")
from touchline.llm import canonical, linkage, names, queries  # noqa: E402


def test_pigeonhole_finds_all_within_two_edits(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    refs = sorted({word(rng.randrange(3, 12)) for _ in range(300)})
    typed = sorted({word(rng.randrange(3, 12)) for _ in range(300)} | {r[:1] + r[2:] for r in refs[:80]} | {r[:2] + "e" + r[2:] for r in refs[80:160]})
    q, r = spark.createDataFrame([(t,) for t in typed], "t string"), spark.createDataFrame([(t,) for t in refs], "r string")
    got = canonical.probes_of(q, "t").join(canonical.segments_of(r, "r"), "segment").where(F.levenshtein("t", "r", 2) >= 0).select("t", "r").distinct()
    want = q.crossJoin(r).where(F.levenshtein("t", "r") <= 2)  # brute force on a fixture
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}


CLUBS = [
    ("1", "FC Grünbrück", "GBK", "BNM"), ("2", "Oldford United", "OFU", "ABR"), ("3", "Oldford City", "OFC", "ABR"), ("4", "Real Montaña", "MON", "VDR"), ("5", "Wexley Rovers", "WXR", "ABR"), ("6", "Wexley Rovers", "WXS", "STM"), ("7", "Oldford United B", None, "ABR"),
    *[(f"f{i}", f"FC Platz{'abcdefghijkl'[i] * 3}", None, "BNM") for i in range(12)], *[(f"u{i}", f"Stead{'mnopqrstuvwx'[i] * 3} United", None, "ABR") for i in range(12)], *[(f"c{i}", f"Hill{'mnopqrstuvwx'[i] * 3} City", None, "ABR") for i in range(12)],
    *[(f"r{i}", f"Ford{'mnopqrstuvwx'[i] * 3} Rovers", None, "ABR") for i in range(12)], *[(f"m{i}", f"Real Casa{'mnopqrstuvwx'[i] * 3}", None, "VDR") for i in range(12)],
]


def clubs(spark):
    full = {"BNM": "Brennmark", "ABR": "Albrey", "VDR": "Valdoria", "STM": "Southmere"}
    return spark.createDataFrame([(i, n, s, c, full[c]) for i, n, s, c in CLUBS], "entry string, name string, short string, country string, country_name string")


def test_map_names(spark):
    cases = [
        ("grunbruck  F.C.", None, "BNM", "1"), ("Football Club Gruenbrück", None, "bnm", "1"), ("FC Grunbrukc", None, "Brennmark", "1"), ("GBK", None, None, "1"), ("Oldford", None, "ABR", "UNMATCHED"), ("Oldford Utd.", None, None, "2"), ("0ldf0rd Cty*", None, "ABR", "3"),
        ("Oldf. City (club)", None, "ABR", "3"), ("Oldford United Ladies", None, "ABR", "UNMATCHED"), ("Oldford United II", None, "ABR", "7"), ("montana real 1st team", None, None, "4"), ("Wexley Rovers", None, None, "UNMATCHED"), ("Wexley Rovers [Southmere]", None, None, "6"),
        ("Oldford", "Oldford City", "ABR", "3"), ("Oldford City", "Oldford United", "ABR", "UNMATCHED"), ("?", "Real Montaña", None, "4"), ("Winner QF1", None, "ABR", "UNMATCHED"), ("", "  ", None, "UNMATCHED"), (None, None, "ABR", "UNMATCHED"), ("x" * 5000, None, None, "UNMATCHED"), ("Oldford Rovers", None, "ABR", "UNMATCHED"),
    ]
    rows = [(i, a, b, c, "clash") for i, (a, b, c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows + rows[:2] + [(None, "GBK", None, None, "x")], "id long, a string, b string, land string, entry string")
    got = {r.id: r.entry for r in canonical.map_names(df.drop("entry"), "id", ["a", "b"], F.col("land"), clubs(spark)).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases] and len(got) == len(cases)


def test_map_names_on_empty_tables(spark):
    df = spark.createDataFrame([(1, "Oldford City", None)], "id long, a string, land string")
    assert [tuple(r) for r in canonical.map_names(df, "id", ["a"], F.col("land"), clubs(spark).limit(0)).collect()] == [(1, "UNMATCHED")]
    assert canonical.map_names(df.limit(0), "id", ["a"], F.col("land"), clubs(spark)).collect() == []


def test_sides_and_words(spark):
    r = spark.createDataFrame([("A.F.C. Old-ford  (W)",), ("Oldford U-19 1st team [Albrey]",), ("Oldford B.",)], "n string").select(names.tokens(F.col("n")).alias("t")).select(names.sides(F.col("t")).alias("s"), F.transform(names.core(F.col("t")), lambda w: w["t"]).alias("w")).collect()
    assert [(x.s, x.w) for x in r] == [("women", ["afc", "old", "ford"]), ("youth", ["oldford"]), ("", ["oldford", "b"])]


LEFT = [
    (1, "Oldford Utd", "FC Gruenbruck", 100, 2, 1), (2, "Oldford Utd", "FC Gruenbruck", 100, 2, 1), (3, "Grunbruck", "Oldf. United", 101, 1, 2), (4, "Oldford City", "FC Grünbrück", 100, 2, 1), (5, "Oldford United Women", "FC Grünbrück Women", 100, 2, 1),
    (6, "Wexley Rvrs", "Montana Real", 200, None, None), (7, "Wexley Rovers", "Real Montaña", 203, 0, 0), (8, "Oldford United", "FC Grünbrück", None, 2, 1), (9, None, "x", 100, 0, 0), (10, "", "", 100, 0, 0), (11, "z" * 3000, "y", 100, 0, 0),
]
RIGHT = [("m1", "OLDFORD UNITED", "FC Grünbrück", 100, 2, 1), ("m1", "OLDFORD UNITED", "FC Grünbrück", 100, 2, 1), ("m2", "Wexley Rovers", "real montaña", 201, 3, 3), ("m3", "Wexley Rovers", "Real Montaña", 206, 0, 0), ("m4", None, None, 100, 0, 0)]


TRACE: list[float] = []


def link(spark, left, right):
    l = spark.createDataFrame(left, "i long, home_text string, away_text string, day int, home_goals int, away_goals int").withColumn("season", F.lit("1970/1971"))  # noqa: E741
    r = spark.createDataFrame(right, "j string, home_text string, away_text string, day int, home_goals int, away_goals int").withColumn("season", F.lit("1970/1971"))
    return {x.i: (x.j, x.confidence) for x in linkage.link(l, r, spark.createDataFrame([(w,) for w in ("fc", "united", "city", "rovers", "real")], "word string"), trace=TRACE).collect()}


def test_link(spark):
    got = link(spark, LEFT, RIGHT)
    assert {i: j for i, (j, _) in got.items()} == {1: "m1", 2: "m1", 3: "m1", 6: "m2"}
    assert got[1] == got[2] and all(0.45 <= c <= 1 for _, c in got.values())
    assert link(spark, [], RIGHT) == {} and link(spark, LEFT, []) == {}


def test_the_solver_comes_to_rest(spark):
    TRACE.clear()
    link(spark, LEFT, RIGHT)
    assert TRACE[-1] < linkage.Rules().tolerance and len(TRACE) < linkage.Rules().rounds - 1


def test_projection_is_exact():
    """Against a search for the amount that all values give up; records of many values, of negative ones, and of one."""
    rng = np.random.default_rng(5)
    record = np.sort(rng.integers(0, 40, 400))
    _, record = np.unique(record, return_inverse=True)
    values = rng.normal(0.2, 0.6, 400)
    got = linkage.at_most_one(values, record)
    for r in range(record.max() + 1):
        v, low, high = values[record == r], 0.0, 10.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if np.maximum(v - mid, 0).sum() > 1 else (low, mid)
        assert got[record == r] == pytest.approx(np.maximum(v - (0 if np.maximum(v, 0).sum() <= 1 else low), 0), abs=1e-9)


def test_spellings_of_marked_letters_and_short_words(spark):
    right = [("m1", "Mäkikkajärvi Pallo", "AZ", 100, 2, 1), ("m2", "Real Montañera", "Oldford United", 100, 1, 1)]
    left = [(1, "Maekikkajaer. Pallo", "AZ", 100, 2, 1), (2, "Makikkaja. Pallo", "AZ", 101, 2, 1), (3, "Montanyera", "Oldford Utd", 100, 1, 1)]
    assert {i: j for i, (j, _) in link(spark, left, right).items()} == {1: "m1", 2: "m1", 3: "m2"}


def test_undated_match_falls_back_to_the_season(spark):
    right = [("m1", "Oldford United", "FC Grünbrück", None, 2, 1), ("m2", "FC Grünbrück", "Oldford United", None, 0, 0)]
    assert {i: j for i, (j, _) in link(spark, LEFT[:1], right).items()} == {1: "m1"}


def test_known_ids_are_found_again(spark, sf):
    """Held-out accuracy: mappings whose club is known, as if it were not."""
    known = spark.read.parquet(f"{sf}/provider_mapping.parquet").where("canonical_team_id is not null").select("mapping_id", "provider_team_name", "country_code", "canonical_team_id").dropDuplicates(["mapping_id"])
    entries = canonical.club_entries(spark.read.parquet(f"{sf}/product_teams.parquet"))
    got = canonical.map_names(known, "mapping_id", ["provider_team_name"], F.col("country_code"), entries).join(known, "mapping_id").collect()
    wrong = [r for r in got if r.entry not in (r.canonical_team_id, canonical.UNMATCHED)]
    assert not wrong and sum(r.entry == r.canonical_team_id for r in got) >= 0.95 * len(got)


def test_queries_run(spark, sf):
    for name in ("p4_found", "p4_confidence", "p6_found"):
        assert queries.queries()[name](spark, sf).count() > 0

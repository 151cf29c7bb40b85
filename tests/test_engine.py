"""Graphs, folds, fits, simulation, scores, sources, sinks and streams on small fixtures."""

import json
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.functions import markets
from touchline.functions import probability as P
from touchline.functions import text
from touchline.functions.clocks import clock_seconds
from touchline.functions.keys import uuid_key, uuid_text
from touchline.operators import graphs, models, quality, ratings, score_models, scoring, simulation
from touchline.sources import files, sinks
from touchline.streaming import observations


def test_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1)]
    df = spark.createDataFrame(edges, "a int, b int")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in graphs.components(df, "a", "b").collect()} == {n: find(n) for n in parent}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (9, 7)], "s int, t int")
    assert {r.s: (r.final, r.hops) for r in graphs.resolve_chains(chain, "s", "t").collect()} == {1: (4, 3), 2: (4, 2), 3: (4, 1), 7: (None, None), 8: (None, None), 9: (None, None)}
    seeds = spark.createDataFrame([(1,)], "n int")
    assert {r.node: r.depth for r in graphs.reachable(chain, "s", "t", seeds).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_probabilities(spark):
    df = spark.createDataFrame([(1.4, 1.1, -0.05)], "lh double, la double, rho double")
    cells = P.score_cells(F.col("lh"), F.col("la"), F.col("rho"), 25)
    r = df.select(P.mass(cells, lambda h, a: F.lit(True)).alias("all"), P.poisson(F.lit(30), F.lit(28.0)).alias("p"), P.poisson_cdf(F.lit(3), F.col("lh")).alias("c"), P.negative_binomial(F.lit(2), F.lit(1.5), F.lit(0.0)).alias("nb")).first()
    assert r["all"] == pytest.approx(1, abs=1e-9)
    assert r.p == pytest.approx(math.exp(30 * math.log(28) - 28 - math.lgamma(31)))
    assert r.c == pytest.approx(sum(math.exp(-1.4) * 1.4**k / math.factorial(k) for k in range(4)))
    assert r.nb == pytest.approx(math.exp(-1.5) * 1.5**2 / 2)
    x = spark.createDataFrame([(m, q) for m in range(-2, 3) for q in range(-4, 5)], "m int, q int").withColumn("s", P.settle_quarters(4 * F.col("m"), F.col("q")))

    def slow(m, q):
        lines = [q / 4] * 2 if q % 2 == 0 else [(q - 1) / 4, (q + 1) / 4]
        won = sum((m + line > 0) - (m + line < 0) for line in lines)
        return {2: "FULL_WIN", 1: "HALF_WIN", 0: "PUSH", -1: "HALF_LOSS", -2: "FULL_LOSS"}[won]

    assert all(r.s == slow(r.m, r.q) for r in x.collect())


def test_scores(spark):
    df = spark.createDataFrame([("g", 0.2, True), ("g", 0.2, False), ("g", 0.1, False), ("g", 0.9, True), ("h", 0.3, True)], "k string, s double, y boolean")
    got = {r.k: r.auc for r in scoring.auc(df, ["k"], "s", "y").collect()}
    assert got == {"g": pytest.approx((0.5 + 1 + 2) / 4), "h": None}
    d = spark.createDataFrame([([0.5, 0.3, 0.2], 1)], "pmf array<double>, y int").select(scoring.crps(F.col("pmf"), F.col("y")).alias("c")).first().c
    assert d == pytest.approx(0.25 + 0.04)
    same = np.full(37, 0.25)
    assert scoring.block_bootstrap(same, 50, 10, 1) == pytest.approx(np.full(50, 0.25))


def test_generator_and_simulation(spark):
    # published first outputs for seed 0
    assert [int(x) for x in simulation.splitmix64(0, 3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    df = spark.createDataFrame([("m", [(0, 0, 0.3), (1, 0, 0.6)])], "id string, cells array<struct<home:int,away:int,p:double>>")
    a = sorted(map(tuple, simulation.simulate(df, "id", "cells", draws=5000).collect()))
    b = sorted(map(tuple, simulation.simulate(df.repartition(5), "id", "cells", draws=5000).collect()))
    assert a == b and sum(r[-1] for r in a) == 20_000
    drawn = [sorted(map(str, simulation.simulate_events(x, "id", "cells").collect())) for x in (df, df.repartition(5))]
    assert drawn[0] == drawn[1]
    rates = {r.event: r.hits / 112_460 for r in simulation.event_rates(simulation.simulate_events(df, "id", "cells"), "id").collect()}
    assert rates["outcome:home_win"] == pytest.approx(0.6, abs=0.01) and rates["unresolved_tail"] == pytest.approx(0.1, abs=0.01)


def test_elo_against_a_plain_fold():
    rng = random.Random(7)
    m = pd.DataFrame([{"match_id": i, "ko": 86400 * (i // 3), "home": i % 3 * 2 + rng.randrange(2), "away": 6 + i % 3, "hg": rng.randrange(5), "ag": rng.randrange(5)} for i in range(60)])
    got = ratings.fold(m.sample(frac=1, random_state=1)).set_index("match_id")
    state: dict = {}
    for _, batch in m.groupby("ko"):
        updates = []
        for r in batch.itertuples():
            now = [1500 if t not in state else 1500 + (state[t][0] - 1500) * 0.5 ** ((r.ko - state[t][1]) / 86400 / 365) for t in (r.home, r.away)]
            assert (got.home_before[r.match_id], got.away_before[r.match_id]) == (pytest.approx(now[0]), pytest.approx(now[1]))
            e = 1 / (1 + 10 ** ((now[1] - now[0] - 100) / 400))
            g = abs(r.hg - r.ag)
            k = 20 * (1 + math.log(g) if g > 1 else 1) * ((r.hg > r.ag) + 0.5 * (r.hg == r.ag) - e)
            updates += [(r.home, now[0] + k, r.ko), (r.away, now[1] - k, r.ko)]
        for t, v, ko in updates:
            state[t] = (v, ko)


def test_fits_recover_what_made_the_data():
    rng = np.random.default_rng(4)
    attack, defence = rng.normal(0, 0.3, 8), rng.normal(0, 0.3, 8)
    rows = []
    for h in range(8):
        for a in range(8):
            if h != a:
                n = 400
                x, y = rng.poisson(np.exp(0.1 + 0.25 + attack[h] - defence[a]), n), rng.poisson(np.exp(0.1 + attack[a] - defence[h]), n)
                rows += [{"home": h, "away": a, "hg": i, "ag": j} for i, j in zip(x, y, strict=True)]
    counts = pd.DataFrame(rows).groupby(["home", "away", "hg", "ag"]).size().rename("w").reset_index()
    f = score_models.fit(counts)
    got_a, got_d, home, rho = dict(zip(f.teams, f.attack, strict=True)), dict(zip(f.teams, f.defence, strict=True)), f.home, f.rho
    assert home == pytest.approx(0.25, abs=0.05) and abs(rho) < 0.05
    assert np.corrcoef([got_a[t] for t in range(8)], attack)[0, 1] > 0.99 and np.corrcoef([got_d[t] for t in range(8)], defence)[0, 1] > 0.99
    assert models.mixture_weights(np.array([[0.5, 0.1], [0.4, 0.2]]), np.array([1.0, 1.0]))[0] == pytest.approx(1, abs=1e-3)
    z = np.linspace(-3, 3, 200)
    p = 1 / (1 + np.exp(-(0.3 + 0.7 * z)))
    assert models.platt(z, 1000 * p, np.full(200, 1000.0)) == (pytest.approx(0.3, abs=1e-6), pytest.approx(0.7, abs=1e-6))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=30))
def test_isotonic_is_monotone_and_keeps_the_mean(values):
    out = models.pool_adjacent(np.array(values), np.ones(len(values)))
    assert np.all(np.diff(out) >= -1e-9) and out.mean() == pytest.approx(np.mean(values), abs=1e-9)


def test_texts(spark):
    clocks = {"45+2:43": 2863, "00:34:23": 2063, "79:31.000": 4771, "112:24": 6744, "7:12": 432, "90+10:01": 6001, "x": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in clocks], "t string").select("t", clock_seconds(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == clocks
    keys = spark.createDataFrame([("{99EB61F0-86b6-4828-ab04-93b43533e7a2}",), (" 99eb61f086b64828ab0493b43533e7a2",), ("99eb61f0-86b6-4828-ab04-93b43533e7a2",)], "k string")
    assert keys.select(uuid_key(F.col("k"))).distinct().count() == 1 and keys.select(uuid_text(F.col("k")).alias("t")).distinct().first().t == "99eb61f0-86b6-4828-ab04-93b43533e7a2"
    r = spark.range(1).select(
        text.measurement_key(F.lit("Ball Possession")).alias("k"), text.measurement_value(F.lit("12%")).alias("p"), text.measurement_value(F.lit("3/4 (75%)")).alias("f"), text.measurement_value(F.lit("true")).alias("n"), text.strict_count(F.lit("-1")).alias("c"),
        markets.market(F.lit(" Over  2.5 ")).alias("m"), text.event_kind(F.lit("Goal disallowed")).alias("e"), text.score_bucket(F.lit("5+")).alias("b"), text.club_key(F.lit("FC The Rovers!")).alias("club"), text.backoff_seconds(F.lit(4)).alias("w"),
    ).first()
    assert (r.k, r.p, r.f, r.n, r.c, tuple(r.m), r.e, tuple(r.b), r.club, r.w) == ("possession", 12.0, 0.75, None, None, ("TOTAL_GOALS", "TOTAL_OVER_2_5"), "DISALLOWED", (5, "AT_LEAST"), "rovers", 240.0)


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nE0,01/02/20,A,B,2,1,H\nE0,02/02/20,A,,1,1,D\nE0,03/02/20,C,D,0,3,H\n")
    raw = files.read_results(spark, str(tmp_path / "r.csv"))
    assert [r.finding for r in files.typed_results(raw).collect()] == [None, "missing_required", "result_contradicts_score"]
    (tmp_path / "bad.csv").write_text("Div,Date,HomeTeam,AwayTeam\nE0,01/02/20,A,B\nE0,01/02/20,A,B,1,2\n")
    assert [r._corrupt for r in files.read_results(spark, str(tmp_path / "bad.csv")).collect()] == [None, "E0,01/02/20,A,B,1,2"]
    cells = files.located_values(spark, str(tmp_path / "r.csv")).collect()
    assert {(r.row, r.field): (r.name, r.value) for r in cells}[2, 3] == ("AwayTeam", "") and len(cells) == 28
    assert len(files.store_raw(spark, str(tmp_path / "*.csv"), str(tmp_path / "store")).collect()) == 2
    (tmp_path / "again.csv").write_bytes((tmp_path / "r.csv").read_bytes())
    assert files.store_raw(spark, str(tmp_path / "*.csv"), str(tmp_path / "store")).collect() == []
    assert {r.field: r.filled for r in files.field_coverage(raw).collect()}["AwayTeam"] == 2
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", "a,b\n1,2\n")
        z.writestr("bomb.csv", "0" * 2_000_000)
    got = files.read_zipped_results(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.member, r.text, r.finding) for r in got] == [("x.csv", "a,b", None), ("x.csv", "1,2", None), ("bomb.csv", None, "member_too_large")]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("../out.csv", "a\n")
        z.writestr("d/x.csv", "a\n")
        z.writestr("D/X.csv", "b\n")
    assert [(r.member, r.finding) for r in files.read_zipped_results(spark, str(tmp_path / "c.zip")).collect()] == [("../out.csv", "unsafe_path"), ("d/x.csv", None), ("D/X.csv", "duplicate_member")]
    assert [r.finding for r in files.read_zipped_results(spark, str(tmp_path / "c.zip"), max_total=1).collect()] == ["unsafe_path", "archive_too_large", "duplicate_member"]
    pages = spark.createDataFrame([("p", "<table><tr><th>Team<td>Pts</td></tr><tr><td>A&amp;B</td><td> 3 </td></tr></table>"), ("q", None)], "k string, page string")
    assert {(r.row, r.text) for r in files.html_cells(pages, "k", "page").collect()} >= {(1, "A&B"), (1, "3")}
    feed = spark.createDataFrame([("AA÷x¬AB÷1¬AA÷z~AA÷y¬bad¬~",)], "t string").select(files.delimited_feed(F.col("t")).alias("r")).first().r
    assert feed == [{"AA": "x", "AB": "1"}, {"AA": "y"}]
    page = r"<script>var shots = JSON.parse('\x5B\x7B\x22a\x22:1\x7D\x5D'); var direct = {b: 1};</script>"
    got = spark.createDataFrame([(page,)], "t string").select(files.embedded_json(F.col("t"), "shots").alias("a"), files.embedded_json(F.col("t"), "none").alias("n")).first()
    assert json.loads(got.a) == [{"a": 1}] and got.n is None
    docs = spark.createDataFrame([("r", json.dumps([{"id": "e", "index": 1, "location": [130.0, 2.0], "type": {"id": 1, "name": "Pass"}}])), ("s", "broken")], "k string, raw string")
    assert [(r.event_id, r.event_type, r.location_quality, r.x_norm) for r in files.event_rows(docs, "k", "raw").collect()] == [("e", "Pass", "out_of_bounds", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.publish(df, str(tmp_path), "t", "v1")
    assert [r.sound for r in sinks.verify(spark, str(tmp_path)).collect()] == [True]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, str(tmp_path), "t", "v1")
    assert sinks.table_checksum(df) == sinks.table_checksum(df.repartition(3)) != sinks.table_checksum(df.limit(1))
    more = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert {tuple(r) for r in sinks.new_rows(more, df, ["k"]).collect()} == {(3, "y")}
    assert {tuple(r) for r in sinks.upsert(df, more.distinct(), ["k"]).collect()} == {(1, "a"), (2, "x"), (3, "y")}
    assert sinks.metrics_text(df.limit(1), "rows", ["v"], "k").first().value == 'rows{v="a"} 1'


def test_quality(spark):
    df = spark.createDataFrame([(1, "p", 0, "", None, "00:01:02.3", 1, 1), (2, "p", 1, "x", "t", "99", 9, 0)], "stage_id long, provider_event_id string, staged_at long, player_id string, team_id string, event_clock string, period int, event_index int")
    found = quality.event_rules(df)
    assert {(r.stage_id, r.rule) for r in found.collect()} == {(1, "missing_player"), (1, "missing_team"), (2, "repeated_delivery"), (2, "impossible_clock"), (2, "impossible_period"), (2, "impossible_index")}
    assert {r.stage_id: r.worst for r in quality.roll_up(found, ["stage_id"]).collect()} == {1: "WARNING", 2: "FATAL"}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source = str(tmp_path / "in")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = observations.windowed_counts(stream, "ts", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.event_type, r.start)
    got = {key(r): (r.n, round(r.total, 6)) for r in spark.sql("select * from windows").collect()}
    want = {key(r): (r.n, round(r.total, 6)) for r in observations.windowed_counts(events, "ts", ["event_type"], "value").collect()}
    assert got == want


def test_live_states(spark, tmp_path):
    schema = "m string, source_time long, minute long, status string, home long, away long"
    rows = [("a", 1, 5, "LIVE", 0, 0), ("a", 2, 9, "LIVE", 1, 0), ("a", 1, 8, "LIVE", 0, 0), ("a", 2, 9, "LIVE", 1, 0), ("a", 2, 9, "LIVE", 0, 1), ("a", None, None, "FINISHED", 1, 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = observations.live_states(stream, "m").writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.verdict for r in spark.sql("select verdict from live").collect()] == ["NEWER", "NEWER", "STALE", "SAME", "CONFLICT", "NEWER"]


def test_feeds(spark):
    from touchline.sources import feeds

    doc = json.dumps({"response": [{"fixture": {"id": 7, "date": "2024-01-02T15:00:00+00:00", "status": {"short": "FT"}}, "league": {"id": 3}, "teams": {"home": {"name": "A"}, "away": {"name": "B"}}, "goals": {"home": 2, "away": "x"}}, {"fixture": {"id": 8}, "teams": {"home": {"name": "C"}}}]})
    docs = spark.createDataFrame([("a", doc), ("b", "{broken"), ("c", "{}"), ("d", None), ("e", '{"response": []}')], "id string, raw string")
    rows = {(r.id, r.place): r for r in feeds.observations(docs, "id", "raw", feeds.REGISTRY["envelope_api", "fixtures"]).collect()}
    assert {k: r.finding for k, r in rows.items()} == {("a", 0): None, ("a", 1): "missing_away_name", ("b", None): "malformed", ("c", None): "no_records", ("d", None): "malformed"}
    first = rows["a", 0]
    assert (first.native_id, first.home_name, first.home_goals, first.away_goals) == ("7", "A", 2, None)
    shots = spark.createDataFrame([("s", '[{"id": "1", "xG": "0.25", "X": 0.9, "minute": 12}]')], "id string, raw string")
    assert feeds.observations(shots, "id", "raw", feeds.REGISTRY["shot_site", "shots"]).first().xg == 0.25
    assert all(feeds.observations(docs.limit(0), "id", "raw", f).count() == 0 for f in feeds.FEEDS)


def test_gates_leaks_and_regression(spark):
    m = spark.createDataFrame([("ece", 0.01), ("ece", 0.03), ("ece", 0.5), ("other", 0.1), ("ece", None)], "metric string, value double")
    assert [r.verdict for r in scoring.gate(m, {"ece": (0.02, 0.05)}).collect()] == ["PASS", "WARN", "FAIL", "UNKNOWN", "UNKNOWN"]
    docs = [(1, json.dumps({"form": {"known_at": 5}}), 9), (2, json.dumps({"form": {"known_at": 10}}), 9), (3, json.dumps({"Outcome": {"known_at": 1}}), 9), (4, "broken", 9)]
    snaps = spark.createDataFrame(docs, "id int, doc string, cutoff long")
    assert {r.id: r.finding for r in scoring.leaks(snaps, "id", "doc", "cutoff").collect()} == {2: "known_after_cutoff", 3: "outcome_key", 4: "malformed"}
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "y": rng.poisson(np.exp(0.2 + 0.3 * x))}))
    assert {r.term: r.coefficient for r in models.fit_poisson(df, "g", "y", ["x"]).collect()} == {"intercept": pytest.approx(0.2, abs=0.05), "x": pytest.approx(0.3, abs=0.03)}


def test_exact_intervals(spark):
    # published 95% intervals: 0 of 10, 5 of 10, 10 of 10, 1 of 100
    low, high = scoring.clopper_pearson(np.array([0, 5, 10, 1]), np.array([10, 10, 10, 100]))
    assert low == pytest.approx([0, 0.1871, 0.6915, 0.00025], abs=1e-4) and high == pytest.approx([0.3085, 0.8129, 1, 0.0545], abs=1e-4)
    df = spark.createDataFrame([(1, 2, "x"), (0, 0, "y"), (None, 3, "z")], "k long, n long, tag string")
    assert [(r.tag, r.low is None) for r in scoring.exact_intervals(df, "k", "n").orderBy("tag").collect()] == [("x", False), ("y", True), ("z", True)]


def test_simulation_gates(spark):
    df = spark.createDataFrame([("m", [(0, 0, 0.3), (1, 0, 0.6), (7, 2, 0.1)])], "id string, cells array<struct<home:int,away:int,p:double>>")
    hits = simulation.simulate(df, "id", "cells")
    assert simulation.total_variation(hits, df, "id", "cells").first().distance < simulation.VARIATION_LIMIT
    drawn = simulation.simulate_events(df, "id", "cells")
    rates = {r.event: r for r in simulation.gates(simulation.event_rates(drawn, "id"), "id").collect()}
    assert len(rates) == len(simulation.EVENTS) == 62 and all(r.verdict == "PASS" for r in rates.values())
    assert rates["outcome:home_win"].analytic == pytest.approx(0.7) and rates["score:5+-2"].analytic == pytest.approx(0.1) and rates["unresolved_tail"].hits == 0
    assert all(sum(rates[e].hits for e in simulation.EVENTS if e.startswith(g)) == 112_460 for g in ("score:", "outcome:", "btts:", "total_goals:", "clean_sheet:home", "total:over_2.5", "total:under_2.5") if not g.startswith("total:"))
    assert rates["total:over_2.5"].hits + rates["total:under_2.5"].hits == 112_460
    assert rates["outcome:home_win"].low < rates["outcome:home_win"].hits / 112_460 < rates["outcome:home_win"].high
    gate = simulation.variation_gate(drawn, "id").first()
    assert gate.verdict in ("PASS", "WARN") and gate.distance <= simulation.VARIATION_LIMIT
    # what was drawn from another forecast is out of parity, and a tail that was drawn is named
    wrong = simulation.event_rates(drawn, "id").withColumn("analytic", F.col("analytic") + 0.02)
    assert {r.verdict for r in simulation.gates(wrong.where("event = 'outcome:home_win'"), "id").collect()} == {"OUT_OF_PARITY"}
    short = spark.createDataFrame([("m", [(0, 0, 0.9)])], "id string, cells array<struct<home:int,away:int,p:double>>")
    tail = simulation.gates(simulation.event_rates(simulation.simulate_events(short, "id", "cells"), "id"), "id").where("event = 'unresolved_tail'").first()
    assert tail.verdict == "TAIL_SAMPLED"
    assert simulation.simulate_events(df.limit(0), "id", "cells").collect() == []


def test_event_matrix_against_the_words_of_the_events():
    home, away = np.array([0, 3, 9, 2, -1]), np.array([0, 1, 6, 2, -1])
    m = simulation.event_matrix(home, away)
    names = [[e for e, hit in zip(simulation.EVENTS, row, strict=True) if hit] for row in m]
    assert names[1] == ["score:3-1", "outcome:home_win", "btts:yes", "total:over_0.5", "total:over_1.5", "total:over_2.5", "total:over_3.5", "total:under_4.5", "clean_sheet:home_no", "clean_sheet:away_no", "total_goals:4"]
    assert "score:5+-5+" in names[2] and names[4] == ["unresolved_tail"] and [len(n) for n in names] == [11, 11, 11, 11, 1]


def test_reports_and_sheets(spark, tmp_path):
    counts = spark.createDataFrame([("b", "y", 2), ("a", "x", 1)], "section string, name string, n long")
    assert sinks.run_report(counts, "Run").splitlines()[4:] == ["| a | x | 1 |", "| b | y | 2 |"]
    sinks.review_sheet(spark.createDataFrame([("=1+1", 2), ("a", 1)], "t string, n int"), str(tmp_path / "sheet"), ["n"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "sheet")).orderBy("n").collect()] == [("a", "1"), ("'=1+1", "2")]


def test_both_readings_of_the_order_of_updates_agree(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)
    update = lambda: (pick(None, "p", "q", ""), pick(None, 5, 6), pick(None, 5, 6, 7), pick(None, 10, 11), pick(None, 0, 2), pick("SCHEDULED", "LIVE", "HALF_TIME", "FINISHED", "ABANDONED"), pick(0, 1), pick(None, 0))
    rows = [(i, update(), update()) for i in range(1500)]
    struct = "struct<" + ",".join(f"{n}:{t}" for n, t in observations.UPDATE.items()) + ">"
    df = spark.createDataFrame(rows, f"i int, old {struct}, new {struct}")
    got = {r.i: r.v for r in df.select("i", observations.compare(F.col("old"), F.col("new")).alias("v")).collect()}
    names = list(observations.UPDATE)
    want = {i: observations.order_of(dict(zip(names, a, strict=True)), dict(zip(names, b, strict=True))) for i, a, b in rows}
    assert got == want and set(want.values()) == {"NEWER", "SAME", "STALE", "CONFLICT", "UNORDERED"}


def test_ratings_of_a_table(spark):
    """Pools of uneven size, batches that end within a moment, weights, and ratings at a cutoff, against folds in memory."""
    rng = random.Random(12)
    rows, i = [], 0
    for pool, moments in (("a", 900), ("b", 30), ("c", 1)):
        for t in range(moments):
            teams = rng.sample(range(12), 8)
            for k in range(4):
                rows.append((pool, i, t * 86_400, teams[2 * k], teams[2 * k + 1], rng.randrange(4), rng.randrange(4), rng.choice([1.0, 0.5])))
                i += 1
    df = spark.createDataFrame(rows, "pool string, match_id long, ko long, home long, away long, hg int, ag int, weight double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "101")
    try:
        rated = ratings.elo(df, "pool", "weight")
        got = rated.toPandas().set_index("match_id").sort_index()
        at = {(r.pool, r.team): r.rating for r in ratings.ratings_at(rated, "pool", F.lit(20 * 86_400 + 1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = pd.DataFrame(rows, columns=["pool", "match_id", "ko", "home", "away", "hg", "ag", "weight"])
    want = pd.concat(ratings.fold(p) for _, p in pdf.groupby("pool")).set_index("match_id").sort_index()
    assert np.allclose(got[want.columns].to_numpy(), want.to_numpy())
    state = ratings.Chronicle()
    state.add(pdf[(pdf.pool == "a") & (pdf.ko <= 20 * 86_400)].sort_values(["ko", "match_id"]))
    assert all(at["a", team] == pytest.approx(state.now(team, 20 * 86_400 + 1)) for team in state.rating)
    with pytest.raises(ValueError, match="two matches"):
        state.add(pd.DataFrame({"ko": [1e9, 1e9], "home": [1, 1], "away": [2, 3], "hg": 0, "ag": 0, "weight": 1.0}))

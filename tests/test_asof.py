import random

from pyspark.sql import functions as F

from touchline.operators import asof, temporal

DAY = 86_400_000_000


def test_as_known_against_brute_force(spark):
    rng = random.Random(3)
    # one entity holds most of the rows, moments tie, some parts are null, rows repeat
    revisions = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(0, 400 * DAY, 7 * DAY)]), rng.choice([None, *range(0, 400 * DAY, 11 * DAY)]), i) for i in range(300)]
    revisions += revisions[:40]
    events = [(i, rng.choice([1, 1, 2, 3, 4, None]), rng.choice([None, *range(0, 420 * DAY, 5 * DAY)])) for i in range(200)]
    r = spark.createDataFrame(revisions, "entity int, updated long, known long, id int")
    e = spark.createDataFrame(events + events[:5], "id int, entity int, moment long")
    known = F.coalesce("known", "updated")
    got = asof.as_known(e, "id", F.col("moment"), r, {"entity": "entity"}, F.when(F.col("updated").isNotNull(), F.greatest("updated", known)), [F.col("updated"), known, F.col("id")])
    got = {x.event_id: x["rank"]["r2"] for x in got.collect()}
    want = {}
    for i, entity, moment in events:
        if entity is None or moment is None:
            continue
        seen = [(u, k if k is not None else u, n) for ent, u, k, n in revisions if ent == entity and u is not None and u <= moment and (k if k is not None else u) <= moment]
        if seen:
            want[i] = max(seen)[2]
    assert got == want
    # the written history serves other events as well, and a period's length changes nothing
    history = asof.materialise(r, ["entity"], F.when(F.col("updated").isNotNull(), F.greatest("updated", known)), [F.col("updated"), known, F.col("id")], days=9)
    assert {x.event_id: x["rank"]["r2"] for x in asof.as_known(e, "id", F.col("moment"), history, {"entity": "entity"}).collect()} == want
    assert asof.as_known(e.limit(0), "id", F.col("moment"), r, {"entity": "entity"}, F.col("updated"), [F.col("id")]).collect() == []
    assert asof.as_known(e, "id", F.col("moment"), r.limit(0), {"entity": "entity"}, F.col("updated"), [F.col("id")]).collect() == []


def test_stray_moments(spark):
    """Changes and events thousands of years apart cost no row for the time between."""
    year = 365 * DAY
    r = spark.createDataFrame([(1, -1970 * year, 1), (1, 8000 * year, 2)], "entity int, at long, id int")
    e = spark.createDataFrame([(1, 1, 0), (2, 1, 9000 * year), (3, 1, -1970 * year), (4, 1, -1971 * year)], "id int, entity int, moment long")
    got = asof.as_known(e, "id", F.col("moment"), r, {"entity": "entity"}, F.col("at"), [F.col("at"), F.col("id")])
    assert {x.event_id: x["rank"]["r1"] for x in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_asof_join_bounds(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (1, None)], "k int, t int")
    right = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 15, "c"), (3, 1, "d"), (1, None, "e")], "k int, u int, v string")
    inclusive = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", "u", ["v"], tie="v").collect()}
    strict = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", "u", ["v"], tie="v", inclusive=False).collect()}
    assert inclusive == {(1, 10): "b", (1, 20): "c", (2, 10): None, (1, None): None}
    assert strict == {(1, 10): None, (1, 20): "c", (2, 10): None, (1, None): None}


def test_latest_overlaps_and_heads(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, 5, "b"), (1, 2, 7, "c"), (None, 1, 1, "d")], "k int, t int, u int, v string")
    assert {(r.k, r.v) for r in temporal.latest_per_key(df, ["k"], ["t", "u"]).collect()} == {(1, "c"), (None, "d")}
    spans = spark.createDataFrame([(1, 0, 5, 1), (1, 5, 9, 2), (1, 8, None, 3), (1, 20, 21, 4)], "k int, a long, b long, row int")
    assert {r.row for r in temporal.overlapping(spans, ["k"], "a", "b", "row").collect()} == {3, 4}
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3)], "n int, p int")
    assert {r.n for r in temporal.chain_heads(chain, "n", "p").collect()} == {2, 4}
    assert [r.live for r in spark.createDataFrame([(1, 5), (5, None), (6, 9), (None, 9)], "a int, b int").select(temporal.known_at(F.col("a"), F.col("b"), F.lit(5)).alias("live")).collect()] == [False, True, False, False]


def test_running_sums_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(-50, 200), rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    for strict in (False, True):
        got = sorted((r.k, r.t, r.v, r.s) for r in temporal.running_sums(df, ["k"], "t", {"s": "v"}, 30, strict).collect())
        assert got == sorted((k, t, v, sum(w for k2, t2, w in rows if k2 == k and (t2 < t or (t2 == t and not strict)))) for k, t, v in rows)
    assert temporal.running_sums(df.limit(0), ["k"], "t", {"s": "v"}, 30).collect() == []

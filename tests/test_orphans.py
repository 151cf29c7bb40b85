import datetime as dt

from touchline.operators import orphans

T = lambda d: dt.datetime(2020, 1, d)


def setup(spark):
    a, b = "11111111-2222-3333-4444-555555555555", "aaaaaaaa-2222-3333-4444-555555555555"
    parents = spark.createDataFrame([(a, T(5), T(10), "x"), (a, T(20), None, "x"), (b, T(8), None, "x"), (None, T(1), None, "x")], "k string, registered_at timestamp, removed_at timestamp, staged_at string")
    events = spark.createDataFrame(
        [(1, a, T(6)), (2, "{" + a.upper() + "}", T(10)), (3, a.replace("-", ""), T(1)), (4, " " + b, T(7)), (5, "nowhere", T(7)), (6, "", T(7)), (7, None, T(7)), (8, a, None), (9, "nowhere", None), (10, a, T(25)), (11, "nowhere" * 1000, T(2))],
        "id long, ref string, staged_at timestamp",
    )
    return events, parents


def test_kinds(spark):
    events, parents = setup(spark)
    got = {r.row_id: r.kind for r in orphans.orphan_references(events, "id", "staged_at", [orphans.Reference("ref", parents, "k")]).collect()}
    assert got == {2: "deleted", 3: "late", 4: "late", 5: "missing", 9: "missing", 11: "missing"}


def test_joins_beyond_the_broadcast_bound_give_the_same(spark):
    events, parents = setup(spark)
    refs = [orphans.Reference("ref", parents, "k")]
    plain = sorted(map(str, orphans.orphan_references(events, "id", "staged_at", refs).collect()))
    assert sorted(map(str, orphans.orphan_references(events, "id", "staged_at", refs, bound=0).collect())) == plain


def test_empty_tables_and_counts(spark):
    events, parents = setup(spark)
    assert orphans.orphan_references(events.limit(0), "id", "staged_at", [orphans.Reference("ref", parents, "k")]).collect() == []
    found = orphans.orphan_references(events, "id", "staged_at", [orphans.Reference("ref", parents.limit(0), "k")])
    assert {r.kind for r in found.collect()} == {"missing"}
    counts = {(r.kind, r.period): r.orphans for r in orphans.orphan_counts(found).collect()}
    assert counts == {("missing", "2020-01"): 7, ("missing", None): 2}

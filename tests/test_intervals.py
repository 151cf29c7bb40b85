import random

from touchline.operators.intervals import periods_and_gaps


def brute(rows):
    by = {}
    for e, a, b in rows:
        if None not in (e, a, b) and b > a:
            by.setdefault(e, []).append((a, b))
    out = set()
    for e, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(e, "period", a, b) for a, b in merged}
        out |= {(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def test_against_brute_force_with_a_hot_entity(spark):
    for seed, length in ((1, 3), (2, 300), (3, 20)):
        rng = random.Random(seed)
        rows = []
        for _ in range(3000):
            a = rng.randrange(20_000)
            rows.append((rng.choice([1, 1, 1, rng.randrange(50), None]), rng.choice([a, a, a, None]), a + rng.randrange(-2, length)))
        rows += [(1, 0, 19_000)] * 2 if seed == 3 else []
        df = spark.createDataFrame([(*r, "x") for r in rows], "e int, start int, end int, part string")
        got = {tuple(r) for r in periods_and_gaps(df, ["e"], partitions=7).collect()}
        assert got == brute(rows)


def test_touching_nested_repeated_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 9, 9), ("a", 8, 10), ("a", 8, 10), ("b", 3, 1)], "e string, start long, end long")
    assert {tuple(r) for r in periods_and_gaps(df, ["e"]).collect()} == {("a", "period", 0, 7), ("a", "gap", 7, 8), ("a", "period", 8, 10)}
    assert periods_and_gaps(df.limit(0), ["e"]).collect() == []


def test_microseconds_over_fifty_years_and_many_entities(spark):
    """Ends and entities whose product is far beyond 64 bits; nested intervals, and one entity with a third of the rows over several partitions."""
    rng = random.Random(7)
    year = 365 * 86_400 * 1_000_000
    rows = []
    for e in range(10_000):
        a = rng.randrange(-20 * year, 30 * year)
        rows += [(e, a, a + 2 * year), (e, a + 1, a + 2), (e, a + year, a + year + 5), (e, a + 3 * year, a + 3 * year + 1)]
    for _ in range(20_000):
        a = rng.randrange(-20 * year, 30 * year)
        rows.append((5000, a, a + rng.randrange(year // 2000)))
    df = spark.createDataFrame(rows, "e int, start long, end long")
    assert {tuple(r) for r in periods_and_gaps(df, ["e"], partitions=5).collect()} == brute(rows)


def test_ends_of_the_whole_range(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [("a", low, low + 1), ("a", low + 1, 0), ("a", 5, high), ("b", low, high), ("b", 0, 1), ("c", high - 1, high)]
    df = spark.createDataFrame(rows, "e string, start long, end long")
    assert {tuple(r) for r in periods_and_gaps(df, ["e"], partitions=3).collect()} == brute(rows)

import random

import pytest

pytest.importorskip("touchline.llm.mixing")
from touchline.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, site string, lang string, source string, tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def split(budget, weights, limits):
    """The same split by filling up what is full, round by round."""
    out, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    while open_ and budget > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if budget * weights[i] / total >= limits[i]]
        for i in full or open_:
            out[i] = limits[i] if full else budget * weights[i] / total
        if not full:
            break
        budget -= sum(limits[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def walk(leaves, budget, depth=0):
    """path -> tokens by recursion; leaves: (path, weight, capacity)."""
    groups = {}
    for leaf in leaves:
        groups.setdefault(leaf[0][depth], []).append(leaf)
    parts = split(budget, [sum(x[1] for x in g) for g in groups.values()], [sum(x[2] for x in g) for g in groups.values()])
    out = {}
    for group, part in zip(groups.values(), parts, strict=True):
        out |= {group[0][0]: part} if depth == len(group[0][0]) - 1 else walk(group, part, depth + 1)
    return out


def test_shares(spark):
    cases = [(100, [1, 1], [1000, 1000], [50, 50]), (100, [1, 1, 2], [10, 1000, 1000], [10, 30, 60]), (100, [1, 0, 2], [10, 50, 20], [10, 0, 20]), (0, [1], [5], [0])]
    rng = random.Random(4)
    for _ in range(6):
        n = rng.randrange(1, 30)
        w, c = [rng.random() for _ in range(n)], [rng.choice([0, rng.random() * 50, 5.0]) for _ in range(n)]
        cases.append((rng.random() * 200, w, c, split(1.0, w, c)))
        cases[-1] = (cases[-1][0], w, c, split(cases[-1][0], w, c))
    rows = [(k, i, float(b), float(w), float(c)) for k, (b, ws, cs, _) in enumerate(cases) for i, (w, c) in enumerate(zip(ws, cs, strict=True))]
    df = spark.createDataFrame(rows, "k int, i int, budget double, weight double, capacity double")
    got = {(r.k, r.i): r.part for r in mixing.share_out(df, ["k"], "i").collect()}
    for k, (_, _, _, want) in enumerate(cases):
        assert [got.get((k, i), 0.0) for i in range(len(want))] == pytest.approx(want), k
    one = {r.i: r.part for r in mixing.share_out(df.where("k = 1").drop("k"), [], "i").collect()}
    assert one == pytest.approx({0: 10, 1: 30, 2: 60})


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["s1"] * 6 + ["s2", "s3", None]), rng.choice(["en", "de", None]), rng.choice(["big"] * 8 + ["small", "none", None]), rng.randrange(0, 400)) for i in range(4000)]
    targets = [("big", 0.6, 1), ("small", 0.35, 3), ("absent", 0.05, 4)]
    return rows, targets, spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", copies string"), spark.createDataFrame([*targets, targets[0]], TARGETS)


def leaves_of(rows, targets, weights=()):
    goals, weights = {t[0]: t for t in targets}, dict(weights)
    rel, tokens = {}, {}
    for _, site, lang, source, n in rows:
        if source in goals and n > 0:
            tokens[site, lang, source] = tokens.get((site, lang, source), 0) + n
    for p, n in tokens.items():
        rel[p] = n * weights.get(("site", p[0]), 1) * weights.get(("lang", p[1]), 1)
    every = {s: sum(v for p, v in rel.items() if p[2] == s) for s in goals}
    return [(p, goals[p[2]][1] * rel[p] / every[p[2]], tokens[p] * goals[p[2]][2]) for p in tokens]


@pytest.mark.parametrize("weights", [(), ((("lang", "de"), 4.0), (("site", "s2"), 0.5))])
def test_mix(spark, tables, weights):
    """Every document within its repeats, every source within half a document of the plan that the recursion gives."""
    rows, targets, sized, goals = tables
    given = spark.createDataFrame([(*k, v) for k, v in weights], "level string, node string, weight double") if weights else None
    total = sum(r[4] for r in rows)
    want = walk(leaves_of(rows, targets, weights), total)
    planned = mixing.plan(sized, goals, weights=given)
    assert {(r.site, r.lang, r.source): r.part for r in planned.collect()} == pytest.approx(want)
    mixed = mixing.mix(sized, goals, planned=planned).collect()
    by = {r[0]: r for r in rows}
    limits = {"big": 1, "small": 3}
    assert len({r.doc_id for r in mixed}) == len(mixed)
    assert all(1 <= r.copies <= limits[r.source] and by[r.doc_id][1:4] == (r.site, r.lang, r.source) for r in mixed)
    for s in limits:
        assert abs(sum(r.tokens * r.copies for r in mixed if r.source == s) - sum(v for p, v in want.items() if p[2] == s)) <= 200
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(sized.repartition(7), goals, weights=given).collect()))
    report = {r.source: r for r in mixing.report(mixing.mix(sized, goals, planned=planned), sized, goals, planned).collect()}
    assert report["absent"].actual_share == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert all(abs(report[s].mixed_tokens - report[s].planned_tokens) <= 200 for s in limits)


def test_a_short_language_moves_tokens_to_its_siblings(spark):
    """German of source a runs short in site x: what is missing comes from source b in the same language and site, then from the site's other language, and site y gives no more than its own part."""
    docs = [("x", "de", "a", 10), ("x", "de", "b", 30), ("x", "en", "a", 400), ("x", "en", "b", 400), ("y", "en", "a", 400), ("y", "en", "b", 400)]
    rows = [(100_000 * k + i, site, lang, source, 1) for k, (site, lang, source, n) in enumerate(docs) for i in range(n)]
    sized, targets = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    # German is to have forty times its weight
    boosted = spark.createDataFrame([("lang", "de", 40.0)], "level string, node string, weight double")

    def mixed(weights):
        out = {}
        for r in mixing.mix(sized, targets, total=600, weights=weights).collect():
            out[r.site, r.lang, r.source] = out.get((r.site, r.lang, r.source), 0) + r.tokens * r.copies
        return out

    got, want = mixed(boosted), walk(leaves_of(rows, [("a", 0.5, 1), ("b", 0.5, 1)], [(("lang", "de"), 40)]), 600)
    assert got == pytest.approx(want, abs=1)
    # all the German there is, and its site still gives its whole part: the shortage went to the site's English
    assert got["x", "de", "a"] == 10 and got["x", "de", "b"] == 30
    part_of_x = 600 * sum(w for p, w, _ in leaves_of(rows, [("a", 0.5, 1), ("b", 0.5, 1)], [(("lang", "de"), 40)]) if p[0] == "x")
    assert sum(v for p, v in got.items() if p[0] == "x") == pytest.approx(part_of_x, abs=1)
    # a little short: the other source of the same language makes up for it
    less = spark.createDataFrame([("lang", "de", 3.0)], "level string, node string, weight double")
    leaves = leaves_of(rows, [("a", 0.5, 1), ("b", 0.5, 1)], [(("lang", "de"), 3)])
    assert mixed(less) == pytest.approx(walk(leaves, 600), abs=1)


def test_exact_prefix_of_a_leaf(spark):
    sized = spark.createDataFrame([(i, "x", "en", "s", 10) for i in range(100)], SCHEMA)
    targets = spark.createDataFrame([("s", 1.0, 3)], TARGETS)
    mixed = mixing.mix(sized, targets, total=2500).collect()
    assert sum(r.copies for r in mixed) == 250 and {r.copies for r in mixed} == {2, 3}
    other = mixing.mix(sized, targets, total=1500).collect()
    # the epoch that is cut has an order of its own
    assert {r.doc_id for r in mixed if r.copies == 3} != {r.doc_id for r in other if r.copies == 2}
    assert mixing.mix(sized.limit(0), targets).collect() == [] and mixing.mix(sized, targets.limit(0)).collect() == []

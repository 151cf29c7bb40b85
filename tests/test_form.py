"""Form windows against a reading in plain Python, and the rules of result recovery."""

import random

from pyspark.sql import functions as F

from touchline.operators import form, recovery

DAY = 86_400


def plain(targets, official, played, scopes, pending):
    """{(fixture, team, form): (actual, coverage, flags, results, fixtures)} by loops."""
    off, pl = {r[0]: r for r in official}, {r[0]: r for r in played}
    out = {}
    for t_id, team, comp, t_ko in targets:
        rows = []
        for fid in off.keys() | pl.keys():
            o, p = off.get(fid), pl.get(fid)
            base = o or p
            if team not in base[3:5] or base[2] >= t_ko:
                continue
            home = base[3] == team
            mine = (o or p)[5:7] if home else (o or p)[5:7][::-1]
            field = (p or o)[5:7] if home else (p or o)[5:7][::-1]
            award = o is not None and o[7] == "AWARDED"
            basis = "REGULATION_90" if p and not award else o[8] if o else "REGULATION_90"
            rows.append({"id": fid, "ko": base[2], "home": home, "comp": base[1], "scope": scopes.get(base[1], "UNCLASSIFIED"), "o": mine, "p": field, "q": p is not None, "award": award, "basis": basis, "day": p is not None and not p[7]})
        rows.sort(key=lambda r: (-r["ko"], r["id"]))
        for name, (basis, scope, venue, asked) in form.WINDOWS.items():
            def fits(r):
                ok = r["q"] and not r["award"] if basis == "FORECAST_ELIGIBLE" else r["scope"] != "FRIENDLY"
                if basis == "PLAYED":
                    ok = ok and (r["q"] or (not r["award"] and r["basis"] != "UNKNOWN"))
                return ok and (scope != "SAME_COMPETITION" or r["comp"] == comp) and venue in ("ALL", "HOME" if r["home"] else "AWAY")

            every = [r for r in rows if fits(r)]
            taken, seen = every[:asked], every[: asked + 1]
            letter = lambda s: "W" if s[0] > s[1] else "L" if s[0] < s[1] else "D"
            results = "".join(letter(r["p"]) if basis != "OFFICIAL" else "D" if r["basis"] == "PENALTY_SHOOTOUT" else letter(r["o"]) for r in taken)
            flags = set()
            if any(a["ko"] == b["ko"] or (a["ko"] // DAY == b["ko"] // DAY and (a["day"] or b["day"])) for a, b in zip(seen, seen[1:])):
                flags.add("ORDER_AMBIGUOUS")
            if taken and t_ko - taken[-1]["ko"] > 180 * DAY:
                flags.add("STALE")
            if any(len(taken) < asked or k >= taken[-1]["ko"] for tm, k in pending if tm == team and k < t_ko):
                flags.add("RESULT_PENDING")
            for r in taken:
                flags |= {f for f, on in (("SCORE_CONFLICT", not r["award"] and r["o"] != r["p"]), ("UNQUALIFIED_RESULT", not r["q"]), ("AWARDED_INCLUDED", r["award"]), ("UNKNOWN_SCORE_BASIS", r["basis"] == "UNKNOWN"), ("UNCLASSIFIED_COMPETITION", r["scope"] == "UNCLASSIFIED")) if on}
            out[t_id, team, name] = (len(taken), "EMPTY" if not taken else "COMPLETE" if len(taken) == asked else "PARTIAL", ",".join(sorted(flags)), results, ",".join(r["id"] for r in taken))
    return out


def test_windows_against_plain_python(spark):
    rng = random.Random(11)
    teams, comps = ["a", "b", "c", "d"], ["L", "C", "F", "?"]
    scopes = {"L": "LEAGUE", "C": "CUP", "F": "FRIENDLY"}
    official, played = [], []
    for i in range(120):
        h, a = rng.sample(teams, 2)
        comp, ko = rng.choice(comps), rng.randrange(0, 900) * DAY // 2
        hg, ag = rng.randrange(4), rng.randrange(4)
        if rng.random() < 0.8:
            official.append((f"m{i:03}", comp, ko, h, a, hg, ag, rng.choice(["FINISHED"] * 5 + ["AWARDED"]), rng.choice(["REGULATION_90"] * 4 + ["UNKNOWN", "PENALTY_SHOOTOUT"])))
        if rng.random() < 0.7:
            played.append((f"m{i:03}", comp, ko, h, a, hg + (rng.random() < 0.1), ag, rng.random() < 0.7))
    targets = [(f"t{i}", rng.choice(teams), rng.choice(comps), rng.randrange(0, 480) * DAY) for i in range(25)]
    pending = [(rng.choice(teams), rng.randrange(0, 480) * DAY) for _ in range(6)]
    m = "fixture_id string, competition_id string, ko long, home string, away string, hg int, ag int"
    o, p = spark.createDataFrame(official, m + ", status string, basis string"), spark.createDataFrame(played, m + ", exact boolean")
    t = spark.createDataFrame(targets + targets[:2], "fixture_id string, team string, competition_id string, ko long")
    s = spark.createDataFrame(list(scopes.items()), "competition_id string, scope string")
    w = spark.createDataFrame(pending, "team string, ko long")
    rows = form.form(t, form.candidates(o, p, s), w).collect()
    got = {(r.fixture_id, r.team, r.form): (r.actual, r.coverage, r.flags, r.results, r.fixtures) for r in rows}
    assert len(rows) == len(got) and got == plain(targets, official, played, scopes, pending)
    assert {r.coverage for r in form.form(t, form.candidates(o.limit(0), p.limit(0), s), w).collect()} == {"EMPTY"}
    assert form.form(t.limit(0), form.candidates(o, p, s), w).collect() == []


def test_scopes(spark):
    df = spark.createDataFrame([("LEAGUE", "First Division"), ("CUP", "Club Friendlies"), ("OTHER", "x"), (None, None), ("LEAGUE", "Friendlyville League")], "k string, n string")
    assert [r.s for r in df.select(form.competition_scope(F.col("k"), F.col("n")).alias("s")).collect()] == ["LEAGUE", "FRIENDLY", "UNCLASSIFIED", "UNCLASSIFIED", "LEAGUE"]


STATE = "struct<status:string,home:int,away:int,basis:string,final:boolean,candidate:boolean>"
SAID = "struct<status:string,home:int,away:int,basis:string>"


def test_outcomes(spark):
    held, done = ("SCHEDULED", None, None, "REGULATION_90", False, True), ("FINISHED", 2, 1, "REGULATION_90", True, True)
    unknown = ("FINISHED", 2, 1, "UNKNOWN", True, True)
    closed = ("FINISHED", 2, 1, "REGULATION_90", True, False)
    cases = [
        ("RECOVERY", held, done, None, True, "RECOVERED"), ("RECOVERY", done, closed, None, False, "RECOVERED"), ("RECOVERY", done, done, ("FINISHED", 3, 1, "REGULATION_90"), True, "RESULT_CONFLICT"),
        ("RECOVERY", unknown, unknown, None, True, "SCORE_BASIS_UNAVAILABLE"), ("RECOVERY", done, done, ("FINISHED", 2, 1, "REGULATION_90"), True, "QUALIFICATION_FAILED"), ("RECOVERY", held, held, None, True, "NOT_RETURNED"),
        ("RECOVERY", held, held, None, False, "NOT_YET_PUBLISHED"), ("RECOVERY", held, held, ("LIVE", 1, 0, "UNKNOWN"), True, "NOT_YET_PUBLISHED"), ("RECOVERY", held, held, ("FINISHED", 1, 0, "UNKNOWN"), True, "IDENTITY_UNRESOLVED"),
        ("CORRECTION", held, done, None, True, "CORRECTED"), ("CORRECTION", done, done, None, True, "NOT_RETURNED"), ("CORRECTION", done, done, None, False, "VERIFIED_UNCHANGED"),
        ("CORRECTION", done, done, ("FINISHED", 0, 0, "UNKNOWN"), True, "RESULT_CONFLICT"), ("CORRECTION", done, done, ("FINISHED", 2, 1, "UNKNOWN"), True, "VERIFIED_UNCHANGED"),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], f"i int, purpose string, before {STATE}, after {STATE}, said {SAID}, fetched boolean")
    got = {r.i: r.o for r in df.select("i", recovery.outcome(F.col("purpose"), F.col("before"), F.col("after"), F.col("said"), F.col("fetched")).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases]


def test_next_checks(spark):
    now, h = 1_000 * DAY, 3600
    cases = [
        ("NOT_RETURNED", now - DAY, 1, None, now + 900), ("NOT_RETURNED", now - DAY, 5, None, now + 2 * h), ("NOT_YET_PUBLISHED", now - 10 * DAY, 2, None, now + 4 * h), ("NOT_RETURNED", now - 60 * DAY, 9, None, now + DAY), ("NOT_RETURNED", now - 400 * DAY, 1, None, now + 2 * DAY),
        ("NOT_RETURNED", now - 400 * DAY, 20, None, now + 7 * DAY), ("PROVIDER_RATE_LIMITED", now, 1, None, now + h), ("PROVIDER_RATE_LIMITED", now, 1, now + 7, now + 7), ("PROVIDER_UNAVAILABLE", now, 1, None, now + 300), ("PROVIDER_UNAVAILABLE", now, 8, None, now + h),
        ("RESULT_CONFLICT", now, 1, None, now + 7 * DAY), ("RECOVERED", now - 2 * DAY, 1, None, now + 5 * DAY), ("VERIFIED_UNCHANGED", now - 29 * DAY, 1, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, o string, ko long, n long, until long")
    got = {r.i: r.x for r in df.select("i", recovery.next_check(F.col("o"), F.col("ko"), F.lit(now).cast("long"), F.col("n"), F.col("until")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[-1] for c in cases]


def test_unselected(spark):
    due = spark.createDataFrame([("a", 5 * DAY, "FINISHED", "VERIFIED", True, True), ("b", 5 * DAY, "FINISHED", "PROVISIONAL", True, False), ("c", 5 * DAY, "FINISHED", "VERIFIED", False, False), ("d", 99 * DAY, "SCHEDULED", "VERIFIED", True, False), ("e", 5 * DAY, "POSTPONED", "VERIFIED", True, False), ("f", 5 * DAY, "FINISHED", "VERIFIED", True, False), ("g", 7 * DAY, "FINISHED", "VERIFIED", True, False)], "fixture_id string, ko long, status string, identity string, mapped boolean, member boolean")
    chosen = spark.createDataFrame([(7,)], "day long")
    got = {r.fixture_id: r.reason for r in recovery.unselected(due, chosen, F.lit(50 * DAY)).collect()}
    assert got == {"a": "FIXTURE_IS_DUPLICATE_MEMBER", "b": "IDENTITY_NOT_VERIFIED", "c": "NO_EXACT_PROVIDER_MAPPING", "d": "KICKOFF_NOT_REACHED", "e": "FIXTURE_STATUS_POSTPONED", "f": "DAY_NOT_CHOSEN"}

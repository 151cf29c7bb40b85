"""Results that are missing or unproved: which fixtures to look at again, what a look has brought, and when to look next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a fixture that is not over, the time after which its result is overdue, when a settled result is looked at again, and the waits of a retry by the fixture's age.
OPEN_STATES = ("SCHEDULED", "LIVE", "HALF_TIME", "SUSPENDED", "INTERRUPTED", "POSTPONED")
OVERDUE_SECONDS = 4 * 3600
CORRECTION_DAYS = (1, 7, 28)
DAY, HOUR, MINUTE = 86_400, 3_600, 60
WAITS = ((2 * DAY, 15 * MINUTE, 2 * HOUR), (14 * DAY, 2 * HOUR, 12 * HOUR), (90 * DAY, 12 * HOUR, DAY), (None, 2 * DAY, 7 * DAY))


def candidates(fixtures: DataFrame, history: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """fixture_id, ko, status, reason: OVERDUE_UNFINISHED, MISSING_SCORE, SCORE_BASIS_UNKNOWN or HISTORY_UNQUALIFIED.

    ``fixtures``: fixture_id, ko (seconds), status, home_score, away_score, basis, one row each; ``history`` (fixture_id): those with a qualified result; ``members`` (fixture_id):
    duplicates that another fixture stands for, which are left out. The reasons exclude each other.
    """
    q = history.select("fixture_id").distinct().withColumn("qualified", F.lit(True))
    f = fixtures.join(q, "fixture_id", "left").join(members.select("fixture_id").distinct(), "fixture_id", "left_anti")
    scored = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    over = F.col("status") == "FINISHED"
    reason = (
        F.when(F.col("status").isin(*OPEN_STATES) & (F.col("ko") < now - OVERDUE_SECONDS), "OVERDUE_UNFINISHED")
        .when(over & ~scored, "MISSING_SCORE")
        .when(over & F.col("qualified").isNull() & (F.col("basis") == "UNKNOWN"), "SCORE_BASIS_UNKNOWN")
        .when(over & F.col("qualified").isNull() & (F.col("basis") == "REGULATION_90"), "HISTORY_UNQUALIFIED")
    )
    return f.select("fixture_id", "ko", "status", reason.alias("reason")).where("reason is not null")


def days_to_check(due: DataFrame, limit: int) -> DataFrame:
    """day, fixtures, turn (RECENT or WAITING): at most ``limit`` days of ``due`` (fixture_id, ko, last_checked, in seconds): the newest for half of them, then those that have waited longest.

    A day's wait runs from the earliest last look at one of its fixtures, or from the kick-off of one never looked at. One row per day: both rankings are by the calendar.
    """
    waits = F.coalesce("last_checked", "ko")
    days = due.groupBy(F.floor(F.col("ko") / DAY).alias("day")).agg(F.count("*").alias("fixtures"), F.min(waits).alias("since"))
    newest = F.row_number().over(Window.orderBy(F.desc("day")))
    days = days.withColumn("recent", newest <= limit // 2)
    turn = F.row_number().over(Window.partitionBy("recent").orderBy("since", "day"))
    days = days.withColumn("turn", turn)
    return days.where(F.col("recent") | (F.col("turn") <= limit - limit // 2)).select("day", "fixtures", F.when(F.col("recent"), "RECENT").otherwise("WAITING").alias("turn"))


def unselected(due: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """fixture_id, reason: why a fixture of ``due`` (fixture_id, ko, status, identity, mapped, member) is not looked at: the first thing that is missing, else that its day was not chosen."""
    day = F.floor(F.col("ko") / DAY)
    reason = (
        F.when(F.col("member"), "FIXTURE_IS_DUPLICATE_MEMBER").when(F.col("identity") != "VERIFIED", "IDENTITY_NOT_VERIFIED").when(~F.col("mapped"), "NO_EXACT_PROVIDER_MAPPING")
        .when(F.col("ko") > now, "KICKOFF_NOT_REACHED").when(F.col("status") != "FINISHED", F.concat(F.lit("FIXTURE_STATUS_"), "status")).otherwise("DAY_NOT_CHOSEN")
    )
    return due.withColumn("day", day).join(chosen.select("day"), "day", "left_anti").select("fixture_id", reason.alias("reason"))


def outcome(purpose: Column, before: Column, after: Column, returned: Column, fetched: Column) -> Column:
    """What a look at a fixture has brought.

    ``before`` and ``after`` are structs (status, home, away, basis, final, candidate) of what is held, ``returned`` (status, home, away, basis) of what the provider said, null if nothing.
    A request that succeeds is no recovery by itself: it is one only if the result has become final or is no longer asked for.
    """
    said = returned.isNotNull()
    full = said & (returned["status"] == "FINISHED") & returned["home"].isNotNull() & returned["away"].isNotNull()
    differs = F.coalesce(said & (returned["status"] == "FINISHED") & returned["home"].isNotNull() & ~(returned["home"].eqNullSafe(after["home"]) & returned["away"].eqNullSafe(after["away"])), F.lit(False))
    recovery = (
        F.when((after["final"] & ~before["final"]) | ~after["candidate"], "RECOVERED")
        .when(after["final"], F.when(differs, "RESULT_CONFLICT").when((after["basis"] == "UNKNOWN") & (~said | (returned["basis"] == "UNKNOWN")), "SCORE_BASIS_UNAVAILABLE").otherwise("QUALIFICATION_FAILED"))
        .when(~said, F.when(fetched, "NOT_RETURNED").otherwise("NOT_YET_PUBLISHED"))
        .when(~F.coalesce(full, F.lit(False)), "NOT_YET_PUBLISHED")
        .otherwise("IDENTITY_UNRESOLVED")
    )
    changed = ~reduce_same(before, after, ("status", "home", "away", "basis"))
    correction = F.when(changed, "CORRECTED").when(~said, F.when(fetched, "NOT_RETURNED").otherwise("VERIFIED_UNCHANGED")).when(differs, "RESULT_CONFLICT").otherwise("VERIFIED_UNCHANGED")
    return F.when(purpose == "RECOVERY", recovery).otherwise(correction)


def reduce_same(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    """Whether two structs agree in all of the fields, nulls being equal to nulls."""
    out = F.lit(True)
    for f in fields:
        out = out & a[f].eqNullSafe(b[f])
    return out


def next_check(outcome_: Column, ko: Column, now: Column, attempts: Column, until: Column | None = None) -> Column:
    """The second at which to look again, null for never: doubling waits by the fixture's age while a result is missing, a week for what needs other evidence, an hour or the provider's
    own moment where it is overloaded, and 1, 7 and 28 days after the kick-off for what is settled."""
    until = F.lit(None).cast("long") if until is None else until
    doubled = lambda base: F.lit(base) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(8))).cast("long")
    age = now - ko
    wait = F.lit(None).cast("long")
    for limit, base, cap in reversed(WAITS):
        step = F.least(F.lit(cap).cast("long"), doubled(base))
        wait = step if limit is None else F.when(age < limit, step).otherwise(wait)
    later = F.array_min(F.filter(F.array(*[ko + d * DAY for d in CORRECTION_DAYS]), lambda x: x > now))
    return (
        F.when(outcome_ == "PROVIDER_RATE_LIMITED", F.coalesce(until, now + HOUR))
        .when(outcome_ == "PROVIDER_UNAVAILABLE", F.coalesce(until, now + F.least(F.lit(HOUR).cast("long"), doubled(5 * MINUTE))))
        .when(outcome_.isin("NOT_RETURNED", "NOT_YET_PUBLISHED"), now + wait)
        .when(outcome_.isin("IDENTITY_UNRESOLVED", "RESULT_CONFLICT", "QUALIFICATION_FAILED"), now + 7 * DAY)
        .otherwise(later)
    )

"""Observation streams: late corrections as new rows, live updates in a partial order, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States in which a match is over for good, and in which it is under way.
FINAL, RUNNING = ("FINISHED", "CANCELLED", "ABANDONED", "AWARDED"), ("LIVE", "HALF_TIME")
#: The fields of an update, and their types; what a table lacks of them is null.
UPDATE = {"provider": "string", "source_time": "bigint", "known_by": "bigint", "minute": "bigint", "added": "bigint", "status": "string", "home": "bigint", "away": "bigint"}


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """keys, start, end, n, total per event-time window, with rows later than ``late`` behind the newest left out; runs on a stream and on a table alike."""
    frame = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, late).groupBy(frame.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """The first delivery of each key within the lateness; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def compare(old: Column, new: Column) -> Column:
    """NEWER, SAME, STALE, CONFLICT or UNORDERED for two updates (structs of the fields of UPDATE, all but status nullable).

    The source's clock decides where both bear one that is not later than when the update was known, and come from one provider; what was known before the held clock is stale, what
    bears a clock after the held one was known is newer. Else the match clock decides, added time within its minute; else a step from scheduled to under way, or to finished.
    """
    sound = lambda u: F.when(u["source_time"].isNotNull() & u["known_by"].isNotNull() & (u["source_time"] <= u["known_by"]), u["source_time"])
    sign = lambda a, b: F.when(b > a, 1).when(b < a, -1).when(a == b, 0)
    was, now = sound(old), sound(new)
    foreign = F.coalesce((old["provider"] != "") & ~old["provider"].eqNullSafe(new["provider"]), F.lit(False))
    source = F.when(foreign, F.lit(None)).when(was.isNotNull() & now.isNotNull(), sign(was, now)).when(was.isNotNull() & (new["known_by"] < was), -1).when(now.isNotNull() & (now > old["known_by"]), 1)
    clock = F.when(old["minute"] != new["minute"], sign(old["minute"], new["minute"])).when(old["minute"] == new["minute"], sign(old["added"], new["added"]))
    facts = ("status", "home", "away", "minute", "added")
    same = F.lit(True)
    for f in facts:
        same = same & old[f].eqNullSafe(new[f])
    at_once = old["minute"].isNotNull() & (old["minute"] == new["minute"]) & old["added"].eqNullSafe(new["added"])
    return (
        F.when(source == 1, "NEWER").when(source == -1, "STALE").when(source == 0, F.when(same, "SAME").otherwise("CONFLICT"))
        .when(clock == 1, "NEWER").when(clock == -1, "STALE").when(same, "SAME")
        .when((new["status"] == "FINISHED") & ~F.coalesce(old["status"].isin(*FINAL), F.lit(False)), "NEWER").when((old["status"] == "SCHEDULED") & new["status"].isin(*RUNNING), "NEWER")
        .when(at_once, "CONFLICT").otherwise("UNORDERED")
    )


def order_of(old: dict[str, Any], new: dict[str, Any]) -> str:
    """``compare`` of two updates in Python, for the fold of a stream."""

    def sound(u: dict[str, Any]) -> Any:
        t, k = u["source_time"], u["known_by"]
        return t if t is not None and k is not None and t <= k else None

    def sign(a: Any, b: Any) -> int | None:
        return None if a is None or b is None else (b > a) - (b < a)

    was, now, source = sound(old), sound(new), None
    if not (old["provider"] and old["provider"] != new["provider"]):
        if was is not None and now is not None:
            source = sign(was, now)
        elif was is not None and new["known_by"] is not None and new["known_by"] < was:
            source = -1
        elif now is not None and old["known_by"] is not None and now > old["known_by"]:
            source = 1
    same = all(old[f] == new[f] for f in ("status", "home", "away", "minute", "added"))
    if source is not None:
        return {1: "NEWER", -1: "STALE"}.get(source) or ("SAME" if same else "CONFLICT")
    clock = sign(old["minute"], new["minute"])
    clock = sign(old["added"], new["added"]) if clock == 0 else clock
    if clock:
        return "NEWER" if clock > 0 else "STALE"
    if same:
        return "SAME"
    if (new["status"] == "FINISHED" and old["status"] not in FINAL) or (old["status"] == "SCHEDULED" and new["status"] in RUNNING):
        return "NEWER"
    return "CONFLICT" if old["minute"] is not None and old["minute"] == new["minute"] and old["added"] == new["added"] else "UNORDERED"


def live_states(stream: DataFrame, key: str) -> DataFrame:
    """key, the fields of UPDATE, verdict: every update against the state it meets; only newer ones change the state.

    ``stream`` has the key and fields of UPDATE; without known_by an update is taken as known at its source's time. The state of a match is one update.
    """
    kind = dict(stream.dtypes)[key]
    names = list(UPDATE)
    have = [F.col(n).cast(t).alias(n) if n in stream.columns else (F.col("source_time").cast(t) if n == "known_by" and "source_time" in stream.columns else F.lit(None).cast(t)).alias(n) for n, t in UPDATE.items()]

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = dict(zip(names, state.get, strict=True)) if state.exists else None
        for pdf in frames:
            verdicts = []
            for row in pdf[names].itertuples(index=False):
                new = {n: None if pd.isna(v) else v if UPDATE[n] == "string" else int(v) for n, v in zip(names, row, strict=True)}
                verdict = "NEWER" if held is None else order_of(held, new)
                if verdict == "NEWER":
                    held = new
                verdicts.append(verdict)
            if held is not None:
                state.update(tuple(held[n] for n in names))
            yield pdf.assign(verdict=verdicts)[[key, *names, "verdict"]]

    columns = ", ".join(f"{n} {t}" for n, t in UPDATE.items())
    return stream.select(key, *have).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {columns}, verdict string", columns, "append", "NoTimeout")

"""Attributes as known at event time: periodic as-known snapshots plus the change log.

The change log of each entity is cut into calendar periods, and written together with a snapshot per entity and period that has changes: the
greatest revision up to the period's end. An event takes the snapshot before its own period and replays only the changes between that
snapshot and its moment, by one merged sort. Periods are cut into slots, so that not even an entity with a third of all
rows is replayed in one task, and no event is ever paired with a change.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut

#: Length of a snapshot period, and the slots that a period's replay is split by. Neither changes a result.
PERIOD_DAYS, SLOTS = 30, 1024


@dataclass(frozen=True)
class History:
    """``log`` (entity columns, visible, rank, period, slot: per entity and moment the greatest revision that became visible then) and ``snapshots`` (entity columns, period, rank: the state at the end of each period with changes)."""

    entity: list[str]
    days: int
    log: DataFrame
    snapshots: DataFrame


def _width(days: int) -> int:
    """Microseconds of a slot; a period is SLOTS of them."""
    return -(-days * 86_400_000_000 // SLOTS)


def _placed(df: DataFrame, time: str, days: int) -> DataFrame:
    slot = F.floor(F.col(time) / F.lit(_width(days))).cast("long")
    return df.withColumn("slot", slot).withColumn("period", F.floor(F.col("slot") / SLOTS).cast("long"))


def materialise(revisions: DataFrame, entity: list[str], visible: Column, rank: list[Column], days: int = PERIOD_DAYS) -> History:
    """The written history of ``revisions``: repeated rows and ties collapse before the shuffle. Revisions with a null entity or moment are never valid.

    A window over an entity's snapshots is bounded by the calendar, not by the number of its changes.
    """
    best = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
    log = revisions.select(*entity, visible.alias("visible"), best.alias("rank")).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*entity, "visible"]]))
    log = cut(_placed(log.groupBy(*entity, "visible").agg(F.max("rank").alias("rank")), "visible", days))
    states = log.groupBy(*entity, "period").agg(F.max("rank").alias("rank"))
    w = Window.partitionBy(*entity).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return History(entity, days, log, cut(states.select(*entity, "period", F.max("rank").over(w).alias("rank"))))


def _before(states: DataFrame, asked: DataFrame, keys: list[str], place: str) -> DataFrame:
    """keys, place, rank: for each row of ``asked`` the greatest rank of the key's ``states`` at earlier places."""
    rows = states.select(*keys, place, "rank", F.lit(1).alias("o")).unionByName(asked.select(*keys, place, F.lit(None).cast(states.schema["rank"].dataType).alias("rank"), F.lit(0).alias("o")))
    # at an equal place the question comes first
    w = Window.partitionBy(*keys).orderBy(place, "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("rank", F.max("rank").over(w)).where("o = 0").drop("o")


def as_known(events: DataFrame, event_id: str, moment: Column, revisions: DataFrame | History, entity: dict[str, str], visible: Column | None = None, rank: list[Column] | None = None, days: int = PERIOD_DAYS) -> DataFrame:
    """event_id, rank: for each event the greatest revision (by ``rank``) of its entity that was visible at or before ``moment``.

    ``entity`` maps event columns to revision columns; ``moment`` and ``visible`` are microseconds. ``revisions`` may be a history that
    ``materialise`` wrote before. Events without a visible revision, with a null moment or a null entity give no row; repeated events give one
    row; ties in all of ``rank`` are one and the same answer. Empty tables give no rows. Columns of the two sides may share names: only the named ones are read.
    """
    names = [f"__e{i}" for i in range(len(entity))]
    if not isinstance(revisions, History):
        renamed = revisions.select("*", *[F.col(c).alias(n) for n, c in zip(names, entity.values(), strict=True)])
        revisions = materialise(renamed, names, visible, rank, days)
    log, snapshots = (df.withColumnsRenamed(dict(zip(revisions.entity, names, strict=True))) for df in (revisions.log, revisions.snapshots))
    asked = events.select(F.col(event_id).alias("event_id"), moment.alias("visible"), *[F.col(c).alias(n) for n, c in zip(names, entity, strict=True)])
    asked = _placed(asked.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*names, "visible"]])).distinct(), "visible", revisions.days)
    slots = asked.select(*names, "period", "slot").distinct()
    # the snapshot before the period, then the greatest change of the period's slots before the event's own
    snapshot = _before(snapshots, slots.select(*names, "period").distinct(), names, "period")
    changes = _before(log.groupBy(*names, "period", "slot").agg(F.max("rank").alias("rank")), slots, [*names, "period"], "slot")
    base = changes.alias("c").join(snapshot.withColumnRenamed("rank", "snapshot"), [*names, "period"]).select(*names, "period", "slot", F.greatest("rank", "snapshot").alias("rank"))
    # replay: changes and events of a slot in one sort, on top of the state at its start; at an equal moment the change comes first
    none = F.lit(None)
    id_type, rank_type = asked.schema["event_id"].dataType, log.schema["rank"].dataType
    merged = base.select(*names, "period", "slot", F.lit(None).cast("long").alias("visible"), F.lit(0).alias("o"), "rank", none.cast(id_type).alias("event_id"))
    merged = merged.unionByName(log.select(*names, "period", "slot", "visible", F.lit(0).alias("o"), "rank", none.cast(id_type).alias("event_id")))
    merged = merged.unionByName(asked.select(*names, "period", "slot", "visible", F.lit(1).alias("o"), none.cast(rank_type).alias("rank"), "event_id"))
    w = Window.partitionBy(*names, "period", "slot").orderBy(F.asc_nulls_first("visible"), "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("rank", F.max("rank").over(w)).where("o = 1 and rank is not null")
    return found.groupBy("event_id").agg(F.max("rank").alias("rank"))

"""Overlapping and gapped intervals: continuous periods and the gaps between them.

The intervals are sorted globally by entity and start into range partitions and written to the checkpoint folder. Each partition
gives one summary row (its last entity and the state there), the summaries are combined in order, and every partition is
scanned again with the state carried into it. No entity is ever gathered in one task, however many intervals it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import cut


def _codes(pdf: pd.DataFrame, entity: list[str], last: tuple | None) -> tuple[np.ndarray, bool]:
    """A dense number per run of equal entities, and whether the first run continues ``last``."""
    change = np.zeros(len(pdf), dtype=bool)
    for e in entity:
        v = pdf[e].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change), last is not None and tuple(pdf[e].iloc[0] for e in entity) == last


def _scan(batches: Iterator[pd.DataFrame], entity: list[str], carry: tuple | None) -> Iterator[tuple[pd.DataFrame, tuple]]:
    """Yields each batch with columns island (start of the island the row belongs to), gap (whether a gap lies before it) and seen (greatest end before the row), and the carry after it."""
    for pdf in batches:
        if not len(pdf):
            continue
        runs, goes_on = _codes(pdf, entity, carry[0] if carry else None)
        start, end = pdf["start"].to_numpy(np.int64), pdf["end"].to_numpy(np.int64)
        first = np.r_[True, runs[1:] != runs[:-1]]
        # greatest end so far within the run, the carried one included: a running maximum over the ranks of the ends, which stay small whatever the ends are
        values, rank = np.unique(np.r_[end, carry[2] if goes_on else end[0]], return_inverse=True)
        lifted = rank[:-1] + runs * len(values)
        if goes_on:
            lifted[0] = max(lifted[0], rank[-1])
        top = values[np.maximum.accumulate(lifted) - runs * len(values)]
        seen = np.r_[end[0], top[:-1]]
        fresh = first | (start > seen)
        if goes_on:
            seen[0], fresh[0] = carry[2], start[0] > carry[2]
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(pdf)), -1))
        island = np.where(at >= 0, start[np.maximum(at, 0)], carry[1] if goes_on else 0)
        gap = fresh & ~first
        gap[0] = goes_on and fresh[0]
        entity_now = tuple(pdf[e].iloc[-1] for e in entity)
        carry = (entity_now, int(island[-1]), int(top[-1]))
        yield pdf.assign(island=island, seen=seen, gap=gap), carry


def _summaries(spread: DataFrame, entity: list[str]) -> list[tuple]:
    """One row per range partition, in order: number, first entity, last entity, start of its last island, greatest end of its last entity."""
    keys = [f"{e} {t}" for e, t in spread.select(*entity).dtypes]
    schema = ", ".join(["part int", *[f"f_{k}" for k in keys], *[f"l_{k}" for k in keys], "island bigint", "top bigint"])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = carry = part = None
        for pdf, carry in _scan(batches, entity, None):
            if first is None:
                first, part = tuple(pdf[e].iloc[0] for e in entity), int(pdf["part"].iloc[0])
        if carry:
            yield pd.DataFrame([[part, *first, *carry[0], carry[1], carry[2]]], columns=[c.split(" ")[0] for c in schema.split(", ")])

    rows = spread.withColumn("part", F.spark_partition_id()).mapInPandas(summarise, schema).collect()
    n = len(entity)
    return sorted((r[0], tuple(r[1 : 1 + n]), tuple(r[1 + n : 1 + 2 * n]), r[-2], r[-1]) for r in rows)


def carried_states(summaries: list[tuple]) -> dict[int, tuple]:
    """For each partition the (entity, island start, greatest end) that the partitions before it leave open; prefix combination of the summaries."""
    out: dict[int, tuple] = {}
    carry: tuple | None = None
    for part, first, last, island, top in summaries:
        if carry is not None:
            out[part] = carry
        if carry is not None and carry[0] == first == last:
            # the whole partition belongs to the open entity: its last island may be the carried one
            carry = (last, carry[1] if island <= carry[2] else island, max(top, carry[2]))
        else:
            carry = (last, island, top)
    return out


def periods_and_gaps(intervals: DataFrame, entity: list[str], partitions: int | None = None) -> DataFrame:
    """entity columns, kind (``period`` or ``gap``), start, end: merged intervals of each entity, and the stretches between them.

    ``intervals`` has the entity columns and numeric ``start`` and ``end``. Intervals that overlap or touch merge. Rows that are
    null in any of these or do not end after their start cover nothing; repeated rows change nothing; an empty table gives no rows.
    """
    spark = intervals.sparkSession
    clean = intervals.select(*entity, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).where("`end` > `start`")
    for e in entity:
        clean = clean.where(F.col(e).isNotNull())
    # of the intervals of an entity with the same start the longest says all
    clean = clean.groupBy(*entity, "start").agg(F.max("end").alias("end"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(clean.repartitionByRange(n, *entity, "start").sortWithinPartitions(*entity, "start"))
    carried = carried_states(_summaries(spread, entity))
    keys = [f"{e} {t}" for e, t in spread.select(*entity).dtypes]

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = iter(batches)
        head = next((b for b in batches if len(b)), None)
        if head is None:
            return
        carry = carried.get(int(head["part"].iloc[0]))

        def all_batches() -> Iterator[pd.DataFrame]:
            yield head
            yield from batches

        for pdf, _ in _scan(all_batches(), entity, carry):
            islands = pdf.groupby([*entity, "island"], sort=False, as_index=False)["end"].max().rename(columns={"island": "start"})
            gaps = pdf[pdf["gap"]]
            gaps = gaps[entity].assign(start=gaps["seen"], end=gaps["start"], kind="gap")
            yield pd.concat([islands.assign(kind="period")[[*entity, "kind", "start", "end"]], gaps[[*entity, "kind", "start", "end"]]])

    found = spread.withColumn("part", F.spark_partition_id()).mapInPandas(rescan, ", ".join([*keys, "kind string", "start bigint", "end bigint"]))
    # an island that runs over partitions came out once from each
    return found.groupBy(*entity, "kind", "start").agg(F.max("end").alias("end"))

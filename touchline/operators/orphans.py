"""References to records that do not exist, by registry and key, valid in time.

Parents and children are brought into one long form (registry, key, tag), grouped by registry and key, and the groups whose
parent intervals do not cover all their references are kept; only references to those keys are then looked at one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.keys import bare_uuid, key_bytes, uuid_key
from touchline.session import cut, sized_join


@dataclass(frozen=True)
class Reference:
    """A child column and the registry (``parent``: key column, registered_at, removed_at) it points into."""

    field: str
    parent: DataFrame
    key: str


def _children(events: DataFrame, row_id: str, at: str, references: list[Reference]) -> DataFrame:
    """field, key, row_id, at: one row per non-empty reference."""
    # the bare spellings are columns of their own, so that each is made once and the keys are taken from it
    bare = events.select(F.col(row_id).alias("row_id"), F.unix_micros(F.col(at)).alias("at"), *[bare_uuid(F.col(r.field)).alias(f"k{i}") for i, r in enumerate(references)])
    refs = F.array_compact(F.array(*[F.when(F.col(f"k{i}").isNotNull(), F.struct(F.lit(r.field).alias("field"), key_bytes(F.col(f"k{i}")).alias("key"))) for i, r in enumerate(references)]))
    return bare.select("row_id", "at", F.inline(refs))


def _parents(references: list[Reference]) -> DataFrame:
    parts = [
        r.parent.select(F.lit(r.field).alias("field"), uuid_key(F.col(r.key)).alias("key"), F.unix_micros("registered_at").alias("a"), F.unix_micros("removed_at").alias("b")).where("key is not null")
        for r in references
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _live(spans: Column, at: Column) -> Column:
    return F.exists(spans, lambda s: (F.coalesce(s["a"], F.lit(-(2**62))) <= at) & (at < F.coalesce(s["b"], F.lit(2**62))))


def key_groups(events: DataFrame, row_id: str, at: str, references: list[Reference]) -> DataFrame:
    """field, key, references, low, high (the first and last moment of its references), spans (the registry's distinct intervals; empty where it lacks the key).

    Child rows are combined before the shuffle, so a key with a third of all rows costs each task one row of the exchange.
    """
    span = "struct<a:bigint,b:bigint>"
    # children first by themselves: an aggregate of plain numbers, hashed and combined on the map side, without the collected spans
    children = _children(events, row_id, at, references).groupBy("field", "key").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    children = children.withColumn("span", F.lit(None).cast(span))
    none = F.lit(None).cast("bigint")
    parents = _parents(references).distinct().select("field", "key", F.lit(0).cast("bigint").alias("n"), none.alias("low"), none.alias("high"), F.struct("a", "b").alias("span"))
    return children.unionByName(parents).groupBy("field", "key").agg(F.sum("n").alias("references"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("span").alias("spans"))


def doubtful_keys(groups: DataFrame) -> DataFrame:
    """The referenced keys that no single interval of the registry covers from first to last reference."""
    covered = F.exists(F.col("spans"), lambda s: (F.coalesce(s["a"], F.lit(-(2**62))) <= F.col("low")) & (F.col("high") < F.coalesce(s["b"], F.lit(2**62))))
    return groups.where((F.col("references") > 0) & ~F.coalesce(covered, F.lit(False)))


def orphan_references(events: DataFrame, row_id: str, at: str, references: list[Reference], bound: int | None = None) -> DataFrame:
    """row_id, field, kind, at of each reference whose key is not live in its registry at ``at``.

    kind: ``missing`` if the registry never holds the key, ``late`` if all its rows there are registered after ``at``, else
    ``deleted``. A key is live from registered_at (null: from ever) up to but not at removed_at (null: for ever). Null, empty and
    blank references are none. Uuids are compared by value, not spelling. A reference with a null time is reported only as missing.
    Empty tables: no events give no rows; an empty registry makes each reference missing. Repeated rows of a registry change
    nothing; repeated event rows are reported each. A null key in a registry holds nothing. Other columns are not read.
    ``bound`` is that of ``sized_join``; it changes no result.
    """
    # written once; joined by its counted size, with hot keys told apart beyond the bound of a broadcast
    groups = cut(doubtful_keys(key_groups(events, row_id, at, references)).select("field", "key", "spans"))
    joined = sized_join(_children(events, row_id, at, references), groups, ["field", "key"], bound=bound)
    at_col = F.col("at")
    kind = (
        F.when(F.size("spans") == 0, F.lit("missing"))
        .when(at_col.isNull() | _live(F.col("spans"), at_col), F.lit(None))
        .when(F.forall("spans", lambda s: F.coalesce(s["a"] > at_col, F.lit(False))), F.lit("late"))
        .otherwise(F.lit("deleted"))
    )
    return joined.select("row_id", "field", kind.alias("kind"), "at").where(F.col("kind").isNotNull())


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """field, kind, period (month of the reference, null if it has no time), orphans: the report per registry and period."""
    period = F.date_format(F.date_from_unix_date(F.floor(F.col("at") / F.lit(86_400_000_000)).cast("int")), "yyyy-MM")
    return orphans.groupBy("field", "kind", period.alias("period")).agg(F.count("*").alias("orphans"))

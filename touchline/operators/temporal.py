"""Bitemporal and as-of operators: knowledge predicates, latest rows, as-of joins and strict windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def known_at(start: Column, end: Column, moment: Column) -> Column:
    """Whether a half-open knowledge interval [start, end) holds the moment; a null end is open, a null start never begins."""
    return F.coalesce((start <= moment) & (end.isNull() | (end > moment)), F.lit(False))


def strictly_before(ko: Column, cutoff: Column, known: Column, knowledge_cutoff: Column, exact: Column | None = None) -> Column:
    """Whether a match may be used at a cutoff: it kicked off strictly before (by day, where its time is no exact one) and was known by then."""
    before = ko < cutoff
    if exact is not None:
        day = lambda x: F.floor(x / 86400)
        before = F.when(exact, before).otherwise(day(ko) < day(cutoff))
    return before & (known <= knowledge_cutoff)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order`` (end it with an id, so that it is total).

    An aggregate rather than a window: rows combine on the map side, so a key with a third of all rows needs no sort in one task.
    Nulls in ``order`` come last; null keys are a key of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.struct(F.col(o).isNotNull().alias("a"), F.col(o).alias("b")).alias(f"o{i}") for i, o in enumerate(order)])).alias("row"))
    return best.select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(*df.columns)


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by ``order``. Spark cuts each sorted partition to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], tie: str | None = None, inclusive: bool = True, width: int | None = None) -> DataFrame:
    """``left`` with, per row, ``values`` of the latest row of ``right`` with the same keys at (``inclusive``) or before its time; nulls where there is none.

    Both sides are merged in one sort per key and the last value is carried forward: n log n, and no pair of rows is ever formed. With ``width``, times are whole numbers and a key is cut
    into periods of that width, each of which begins with the last value before it, so that a hot key is spread. Right rows of equal time are ordered by ``tie``. Left rows with a null
    time have none.
    """
    lcols = left.columns
    pack = F.struct(*[F.col(v) for v in values])
    tie_col = F.col(tie).cast("string") if tie else F.lit("")
    period = lambda t: F.floor(F.col(t) / width) if width else F.lit(0).cast("long")
    r = right.where(F.col(right_time).isNotNull()).select(*keys, period(right_time).alias("__p"), F.col(right_time).alias("__t"), F.lit(0 if inclusive else 2).alias("__o"), tie_col.alias("__tie"), pack.alias("__v"), F.lit(None).cast(left.select(F.struct(*lcols).alias("s")).schema["s"].dataType).alias("__l"))
    l = left.select(*keys, F.coalesce(period(left_time), F.lit(0)).alias("__p"), F.col(left_time).alias("__t"), F.lit(1).alias("__o"), F.lit("").alias("__tie"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.struct(*lcols).alias("__l"))  # noqa: E741
    merged = l.unionByName(r)
    if width:
        # one row per key and period: the last value of the periods before
        last = r.groupBy(*keys, "__p").agg(F.max_by("__v", F.struct("__t", "__tie")).alias("__v")).withColumn("__o", F.lit(1))
        asked = l.select(*keys, "__p").distinct().withColumns({"__v": F.lit(None).cast(r.schema["__v"].dataType), "__o": F.lit(0)})
        before = Window.partitionBy(*keys).orderBy("__p", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        starts = last.unionByName(asked).withColumn("__v", F.last("__v", ignorenulls=True).over(before)).where("__o = 0 and __v is not null")
        merged = merged.unionByName(starts.select(*keys, "__p", F.lit(None).cast(r.schema["__t"].dataType).alias("__t"), F.lit(-1).alias("__o"), F.lit("").alias("__tie"), "__v", F.lit(None).cast(r.schema["__l"].dataType).alias("__l")))
    w = Window.partitionBy(*keys, *(["__p"] if width else [])).orderBy(F.asc_nulls_first("__t"), "__o", F.col("__tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("__found", F.last("__v", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    found = F.when(F.col("__t").isNotNull(), F.col("__found"))
    return merged.select(*[F.col("__l")[c].alias(c) for c in lcols], *[found[v].alias(v) for v in values])


def strict_past(keys: list[str], time: str) -> WindowSpec:
    """The frame of all rows of a key strictly before the current row's (whole-number) time: rows of the same moment do not see each other."""
    return Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)


def last_n(keys: list[str], order: list[str], n: int) -> WindowSpec:
    """The frame of the n rows before the current one; times must be unique within a key."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)


def overlapping(df: DataFrame, keys: list[str], start: str, end: str, row: str) -> DataFrame:
    """keys, row, start, end of rows whose half-open interval begins before an earlier one of the key has ended (null end: open)."""
    top = 2**62
    w = Window.partitionBy(*keys).orderBy(start, row).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.coalesce(F.col(end), F.lit(top))).over(w)
    return df.withColumn("__seen", ended).where(F.col("__seen") > F.col(start)).select(*keys, row, start, end)


def chain_heads(df: DataFrame, node: str, replaces: str) -> DataFrame:
    """The rows that no other row replaces."""
    gone = df.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias(node)).distinct()
    return df.join(gone, node, "left_anti")


def running_sums(df: DataFrame, keys: list[str], time: str, sums: dict[str, str], width: int, strict: bool = False) -> DataFrame:
    """``df`` with, per entry of ``sums`` (new column: summed column), the sum over all rows of the key at or before (``strict``: before) the row's whole-number time.

    Time is cut into periods of ``width``: a row adds the sums of the periods before its own, taken from one row per key and period, to the sum
    within its period. A key with a third of all rows is so spread over its periods. Rows of equal time lie in one period. Null keys or times get null sums.
    """
    bucket = F.floor(F.col(time) / width)
    rows = df.withColumn("__p", bucket)
    per = rows.groupBy(*keys, "__p").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__p", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__p").orderBy(time).rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    rows = rows.withColumns({f"__i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = rows.join(per, [*keys, "__p"], "left")
    return joined.select(*df.columns, *[(F.col(f"__o_{n}") + F.col(f"__i_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, keys: list[str], time: str, ties: list[str | Column], width: int, name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row of a key by time, then ``ties``, from 1; time is a whole number, cut into periods of ``width`` as in ``running_sums``, so that a hot key is spread over its periods."""
    rows = df.withColumn("__p", F.floor(F.col(time) / width))
    per = rows.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys, "__p").orderBy(time, *ties)
    return rows.withColumn("__i", F.row_number().over(inside)).join(per, [*keys, "__p"]).select(*df.columns, (F.col("__o") + F.col("__i")).alias(name))


#: Rows of a key that one task sorts for a frame of neighbouring rows; it changes no result.
CHUNK = 4096


def with_neighbours(df: DataFrame, keys: list[str], time: str, ties: list[str | Column], width: int, columns, before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``columns``: a function of a window over a key's rows in order of time and ``ties``, whose frames look at most ``before`` rows back and ``after`` rows ahead, and of each row's number.

    The rows of a key are numbered (see ``numbered``) and cut into chunks; each chunk also gets the last rows of the one before it and the first of the one after it, so
    that a key with a third of all rows is spread over its chunks. ``columns(window, number)`` returns the new columns by name.
    """
    rows = numbered(df, keys, time, ties, width, "__number")
    own, at = F.floor((F.col("__number") - 1) / chunk), (F.col("__number") - 1) % chunk
    copies = F.array_compact(F.array(own, F.when(at >= chunk - before, own + 1) if before else F.lit(None).cast("bigint"), F.when(at < after, own - 1) if after else F.lit(None).cast("bigint")))
    rows = rows.select("*", own.alias("__own"), F.explode(copies).alias("__chunk"))
    w = Window.partitionBy(*keys, "__chunk").orderBy("__number")
    # the frames are laid over the chunk with its neighbours, which are dropped afterwards
    return rows.withColumns(columns(w, F.col("__number"))).where("__chunk = __own").drop("__own", "__chunk", "__number")


def with_recent(df: DataFrame, keys: list[str], time: str, reach: int, width: int, columns) -> DataFrame:
    """``df`` with ``columns``: a function of a window ordered by whole-number time whose range frames look back at most ``reach``. A key is cut into periods of ``width`` (at least ``reach``), each with the end of the one before it."""
    own = F.floor(F.col(time) / width)
    copies = F.array_compact(F.array(own, F.when(F.pmod(F.col(time), F.lit(width)) >= width - reach, own + 1)))
    rows = df.select("*", own.alias("__own"), F.explode(copies).alias("__chunk"))
    w = Window.partitionBy(*keys, "__chunk").orderBy(time)
    return rows.withColumns(columns(w)).where("__chunk = __own").drop("__own", "__chunk")

"""Session construction and the few session-wide settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "touchline", cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session with adaptive execution on; on a cluster use its own builder and skip this."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the cluster's ``spark.checkpoint.dir``, or an own one where that is unset and all runs in one process (tests).

    On a cluster a machine's own folder would be lost with the machine, so it is refused.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("TOUCHLINE_CHECKPOINT_DIR")
    if not wanted and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="touchline-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so later steps survive a lost executor without recomputing what came before.

    The size estimate is cut as well: a checkpoint keeps the estimate of the plan it replaces, and in a loop of joins those multiply
    until the planner works on numbers of millions of digits.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    try:
        rows = kept._jdf.queryExecution().toRdd()
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
    except (AttributeError, TypeError):  # another session type: the estimates stay
        return kept


#: A table is broadcast only where its counted bytes are at most this; beyond it, a key that holds more than one in HOT_KEYS of the other side's rows is hot.
BROADCAST_BYTES = int(os.environ.get("TOUCHLINE_BROADCAST_BYTES", 32 * 2**20))
HOT_KEYS = 1024


def bytes_of(df: DataFrame) -> int:
    """About the bytes that the rows of ``df`` take: the lengths of texts and of arrays of numbers, of other nested values as JSON, 16 for a field and for a row."""
    plain = ("array<int>", "array<bigint>", "array<double>")
    width = lambda name, kind: F.octet_length(name) if kind in ("string", "binary") else 8 * F.size(name) if kind in plain else F.octet_length(F.to_json(F.struct(name))) if kind.startswith(("array", "map", "struct")) else F.lit(0)
    sizes = [F.coalesce(width(name, kind), F.lit(0)) + 16 for name, kind in df.dtypes]
    return df.agg(F.sum(sum(sizes, F.lit(16))).alias("n")).first()["n"] or 0


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", bound: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` (written, one row per key) on ``keys``, inner or left.

    ``right`` is broadcast if its counted bytes are at most ``bound``. Else the rows of hot keys, at most HOT_KEYS of them, meet ``right`` in a broadcast
    join (if these rows of ``right`` are within the bound), and all others in a shuffled one, in which no key holds more than one in HOT_KEYS rows.
    """
    bound = BROADCAST_BYTES if bound is None else bound
    if bytes_of(right) <= bound:
        return left.join(F.broadcast(right), keys, how)
    per = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = per.agg(F.sum("__n").alias("__total"))
    hot = cut(per.join(F.broadcast(total), F.lit(True)).where(F.col("__n") * HOT_KEYS > F.col("__total")).select(*keys))
    hot_right = cut(right.join(F.broadcast(hot), keys, "left_semi"))
    hot_rows = left.join(F.broadcast(hot), keys, "left_semi")
    # rows of a null key meet nothing, and go past the shuffle
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    cold = left.where(known).join(F.broadcast(hot), keys, "left_anti").join(right.join(F.broadcast(hot), keys, "left_anti"), keys, how)
    met = hot_rows.join(F.broadcast(hot_right) if bytes_of(hot_right) <= max(bound, BROADCAST_BYTES) else hot_right, keys, how)
    out = met.select(*cold.columns).unionByName(cold)
    if how == "left":
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in right.dtypes if name not in keys]
        out = out.unionByName(left.where(~known).select(*left.columns, *nothing).select(*cold.columns))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

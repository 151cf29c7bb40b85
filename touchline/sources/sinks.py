"""Sinks: immutable Parquet outputs with a manifest, canonical row hashes, idempotent inserts, and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns as canonical JSON in the given order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_checksum(df: DataFrame) -> str:
    """A checksum that does not depend on the order of rows or on partitions: sums of halves of row hashes with the row count, folded once more."""
    h = df.select(row_hash(*sorted(df.columns)).alias("h"))
    r = h.agg(F.count("*").alias("n"), *_words(F.col("h")))
    return r.select(F.sha2(F.concat_ws("|", *r.columns), 256)).first()[0]


def _words(h: Column) -> list[Column]:
    return [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]


def publish(df: DataFrame, path: str, name: str, version: str) -> DataFrame:
    """Writes an output that must not exist yet, and appends name, version, path, rows and checksum to the manifest beside it.

    The output is computed once, into a staging folder; its checksum is taken as it is written and again as it is read back, and only when they agree is it moved to its place by one rename.
    """
    spark = df.sparkSession
    target, staged = f"{path}/{name}/{version}", f"{path}/_staging/{name}-{version}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(target)):
        raise ValueError(f"{target} exists already")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *_words(row_hash(*sorted(df.columns)))).write.mode("overwrite").option("compression", "zstd").parquet(staged)
    written = spark.createDataFrame([tuple(str(seen.get[c] or 0) if c == "n" else None if seen.get[c] is None else str(seen.get[c]) for c in ("n", *[f"w{i}" for i in range(8)]))], ", ".join(f"{c} string" for c in ("n", *[f"w{i}" for i in range(8)])))
    checksum = table_checksum(spark.read.parquet(staged))
    if checksum != written.select(F.sha2(F.concat_ws("|", *written.columns), 256)).first()[0]:
        raise ValueError(f"{staged} differs from what was to be written")
    fs.mkdirs(fs_path(target).getParent())
    if not fs.rename(fs_path(staged), fs_path(target)):
        raise ValueError(f"{target} could not be put in its place")
    manifest = spark.createDataFrame([(name, version, target, int(seen.get["n"]), checksum)], "name string, version string, path string, rows long, checksum string")
    manifest.coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return manifest


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with a column sound: whether each output still has its checksum."""
    rows = spark.read.json(f"{path}/_manifest").collect()  # a row per published output
    checked = [(r["name"], r["version"], table_checksum(spark.read.parquet(r["path"])) == r["checksum"]) for r in rows]
    return spark.createDataFrame(checked, "name string, version string, sound boolean")


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``incoming`` whose key ``existing`` lacks, one per key: an insert that ignores duplicates."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those of equal key."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def metrics_text(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One line per row in the text exposition format of metrics."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.regexp_replace(F.col(x).cast("string"), '(["\\\\])', "\\\\$1"), F.lit('"')) for x in labels])
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))


def run_report(counts: DataFrame, title: str) -> str:
    """A run's summary as Markdown: a heading, and a row per section, name and number of ``counts`` (section, name, n), in that order. The rows are a summary, not data."""
    rows = counts.select("section", "name", "n").orderBy("section", "name").collect()
    return "\n".join([f"# {title}", "", "| Section | Name | Number |", "| --- | --- | ---: |", *[f"| {r.section} | {r['name']} | {r.n} |" for r in rows], ""])


def review_sheet(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows for people to look at, as CSV with a header, range-sorted by ``order`` over the files; a leading sign that a spreadsheet would compute is made text."""
    safe = [F.when(F.col(c).rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.orderBy(*order).select(*safe).write.mode("errorifexists").option("header", True).csv(path)

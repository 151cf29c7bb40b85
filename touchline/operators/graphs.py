"""Chains, reachability and components of edge tables by iterated joins; every round is written, so lineage stays short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import cut


def resolve_chains(edges: DataFrame, source: str, target: str) -> DataFrame:
    """source, final, hops: where following target from source ends; chains that return to themselves have a null final.

    Pointers are doubled, so a chain of n rows takes log n joins, and what still moves after that many is a cycle. Each source has one
    target (the least); null sources and targets are left out.
    """
    now = cut(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("a")).agg(F.min(target).alias("b")).withColumn("hops", F.lit(1).cast("long")))
    for _ in range(now.count().bit_length() + 1):
        nxt = now.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("hops").alias("more"))
        moved = cut(now.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b2"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("c").isNotNull().alias("moved")))
        now = moved.select("a", F.col("b2").alias("b"), "hops")
        if not moved.where("moved").limit(1).count():
            break
    # what still moves, or points at something that moves, is a cycle or leads into one
    starts = now.select(F.col("a").alias("b")).distinct()
    looped = now.join(starts, "b", "left_semi").select("a").withColumn("loop", F.lit(True))
    out = now.join(looped, "a", "left")
    return out.select(F.col("a").alias(source), F.when(F.col("loop").isNull(), F.col("b")).alias("final"), F.when(F.col("loop").isNull(), F.col("hops")).alias("hops"))


def reachable(edges: DataFrame, source: str, target: str, seeds: DataFrame) -> DataFrame:
    """node, depth: everything reachable from the seeds (their first column), with the least number of steps; each node once, seeds at 0."""
    e = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("node"), F.col(target).alias("next")).distinct()
    fronts = [cut(seeds.toDF("node").where("node is not null").distinct().withColumn("depth", F.lit(0).cast("long")))]
    while fronts[-1].limit(1).count():
        # what was reached before is the union of the written fronts: none of them is written again
        seen = reduce(DataFrame.unionByName, fronts)
        new = fronts[-1].join(e, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct().join(seen, "node", "left_anti")
        fronts.append(cut(new))
    return reduce(DataFrame.unionByName, fronts)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: connected components of an undirected edge table, named by their least node.

    Alternates large-star and small-star steps, which halve distances, so few rounds do even for long paths; a hub costs each task one
    row per neighbour and no node's neighbours are collected.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    now = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least2 = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(least2, "u").select(F.col("v").alias("x"), "m").unionByName(least2.select(F.col("u").alias("x"), "m")).where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        after = cut(small)
        changed = after.exceptAll(now).limit(1).count() or now.exceptAll(after).limit(1).count()
        now = after
        if not changed:
            break
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))

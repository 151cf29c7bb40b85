"""Mixing sources to target weights by hierarchical budgets.

Budgets go down a tree of domain, language and source: at every node they are split by weight, what a child cannot take is shared among
its siblings, and only what a whole node cannot take goes to the node's own siblings. Each leaf then takes full epochs of its
documents and a prefix of one more, each epoch in a seeded order of its own. All of it is a computation on tables: nothing about the leaves reaches the driver.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut, sized_join

#: The levels of the tree, from the top: the site as the domain, the language, the source.
TREE = ("site", "lang", "source")
#: Buckets of the seeded order: token sums are taken per bucket, and only the bucket in which a leaf's prefix ends is ordered.
BUCKETS = 4096
#: What a null node is called within the tree.
NULL = "\u0000"
#: Leaves of a source whose prefixes are rounded in one series; each series is off its plan by less than half a document.
ROUNDED_AT_ONCE = 65_536


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``children`` (parent columns, child, weight, capacity, and the parent's budget) with ``part``: the budget split by weight without exceeding any capacity; what a child cannot take goes to its siblings by weight.

    A child takes the lesser of its capacity and its weight times a level, which is the greatest of (budget - capacities of all children with a lower ratio) /
    (weights of the others). Sums over the children of a node are taken by ranges of the ratio first, so that a node with many children is not sorted in one task.
    Weightless children take nothing.
    """
    ratio = F.col("capacity") / F.col("weight")
    open_ = children.where("weight > 0 and capacity > 0").withColumns({"__r": ratio, "__b": F.floor(16 * F.log2(ratio)).cast("int")})
    per = open_.groupBy(*parent, "__b").agg(F.sum("capacity").alias("__bc"), F.sum("weight").alias("__bw"))
    w = Window.partitionBy(*parent).orderBy("__b") if parent else Window.orderBy("__b")
    low, high = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    per = per.select(*parent, "__b", F.coalesce(F.sum("__bc").over(low), F.lit(0.0)).alias("__c0"), F.coalesce(F.sum("__bw").over(high), F.lit(0.0)).alias("__w1"))
    inside = Window.partitionBy(*parent, "__b").orderBy("__r", child)
    before = F.col("__c0") + F.coalesce(F.sum("capacity").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.col("__w1") + F.sum("weight").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = open_.join(per, [*parent, "__b"]).withColumn("__level", F.greatest((F.col("budget") - before) / rest, F.lit(0.0)))
    level = levels.groupBy(*parent).agg(F.max("__level").alias("__level")) if parent else levels.agg(F.max("__level").alias("__level"))
    met = open_.join(level, parent) if parent else open_.join(F.broadcast(level), F.lit(True))  # the root has one level
    return met.withColumn("part", F.least(F.col("capacity"), F.col("weight") * F.col("__level"))).drop("__r", "__b", "__level")


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None, weights: DataFrame | None = None, tree: tuple[str, ...] = TREE) -> DataFrame:
    """tree columns, tokens, max_repeats, part, epochs, rest: what each leaf (domain, language, source) is to give: ``epochs`` times all of its documents, and ``rest`` tokens more. Written.

    A source's target share is spread over its leaves by their tokens, each times the weights that ``weights`` (level, node, weight; default 1) gives to its domain
    and its language. See ``mix`` for the rest.
    """
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats")).where("share > 0 and max_repeats > 0")
    # a null site or language is a node like any other
    sized_nodes = sized.select(*[F.coalesce(F.col(t), F.lit(NULL)).alias(t) for t in tree], "tokens")
    leaves = sized_nodes.where(F.col("tokens") > 0).groupBy(*tree).agg(F.sum("tokens").alias("tokens")).join(F.broadcast(cut(goals)), "source")
    rel = F.col("tokens").cast("double")
    if weights is not None:
        for level in tree[:-1]:
            given = weights.where(F.col("level") == level).groupBy(F.col("node").alias(level)).agg(F.max("weight").alias(f"__{level}"))
            leaves = leaves.join(given, level, "left")
            rel = rel * F.coalesce(f"__{level}", F.lit(1.0))
    leaves = leaves.withColumn("__rel", rel)
    of_source = leaves.groupBy("source").agg(F.sum("__rel").alias("__all"))
    leaves = leaves.join(F.broadcast(of_source), "source").select(*tree, "tokens", "max_repeats", F.when(F.col("__all") > 0, F.col("share") * F.col("__rel") / F.col("__all")).otherwise(0.0).alias("weight"), (F.col("tokens") * F.col("max_repeats")).cast("double").alias("capacity"))
    leaves = cut(leaves)
    size = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("budget")) if total is None else sized.sparkSession.range(1).select(F.lit(float(total)).alias("budget"))
    parts: DataFrame | None = None
    for depth in range(len(tree)):
        parent, child = list(tree[:depth]), tree[depth]
        nodes = leaves if depth == len(tree) - 1 else leaves.groupBy(*parent, child).agg(F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"))
        nodes = nodes.join(F.broadcast(size), F.lit(True)) if parts is None else nodes.join(parts, parent)
        parts = cut(share_out(nodes, parent, child))
        if depth < len(tree) - 1:
            parts = parts.select(*parent, child, F.col("part").alias("budget"))
    epochs = F.least(F.floor(F.col("part") / F.col("tokens") + 1e-9), F.col("max_repeats")).cast("int")
    out = parts.select(*[F.nullif(F.col(t), F.lit(NULL)).alias(t) for t in tree], "tokens", "max_repeats", "part", epochs.alias("epochs"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.col("part") - F.col("epochs") * F.col("tokens"), F.lit(0.0))).otherwise(0.0)
    return cut(out.withColumn("rest", rest))


def _rounded(boundaries: DataFrame, tree: tuple[str, ...]) -> DataFrame:
    """tree columns, over: whether a leaf's prefix takes in the document at which it ends, decided along the leaves of a source so that what was rounded away before is made up for."""
    kinds = dict(boundaries.dtypes)
    schema = ", ".join([*[f"`{t}` {kinds[t]}" for t in tree], "over boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__h")
        short, out = 0.0, []
        for lack, tokens in zip(pdf["lack"], pdf["tokens"], strict=True):
            short += lack
            over = short >= tokens / 2
            short -= tokens if over else 0
            out.append(over)
        return pdf.assign(over=out)[[*tree, "over"]]

    placed = boundaries.withColumn("__h", F.xxhash64(*tree))
    per = placed.groupBy("source").agg(F.count("*").alias("__n"))
    placed = placed.join(F.broadcast(per), "source")
    chunk = F.pmod(F.shiftrightunsigned("__h", 20), F.ceil(F.col("__n") / ROUNDED_AT_ONCE))
    return placed.groupBy("source", chunk.alias("__chunk")).applyInPandas(run, schema)


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17, total: int | None = None, weights: DataFrame | None = None, planned: DataFrame | None = None) -> DataFrame:
    """doc_id, site, lang, source, tokens, copies: the mix, about ``total`` tokens (default: of all of ``sized``).

    ``sized`` has doc_id, site, lang, source, tokens; ``targets`` source, target_share, max_repeats (repeated rows count once). Documents without a target, of a null
    source or without tokens are not taken; a null site or language is a node of its own; a source without documents gives its
    share to the others. A leaf that cannot give its part leaves it to the sources of its site and language, then to the languages of its site, then to
    other sites. No document is taken more than max_repeats times. Empty tables give no rows. ``planned`` is what ``plan`` returned, if it is at hand.
    """
    keys = [f"__{t}" for t in TREE]
    named = lambda t: F.coalesce(F.col(t), F.lit(NULL)).alias(f"__{t}")
    docs = sized.where("source is not null and tokens > 0").select("doc_id", *TREE, "tokens", *[named(t) for t in TREE])
    if planned is None:
        planned = plan(sized, targets, total, weights)
    leaf_plan = planned.select(*[named(t) for t in TREE], "epochs", "rest", F.col("tokens").alias("__all")).where("epochs > 0 or rest > 0")
    docs = sized_join(docs, cut(leaf_plan), keys)
    # the order of the epoch that is cut
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    docs = docs.withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 64 - BUCKETS.bit_length() + 1).cast("int"))
    sums = docs.where("rest > 0").groupBy(*keys, "bucket").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    at = sums.withColumn("before", F.sum("tokens").over(w) - F.col("tokens")).where("before < rest").withColumn("edge", F.col("before") + F.col("tokens") > F.col("rest"))
    # per leaf the last bucket wholly inside its prefix, and the bucket where it ends
    ends = cut(at.groupBy(*keys).agg(F.max(F.when(~F.col("edge"), F.col("bucket"))).alias("last"), F.max(F.when(F.col("edge"), F.col("bucket"))).alias("edge"), F.max(F.when(F.col("edge"), F.col("before"))).alias("before")))
    joined = cut(sized_join(docs, ends, keys, "left"))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    inside = F.coalesce(F.col("bucket") <= F.col("last"), F.lit(False))
    plain = joined.where(~at_edge).select("doc_id", *TREE, "tokens", (F.col("epochs") + inside.cast("int")).alias("copies"))
    edge_w = Window.partitionBy(*keys).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edged = joined.where(at_edge).withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(edge_w), F.lit(0)))
    edged = edged.withColumn("boundary", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest")))
    boundaries = edged.where("boundary").select(*[F.col(k).alias(t) for k, t in zip(keys, TREE, strict=True)], (F.col("rest") - F.col("before")).alias("lack"), "tokens")
    over = _rounded(boundaries, TREE).toDF(*keys, "over")
    edged = edged.join(over, keys, "left")
    extra = F.when(F.col("boundary"), F.col("over")).otherwise(F.col("before") + F.col("tokens") <= F.col("rest")).cast("int")
    taken = plain.unionByName(edged.select("doc_id", *TREE, "tokens", (F.col("epochs") + extra).alias("copies")))
    return taken.where("copies > 0")


def report(mixed: DataFrame, sized: DataFrame, targets: DataFrame, planned: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, available_tokens, planned_tokens, mixed_documents, mixed_tokens, actual_share: what the mix reached, a row per target."""
    available = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    wanted = planned.groupBy("source").agg(F.round(F.sum("part")).cast("long").alias("planned_tokens"))
    reached = mixed.groupBy("source").agg(F.sum("copies").alias("mixed_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    total = reached.agg(F.sum("mixed_tokens").alias("total"))
    out = reduce(lambda a, b: a.join(b, "source", "left"), [available, wanted, reached], targets.select("source", "target_share", "max_repeats").distinct())
    out = out.join(F.broadcast(total), F.lit(True), "left")
    zero = ["documents", "available_tokens", "planned_tokens", "mixed_documents", "mixed_tokens"]
    return out.fillna(0, zero).select("source", "target_share", "max_repeats", *zero, F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))

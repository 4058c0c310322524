"""Directed graphs of a supply chain: levels, ancestors, propagation of estimates.

edges: source, target, retention, link (confidence). Nodes are longs. All loops are
over levels or distances, each a join and an aggregation on executors; every round
is a written table, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.storage import drop_written, written


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes; missing retention is 1, missing confidence 0.5; of repeated ones the largest stays."""
    ends = nodes.select("node")
    inside = edges.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi")
    best = inside.groupBy("source", "target").agg(F.max(F.struct(F.coalesce("retention", F.lit(1.0)).alias("r"), F.coalesce("link", F.lit(0.5)).alias("l"))).alias("b"))
    return best.select("source", "target", F.col("b.r").alias("retention"), F.col("b.l").alias("link"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: the longest way from a source; null for nodes on a cycle or behind one.

    Sources are peeled off round by round: a node leaves once all its predecessors have.
    """
    left, open_edges = written(nodes.select("node").distinct(), "open"), written(edges.select("source", "target").distinct(), "open-edges")
    done, level = None, 0
    while True:
        ready = left.join(open_edges.select(F.col("target").alias("node")), "node", "left_anti")
        ready = written(ready.select("node", F.lit(level).alias("level")), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left2 = written(left.join(ready, "node", "left_anti").select("node"), "open")
        edges2 = written(open_edges.join(ready.select(F.col("node").alias("source")), "source", "left_anti").select("source", "target"), "open-edges")
        drop_written(left)
        drop_written(open_edges)
        left, open_edges, level = left2, edges2, level + 1
    rest = left.select("node", F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.unionByName(rest)


def ancestors(edges: DataFrame, node: int, depth: int | None = None) -> DataFrame:
    """node, distance: all nodes from which a way of at most depth edges leads here; cycles end the walk."""
    spark = edges.sparkSession
    seen = written(spark.createDataFrame([(node, 0)], "node long, distance int"), "seen")
    front, step = seen, 0
    while depth is None or step < depth:
        step += 1
        found = edges.join(front.select(F.col("node").alias("target")), "target").select(F.col("source").alias("node")).distinct()
        front = written(found.join(seen, "node", "left_anti").select("node", F.lit(step).alias("distance")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # a table a step, none of them written twice
    return seen.where("distance > 0")


def upstream(edges: DataFrame, node: int, depth: int | None = None) -> DataFrame:
    """The edges, with all their columns, among a node and its ancestors of at most depth steps."""
    inside = ancestors(edges, node, depth).select("node").unionByName(edges.sparkSession.createDataFrame([(node,)], "node long"))
    return edges.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").join(inside.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def brand_estimates(estimates: DataFrame) -> DataFrame:
    """node, estimate, confidence with inference_type and label of propagated estimates."""
    kind = F.when(F.col("source") == "measured", "direct_test").when(F.col("source").isin("propagated", "mixed"), F.col("source")).otherwise("insufficient_data")
    label = F.when(F.col("source") == "measured", "Tested: based on direct enforcement records").otherwise("Inferred from supply chain data, no direct test on this product")
    return estimates.select("node", "estimate", "confidence", kind.alias("inference_type"), label.alias("label"))


#: The most that a node's own tests weigh against its predecessors, what each test adds to that, and to the confidence.
OWN_MOST, OWN_EACH, SURE_EACH = 0.30, 0.03, 0.05


def propagate(nodes: DataFrame, edges: DataFrame, cap: float = 0.60, blend: bool = False) -> DataFrame:
    """node, estimate, confidence, source (measured, propagated, mixed or none).

    nodes: node, measured (mean, null if none), n_tests. A measured node keeps its
    mean with confidence min(0.90, cap + 0.03 * min(10, n)). Others take the mean of
    their predecessors' estimate times retention, weighed by confidence times link
    confidence, and the mean of those weights, at most cap. With a cycle anywhere
    no node gets an estimate.

    blend: a measured node with estimated predecessors is mixed: its own mean weighs
    min(OWN_MOST, OWN_EACH * n), their mean the rest, and its confidence is theirs
    plus SURE_EACH * n, at most 0.90.
    """
    level = written(levels(nodes, edges), "levels")
    sure = (F.col("n_tests") > 0) & F.col("measured").isNotNull()
    belief = F.least(F.lit(0.90), F.lit(cap) + 0.03 * F.least(F.lit(10), F.col("n_tests")))
    if not level.where("level is null").isEmpty():
        return nodes.select("node", F.lit(None).cast("double").alias("estimate"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source"))
    ready = written(nodes.join(level, "node"), "leveled")
    top = ready.agg(F.max("level")).first()[0]
    done = None
    for k in range((top if top is not None else -1) + 1):
        own = ready.where(F.col("level") == k)
        measured = own.where(sure).select("node", F.col("measured").alias("estimate"), belief.alias("confidence"), F.lit("measured").alias("source"))
        if done is None:
            rest = own.where(F.coalesce(~sure, F.lit(True))).select("node", F.lit(None).cast("double").alias("estimate"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source"))
        else:
            before = done.where("estimate is not null").select(F.col("node").alias("source"), "estimate", "confidence")
            weight = F.col("confidence") * F.col("link")
            into = edges.join(before, "source").groupBy(F.col("target").alias("node")).agg(
                F.sum(F.col("estimate") * F.col("retention") * weight).alias("pull"), F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("k")
            )
            has = F.coalesce(F.col("weight") > 0, F.lit(False))
            if blend:
                met = own.where(sure).select("node", "measured", "n_tests", belief.alias("belief")).join(into, "node", "left")
                share = F.least(F.lit(OWN_MOST), OWN_EACH * F.col("n_tests"))
                measured = met.select(
                    "node",
                    F.when(has, (1 - share) * F.col("pull") / F.col("weight") + share * F.col("measured")).otherwise(F.col("measured")).alias("estimate"),
                    F.when(has, F.least(F.lit(0.90), F.col("weight") / F.col("k") + SURE_EACH * F.col("n_tests"))).otherwise(F.col("belief")).alias("confidence"),
                    F.when(has, F.lit("mixed")).otherwise(F.lit("measured")).alias("source"),
                )
            open_ = own.where(F.coalesce(~sure, F.lit(True))).select("node").join(into, "node", "left")
            rest = open_.select(
                "node",
                F.when(has, F.col("pull") / F.col("weight")).alias("estimate"),
                F.when(has, F.least(F.lit(cap), F.col("weight") / F.col("k"))).otherwise(F.lit(0.0)).alias("confidence"),
                F.when(has, F.lit("propagated")).otherwise(F.lit("none")).alias("source"),
            )
        now = written(measured.unionByName(rest), f"level{k}")
        done = now if done is None else done.unionByName(now)
    return done if done is not None else nodes.select("node", F.lit(None).cast("double").alias("estimate"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source"))

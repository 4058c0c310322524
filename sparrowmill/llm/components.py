"""Connected components of a table of links, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.storage import drop_written, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each linked node with the smallest node of its component.

    links holds longs in columns a and b, in any direction, repeats allowed; links
    with a null end count for nothing. Each round draws a random rank for every node;
    a node moves to the lowest-ranked one among itself and its neighbours, then to
    where that one moved, twice over. Links then join what their ends moved to, so the
    graph shrinks by a factor a round, however its nodes are numbered: a path of
    n nodes takes about log(n) rounds. Moves are stored a table a round and
    composed from the last, smallest one back.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges, moves = written(both.union(both.select("b", "a")).distinct(), "edges"), []
    while not edges.isEmpty():
        rank = lambda node, k=len(moves): F.struct(F.xxhash64(node, F.lit(k)).alias("h"), F.col(node).alias("n"))
        step = edges.groupBy("a").agg(F.min(rank("b")).alias("m")).withColumn("r", rank("a")).select(F.col("a").alias("node"), F.least("m", "r")["n"].alias("to"))
        step = written(step, "step")
        once = step.alias("s").join(step.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        once = written(once, "step")
        twice = once.join(once.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        move = written(twice, "move")
        drop_written(step)
        drop_written(once)
        moves.append(move)
        ends = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        smaller = written(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        drop_written(edges)
        edges = smaller
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = moves.pop().select("node", F.col("to").alias("root"))
    while moves:
        first = moves.pop().alias("f").join(last.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        last = written(first, "roots")
    least = written(last.groupBy("root").agg(F.min(F.least("node", "root")).alias("least")), "least")
    return last.join(least, "root").select("node", F.col("least").alias("root"))

"""Connected components of a link table, entirely in DataFrames.

Rounds alternate two rewritings of the edge list: every node hands its larger
neighbours, then its smaller ones, to the smallest node it knows.  Stars are the
fixed point.  A round is two grouped minima (combined before the shuffle) and two
equi-joins.  The minima are written to the shared folder before they are joined: then
both sides of a join are plain exchanges, whose hot partitions Spark splits, and a hub
with millions of neighbours needs no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _to_larger(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _to_smaller(edges: DataFrame) -> DataFrame:
    edges = cut(edges)
    least = cut(edges.groupBy("b").agg(F.min("a").alias("m")))
    seen = edges.join(least, "b")
    moved = seen.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.unionByName(own).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest member.

    Links may repeat, run either way or join a node to itself; null ends are no links.
    ``max_rounds`` only guards against an endless loop: reaching it raises.
    """
    edges = cut(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")
        ).first()
        if state["n"] == 0 or (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
        edges = cut(_to_smaller(_to_larger(edges)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    child = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    root = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return child.unionByName(root)

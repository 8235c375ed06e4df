"""Connected components of an edge list, without gathering nodes or edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, release

#: Rounds after which an unfinished run is an error; each halves the distance to the roots at least.
MOST_ROUNDS = 40


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (a, b) in both directions."""
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node joins its larger (or its smaller) neighbours to its least neighbour.

    The least neighbour of a node is a grouped minimum; it comes back to the node's edges in a join that splits hubs.
    """
    rows = both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = rows.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = rows.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Alternates large and small stars until the edges stay as they are: then every component is a star on its least
    node. Loops and nulls are left out; no edges give no rows.
    """
    now = materialize(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges")
    seal = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seal or not state[0]:
            break
        seal, before = tuple(state), now
        now = materialize(star(star(now, True), False), "edges")
        release(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

"""Connected components of an edge table, without collecting nodes or links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import cut

#: Pointer jumps in a round: chains of parents become eight times shorter.
JUMPS = 3


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round points every node at its smallest neighbour, if that is smaller (an aggregate, so a node with
    many links is pre-aggregated before the shuffle), jumps along these pointers and contracts the edges to
    where they point: edges within a contracted group go, and most of the graph with them. The smallest
    node of a component always points at itself, so it is what remains. Rounds are tables of the shared
    folder. Self links, repeated links and links with a null end add nothing; an empty table gives none.
    """
    def one_way(e: DataFrame) -> DataFrame:
        return e.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    e, maps = cut(one_way(edges.select("a", "b")), f"{label}-edges"), []
    while True:
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("low")), F.struct(F.col("b").alias("node"), F.col("a").alias("low")))).alias("s")).select("s.*")
        points = cut(both.groupBy("node").agg(F.min("low").alias("to")), f"{label}-pointers")
        jumped = points
        for _ in range(JUMPS):
            jumped = jumped.join(points.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        jumped = cut(jumped, label)
        maps.append(jumped)
        ends = [jumped.select(F.col("node").alias(n), F.col("to").alias(f"{n}_to")) for n in "ab"]
        e = cut(one_way(e.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))), f"{label}-edges")
        if not e.take(1):
            break

    def followed(found: DataFrame, later: DataFrame) -> DataFrame:
        step = later.select(F.col("node").alias("component"), F.col("to").alias("__to"))
        return found.join(step, "component", "left").select("node", F.coalesce("__to", "component").alias("component"))

    return reduce(followed, maps[1:], maps[0].withColumnRenamed("to", "component"))

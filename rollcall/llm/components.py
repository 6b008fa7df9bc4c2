"""Connected components of a link table by alternating star contraction, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import stored


def _to_least(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v), v a neighbour of u: each v and u itself linked to the least of u's neighbourhood.

    The minimum is combined on the map side, and a node with many neighbours
    meets its one minimum row in a join whose large partitions Spark may split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("c"))


def components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): every node of the links with the least node it is connected to.

    Alternates large-star and small-star steps until the links no longer
    change; each round is written to the checkpoint folder.  Rounds grow with the logarithm of the
    number of nodes, whatever the shape of a component.  Links with a null end
    and links of a node to itself join nothing.
    """
    edges = stored(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
                .filter(F.col("x") > F.col("y")).distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(
            edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
        large = _to_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("x"), F.col("m").alias("y"))
        small = _to_least(large.distinct().select(F.col("x").alias("u"), F.col("y").alias("v")))
        edges = stored(small.select(F.explode(F.array(
            F.struct(F.col("v").alias("x"), F.col("m").alias("y")),
            F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e"))
            .select("e.*").filter(F.col("x") > F.col("y")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")),
                        F.sum(F.xxhash64("y", "x").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return nodes.union(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())

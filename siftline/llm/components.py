"""Connected components and the pairs of each, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.sources.shared import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Alternating large-star and small-star steps over a written edge table, so the
    number of rounds is logarithmic in the size of a component and no component
    gathers in one task: each step is an aggregation by node and a join.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "edges")
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node move to the least of its neighbourhood
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # small star: a node and its lower neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where(F.col("u") != F.col("v")).distinct()
        e = materialize(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not found after {most_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def pairs_of_groups(members: DataFrame, group: list[str], id: str, *, block: int = 2000) -> DataFrame:
    """All pairs (id_a < id_b) within each group; a large group is met in blocks, each block pair in its own key."""
    m = members.select(*group, F.col(id).alias("_id")).distinct()
    size = m.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    m = m.join(size, group).withColumn("_k", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))
    left = m.select(*group, F.col("_id").alias("a"), F.col("_k").alias("_ka"), F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_kb"))
    right = m.select(*group, F.col("_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_ka"), F.col("_k").alias("_kb"))
    return left.join(right, [*group, "_ka", "_kb"]).where(F.col("a") < F.col("b")).select(*group, F.col("a").alias("id_a"), F.col("b").alias("id_b"))

"""Connected components of an edge list by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize


def _to_roots(up: DataFrame, most_jumps: int) -> DataFrame:
    """(node, up) with every pointer led to the end of its chain, by pointer jumping: chains halve with each jump."""
    for _ in range(most_jumps):
        ahead = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        step = materialize(up.join(ahead, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "cc-up")
        up = step.select("node", "up")
        if step.filter("moved").isEmpty():
            return up
    raise RuntimeError(f"chains do not end after {most_jumps} jumps")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    In each round every node that has a lesser neighbour points to the least one; pointers are followed to their ends,
    which are at most half of the nodes; edges are drawn between the ends, and those within one end are dropped. So an
    edge list is joined once, and what is left of it soon is small. The rounds' pointers are put together backwards.
    Each round's tables are written to the shared folder, which keeps plans short and survives lost executors. Hubs are
    combined before they are shuffled, or lie on a side of a join that adaptive execution can split.
    """
    def between(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = materialize(between(edges.select("a", "b")), "cc-edges")
    kind = left.schema["a"].dataType
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        if len(rounds) >= most_rounds:
            raise RuntimeError(f"edges are left after {most_rounds} rounds")
        up = materialize(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "cc-up")
        up = _to_roots(up, 64)
        rounds.append(up)
        low = up.select(F.col("node").alias("a"), F.col("up").alias("low"))
        high = up.select(F.col("node").alias("b"), F.col("up").alias("high"))
        drawn = left.join(low, "a", "left").select(F.coalesce("low", "a").alias("a"), "b").join(high, "b").select("a", F.col("high").alias("b"))
        left = materialize(between(drawn), "cc-edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").cast(kind).alias("root"))
    found = rounds[-1].select("node", F.col("up").alias("root"))
    for up in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("up"), "root")
        found = up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")).unionByName(found)
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return materialize(found.unionByName(roots), "cc-roots")

"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwatch.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b): the smallest id reachable.

    Each round every id hooks onto its smallest neighbour, chains of hooks are shortened twice, and the edges between
    the ids hooked onto remain: at least half of the ids with edges go. A hub is combined on the map side, and joins
    on it can be split. Only a flag per round comes to the driver. Null ends and loops are no edges.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # least and greatest skip nulls, so an edge with a null end has become a loop.
    edges = stored(pairs.where(F.col("a") < F.col("b")).distinct(), "edges")
    result = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up"))
        hooks = stored(hooks.select("id", F.least("id", "up").alias("up")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up").select("id", F.col("top").alias("up"))
        hooks = stored(hooks, "hooks")
        if result is None:
            result = hooks.select("id", F.col("up").alias("component"))
        else:
            above = hooks.select(F.col("id").alias("component"), F.col("up").alias("top"))
            result = result.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
            result = stored(result, "components")
        ends = [hooks.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b")
        moved = moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        edges = stored(moved.where(F.col("a") < F.col("b")).distinct(), "edges")
    return result if result is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))

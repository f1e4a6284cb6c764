"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecourt.workspace import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (columns ``a`` and ``b``, bigint).

    Nodes of one component share ``root``, which is one of them.  In each round every node
    moves to the neighbour (or itself) that comes first in an order drawn anew for the
    round, and the graph between the new places is what remains; a path or a star of any
    size loses a fixed share of its nodes each time.  Minima are combined in each task, so a
    node with very many neighbours is no hot spot.  Every round is written to the shared
    folder, so a lost executor costs no earlier round.  NULL ends are passed over.
    """
    spark = edges.sparkSession
    edges = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "edges",
    )
    moved: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda node: F.xxhash64(node, F.lit(turn))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(order(F.col("b")).alias("rank"), F.col("b").alias("to")))
        best = both.groupBy(F.col("a").alias("node")).agg(first.alias("best"))
        nearer = F.col("best.rank") < order(F.col("node"))
        place = stored(
            best.select("node", F.when(nearer, F.col("best.to")).otherwise(F.col("node")).alias("to")),
            "places",
        )
        if moved is None:
            moved = place.select("node", F.col("to").alias("root"))
        else:
            step = place.select(F.col("node").alias("root"), "to")
            moved = moved.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            moved = stored(moved, "moved")
        left = place.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        right = place.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        edges = stored(
            edges.join(left, "a")
            .join(right, "b")
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
    if moved is None:
        return spark.createDataFrame([], "node bigint, root bigint")
    return moved

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.runtime import cut, discard


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link with the smallest node it is connected to.

    Rounds of contraction: every node moves to its smallest neighbour if that is smaller, all
    ways are followed to their end, and the links go on between the ends. Of two linked nodes
    one vanishes, so the links at least halve their nodes in a round. Nodes may be of any type
    that has an order. Links with a null end or from a node to itself are left out.

    A node with very many links costs one row a task, since minima are taken before the
    shuffle. Every round is written to the shared folder, and the one before is deleted.
    """
    rest = cut(
        links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    ends = rest.select(F.col("u").alias("node")).union(rest.select("v")).distinct()
    placed = cut(ends.select("node", F.col("node").alias("component")))
    while not rest.isEmpty():
        moves = _followed(cut(rest.groupBy("u").agg(F.min("v").alias("to"))))
        further = cut(
            placed.join(moves.withColumnRenamed("u", "component"), "component", "left")
            .select("node", F.coalesce("to", "component").alias("component"))
        )
        fewer = cut(
            rest.join(moves, "u")
            .select("to", "v").withColumnRenamed("to", "x")
            .join(moves.withColumnRenamed("u", "v"), "v", "left")
            .select("x", F.coalesce("to", "v").alias("y"))
            .filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        )
        discard(placed, rest, moves)
        placed, rest = further, fewer
    discard(rest)
    return placed


def _followed(moves: DataFrame) -> DataFrame:
    """(u, to) with every way followed to its end, twice as far each time."""
    while True:
        on = moves.select(F.col("u").alias("to"), F.col("to").alias("_next"))
        further = cut(moves.join(on, "to", "left").select(
            "u", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_went")))
        discard(moves)
        went = not further.filter("_went").isEmpty()
        at, moves = further._cut_at, further.drop("_went")
        moves._cut_at = at
        if not went:
            return moves

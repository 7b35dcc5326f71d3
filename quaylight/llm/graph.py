"""Connected components by alternating stars over DataFrames; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node on the least node of its neighbourhood.

    A node is grouped only for its least neighbour, which is summed before the shuffle; no list of neighbours is
    built, so the centre of a star may have any number of them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    joined = both.join(least, both["a"] == least["node"])
    if large:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return hung.where("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """``links`` (a long, b long), in any direction and number → (node, root), root the least node reachable.

    Only nodes with a link to another one appear. Nulls take no part. Each round is written to the shared folder.
    Returns the table and its path, for discard().
    """
    spark = links.sparkSession
    flat = links.where("a is not null and b is not null and a <> b")
    edges, path = materialize(flat.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        new, new_path = materialize(_stars(_stars(edges, large=True), large=False), "links")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(spark, [path])
        edges, path = new, new_path
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")), path
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components of a link table, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.llm._spark import counted

#: Links in a partition, as the number of partitions follows the links that are left.
ROWS = 250_000
#: Links whose minima are broadcast at most.
FEW = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node that has a link, with the smallest node it can reach.

    ``links`` has two long columns, ``a`` and ``b``; loops, repeats and either direction are allowed, nulls
    are not. Every round moves each node's larger neighbours to its smallest one (large star), then its
    smaller ones (small star). Minima are partial aggregates and a hub's rows meet its minimum in a join that
    adaptive execution can split, so no node's neighbours are ever collected. A round runs in as many partitions as its links
    fill, without further shuffles, so few links write few files; up to ``FEW`` links run in one partition, their minima
    are broadcast and nothing is shuffled. An empty table gives an empty one.
    """
    stars = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
        .distinct()
    )
    mark = {"h": F.sum(F.xxhash64("big", "small").cast("decimal(20,0)"))}
    stars, found = counted(stars, **mark)
    seen = None
    while found["n"] and found != seen:
        seen = found
        few, parts = found["n"] <= FEW, -(-found["n"] // ROWS)
        stars = stars.coalesce(parts)

        def small(table: DataFrame) -> DataFrame:
            return F.broadcast(table) if few else table

        # large star: every larger neighbour of a node goes to the node's smallest neighbour (itself included)
        both = (
            stars.select(F.col("small").alias("centre"), F.col("small").alias("low"))
            .union(stars.select(F.col("big").alias("centre"), F.col("small").alias("low")))
        )
        lowest = (both.coalesce(1) if few else both).groupBy("centre").agg(F.min("low").alias("low"))
        wide = stars.join(small(lowest), stars["small"] == lowest["centre"]).select("big", F.col("low").alias("small")).distinct().coalesce(parts)
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        least = wide.groupBy(F.col("big").alias("centre")).agg(F.min("small").alias("low"))
        met = wide.join(small(least), wide["big"] == least["centre"])
        stars, found = counted(
            met.where("small <> low").select(F.col("small").alias("big"), F.col("low").alias("small"))
            .union(least.select(F.col("centre").alias("big"), F.col("low").alias("small")))
            .coalesce(parts).distinct().coalesce(parts), **mark
        )
    return stars.select(F.col("big").alias("node"), F.col("small").alias("root")).union(
        stars.select(F.col("small").alias("node"), F.col("small").alias("root"))
    ).distinct()

"""Running totals by order of a key inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.sources.shared import pinned

#: Different keys of a group that one task sorts at most.
LARGE = 200_000


def running(counts: DataFrame, by: list[str], key: str, sums: list[str], parts: int | None = None) -> DataFrame:
    """``counts`` (one row for each key of a group) with ``before_x`` for each x of ``sums``: its total over the group's lesser keys; 0 for the least.

    Where a group has over ``LARGE`` keys, rows are dealt by ranges of group and key into ``parts`` (default: the session's number of shuffle
    partitions): totals run inside a part, and each part begins with the totals of the group's parts before it, a row for each group and part. So no task sorts
    more than a part, whatever a group's size; both ways give the same rows. Null keys come first.
    """
    largest = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= LARGE:
        return _inside(counts, by, key, sums)
    dealt = counts.repartitionByRange(parts, *by, key) if parts else counts.repartitionByRange(*by, key)
    dealt = pinned(dealt.withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "__part").agg(*[F.sum(x).alias(f"__sum_{x}") for x in sums])
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__sum_{x}").over(ahead), F.lit(0)).alias(f"__sum_{x}") for x in sums])
    rows = _inside(dealt, [*by, "__part"], key, sums)
    same = F.col("__part") == F.col("__of_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    rows = rows.join(begins.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of_part"), *[f"__sum_{x}" for x in sums]), same)
    return rows.select(*counts.columns, *[(F.col(f"before_{x}") + F.col(f"__sum_{x}")).alias(f"before_{x}") for x in sums])


def _inside(counts: DataFrame, by: list[str], key: str, sums: list[str]) -> DataFrame:
    ahead = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"before_{x}") for x in sums])

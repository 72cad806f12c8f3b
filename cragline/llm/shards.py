"""Sharding by weighted rendezvous hashing of record keys.

Every shard draws a score for every key from a hash of both; the highest wins. A further shard can only win keys
for itself, so that one more of n shards moves about one key in n + 1 and none between the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm._spark import pinned

#: Rows numbered together on average within a shard.
RUN_ROWS = 16_384


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that draws the highest of ``-weight / ln(u)`` for the key; a null key is a key of its own.

    u lies strictly between 0 and 1 and comes from 53 bits of XXH64 (seed 42) of the key and the shard's number.
    A shard of twice the weight gets twice the keys; equal scores go to the higher number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("a shard needs a weight above 0")

    def score(number: Column, weight: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, number), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-weight / F.ln(u)).alias("score"), number.alias("shard"))

    drawn = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, i: score(i, w))
    return F.array_max(drawn)["shard"]


def sharded(docs: DataFrame, weights: list[float], extra: float = 1.0, text: str = "text", key: str = "doc_id", overhead: int = 8) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (with one more shard of weight ``extra``) of each row of ``docs``.

    size: UTF-8 bytes of the text plus ``overhead``; a null text has none and the CRC of no bytes. Rows of one key share a
    shard. Slots number a shard's rows from 0 without gaps: rows are dealt to runs by a hash, numbered in
    their run by key, and each run begins where the shard's runs before it end. Texts aren't shuffled; no shard is sorted as a whole.
    """
    text_bytes = F.coalesce(docs[text], F.lit("")).cast("binary")
    rows = pinned(docs.select(
        docs[key].cast("long").alias("key"), (F.octet_length(text_bytes) + overhead).cast("long").alias("size"), F.crc32(text_bytes).alias("crc")))
    runs = max(16, -(-rows.count() // (len(weights) * RUN_ROWS)))
    rows = rows.select("*", rendezvous(F.col("key"), weights).alias("shard"), rendezvous(F.col("key"), [*weights, extra]).alias("grown"),
                       F.pmod(F.xxhash64("key", "size", "crc"), F.lit(runs)).cast("int").alias("run"))
    counts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begins = pinned(counts.select("shard", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin")))  # a few numbers for each run
    place = Window.partitionBy("shard", "run").orderBy("key", "size", "crc")
    rows = rows.withColumn("place", F.row_number().over(place) - 1).join(begins, ["shard", "run"])
    return rows.select("key", "size", "crc", "shard", (F.col("begin") + F.col("place")).cast("long").alias("slot"), "grown").toDF(
        key, "size", "text_crc32", "shard", "slot", "grown_shard")

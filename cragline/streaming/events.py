"""Event streams: windowed metrics with watermarks, sessions, deduplication.

The same functions take a streaming or a batch DataFrame; ``latest`` runs a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ``ts`` (which may come without a zone); a batch as it is."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def windowed(rows: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and mean of ``value`` by event type in tumbling or sliding windows of ``ts``; rows later than ``late`` are dropped by a stream."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = _timed(rows, late)
    out = rows.groupBy(span, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(rows: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: rows less than ``gap`` apart."""
    rows = _timed(rows, late)
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First row of each event id."""
    return _timed(rows, late).dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])


def latest(stream: DataFrame, keys: list[str], order: str, folder: str) -> DataFrame:
    """Runs a stream over all that is there now; of each micro-batch the row of greatest ``order`` of each key goes into a Parquet table in ``folder``, a folder a batch.

    Returns the table as a stream. Rows are reduced where they lie and then by key, so what follows meets a row for each key, not for each event. A batch that runs again replaces its own folder.
    """
    others = [c for c in stream.columns if c not in keys]

    def keep(rows: DataFrame, batch: int) -> None:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("last"))
        last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in others]).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.readStream.schema(stream.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/rows")

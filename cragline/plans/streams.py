"""Queries for windows, sessions and kept routes, on the event table as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import planning
from cragline.plans.fixtures import nodes, table
from cragline.plans.graphs import COST, KNN, MISSION, knn, recursive
from cragline.plans.registry import query, r
from cragline.sources.shared import new_folder, pinned
from cragline.streaming import events, missions


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def w01_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed(table(spark, d, "events"), "1 hour").withColumn("mean", r(F.col("mean")))


@query("""SELECT s AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL '1 hour']) AS s, event_type, value FROM events) GROUP BY 1, 2""")
def w02_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed(table(spark, d, "events"), "2 hours", "1 hour").withColumn("mean", r(F.col("mean")))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def w03_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(table(spark, d, "events"), "6 hours")


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet")


@query("""SELECT start, event_type, n, mean FROM (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(max(ts)) OVER () AS last FROM events GROUP BY 1, 2)
 WHERE start + INTERVAL '1 hour' <= last - INTERVAL '10 minutes'""")
def w04_streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream into a table; windows that the watermark has not passed at its end stay open."""
    rows = missions.into_table(events.windowed(_streamed(spark, d, "events"), "1 hour"), new_folder(spark, "windows"))
    return rows.withColumn("mean", r(F.col("mean")))


#: The last event of a node sets the costs of all edges out of it; costs from the mission's start over the final ones.
REPLANNED = f"""told AS (SELECT event_id % (SELECT count(*) FROM node) AS src, max(event_id) AS seq FROM events GROUP BY 1), base AS (SELECT * FROM cost),
 now AS (SELECT b.tile, b.src, b.dst, b.cost * coalesce(1 + t.seq % 7, 1) AS cost FROM base b LEFT JOIN told t USING (src)),
 walk AS (SELECT tile, start AS node, 0.0::DOUBLE AS cost, 0 AS i FROM mission UNION ALL SELECT tile, node, min(cost), i FROM (SELECT w.tile, c.dst AS node, w.cost + c.cost AS cost, w.i + 1 AS i FROM walk w JOIN now c ON c.tile = w.tile AND c.src = w.node WHERE w.i < 24) GROUP BY tile, node, i)
 SELECT m.tile AS mission, round(min(w.cost), 6) AS cost FROM mission m JOIN walk w ON w.tile = m.tile AND w.node = m.goal GROUP BY m.tile"""


@query(recursive(f"{KNN}, {COST}, {MISSION}, {REPLANNED}", "node"))
def w05_streamed_replanning(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of cost changes to the missions of all tiles, each kept in the state store; the last route of each.

    Of each node's events in a micro-batch the last one counts, so they are reduced to it before they meet the node's edges."""
    n = nodes(spark, d)
    costs = pinned(planning.edge_costs(knn(spark, d), n))
    graphs = planning.corner_missions(n).withColumnRenamed("tile", "mission")
    edges = costs.select(F.col("tile").alias("mission"), "src", "dst", "cost").unionByName(n.select(F.col("tile").alias("mission"), F.col("id").alias("src"), "px", "py"), allowMissingColumns=True)
    total = n.agg(F.count(F.lit(1)).alias("total"))
    told = _streamed(spark, d, "events").select("event_id", "ts")
    told = told.join(F.broadcast(total)).select((F.col("event_id") % F.col("total")).alias("src"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    told = events.latest(told, ["src"], "seq", new_folder(spark, "told"))
    messages = told.join(costs.select(F.col("tile").alias("mission"), "src", "dst", F.col("cost").alias("base")), "src")
    messages = messages.select("mission", "seq", "ts", F.lit(None).cast("long").alias("node"), "src", "dst", (F.col("base") * (1 + F.col("seq") % 7)).alias("cost"))
    rows = missions.into_table(missions.kept_routes(messages, edges.join(graphs, "mission")), new_folder(spark, "routes"))
    last = rows.groupBy("mission").agg(F.max_by(F.struct("found", "cost"), "seq").alias("e")).where("e.found")
    return last.select("mission", r(F.col("e.cost")).alias("cost"))

"""Domain tables bound to the general test tables, once for Spark and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def by_tile() -> WindowSpec:
    return Window.partitionBy("tile")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(rows: DataFrame, key: str, side: int, values: dict[str, Column]) -> DataFrame:
    """Consecutive keys as places in square tiles."""
    area = side * side
    return rows.select(F.floor(F.col(key) / area).cast("long").alias("tile"), F.floor((F.col(key) % area) / side).cast("int").alias("y"), (F.col(key) % side).cast("int").alias("x"), *[c.alias(n) for n, c in values.items()])


def _tiles(rows: DataFrame, key: str, side: int, values: dict[str, Column]) -> DataFrame:
    """Consecutive keys as square tiles; only full tiles stay."""
    rows = _keyed(rows, key, side, values)
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tile"))).where(F.col("n") == side * side).drop("n")


def _tiles_sql(name: str, source: str, key: str, side: int, values: dict[str, str]) -> str:
    area = side * side
    tile = f"CAST(floor({key} / {area}) AS BIGINT)"
    return (f"{name} AS (SELECT tile, y, x, {', '.join(values)} FROM (SELECT {tile} AS tile, CAST(floor(({key} % {area}) / {side}) AS INT) AS y, CAST({key} % {side} AS INT) AS x, "
            f"{', '.join(f'{v} AS {n}' for n, v in values.items())}, count(*) OVER (PARTITION BY {tile}) AS n FROM {source}) WHERE n = {area})")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tiles (tile, y, x, v, user) of 16 by 16 from the events."""
    return _tiles(table(spark, sf_dir, "events"), "event_id", 16, {"v": F.col("value"), "user": F.col("user_id")})


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation tiles (tile, y, x, z) of 16 by 16 from the orders; pending orders are no data."""
    z = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000)
    return _tiles(table(spark, sf_dir, "orders"), "o_orderkey", 16, {"z": z})


def elevation_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile) of ``elevation``, by partial counts: without values a window would sort all of its pixels in the few partitions that keys alone fill."""
    return _keyed(table(spark, sf_dir, "orders"), "o_orderkey", 16, {}).groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 256).select("tile")


FEATURES = {"s": 2, "r": 3, "d": 4, "h": 5, "f7": 6, "alpha": 7}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes (tile, id, px, py, s, r, d, h, f7, alpha, u) from the embeddings; a tile for each label."""
    e = [F.col("embedding")[i].cast("double") for i in range(9)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("tile"), F.col("vec_id").cast("long").alias("id"), e[0].alias("px"), e[1].alias("py"),
        *[(e[i] + 0.5).alias(n) for n, i in FEATURES.items()], F.abs(e[8]).alias("u"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (tile, split, p, t, valid) from the line items."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tile"), F.col("l_linestatus").alias("split"), F.col("l_linenumber").alias("seed"), (F.col("l_extendedprice") / 110000.0).alias("p"),
        (F.col("l_quantity") / 50.0).alias("t"), (F.col("l_returnflag") != "N").alias("valid"))


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths (path, seq, x, y, risk, tier) from the events of each user."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), "ts", "event_id", F.get_json_object("props", "$.k").cast("double").alias("x"), F.col("value").alias("y"),
        ((F.col("event_id") * 37) % 100 / 100.0).alias("risk"), (F.col("event_id") % 4).cast("int").alias("tier"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("ts", "event_id"))
    return rows.select("path", seq.alias("seq"), "x", "y", "risk", "tier")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stochastic passes (id, pass, p): the 64 numbers of an embedding as passes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pass", "e"))
    return rows.select("id", "pass", (F.col("e").cast("double") + 0.5).alias("p"))


SQL = {
    "pixel": _tiles_sql("pixel", "events", "event_id", 16, {"v": "value", "usr": "user_id"}),
    "elevation": _tiles_sql("elevation", "orders", "o_orderkey", 16, {"z": "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END"}),
    "node": "node AS (SELECT CAST(label AS BIGINT) AS tile, CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) + 0.5 AS {n}" for n, i in FEATURES.items()) + ", abs(CAST(embedding[9] AS DOUBLE)) AS u FROM embeddings)",
    "score": "score AS (SELECT l_suppkey AS tile, l_linestatus AS split, l_linenumber AS seed, l_extendedprice / 110000.0 AS p, l_quantity / 50.0 AS t, l_returnflag <> 'N' AS valid FROM lineitem)",
    "waypoint": "waypoint AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x, value AS y, "
    "(event_id * 37) % 100 / 100.0 AS risk, CAST(event_id % 4 AS INT) AS tier FROM events)",
    "sample": "sample AS (SELECT vec_id AS id, i - 1 AS pass, CAST(embedding[i] AS DOUBLE) + 0.5 AS p FROM embeddings, range(1, 65) r(i))",
}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` (may itself begin with WITH) after the named domain tables."""
    tables = ", ".join(SQL[n] for n in names)
    body = sql.strip()
    return f"WITH {tables}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {tables} {body}"

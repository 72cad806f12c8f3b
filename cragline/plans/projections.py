"""Queries for scalar maps, predicates and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import hazard as hz
from cragline.operators import raster
from cragline.plans.fixtures import by_tile, elevation, nodes, pixels, samples, scores, table, with_tables
from cragline.plans.registry import query, r

W = "OVER (PARTITION BY tile)"


@query(with_tables(f"SELECT tile, y, x, round((v - min(v) {W}) / (max(v) {W} - min(v) {W} + 1e-8), 6) AS v FROM pixel", "pixel"))
def a01_minmax(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("tile", "y", "x", r(hz.minmax(F.col("v"), by_tile())).alias("v"))


@query(with_tables(f"SELECT tile, y, x, round(CASE WHEN max(v) {W} - min(v) {W} < 1e-6 THEN 0 ELSE (v - min(v) {W}) / (max(v) {W} - min(v) {W}) END, 6) AS v FROM (SELECT tile, y, x, CASE WHEN tile % 3 = 0 THEN 7.0 ELSE v END AS v FROM pixel)", "pixel"))
def a02_minmax_or_zero(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).withColumn("v", F.when(F.col("tile") % 3 == 0, F.lit(7.0)).otherwise(F.col("v")))
    return rows.select("tile", "y", "x", r(hz.minmax_or_zero(F.col("v"), by_tile())).alias("v"))


@query(with_tables(f"SELECT tile, y, x, round((v - avg(v) {W}) / (stddev_pop(v) {W} + 1e-8), 6) AS v FROM pixel", "pixel"))
def a03_zscore(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("tile", "y", "x", r(hz.zscore(F.col("v"), by_tile())).alias("v"))


@query("SELECT vec_id, CAST(3 AS INT) AS channels, round(CAST(embedding[1] AS DOUBLE), 6) AS gray, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) + CAST(embedding[3] AS DOUBLE)) / 3, 6) AS mean FROM embeddings")
def a04_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    rgb = raster.gray_to_rgb(F.col("e")[0])
    return rows.select("vec_id", F.size(rgb).alias("channels"), r(rgb[2]).alias("gray"), r(raster.rgb_to_gray(F.slice("e", 1, 3))).alias("mean"))


@query(with_tables("""SELECT tile, round(1 - avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS nodata_frac, round(avg(CASE WHEN n >= 0.95 THEN 1.0 ELSE 0.0 END), 6) AS sat_frac,
 CASE WHEN 1 - avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) > 0.10 THEN 'nodata' WHEN avg(CASE WHEN n >= 0.95 THEN 1.0 ELSE 0.0 END) > 0.30 THEN 'saturated' ELSE 'accepted' END AS verdict
 FROM (SELECT tile, z IS NOT NULL AS ok, (z - min(z) OVER (PARTITION BY tile)) / (max(z) OVER (PARTITION BY tile) - min(z) OVER (PARTITION BY tile) + 1e-8) AS n FROM elevation) GROUP BY tile""", "elevation"))
def a05_a06_tile_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = elevation(spark, d).select("tile", F.col("z").isNotNull().alias("ok"), hz.minmax(F.col("z"), by_tile()).alias("n"))
    return raster.tile_gates(rows, "tile", "ok", "n")


@query(with_tables("""SELECT tile, round(avg(CASE WHEN v - lo < 0.02 * (hi - lo + 1e-8) OR hi - v < 0.02 * (hi - lo + 1e-8) THEN 1.0 ELSE 0.0 END), 6) AS near_share,
 avg(CASE WHEN v - lo < 0.02 * (hi - lo + 1e-8) OR hi - v < 0.02 * (hi - lo + 1e-8) THEN 1.0 ELSE 0.0 END) <= 0.30 AS passes
 FROM (SELECT tile, v, min(v) OVER (PARTITION BY tile) AS lo, max(v) OVER (PARTITION BY tile) AS hi FROM pixel) GROUP BY tile""", "pixel"))
def a07_extremes_filter(spark: SparkSession, d: str) -> DataFrame:
    return raster.extremes_filter(pixels(spark, d), "tile", "v", band=0.02)


@query("SELECT o_orderkey, o_totalprice <> -9999 AS declared, CASE WHEN o_orderstatus = 'P' THEN false ELSE true END AS by_range FROM orders")
def a08_valid_mask(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "P", F.lit(-3.40282e38)).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", hz.valid(F.col("o_totalprice"), -9999.0).alias("declared"), hz.valid(raw).alias("by_range"))


@query(with_tables("SELECT tile, y, x, round(coalesce(z, avg(z) OVER (PARTITION BY tile), 0), 6) AS z FROM elevation", "elevation"))
def a09_mean_fill(spark: SparkSession, d: str) -> DataFrame:
    return elevation(spark, d).select("tile", "y", "x", r(hz.filled(F.col("z"), by_tile())).alias("z"))


LABELS_SQL = """SELECT l_orderkey, l_linenumber, round(CASE WHEN ok THEN least(greatest(greatest(least(greatest(slope / {sl}, 0), 1), least(greatest(rough / {rl}, 0), 1)), 0.05), 0.95) END, 6) AS risk,
 CASE WHEN ok AND (slope > 15 OR rough > 1) THEN 1 ELSE 0 END AS hazard FROM (SELECT l_orderkey, l_linenumber, l_quantity AS slope, l_discount * 40 AS rough, l_returnflag <> 'R' AS ok FROM lineitem)"""


def _labels(spark: SparkSession, d: str, slope_limit: float, rough_limit: float) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"), (F.col("l_discount") * 40).alias("g"), (F.col("l_returnflag") != "R").alias("ok"))
    risk = hz.risk_label(F.col("s"), F.col("g"), F.col("ok"), slope_limit, rough_limit)
    return rows.select("l_orderkey", "l_linenumber", r(risk).alias("risk"), hz.hazard_mask(F.col("s"), F.col("g"), F.col("ok")).alias("hazard"))


@query(LABELS_SQL.format(sl=30, rl=3))
def a10_a11_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d, 30.0, 3.0)


@query(LABELS_SQL.format(sl=20, rl=2))
def a12_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Stored slope and roughness labelled again under other limits."""
    return _labels(spark, d, 20.0, 2.0)


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0.05 ELSE round(value, 6) END AS risk FROM events")
def a13_cleaned(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", r(hz.cleaned(v)).alias("risk"))


@query(with_tables("""SELECT tile, id, round(hp, 6) AS h_physics, round(alpha * h + (1 - alpha) * hp, 6) AS fused, round(0.5 * h + 0.5 * hp, 6) AS fixed FROM
 (SELECT *, least(greatest(0.4 * s + 0.3 * r + 0.3 * d, 0), 1) AS hp FROM node)""", "node"))
def a14_a15_a16_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).withColumn("hp", hz.physics(F.col("s"), F.col("r"), F.col("d")))
    return rows.select("tile", "id", r(F.col("hp")).alias("h_physics"), r(hz.fused(F.col("h"), F.col("hp"), F.col("alpha"))).alias("fused"), r(hz.fused(F.col("h"), F.col("hp"), 0.5)).alias("fixed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN c < 0.25 THEN 0 WHEN c > 0.60 THEN 2 ELSE 1 END AS tier, CAST(round_even(8 + 56 * pow(least(greatest(c, 0), 1), 1.5), 0) AS INT) AS budget,
 CAST(CASE WHEN c < 0.25 THEN 5 WHEN c > 0.60 THEN least(greatest(floor(30 + (c - 0.60) / (1 - 0.60) * 20), 30), 50) ELSE 15 END AS INT) AS stepped FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS c FROM lineitem)""")
def a17_a18_a19_tier_budget(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("l_quantity") / 50
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hz.tier(c).alias("tier"), hz.budget(c).alias("budget"), hz.stepped_budget(c).alias("stepped"))


@query(with_tables("SELECT tile, id, f7 > 0.7 AS flag FROM node", "node"))
def a20_hazard_flag(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("tile", "id", hz.hazardous(F.col("f7")).alias("flag"))


@query(with_tables("SELECT tile, y, x, CAST(dense_rank() OVER (PARTITION BY tile ORDER BY usr) - 1 AS INT) AS seg FROM pixel", "pixel"))
def a21_contiguous_labels(spark: SparkSession, d: str) -> DataFrame:
    return raster.contiguous(pixels(spark, d).withColumnRenamed("user", "seg"), "tile", "seg").select("tile", "y", "x", "seg")


RISKS = ", ".join(f"({k}, '{n}', {v})" for (k, v), n in zip(hz.CLASS_RISK.items(), hz.CLASS_NAMES))


@query(f"SELECT doc_id, name, risk, risk > 0.7 AS hazardous FROM documents JOIN (VALUES {RISKS}) c(id, name, risk) ON doc_id % 8 = c.id WHERE doc_id % 7 = 0")
def a22_a23_a24_class_risk(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh crop is an original; its class has a name and a risk."""
    rows = table(spark, d, "documents").where("doc_id % 7 = 0").select("doc_id", (F.col("doc_id") % 8).cast("int").alias("c"))
    rows = rows.select("doc_id", F.get(F.array(*map(F.lit, hz.CLASS_NAMES)), F.col("c")).alias("name"), hz.class_risk(F.col("c")).alias("risk"))
    return rows.select("doc_id", "name", F.col("risk"), hz.hazardous(hz.class_name_risk(F.col("name"))).alias("hazardous"))


@query(with_tables("SELECT id, pass, round(1 / (1 + exp(-ln(q / (1 - q)) / 1.5)), 6) AS p FROM (SELECT id, pass, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM sample)", "sample"))
def a25_temperature(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("id", "pass", r(hz.cooled(F.col("p"), 1.5)).alias("p"))


@query(with_tables("""SELECT tile, id, CASE WHEN alpha < 0.5 THEN 'physics' ELSE 'cnn' END AS signal, CASE WHEN h > 0.6 THEN 'validated' WHEN h < 0.5 THEN 'limitation' ELSE 'marginal' END AS verdict,
 CASE WHEN u < 0.001 THEN '***' WHEN u < 0.01 THEN '**' WHEN u < 0.05 THEN '*' ELSE 'ns' END AS stars, printf('%.4f', round(u, 4)) AS text FROM node""", "node"))
def a26_a27_a28_labels(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("tile", "id", hz.attribution(F.col("alpha")).alias("signal"), hz.correlation_verdict(F.col("h")).alias("verdict"), hz.stars(F.col("u")).alias("stars"), F.format_string("%.4f", F.round("u", 4)).alias("text"))


@query(with_tables("SELECT tile, round(0.1 * avg(alpha * (1 - alpha)), 6) AS penalty FROM node GROUP BY tile", "node"))
def a29_alpha_regulariser(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("tile").agg(r(0.1 * F.avg(F.col("alpha") * (1 - F.col("alpha")))).alias("penalty"))


@query(with_tables("SELECT tile, 15 - y AS y, x, v FROM pixel WHERE tile % 2 = 0 UNION ALL SELECT tile, y, 15 - x, v FROM pixel WHERE tile % 2 = 1", "pixel"))
def a30_flips(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d)
    even = raster.flipped(rows.where("tile % 2 = 0"), 16, vertical=True)
    return even.union(raster.flipped(rows.where("tile % 2 = 1"), 16, vertical=False)).select("tile", "y", "x", "v")


@query(with_tables("SELECT tile, y, x, round(least(greatest((v + 0.1 - m - 0.1) * 1.2 + m + 0.1, 0), 1), 6) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY tile) AS m FROM (SELECT tile, y, x, (v - min(v) OVER (PARTITION BY tile)) / (max(v) OVER (PARTITION BY tile) - min(v) OVER (PARTITION BY tile) + 1e-8) AS v FROM pixel))", "pixel"))
def a32_brightness_contrast(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).withColumn("v", hz.minmax(F.col("v"), by_tile()))
    return rows.select("tile", "y", "x", r(raster.contrast(F.col("v") + 0.1, by_tile(), 1.2)).alias("v"))


def a33_augmented(spark: SparkSession, d: str) -> DataFrame:
    """Seeded flips, brightness, contrast and noise: one draw for each tile, the same for image and labels."""
    return raster.augmented(pixels(spark, d).withColumn("v", hz.minmax(F.col("v"), by_tile())), 16, seed=3)


query()(a33_augmented)


@query(with_tables("SELECT tile, y, x, least(CAST(floor(y / 4) AS INT), 2) AS by, least(CAST(floor(x / 4) AS INT), 2) AS bx FROM pixel", "pixel"))
def a35_block_index(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("tile", "y", "x", hz.block(F.col("y"), 4, 3).alias("by"), hz.block(F.col("x"), 4, 3).alias("bx"))


@query(with_tables("SELECT tile, split, count(*) AS n, CAST(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS predicted, CAST(sum(CASE WHEN t > 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS actual FROM score GROUP BY tile, split", "score"))
def a36_binarised(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("tile", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") > 0.5).alias("predicted"), F.count_if(hz.hazardous(F.col("t"))).alias("actual"))

"""Queries for stencils, tiling, blocks, patches and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import hazard as hz
from cragline.operators import grids, raster
from cragline.plans.fixtures import by_tile, elevation, elevation_tiles, nodes, pixels, with_tables
from cragline.plans.registry import query, r

FOLD = {"reflect": "15 - abs(15 - abs({c} + k.d{c}))", "symmetric": "CASE WHEN {c} + k.d{c} < 0 THEN -({c} + k.d{c}) - 1 WHEN {c} + k.d{c} >= 16 THEN 31 - ({c} + k.d{c}) ELSE {c} + k.d{c} END"}


def _kernel(name: str, weights: list[tuple[int, int, list[float]]]) -> str:
    columns = ", ".join(f"w{i}" for i in range(len(weights[0][2])))
    return f"{name}(dy, dx, {columns}) AS (VALUES {', '.join(f'({y}, {x}, {chr(44).join(f'CAST({w!r} AS DOUBLE)' for w in ws)})' for y, x, ws in weights)})"


def _met(kernel: str, mode: str, sums: str, source: str = "image") -> str:
    return (f"(SELECT c.tile, c.y, c.x, {sums} FROM {source} c CROSS JOIN {kernel} k JOIN {source} p ON p.tile = c.tile AND p.y = {FOLD[mode].format(c='c.y').replace('k.dc.y', 'k.dy')} "
            f"AND p.x = {FOLD[mode].format(c='c.x').replace('k.dc.x', 'k.dx')} GROUP BY c.tile, c.y, c.x)")


SOBEL = _kernel("sobel", [(i - 1, j - 1, [float(raster.SOBEL[i, j]), float(raster.SOBEL[j, i])]) for i in range(3) for j in range(3)])
BOX = _kernel("box", [(i - 3, j - 3, [1.0 / 49]) for i in range(7) for j in range(7)])
LOG = _kernel("logk", [(i - 6, j - 6, [float(raster.log_kernel()[i, j])]) for i in range(13) for j in range(13)])
IMAGE = "image AS (SELECT tile, y, x, (v - min(v) OVER (PARTITION BY tile)) / (max(v) OVER (PARTITION BY tile) - min(v) OVER (PARTITION BY tile) + 1e-8) AS v FROM pixel)"
TO_MAX = "least(greatest(g / (max(g) OVER (PARTITION BY tile) + 1e-8), 0), 1)"
S_SQL = f"s AS (SELECT tile, y, x, {TO_MAX} AS s FROM (SELECT tile, y, x, sqrt(a * a + b * b + 1e-8) AS g FROM {_met('sobel', 'reflect', 'sum(w0 * p.v) AS a, sum(w1 * p.v) AS b')}))"
R_SQL = f"r AS (SELECT tile, y, x, {TO_MAX} AS r FROM (SELECT tile, y, x, sqrt(greatest(b - a * a, 0) + 1e-8) AS g FROM {_met('box', 'reflect', 'sum(w0 * p.v) AS a, sum(w0 * p.v * p.v) AS b')}))"
D_SQL = f"d AS (SELECT tile, y, x, {TO_MAX} AS d FROM (SELECT tile, y, x, abs(a) AS g FROM {_met('logk', 'reflect', 'sum(w0 * p.v) AS a')}))"


def _image(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).withColumn("v", hz.minmax(F.col("v"), by_tile()))


@query(with_tables(f"WITH {IMAGE}, {SOBEL}, {S_SQL} SELECT tile, y, x, round(s, 6) AS slope FROM s", "pixel"))
def r01_slope_proxy(spark: SparkSession, d: str) -> DataFrame:
    return raster.stencils(_image(spark, d), ["slope"]).select("tile", "y", "x", r(F.col("slope")).alias("slope"))


@query(with_tables(f"WITH {IMAGE}, {BOX}, {R_SQL} SELECT tile, y, x, round(r, 5) AS roughness FROM r", "pixel"))
def r02_roughness_proxy(spark: SparkSession, d: str) -> DataFrame:
    return raster.stencils(_image(spark, d), ["roughness"]).select("tile", "y", "x", r(F.col("roughness"), 5).alias("roughness"))


@query(with_tables(f"WITH {IMAGE}, {LOG}, {D_SQL} SELECT tile, y, x, round(d, 6) AS discontinuity FROM d", "pixel"))
def r03_discontinuity_proxy(spark: SparkSession, d: str) -> DataFrame:
    return raster.stencils(_image(spark, d), ["discontinuity"]).select("tile", "y", "x", r(F.col("discontinuity")).alias("discontinuity"))


BUNDLE = f"{IMAGE}, {SOBEL}, {BOX}, {LOG}, {S_SQL}, {R_SQL}, {D_SQL}, bundle AS (SELECT tile, y, x, s, r, d, least(greatest(0.4 * s + 0.3 * r + 0.3 * d, 0), 1) AS h FROM s JOIN r USING (tile, y, x) JOIN d USING (tile, y, x))"


def physics_bundle(rows: DataFrame) -> DataFrame:
    """Slope, roughness and discontinuity of an image and their combination, in one pass over each tile."""
    out = raster.stencils(rows, ["slope", "roughness", "discontinuity"])
    return out.withColumn("h_physics", hz.physics(F.col("slope"), F.col("roughness"), F.col("discontinuity")))


@query(with_tables(f"WITH {BUNDLE} SELECT tile, y, x, round(h, 5) AS h_physics FROM bundle", "pixel"))
def r04_physics_bundle(spark: SparkSession, d: str) -> DataFrame:
    return physics_bundle(_image(spark, d)).select("tile", "y", "x", r(F.col("h_physics"), 5).alias("h_physics"))


FILLED = "image AS (SELECT tile, y, x, z IS NOT NULL AS ok, coalesce(z, avg(z) OVER (PARTITION BY tile), 0) AS v FROM elevation)"
GRAD = """g AS (SELECT tile, y, x, ok, v, CASE WHEN lag(v) OVER ys IS NULL THEN lead(v) OVER ys - v WHEN lead(v) OVER ys IS NULL THEN v - lag(v) OVER ys ELSE (lead(v) OVER ys - lag(v) OVER ys) / 2 END / 10 AS gy,
 CASE WHEN lag(v) OVER xs IS NULL THEN lead(v) OVER xs - v WHEN lead(v) OVER xs IS NULL THEN v - lag(v) OVER xs ELSE (lead(v) OVER xs - lag(v) OVER xs) / 2 END / 10 AS gx FROM image
 WINDOW ys AS (PARTITION BY tile, x ORDER BY y), xs AS (PARTITION BY tile, y ORDER BY x)), slope AS (SELECT tile, y, x, ok, CASE WHEN ok THEN degrees(atan(sqrt(gx * gx + gy * gy))) ELSE 0 END AS slope FROM g)"""


def filled_elevation(spark: SparkSession, d: str) -> DataFrame:
    return elevation(spark, d).select("tile", "y", "x", F.col("z").isNotNull().alias("ok"), hz.filled(F.col("z"), by_tile()).alias("v"))


@query(with_tables(f"WITH {FILLED}, {GRAD} SELECT tile, y, x, round(slope, 6) AS slope FROM slope", "elevation"))
def r05_gradient_slope(spark: SparkSession, d: str) -> DataFrame:
    rows = raster.gradient_slope(filled_elevation(spark, d), "v", 10.0)
    return rows.select("tile", "y", "x", r(F.when(F.col("ok"), F.col("slope")).otherwise(0.0)).alias("slope"))


ROUGH = f"rough AS (SELECT tile, y, x, sqrt(greatest(b - a * a, 0)) AS rough FROM {_met('box', 'symmetric', 'sum(w0 * p.v) AS a, sum(w0 * p.v * p.v) AS b')})"


@query(with_tables(f"WITH {FILLED}, {BOX}, {ROUGH} SELECT tile, y, x, round(CASE WHEN ok THEN rough ELSE 0 END, 4) AS rough FROM rough JOIN image USING (tile, y, x)", "elevation"))
def r06_local_roughness(spark: SparkSession, d: str) -> DataFrame:
    rows = filled_elevation(spark, d)
    rough = raster.stencils(rows, ["local_roughness"]).join(rows.select("tile", "y", "x", "ok"), ["tile", "y", "x"])
    return rough.select("tile", "y", "x", r(F.when(F.col("ok"), F.col("local_roughness")).otherwise(0.0), 4).alias("rough"))


@query(with_tables(f"""WITH {FILLED}, {GRAD}, {BOX}, {ROUGH}, labelled AS (SELECT tile, ok, CASE WHEN ok AND (slope > 80 OR rough > 90) THEN 1 ELSE 0 END AS hazard FROM slope JOIN rough USING (tile, y, x))
 SELECT tile, round(1 - avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS nodata_fraction, round(sum(hazard) / nullif(sum(CASE WHEN ok THEN 1 ELSE 0 END), 0), 6) AS hazardous_fraction, 1 - avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) > 0.5 AS warned
 FROM labelled GROUP BY tile""", "elevation"))
def r07_label_rasters(spark: SparkSession, d: str) -> DataFrame:
    """Elevation to slope, roughness and hazard, with the fractions a report keeps; limits fit these data's units."""
    rows = raster.gradient_slope(filled_elevation(spark, d), "v", 10.0)
    rows = rows.join(raster.stencils(rows, ["local_roughness"]), ["tile", "y", "x"])
    rows = rows.withColumn("hazard", hz.hazard_mask(F.col("slope"), F.col("local_roughness"), F.col("ok"), 80.0, 90.0))
    ok = F.avg(F.col("ok").cast("double"))
    return rows.groupBy("tile").agg(r(1 - ok).alias("nodata_fraction"), r(F.try_divide(F.sum("hazard"), F.sum(F.col("ok").cast("int")))).alias("hazardous_fraction"), (1 - ok > 0.5).alias("warned"))


@query(with_tables("""SELECT tile, ty AS y, tx AS x, v FROM (SELECT tile, unnest(CASE WHEN 30 - y BETWEEN 16 AND 19 THEN [y, 30 - y] ELSE [y] END) AS ty, x, v FROM pixel),
 LATERAL (SELECT unnest(CASE WHEN 30 - x BETWEEN 16 AND 19 THEN [x, 30 - x] ELSE [x] END) AS tx)""", "pixel"))
def r09_mirror_padding(spark: SparkSession, d: str) -> DataFrame:
    return raster.padded(pixels(spark, d), 16, 20).select("tile", "y", "x", "v")


@query(with_tables("""SELECT tile, rw AS row, cl AS col, count(*) AS n, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 20 THEN 1.0 ELSE 0.0 END), 4) AS bright FROM pixel, range(0, 3) a(rw), range(0, 3) b(cl)
 WHERE y >= rw * 4 AND y < rw * 4 + 8 AND x >= cl * 4 AND x < cl * 4 + 8 GROUP BY tile, rw, cl HAVING avg(CASE WHEN v > 20 THEN 1.0 ELSE 0.0 END) <= 0.9""", "pixel"))
def r10_sliding_tiles(spark: SparkSession, d: str) -> DataFrame:
    rows = raster.tiled(pixels(spark, d), 8, 4, 16)
    bright = F.avg((F.col("v") > 20).cast("double"))
    out = rows.groupBy("tile", "row", "col").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("mean"), bright.alias("b")).where("b <= 0.9")
    return out.select("tile", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "n", "mean", r(F.col("b"), 4).alias("bright"))


@query(with_tables("SELECT tile, CAST(floor(y / 4) AS INT) AS by, CAST(floor(x / 4) AS INT) AS bx, round(avg(v), 6) AS mean FROM pixel GROUP BY 1, 2, 3", "pixel"))
def r11_block_mean(spark: SparkSession, d: str) -> DataFrame:
    return raster.block_mean(pixels(spark, d), 4, "v", 16).select("tile", "by", "bx", r(F.col("mean")).alias("mean"))


@query(with_tables("SELECT tile, CAST(floor(y / 5) AS INT) AS by, CAST(floor(x / 5) AS INT) AS bx, round(avg(v), 6) AS mean FROM pixel WHERE y < 15 AND x < 15 GROUP BY 1, 2, 3", "pixel"))
def r12_ragged_block_mean(spark: SparkSession, d: str) -> DataFrame:
    size = max(1, round(463 / 100))
    return raster.block_mean(pixels(spark, d), size, "v", 16).select("tile", "by", "bx", r(F.col("mean")).alias("mean"))


@query(with_tables(f"""WITH {IMAGE}, {SOBEL} SELECT tile, y, x, round(g / max(g) OVER (PARTITION BY tile), 6) AS edge FROM (SELECT tile, y, x, sqrt(a * a + b * b) AS g FROM {_met('sobel', 'symmetric', 'sum(w0 * p.v) AS a, sum(w1 * p.v) AS b')})""", "pixel"))
def r13_sobel_edges(spark: SparkSession, d: str) -> DataFrame:
    return raster.stencils(_image(spark, d), ["sobel"]).select("tile", "y", "x", r(F.col("sobel")).alias("edge"))


@query(with_tables("SELECT tile, y, x, v FROM pixel", "pixel"))
def r14_patch_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return raster.unpatched(raster.patches(pixels(spark, d), 4, 16), 4, 16)


@query(with_tables("""SELECT tile, patch, place, place >= 16 - floor(16 * 0.75) AS masked FROM (SELECT tile, patch, row_number() OVER (PARTITION BY tile ORDER BY (patch * 7919 + tile * 104729) % 1009, patch) - 1 AS place
 FROM (SELECT DISTINCT tile, CAST(floor(y / 4) * 4 + floor(x / 4) AS INT) AS patch FROM pixel))""", "pixel"))
def r15_random_masking(spark: SparkSession, d: str) -> DataFrame:
    patches = raster.patches(pixels(spark, d), 4, 16).select("tile", "patch")
    out = raster.masked(patches, 0.75, (F.col("patch") * 7919 + F.col("tile") * 104729) % 1009)
    return out.select("tile", "patch", F.col("place").cast("long").alias("place"), "masked")


@query(with_tables("""SELECT tile, round(avg(dy) + avg(dx), 6) AS tv FROM (SELECT tile, abs(v - lag(v) OVER (PARTITION BY tile, x ORDER BY y)) AS dy, abs(v - lag(v) OVER (PARTITION BY tile, y ORDER BY x)) AS dx FROM pixel) GROUP BY tile""", "pixel"))
def r16_total_variation(spark: SparkSession, d: str) -> DataFrame:
    return raster.total_variation(pixels(spark, d), "v").select("tile", r(F.col("tv")).alias("tv"))


@query(with_tables("SELECT p.tile, y, x, round(m, 6) AS risk FROM pixel p JOIN (SELECT tile, usr, avg(v) AS m FROM pixel GROUP BY tile, usr) n ON p.tile = n.tile AND p.usr = n.usr", "pixel"))
def r17_project_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    """A value for each segment, back on its pixels."""
    rows = pixels(spark, d)
    means = rows.groupBy("tile", "user").agg(F.avg("v").alias("risk"))
    return rows.join(means, ["tile", "user"]).select("tile", "y", "x", r(F.col("risk")).alias("risk"))


@query(with_tables("""SELECT n.tile, n.id, round(p.v, 6) AS v FROM node n JOIN pixel p ON p.tile = n.tile AND p.y = least(greatest(CAST(floor(n.py * 100) AS INT), 0), 15) AND p.x = least(greatest(CAST(floor(n.px * 100) AS INT), 0), 15)""", "pixel", "node"))
def r18_pixel_lookup(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * 100), F.lit(0)), F.lit(15)).cast("int")
    points = nodes(spark, d).select("tile", "id", at("py").alias("y"), at("px").alias("x"))
    return points.join(pixels(spark, d), ["tile", "y", "x"]).select("tile", "id", r(F.col("v")).alias("v"))


_C, _S = math.cos(math.radians(12)), math.sin(math.radians(12))
_SY, _SX = f"round_even(7.5 + (y - 7.5) * {_C!r} - (x - 7.5) * {_S!r}, 0)", f"round_even(7.5 + (y - 7.5) * {_S!r} + (x - 7.5) * {_C!r}, 0)"


def _f(e: str) -> str:
    return f"CAST(CASE WHEN {e} < 0 THEN -{e} - 1 WHEN {e} >= 16 THEN 31 - {e} ELSE {e} END AS INT)"


@query(with_tables(f"SELECT t.tile, t.y, t.x, p.v FROM (SELECT tile, y, x, {_f('sy')} AS sy, {_f('sx')} AS sx FROM (SELECT tile, y, x, {_SY} AS sy, {_SX} AS sx FROM pixel)) t JOIN pixel p ON p.tile = t.tile AND p.y = t.sy AND p.x = t.sx", "pixel"))
def a31_rotation(spark: SparkSession, d: str) -> DataFrame:
    return raster.rotated(pixels(spark, d), 12.0, 16).select("tile", "y", "x", "v")


@query(with_tables("""SELECT tile, t.y, t.x, round(sum(v * wy * wx), 6) AS v FROM (SELECT ty.y, tx.x, ty.p AS py, ty.w AS wy, tx.p AS px, tx.w AS wx FROM
 (SELECT y, p, greatest(0, 1 - abs(least(greatest((y + 0.5) * 0.5 - 0.5, 0), 15) - p)) AS w FROM range(0, 32) a(y), range(0, 16) b(p)) ty,
 (SELECT x, p, greatest(0, 1 - abs(least(greatest((x + 0.5) * 0.5 - 0.5, 0), 15) - p)) AS w FROM range(0, 32) a(x), range(0, 16) b(p)) tx WHERE ty.w > 0 AND tx.w > 0) t
 JOIN pixel p ON p.y = t.py AND p.x = t.px GROUP BY tile, t.y, t.x""", "pixel"))
def a34_bilinear_resize(spark: SparkSession, d: str) -> DataFrame:
    return raster.resized(pixels(spark, d), 16, 32).select("tile", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r(F.col("v")).alias("v"))


@query(with_tables(f"""WITH {BUNDLE}, blocks AS (SELECT tile, CAST(floor(y / 4) AS INT) AS by, CAST(floor(x / 4) AS INT) AS bx, round(avg(h), 5) AS c FROM bundle GROUP BY 1, 2, 3)
 SELECT tile, CASE WHEN c < 0.25 THEN 0 WHEN c > 0.60 THEN 2 ELSE 1 END AS tier, count(*) AS blocks FROM blocks GROUP BY 1, 2""", "pixel"))
def flagship_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Image tiles to physics maps, block complexity and the number of blocks of each tier."""
    complexity = raster.block_mean(physics_bundle(_image(spark, d)), 4, "h_physics", 16)
    return complexity.groupBy("tile", hz.tier(F.round("mean", 5)).alias("tier")).agg(F.count(F.lit(1)).alias("blocks"))


#: Target pixels with their place in the source: other pixel sizes, offsets and, for bilinear, those of the four neighbours that hold a value.
_PLACED = """g AS (SELECT DISTINCT tile, 100.0 + tile % 7 AS s0, 50.0 AS s3, 100.0 + tile % 7 - 1.30311 AS t0, 51.17371 AS t3 FROM elevation),
 ask AS (SELECT tile, a.row, b.col, (t0 + 1.37189 * (b.col + 0.5) - s0) / 2.0 AS u, (t3 - 1.43317 * (a.row + 0.5) - s3) / -2.0 AS w FROM g, range(0, 25) a(row), range(0, 24) b(col)),"""


@query(with_tables(f"""WITH {_PLACED} near AS (SELECT q.tile, q.row, q.col, sum(z * wt) / sum(wt) AS v FROM (SELECT tile, row, col, CAST(floor(w - 0.5) AS INT) + i AS y, CAST(floor(u - 0.5) AS INT) + j AS x,
 (CASE WHEN i = 1 THEN w - 0.5 - floor(w - 0.5) ELSE 1 - (w - 0.5 - floor(w - 0.5)) END) * (CASE WHEN j = 1 THEN u - 0.5 - floor(u - 0.5) ELSE 1 - (u - 0.5 - floor(u - 0.5)) END) AS wt
 FROM ask, range(0, 2) p(i), range(0, 2) s(j) WHERE u >= 0 AND u < 16 AND w >= 0 AND w < 16) q JOIN elevation e ON e.tile = q.tile AND e.y = q.y AND e.x = q.x WHERE z IS NOT NULL AND wt > 0 GROUP BY ALL)
 SELECT tile AS raster, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(v, 6) AS v FROM ask LEFT JOIN near USING (tile, row, col)""", "elevation"))
def r08_aligned_grid(spark: SparkSession, d: str) -> DataFrame:
    """Elevation rasters (2 m pixels) on another grid of each (1.37189 m by 1.43317 m, shifted), in tiles of 8 by 8 with borrowed borders."""
    return grids.aligned(*_gridded(spark, d), "bilinear", 8).withColumn("v", r(F.col("v")))


@query(with_tables(f"""WITH {_PLACED} near AS (SELECT q.tile, q.row, q.col, z AS v FROM ask q JOIN elevation e ON e.tile = q.tile AND e.y = floor(w) AND e.x = floor(u))
 SELECT tile AS raster, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(v, 6) AS v FROM ask LEFT JOIN near USING (tile, row, col)""", "elevation"))
def r08_nearest_grid(spark: SparkSession, d: str) -> DataFrame:
    return grids.aligned(*_gridded(spark, d), "nearest", 8).withColumn("v", r(F.col("v")))


def _gridded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = elevation(spark, d)
    number = lambda x: F.lit(float(x))
    left = 100.0 + F.col("tile") % 7
    source, target = (left, number(2), number(0), number(50), number(0), number(-2)), (left - 1.30311, number(1.37189), number(0), number(51.17371), number(0), number(-1.43317))
    table = elevation_tiles(spark, d).select(F.col("tile").alias("raster"), F.lit(16).alias("height"), F.lit(16).alias("width"), *[c.alias(f"s{i}") for i, c in enumerate(source)],
                                             F.lit(25).alias("to_height"), F.lit(24).alias("to_width"), *[c.alias(f"t{i}") for i, c in enumerate(target)])
    return rows.select(F.col("tile").alias("raster"), F.col("y").alias("row"), F.col("x").alias("col"), F.col("z").alias("v")), table

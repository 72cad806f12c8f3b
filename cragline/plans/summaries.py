"""Queries for extents, summaries, parameter grids, smoothing logs and failing tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import graph as g
from cragline.operators import planning, raster
from cragline.plans.fixtures import elevation, nodes, pixels, scores, waypoints, with_tables
from cragline.plans.graphs import ATT, ATTENDED, KNN, PHYS, WEIGHTS, knn
from cragline.plans.registry import query, r


def extents(bands: dict[str, DataFrame]) -> DataFrame:
    """Height and width of each tile in each band, and whether a tile's bands agree."""
    parts = [b.groupBy("tile").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).withColumn("band", F.lit(n)) for n, b in bands.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("tile").agg(F.count(F.lit(1)).alias("bands"), ((F.min("h") == F.max("h")) & (F.min("w") == F.max("w"))).alias("agree"), F.max("h").alias("h"), F.max("w").alias("w"))


@query(with_tables("""SELECT tile, count(*) AS bands, min(h) = max(h) AND min(w) = max(w) AS agree, max(h) AS h, max(w) AS w FROM (SELECT tile, max(y) + 1 AS h, max(x) + 1 AS w FROM pixel GROUP BY tile UNION ALL SELECT tile, max(y) + 1, max(x) + 1 FROM elevation WHERE tile % 4 <> 0 OR y < 15 GROUP BY tile) GROUP BY tile""", "pixel", "elevation"))
def s05_band_extents(spark: SparkSession, d: str) -> DataFrame:
    return extents({"image": pixels(spark, d), "elevation": elevation(spark, d).where("tile % 4 <> 0 OR y < 15")})


@query(with_tables("""SELECT path, count(*) AS n_waypoints, round(sum(risk), 6) AS total, CAST(sum(CASE WHEN tier = 2 THEN 1 ELSE 0 END) AS BIGINT) AS hazardous, first_tier, last_tier FROM waypoint JOIN (SELECT path, arg_min(tier, seq) AS first_tier, arg_max(tier, seq) AS last_tier FROM waypoint GROUP BY path) USING (path) GROUP BY path, first_tier, last_tier""", "waypoint"))
def a37_route_summary(spark: SparkSession, d: str) -> DataFrame:
    """Waypoints of a path as one ordered array, and its summary."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "tier", "risk", "x", "y")))
    rows = waypoints(spark, d).groupBy("path").agg(steps.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["risk"])
    return rows.select("path", F.size("w").cast("long").alias("n_waypoints"), r(total).alias("total"), F.size(F.filter("w", lambda x: x["tier"] == 2)).cast("long").alias("hazardous"),
                       F.element_at("w", 1)["tier"].alias("first_tier"), F.element_at("w", -1)["tier"].alias("last_tier"))


@query(with_tables("SELECT name, split, round(avg(abs(p * scale - t)), 6) AS mae FROM score, (VALUES ('plain', 1.0), ('half', 0.5), ('double', 2.0)) g(name, scale) GROUP BY name, split", "score"))
def j16_j17_parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a small grid over all predictions; the grid is a literal array in each row, so nothing is joined."""
    grid = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("scale")) for n, s in (("plain", 1.0), ("half", 0.5), ("double", 2.0))])
    rows = scores(spark, d).withColumn("g", F.explode(grid))
    return rows.groupBy("g.name", "split").agg(r(F.avg(F.abs(F.col("p") * F.col("g.scale") - F.col("t")))).alias("mae"))


def _log_sql(rows: str, columns: list[str], layer: int) -> str:
    """Energy over edges, mean cosine over all pairs and mean variance of a table of nodes."""
    norm = lambda t: "greatest(sqrt(" + " + ".join(f"{t}.{c} * {t}.{c}" for c in columns) + "), 1e-12)"
    return f"""SELECT v.tile, round(coalesce(energy, 0), 6) AS energy, round(coalesce(cosine, 1), 6) AS cosine, round(variance, 6) AS variance, {layer} AS layer
 FROM (SELECT tile, ({" + ".join(f"var_samp({c})" for c in columns)}) / {len(columns)} AS variance FROM {rows} GROUP BY tile) v
 LEFT JOIN (SELECT e.tile, sum({" + ".join(f"pow(a.{c} - b.{c}, 2)" for c in columns)}) / 2 AS energy FROM edge e JOIN {rows} a ON a.tile = e.tile AND a.id = src JOIN {rows} b ON b.tile = e.tile AND b.id = dst GROUP BY e.tile) e ON e.tile = v.tile
 LEFT JOIN (SELECT a.tile, avg(({" + ".join(f"a.{c} * b.{c}" for c in columns)}) / {norm("a")} / {norm("b")}) AS cosine FROM {rows} a JOIN {rows} b ON a.tile = b.tile AND a.id <> b.id GROUP BY a.tile) c ON c.tile = v.tile"""


HEADS = "heads AS (SELECT tile, id, " + ", ".join(f"max(CASE WHEN head = {h} THEN c{c} END) AS h{h}{c}" for h in (0, 1) for c in (0, 1)) + " FROM attended GROUP BY tile, id)"


@query(with_tables(f"WITH {KNN}, {ATTENDED}, {HEADS} {_log_sql('node', PHYS, 0)} UNION ALL {_log_sql('heads', ['h00', 'h01', 'h10', 'h11'], 1)}", "node"))
def h16_smoothing_log(spark: SparkSession, d: str) -> DataFrame:
    """Dirichlet energy, mean cosine and variance of the inputs and of the attention layer's outputs, by tile."""
    n, e = nodes(spark, d), knn(spark, d)
    out = g.attention(n, e, PHYS, WEIGHTS, ATT, ["s", "r"], 0.1).groupBy("tile", "id").pivot("head", [0, 1]).agg(F.first("c0").alias("c0"), F.first("c1").alias("c1"))
    logs = []
    for layer, (rows, columns) in enumerate(((n, PHYS), (out, ["0_c0", "0_c1", "1_c0", "1_c1"]))):
        variance = rows.groupBy("tile").agg((sum((F.var_samp(c) for c in columns), F.lit(0.0)) / len(columns)).alias("variance"))
        rows = g.dirichlet_energy(rows, e, columns).join(g.mean_cosine(rows, columns), "tile").join(variance, "tile")
        logs.append(rows.withColumn("layer", F.lit(layer)))
    return logs[0].union(logs[1]).select("tile", *[r(F.col(c)).alias(c) for c in ("energy", "cosine", "variance")], "layer")


def applied(rows: DataFrame, run, names: list[str]) -> DataFrame:
    """``run`` (an image to a list of numbers) on each tile's ``v``; a tile on which it fails gives a row with its error instead of ending the job."""
    def step(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        image = np.full((y.max() + 1, x.max() + 1), np.nan)
        image[y, x] = table["v"].to_numpy(zero_copy_only=False)
        try:
            values, error = [float(v) for v in run(image)], None
        except Exception as e:  # any failure of a tile is data here
            values, error = [None] * len(names), f"{type(e).__name__}: {e}"
        return pa.table([pa.array([table["tile"][0].as_py()]), *(pa.array([v], pa.float64()) for v in values), pa.array([error], pa.string())], names=["tile", *names, "error"])

    return rows.select("tile", "y", "x", "v").groupBy("tile").applyInArrow(step, "tile long, " + ", ".join(f"{n} double" for n in names) + ", error string")


def _slope_or_refuse(image: np.ndarray) -> list[float]:
    if np.isnan(image).mean() > 0.3:
        raise ValueError("too little data")
    return [np.nanmean(image), float(np.nanmax(raster.slope_proxy(np.nan_to_num(image))))]


@query(with_tables("SELECT tile, CASE WHEN avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0.0 END) > 0.3 THEN NULL ELSE round(avg(z), 6) END AS mean, CASE WHEN avg(CASE WHEN z IS NULL THEN 1.0 ELSE 0.0 END) > 0.3 THEN 'ValueError: too little data' END AS error FROM elevation GROUP BY tile", "elevation"))
def o02_error_rows(spark: SparkSession, d: str) -> DataFrame:
    out = applied(elevation(spark, d).withColumnRenamed("z", "v"), _slope_or_refuse, ["mean", "steepest"])
    return out.select("tile", r(F.col("mean")).alias("mean"), "error")


@query(with_tables("""WITH box AS (SELECT tile, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM node GROUP BY tile), ends AS (SELECT tile, 0 AS point, x0 + 0.1 * (x1 - x0) AS x, y0 + 0.1 * (y1 - y0) AS y FROM box UNION ALL SELECT tile, 1, x0 + 0.9 * (x1 - x0), y0 + 0.9 * (y1 - y0) FROM box)
 SELECT tile, point, arg_min(id, (round(pow(px - x, 2) + pow(py - y, 2), 12), id)) AS id FROM node JOIN ends USING (tile) GROUP BY tile, point""", "node"))
def o08_demo_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Start and goal nearest to a tenth and nine tenths of a tile's extent."""
    n = nodes(spark, d)
    box = n.groupBy("tile").agg(*[f(c).alias(f"{k}{c}") for c in ("px", "py") for k, f in (("a", F.min), ("b", F.max))])
    at = lambda c, s: F.col(f"a{c}") + s * (F.col(f"b{c}") - F.col(f"a{c}"))
    points = box.select("tile", F.explode(F.array(*[F.struct(F.lit(i).alias("point"), at("px", s).alias("x"), at("py", s).alias("y")) for i, s in enumerate((0.1, 0.9))])).alias("p"))
    return planning.nearest_node(n, points.select("tile", "p.*"))

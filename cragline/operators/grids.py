"""Rasters resampled onto another affine grid, tile by tile with borrowed borders.

A geotransform is six numbers g0 to g5: x = g0 + g1 col + g2 row, y = g3 + g4 col + g5 row at a pixel's outer corner. Each target pixel's centre
is put through the inverse of its raster's source transform; target pixels belong to the tile of their first source neighbour, and of a source tile only its
first row, column and corner are also sent, to the tiles before it. So every source pixel moves once or (on such an edge) a few times. Target pixels don't move: a
tile gets its raster's transforms and finds its own among those around it, and pixels outside the source come from the transforms where they lie. No group is more than a tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["raster", "ty", "tx"]


#: Target pixels that a tile tries at once.
TRIED = 1 << 20
NUMBERS = ["height", "width", *(f"s{i}" for i in range(6)), "to_height", "to_width", *(f"t{i}" for i in range(6))]


def source_place(g: Callable[[str], Column | float], row: Column | np.ndarray, col: Column | np.ndarray) -> tuple[Column, Column] | tuple[np.ndarray, np.ndarray]:
    """Row and column in the source of a target pixel's centre, counted from outer corners; ``g`` gives t0 to t5 and s0 to s5. The same steps for columns and arrays."""
    x = g("t0") + g("t1") * (col + 0.5) + g("t2") * (row + 0.5) - g("s0")
    y = g("t3") + g("t4") * (col + 0.5) + g("t5") * (row + 0.5) - g("s3")
    below = g("s1") * g("s5") - g("s2") * g("s4")
    return (y * g("s1") - x * g("s4")) / below, (x * g("s5") - y * g("s2")) / below


def _window(g: dict[str, float], low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int, int, int]:
    """First and last (one beyond) row and column of the target pixels that can lie between two places of the source, with a margin; all where the target has no inverse."""
    rows, cols = int(g["to_height"]), int(g["to_width"])
    across = g["t1"] * g["t5"] - g["t2"] * g["t4"]
    r, c = np.array([low[0], low[0], high[0], high[0]]) + [-1.0, -1.0, 1.0, 1.0], np.array([low[1], high[1], low[1], high[1]]) + [-1.0, 1.0, -1.0, 1.0]
    x, y = g["s0"] + g["s1"] * c + g["s2"] * r - g["t0"], g["s3"] + g["s4"] * c + g["s5"] * r - g["t3"]
    with np.errstate(all="ignore"):
        row, col = (y * g["t1"] - x * g["t4"]) / across, (x * g["t5"] - y * g["t2"]) / across
    if not (np.isfinite(row).all() and np.isfinite(col).all()):
        return 0, rows, 0, cols
    bound = lambda at, most: (int(np.clip(np.floor(at.min()) - 2, 0, most)), int(np.clip(np.ceil(at.max()) + 2, 0, most)))
    return *bound(row, rows), *bound(col, cols)


def _asked(g: dict[str, float], ty: int, tx: int, tile: int, smooth: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and place in the source of a tile's target pixels."""
    first_row, last_row, first_col, last_col = _window(g, (ty * tile, tx * tile), ((ty + 1) * tile, (tx + 1) * tile))
    wide = max(last_col - first_col, 1)
    found = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0))]
    first = lambda at: np.maximum(np.floor(at - (0.5 if smooth else 0.0)), 0) // tile
    for start in range(first_row, last_row, max(TRIED // wide, 1)):
        row, col = np.meshgrid(np.arange(start, min(start + max(TRIED // wide, 1), last_row), dtype=np.int32), np.arange(first_col, last_col, dtype=np.int32), indexing="ij")
        row, col = row.ravel(), col.ravel()
        at_row, at_col = source_place(g.__getitem__, row, col)
        own = (at_row >= 0) & (at_row < g["height"]) & (at_col >= 0) & (at_col < g["width"]) & (first(at_row) == ty) & (first(at_col) == tx)
        found.append((row[own], col[own], at_row[own], at_col[own]))
    return tuple(map(np.concatenate, zip(*found)))


def _sampled(tile: int, smooth: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _, ty, tx = (k.as_py() for k in key)
        held = np.full((tile + 2, tile + 2), np.nan)  # a border before the tile and one behind it
        held[right["row"].to_numpy() - ty * tile + 1, right["col"].to_numpy() - tx * tile + 1] = right["v"].to_numpy(zero_copy_only=False).astype(np.float64)
        parts = []
        for k in range(len(left)):  # the grids of a raster
            g = dict(zip(NUMBERS, (np.float64(np.nan if x is None else x) for x in left["grid"][k].as_py())))
            row, col, *at = _asked(g, ty, tx, tile, smooth)
            value = _values(held, *at, ty * tile - 1, tx * tile - 1, smooth)
            parts.append(pa.table([left["raster"].take(pa.array(np.full(len(row), k))), pa.array(row), pa.array(col), value], names=["raster", "row", "col", "v"]))
        return pa.concat_tables(parts) if parts else pa.table([left["raster"], pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.float64())], names=["raster", "row", "col", "v"])

    return run


def _values(held: np.ndarray, row: np.ndarray, col: np.ndarray, top_row: int, first_col: int, smooth: bool) -> pa.Array:
    """The values at places of the source, of which ``held`` begins at (``top_row``, ``first_col``)."""
    if smooth:
        row, col = row - 0.5, col - 0.5
    top, first = np.floor(row).astype(np.int64), np.floor(col).astype(np.int64)
    parts = [(top, first, np.ones(len(row)))]
    if smooth:
        down, right = row - top, col - first
        parts = [(top, first, (1 - down) * (1 - right)), (top, first + 1, (1 - down) * right), (top + 1, first, down * (1 - right)), (top + 1, first + 1, down * right)]
    total, weight = np.zeros(len(row)), np.zeros(len(row))
    for r, c, w in parts:
        v = held[r - top_row, c - first_col]
        ok = ~np.isnan(v) & (w > 0)
        total[ok] += w[ok] * v[ok]
        weight[ok] += w[ok]
    known = weight > 0
    return pa.array(np.divide(total, weight, out=np.zeros(len(row)), where=known), mask=~known)


def aligned(pixels: DataFrame, grids: DataFrame, method: str = "bilinear", tile: int = 256) -> DataFrame:
    """(raster, row, col, v) of every pixel of each raster's target grid.

    ``pixels``: raster, row, col, v. ``grids``: raster, height, width, s0 to s5 (source) and to_height, to_width, t0 to t5 (target). ``method``: ``nearest``, or ``bilinear`` over those
    of the four neighbours that exist and hold a value, by their weights. Pixels whose centre lies outside the source, or without a value
    there, are null; a raster without pixels has null ones only. Pixels of unknown rasters are passed over.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"unknown method {method}")
    smooth = method == "bilinear"
    spark = grids.sparkSession
    whole = grids.where("to_height > 0 AND to_width > 0").select("raster", *[F.col(c).cast("int" if "h" in c else "double").alias(c) for c in NUMBERS])
    count = lambda c: F.expr(f"sequence(0, CAST(ceil({c}) AS INT) - 1)")
    asks = whole.where("height > 0 AND width > 0").withColumn("ty", F.explode(count(f"height / {tile}"))).withColumn("tx", F.explode(count(f"width / {tile}")))
    asks = asks.select(*KEY, F.array(*[F.col(c).cast("double") for c in NUMBERS]).alias("grid"))
    # few grids make many pixels, so they are dealt to all partitions, which adaptive execution would join by their few bytes
    rows = whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("raster"))
    rows = rows.withColumn("row", F.explode(count("to_height"))).withColumn("col", F.explode(count("to_width")))
    at_row, at_col = source_place(F.col, F.col("row"), F.col("col"))
    rows = rows.select("raster", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), at_row.alias("at_row"), at_col.alias("at_col"), "height", "width")
    inside = F.expr("at_row >= 0 AND at_row < height AND at_col >= 0 AND at_col < width")
    outside = rows.where(~F.coalesce(inside, F.lit(False))).select("raster", "row", "col", F.lit(None).cast("double").alias("v"))
    own = [F.floor(F.col(c) / tile).cast("int") for c in ("row", "col")]
    back = lambda c, k: F.when((F.col(c) % tile == 0) & (k > 0), F.array(k, k - 1)).otherwise(F.array(k))
    given = pixels.select("raster", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("v").cast("double").alias("v"))
    if smooth:
        given = given.select("*", F.explode(back("row", own[0])).alias("ty")).select("*", F.explode(back("col", own[1])).alias("tx"))
    else:
        given = given.select("*", own[0].alias("ty"), own[1].alias("tx"))
    kind = f"raster {pixels.schema['raster'].dataType.simpleString()}, row int, col int, v double"
    met = asks.groupBy(*KEY).cogroup(given.groupBy(*KEY)).applyInArrow(_sampled(tile, smooth), kind)
    return met.unionByName(outside)

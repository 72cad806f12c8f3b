"""Operators on pixel tables (tile, y, x, value): stencils, tiling, block sums, resampling, augmentation.

Whole-tile stencils run as numpy on one Arrow group for each tile, so a tile is shuffled once however wide
the kernel is; gradients, block means, tiling and gates are plain DataFrame expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cragline.functions.hazard import clip

EPS = 1e-8


def gray_to_rgb(v: Column) -> Column:
    return F.array_repeat(v, 3)


def rgb_to_gray(channels: Column) -> Column:
    return F.aggregate(channels, F.lit(0.0), lambda a, x: a + x) / F.size(channels)


def contrast(v: Column, tile: WindowSpec, factor: float) -> Column:
    mean = F.avg(v).over(tile)
    return clip((v - mean) * factor + mean, 0.0, 1.0)


def flipped(rows: DataFrame, side: int, vertical: bool) -> DataFrame:
    axis = "y" if vertical else "x"
    return rows.withColumn(axis, side - 1 - F.col(axis))


def augmented(rows: DataFrame, side: int, seed: int) -> DataFrame:
    """Each tile flipped, brightened, contrasted and noised by draws from a hash of the seed and the tile.

    Only ``v`` changes in value; positions change alike for all columns, so labels stay aligned. Reruns agree.
    """
    def draw(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(n), F.col("tile")), F.lit(1 << 20)) / float(1 << 20)

    noise = (F.pmod(F.xxhash64(F.lit(seed), F.col("tile"), F.col("y"), F.col("x")), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.02
    tile = Window.partitionBy("tile")
    lift = (draw(1) - 0.5) * 0.2
    v, mean = F.col("v") + lift, F.avg("v").over(tile) + lift
    out = rows.withColumn("v", clip((v - mean) * (0.8 + 0.4 * draw(2)) + mean + noise, 0.0, 1.0))
    return out.withColumn("y", F.when(draw(3) < 0.5, side - 1 - F.col("y")).otherwise(F.col("y"))).withColumn("x", F.when(draw(4) < 0.5, side - 1 - F.col("x")).otherwise(F.col("x")))


def contiguous(rows: DataFrame, tile: str, label: str) -> DataFrame:
    """Labels replaced by their rank among the tile's labels, from 0."""
    return rows.withColumn(label, (F.dense_rank().over(Window.partitionBy(tile).orderBy(label)) - 1).cast("int"))


def tile_gates(rows: DataFrame, tile: str, ok: str, level: str) -> DataFrame:
    """A tile is refused for over 10 % missing pixels first, then for over 30 % saturated ones."""
    missing, bright = 1 - F.avg(F.col(ok).cast("double")), F.avg(F.coalesce(F.col(level) >= 0.95, F.lit(False)).cast("double"))
    out = rows.groupBy(tile).agg(missing.alias("m"), bright.alias("b"))
    verdict = F.when(F.col("m") > 0.10, "nodata").when(F.col("b") > 0.30, "saturated").otherwise("accepted")
    return out.select(tile, F.round("m", 6).alias("nodata_frac"), F.round("b", 6).alias("sat_frac"), verdict.alias("verdict"))


def extremes_filter(rows: DataFrame, tile: str, value: str, band: float) -> DataFrame:
    """Share of a tile's pixels within ``band`` of its range of an extreme; a tile passes with 30 % at most."""
    w = Window.partitionBy(tile)
    low, high = F.min(value).over(w), F.max(value).over(w)
    rows = rows.select(tile, ((F.col(value) - low < band * (high - low + EPS)) | (high - F.col(value) < band * (high - low + EPS))).cast("double").alias("near"))
    return rows.groupBy(tile).agg(F.avg("near").alias("share")).select(tile, F.round("share", 6).alias("near_share"), (F.col("share") <= 0.30).alias("passes"))


# --- stencils on a whole tile -------------------------------------------------------------------------------------------

SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)


def log_kernel(sigma: float = 2.0, size: int = 13) -> np.ndarray:
    """Laplacian of Gaussian with its mean taken off, so that a constant image gives 0."""
    a = np.arange(size) - size // 2
    d2 = a[:, None] ** 2 + a[None, :] ** 2
    k = (d2 - 2 * sigma**2) / sigma**4 * np.exp(-d2 / (2 * sigma**2))
    return k - k.mean()


def correlate(image: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Cross-correlation; ``reflect`` mirrors without the edge pixel, ``symmetric`` repeats it."""
    reach = kernel.shape[0] // 2
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(image, reach, mode), kernel.shape)
    return np.einsum("yxij,ij->yx", wide, kernel)


def box_mean(image: np.ndarray, size: int, mode: str) -> np.ndarray:
    """Mean over a square, by two running sums."""
    padded = np.pad(image, size // 2, mode)
    for axis in (0, 1):
        total = np.cumsum(padded, axis=axis)
        total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis)
        n = padded.shape[axis] - size + 1
        padded = (np.take(total, range(size, size + n), axis) - np.take(total, range(n), axis)) / size
    return padded


def _to_max(x: np.ndarray) -> np.ndarray:
    return np.clip(x / (x.max() + EPS), 0, 1)


def slope_proxy(image: np.ndarray) -> np.ndarray:
    return _to_max(np.sqrt(correlate(image, SOBEL) ** 2 + correlate(image, SOBEL.T) ** 2 + EPS))


def roughness_proxy(image: np.ndarray, size: int = 7) -> np.ndarray:
    variance = box_mean(image * image, size, "reflect") - box_mean(image, size, "reflect") ** 2
    return _to_max(np.sqrt(np.maximum(variance, 0) + EPS))


def discontinuity_proxy(image: np.ndarray) -> np.ndarray:
    return _to_max(np.abs(correlate(image, log_kernel())))


def local_roughness(image: np.ndarray, size: int = 7) -> np.ndarray:
    variance = box_mean(image * image, size, "symmetric") - box_mean(image, size, "symmetric") ** 2
    return np.sqrt(np.maximum(variance, 0))


def sobel_edges(image: np.ndarray) -> np.ndarray:
    """Sobel magnitude with repeated edges over its maximum; 0 where that is almost 0."""
    g = np.hypot(correlate(image, SOBEL, "symmetric"), correlate(image, SOBEL.T, "symmetric"))
    return g / g.max() if g.max() >= EPS else np.zeros_like(g)


STENCILS = {"slope": slope_proxy, "roughness": roughness_proxy, "discontinuity": discontinuity_proxy, "local_roughness": local_roughness, "sobel": sobel_edges}


def stencils(rows: DataFrame, names: list[str], value: str = "v") -> DataFrame:
    """(tile, y, x) and one column for each named stencil of ``value``; a tile holds every (y, x) of a rectangle once, without nulls.

    One group for each tile; an image smaller than a stencil's reach raises an error.
    """
    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        image = np.empty((y.max() + 1, x.max() + 1))
        image[y, x] = table["v"].to_numpy()
        return pa.table([table["tile"], table["y"], table["x"], *(pa.array(STENCILS[n](image)[y, x]) for n in names)], names=["tile", "y", "x", *names])

    rows = rows.select("tile", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("tile").applyInArrow(run, "tile long, y int, x int, " + ", ".join(f"{n} double" for n in names))


def gradient_slope(rows: DataFrame, value: str, pixel_size: float) -> DataFrame:
    """``rows`` with slope in degrees: central differences, one-sided at edges."""
    def along(axis: str, other: str) -> Column:
        w = Window.partitionBy("tile", other).orderBy(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2) / pixel_size

    gy, gx = along("y", "x"), along("x", "y")
    return rows.withColumn("slope", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))))


def tiled(rows: DataFrame, size: int, stride: int, extent: int) -> DataFrame:
    """Overlapping windows: every pixel once for each window (row, col) that it lies in, with its place (wy, wx) in it."""
    last = (extent - size) // stride

    def origins(c: str) -> Column:
        return F.sequence(F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)).cast("int"), F.least(F.floor(F.col(c) / stride), F.lit(last)).cast("int"))

    rows = rows.withColumn("row", F.explode(origins("y"))).withColumn("col", F.explode(origins("x")))
    return rows.withColumn("wy", F.col("y") - F.col("row") * stride).withColumn("wx", F.col("x") - F.col("col") * stride)


def padded(rows: DataFrame, side: int, to: int) -> DataFrame:
    """Mirrors the right and bottom border so that the tile's side is ``to``; at most one copy of each border pixel a side."""
    def places(c: str) -> Column:
        image = 2 * (side - 1) - F.col(c)
        return F.when((image >= side) & (image < to), F.array(F.col(c), image)).otherwise(F.array(F.col(c)))

    return rows.withColumn("y", F.explode(places("y"))).withColumn("x", F.explode(places("x")))


def block_mean(rows: DataFrame, size: int, value: str, side: int) -> DataFrame:
    """(tile, by, bx, mean); ragged blocks at the border are left out."""
    n = side // size
    rows = rows.select("tile", F.floor(F.col("y") / size).cast("int").alias("by"), F.floor(F.col("x") / size).cast("int").alias("bx"), F.col(value).alias("v"))
    return rows.where((F.col("by") < n) & (F.col("bx") < n)).groupBy("tile", "by", "bx").agg(F.avg("v").alias("mean"))


def patches(rows: DataFrame, size: int, side: int) -> DataFrame:
    """(tile, patch, values): row-major patches of row-major pixels."""
    n = side // size
    patch = (F.floor(F.col("y") / size) * n + F.floor(F.col("x") / size)).cast("int")
    place = (F.col("y") % size) * size + F.col("x") % size
    out = rows.groupBy("tile", patch.alias("patch")).agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), F.col("v")))).alias("p"))
    return out.select("tile", "patch", F.col("p.v").alias("values"))


def unpatched(rows: DataFrame, size: int, side: int) -> DataFrame:
    n = side // size
    rows = rows.select("tile", "patch", F.posexplode("values").alias("k", "v"))
    y, x = F.floor(F.col("patch") / n) * size + F.floor(F.col("k") / size), (F.col("patch") % n) * size + F.col("k") % size
    return rows.select("tile", y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def masked(rows: DataFrame, share: float, noise: Column) -> DataFrame:
    """Patches in the order of ``noise``: the first n - floor(share n) are visible; ``place`` restores the order."""
    order = Window.partitionBy("tile").orderBy(noise, "patch")
    n = F.count(F.lit(1)).over(Window.partitionBy("tile"))
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    return rows.withColumn("masked", F.col("place") >= n - F.floor(n * share))


def total_variation(rows: DataFrame, value: str) -> DataFrame:
    """Mean absolute step down plus mean absolute step to the right, over each tile."""
    down, right = Window.partitionBy("tile", "x").orderBy("y"), Window.partitionBy("tile", "y").orderBy("x")
    rows = rows.select("tile", F.abs(F.col(value) - F.lag(value).over(down)).alias("dy"), F.abs(F.col(value) - F.lag(value).over(right)).alias("dx"))
    return rows.groupBy("tile").agg((F.avg("dy") + F.avg("dx")).alias("tv"))


def resized(rows: DataFrame, side: int, to: int, value: str = "v") -> DataFrame:
    """Bilinear resampling to ``to`` pixels a side with pixel centres aligned; every source pixel sends its weights, nothing is crossed."""
    scale = side / to

    def targets(c: str) -> Column:
        # a target t reads floor(u) and floor(u) + 1 with u = (t + 0.5) scale - 0.5 held at 0 and side - 1
        low, high = F.floor((F.col(c) - 1 + 0.5) / scale - 0.5), F.ceil((F.col(c) + 1 + 0.5) / scale - 0.5)
        span = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(to - 1)).cast("int"))
        u = lambda t: F.least(F.greatest((t + 0.5) * scale - 0.5, F.lit(0.0)), F.lit(float(side - 1)))
        return F.transform(span, lambda t: F.struct(t.alias("t"), F.greatest(F.lit(0.0), 1 - F.abs(u(t) - F.col(c))).alias("w")))

    rows = rows.withColumn("a", F.explode(targets("y"))).where("a.w > 0").withColumn("b", F.explode(targets("x"))).where("b.w > 0")
    return rows.groupBy("tile", F.col("a.t").alias("y"), F.col("b.t").alias("x")).agg(F.sum(F.col(value) * F.col("a.w") * F.col("b.w")).alias(value))


def rotated(rows: DataFrame, degrees: float, side: int, value: str = "v") -> DataFrame:
    """Nearest-neighbour rotation about the centre, mirrored at the border: each target pixel looks its source up."""
    import math

    c, s, mid = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), (side - 1) / 2

    def fold(i: Column) -> Column:
        i = F.when(i < 0, -i - 1).otherwise(i)
        return F.when(i >= side, 2 * side - 1 - i).otherwise(i).cast("int")

    dy, dx = F.col("y") - mid, F.col("x") - mid
    targets = rows.select("tile", "y", "x", fold(F.bround(mid + dy * c - dx * s)).alias("sy"), fold(F.bround(mid + dy * s + dx * c)).alias("sx"))
    source = rows.select("tile", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col(value))
    return targets.join(source, ["tile", "sy", "sx"]).select("tile", "y", "x", value)

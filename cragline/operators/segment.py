"""Superpixels of image tiles: seeded clustering in intensity and place, refinement of hazardous blocks, connected labels.

One group a tile, in numpy. Labels are contiguous from 0 and 4-connected, every pixel has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.functions.hazard import budget, tier
from cragline.operators.raster import block_mean


def clusters(image: np.ndarray, mask: np.ndarray, n: int, compactness: float, rounds: int = 8) -> np.ndarray:
    """Labels of the masked pixels by k-means in (intensity, place), from a grid of seeds; -1 outside.

    A pixel chooses among the seeds of its own grid cell and the eight around it, so a round costs nine distances a pixel whatever ``n`` is.
    """
    out = np.full(image.shape, -1)
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return out
    step = max(np.sqrt(len(ys) / max(n, 1)), 1.0)
    points = np.stack([image[ys, xs] * compactness, ys / step, xs / step], 1)
    gy, gx = (ys // step).astype(int), (xs // step).astype(int)
    high, wide = gy.max() + 1, gx.max() + 1
    near = gy * wide + gx
    for _ in range(rounds):
        many = np.bincount(near, minlength=high * wide)
        centre = np.stack([np.bincount(near, points[:, i], high * wide) for i in range(3)], 1) / np.maximum(many, 1)[:, None]
        best = np.full(len(ys), np.inf)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                y, x = gy + dy, gx + dx
                inside = (y >= 0) & (y < high) & (x >= 0) & (x < wide)
                seed = np.where(inside, y * wide + x, 0)
                apart = np.where(inside & (many[seed] > 0), np.square(points - centre[seed]).sum(1), np.inf)
                near, best = np.where(apart < best, seed, near), np.minimum(apart, best)
    out[ys, xs] = np.unique(near, return_inverse=True)[1]
    return out


def connected_parts(labels: np.ndarray) -> np.ndarray:
    """A number for each 4-connected part of equal labels: the least pixel index in it."""
    part = np.arange(labels.size).reshape(labels.shape)
    down, right = labels[1:] == labels[:-1], labels[:, 1:] == labels[:, :-1]
    while True:
        before = part.copy()
        low = np.where(down, np.minimum(part[1:], part[:-1]), part[1:])
        part[1:] = low
        part[:-1] = np.where(down, np.minimum(part[:-1], part[1:]), part[:-1])
        part[:, 1:] = np.where(right, np.minimum(part[:, 1:], part[:, :-1]), part[:, 1:])
        part[:, :-1] = np.where(right, np.minimum(part[:, :-1], part[:, 1:]), part[:, :-1])
        part = part.ravel()[part]
        if np.array_equal(before, part):
            return part


def one_piece(labels: np.ndarray) -> np.ndarray:
    """Of each label the largest part stays (of equals the one of the least pixel); every other part takes the label of a staying part that it
    touches most (of equals the least), parts that touch none a round later. Then labels count from 0."""
    labels = np.unique(labels, return_inverse=True)[1].reshape(labels.shape)
    many_labels = labels.max() + 1
    while True:
        part = connected_parts(labels)
        ids, first, at, many = np.unique(part, return_index=True, return_inverse=True, return_counts=True)
        at, owner = at.reshape(labels.shape), labels.ravel()[first]
        order = np.lexsort((ids, -many, owner))
        loose = np.zeros(len(ids), bool)
        loose[order[1:][owner[order][1:] == owner[order][:-1]]] = True
        if not loose.any():
            return np.unique(labels, return_inverse=True)[1].reshape(labels.shape)
        votes = []
        for a, b in ((at[1:], at[:-1]), (at[:, 1:], at[:, :-1])):
            for p, q in ((a, b), (b, a)):
                meets = loose[p] & ~loose[q]
                votes.append(p[meets] * many_labels + owner[q[meets]])
        name, votes = np.unique(np.concatenate(votes), return_counts=True)
        order = np.lexsort((name % many_labels, -votes, name // many_labels))
        asks, place = np.unique(name[order] // many_labels, return_index=True)
        owner[asks] = (name % many_labels)[order][place]
        labels = owner[at]


def adaptive_labels(image: np.ndarray, n: int | None, refine: bool, compactness: float, block: int, larger: int, least: int) -> tuple[np.ndarray, dict[str, int]]:
    """Superpixels of one tile and what their number came from; see ``segmented``."""
    side = len(image)
    means = image.reshape(side // block, block, side // block, block).mean((1, 3))
    budgets = np.rint(8 + 56 * np.clip(means, 0, 1) ** 1.5).astype(int)
    coarse = max(least, int(0.4 * budgets.sum())) if n is None else n
    labels = clusters(image, np.ones_like(image, bool), coarse, compactness)
    stats = {"budget": int(budgets.sum()), "coarse": int(labels.max()) + 1, "refined": 0}
    if refine:
        area = np.bincount(labels.ravel())
        ys, xs = np.indices(labels.shape)
        by, bx = ((np.bincount(labels.ravel(), c.ravel()) / area).astype(int) // block for c in (ys, xs))
        held = np.zeros(means.shape, int)
        np.add.at(held, (by, bx), 1)
        fresh, order, ends = len(area), np.argsort(labels.ravel(), kind="stable"), np.cumsum(area)
        for s in np.flatnonzero((area > larger) & (means[by, bx] > 0.6)).tolist():
            y, x = np.divmod(order[ends[s] - area[s] : ends[s]], side)
            y0, x0 = y.min(), x.min()
            inside = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
            inside[y - y0, x - x0] = True
            box = image[y0 : y0 + inside.shape[0], x0 : x0 + inside.shape[1]]
            split = clusters(box, inside, max(2, budgets[by[s], bx[s]] // held[by[s], bx[s]]), compactness * 1.5)[y - y0, x - x0]
            labels[y, x] = np.where(split > 0, fresh - 1 + split, s)
            fresh += split.max()
            stats["refined"] += 1
    labels = one_piece(labels)
    return labels, stats | {"segments": int(labels.max()) + 1}


def segmented(rows: DataFrame, side: int, n: int | None = None, refine: bool = True, compactness: float = 10.0, block: int = 4, larger: int = 12, least: int = 8) -> DataFrame:
    """``rows`` with seg, the superpixels of each tile, and the tile's budget and its numbers of coarse, refined and final segments.

    Without ``n`` the first pass makes 0.4 of the tile's node budget (the sum of its blocks' budgets), ``least`` at least. With ``refine``, segments over ``larger``
    pixels whose centre lies in a block of mean over 0.6 are split into their part of that block's budget, two or more.
    ``side`` must be a multiple of ``block``, and a tile must hold each of its pixels once, with a value: others are an error.
    """
    if side % block:
        raise ValueError(f"side {side} is not a multiple of block {block}")
    numbers = ("budget", "coarse", "refined", "segments")

    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        image = np.full((side, side), np.nan)
        image[y, x] = table["v"].to_numpy()
        if len(y) != side * side or np.isnan(image).any():
            raise ValueError(f"tile {table['tile'][0]} doesn't hold each of its {side * side} pixels once, with a value")
        labels, stats = adaptive_labels(image, n, refine, compactness, block, larger, least)
        return pa.table([table["tile"], table["y"], table["x"], table["v"], pa.array(labels[y, x].astype(np.int64)), *(pa.array(np.full(len(y), stats[c], np.int32)) for c in numbers)],
                        names=["tile", "y", "x", "v", "seg", *numbers])

    return rows.select("tile", "y", "x", "v").groupBy("tile").applyInArrow(run, "tile long, y int, x int, v double, seg long, " + ", ".join(f"{c} int" for c in numbers))


def segment_stats(labelled: DataFrame) -> DataFrame:
    """A row for each tile of ``segmented``: its budget, its numbers of segments and the area of the largest."""
    areas = labelled.groupBy("tile", "seg").agg(F.count(F.lit(1)).alias("area"), *[F.first(c).alias(c) for c in ("budget", "coarse", "refined", "segments")])
    return areas.groupBy("tile").agg(*[F.max(c).alias(c) for c in ("budget", "coarse", "refined", "segments")], F.count(F.lit(1)).alias("counted"), F.max("area").alias("largest"))


def tier_budget(rows: DataFrame, block: int, side: int) -> DataFrame:
    """Flat and hazardous blocks and the node budget of each tile."""
    c = F.col("mean")
    return block_mean(rows, block, "v", side).groupBy("tile").agg(
        F.count_if(tier(c) == 0).alias("flat"), F.count_if(tier(c) == 2).alias("hazard"), F.sum(budget(c)).alias("budget"))


def refinement_candidates(rows: DataFrame, block: int, side: int, over: float, larger: int) -> DataFrame:
    """Segments over ``larger`` pixels whose centre lies in a block of mean over ``over``."""
    at = lambda c: F.floor(F.avg(c) / block).cast("int")
    centres = rows.groupBy("tile", "seg").agg(at("y").alias("by"), at("x").alias("bx"), F.count(F.lit(1)).alias("area")).where(F.col("area") > larger)
    hot = block_mean(rows, block, "v", side).where(F.col("mean") > over).select("tile", "by", "bx")
    return centres.join(hot, ["tile", "by", "bx"]).select("tile", "seg", "by", "bx", "area")

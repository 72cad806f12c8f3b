"""Alignment of rasters against a plain loop."""

import math

import numpy as np
import pytest

from cragline.operators import grids

COLUMNS = "raster long, height int, width int, " + ", ".join(f"s{i} double" for i in range(6)) + ", to_height int, to_width int, " + ", ".join(f"t{i} double" for i in range(6))


def brute(images, given, method):
    out = {}
    for raster, height, width, *rest in given:
        s, (to_height, to_width), t = rest[:6], rest[6:8], rest[8:]
        image = images.get(raster)
        for row in range(to_height):
            for col in range(to_width):
                x, y = t[0] + t[1] * (col + 0.5) + t[2] * (row + 0.5), t[3] + t[4] * (col + 0.5) + t[5] * (row + 0.5)
                c, r = np.linalg.solve([[s[1], s[2]], [s[4], s[5]]], [x - s[0], y - s[3]])
                value = None
                if 0 <= r < height and 0 <= c < width and image is not None:
                    if method == "nearest":
                        near = [(math.floor(r), math.floor(c), 1.0)]
                    else:
                        r0, c0 = math.floor(r - 0.5), math.floor(c - 0.5)
                        fr, fc = r - 0.5 - r0, c - 0.5 - c0
                        near = [(r0 + i, c0 + j, (fr if i else 1 - fr) * (fc if j else 1 - fc)) for i in (0, 1) for j in (0, 1)]
                    near = [(image[a, b], w) for a, b, w in near if 0 <= a < height and 0 <= b < width and not np.isnan(image[a, b]) and w > 0]
                    value = sum(v * w for v, w in near) / sum(w for _, w in near) if near else None
                out[raster, row, col] = value
    return out


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_alignment_by_a_plain_loop(spark, method):
    draw = np.random.default_rng(0)
    images = {1: draw.random((23, 17)), 2: draw.random((9, 30)), 3: draw.random((5, 5))}
    images[1][draw.random((23, 17)) < 0.2] = np.nan
    given = [(1, 23, 17, 100.0, 2.0, 0.0, 50.0, 0.0, -2.0, 31, 20, 97.3, 1.5, 0.0, 51.1, 0.0, -1.7), (2, 9, 30, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 12, 40, 0.26, 0.71, 0.11, -0.43, -0.07, 0.69),
             (3, 5, 5, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 4, 4, 500.0, 1.0, 0.0, 0.0, 0.0, 1.0), (4, 3, 3, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 2, 2, 0.1, 1.0, 0.0, 0.2, 0.0, 1.0)]
    rows = [(k, r, c, None if np.isnan(x[r, c]) else float(x[r, c])) for k, x in images.items() for r in range(x.shape[0]) for c in range(x.shape[1])] + [(77, 0, 0, 1.0)]
    pixels, table = spark.createDataFrame(rows, "raster long, row int, col int, v double").repartition(5), spark.createDataFrame(given, COLUMNS)
    want = brute(images, given, method)
    for tile in (4, 256):
        got = {(r.raster, r.row, r.col): r.v for r in grids.aligned(pixels, table, method, tile).collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, abs_tol=1e-12)) for k, v in want.items())
    assert grids.aligned(pixels, table.limit(0), method).count() == 0
    with pytest.raises(ValueError):
        grids.aligned(pixels, table, "cubic")


def test_only_edges_are_sent_twice(spark):
    pixels = spark.range(64 * 64).selectExpr("1L AS raster", "CAST(id div 64 AS INT) AS row", "CAST(id % 64 AS INT) AS col", "1.0D AS v")
    table = spark.createDataFrame([(1, 64, 64, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 64, 64, 0.3, 1.0, 0.0, 0.3, 0.0, 1.0)], COLUMNS)
    out = grids.aligned(pixels, table, tile=16)
    assert out.where("v = 1").count() == 64 * 64

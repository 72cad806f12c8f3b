"""Seeded augmentation against a plain version with the same hash."""

import struct

import numpy as np
import xxhash

from cragline.operators import raster


def hashed(*parts):
    seed = 42
    for kind, value in parts:
        seed = xxhash.xxh64_intdigest(struct.pack("<" + kind, value), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_augmented(spark):
    draw, side = np.random.default_rng(1), 4
    images = {t: draw.random((side, side)) for t in (0, 5, 6, 2**40)}
    rows = [(t, y, x, float(m[y, x]), f"{y}{x}") for t, m in images.items() for y in range(side) for x in range(side)]
    got = {(r.tile, r.label): (r.y, r.x, r.v) for r in raster.augmented(spark.createDataFrame(rows, "tile long, y int, x int, v double, label string"), side, 3).collect()}
    share = lambda h: h % (1 << 20) / (1 << 20)
    flips = set()
    for t, y, x, v, label in rows:
        one, two, three, four = (share(hashed(("i", 3), ("i", n), ("q", t))) for n in (1, 2, 3, 4))
        noise = (share(hashed(("i", 3), ("q", t), ("i", y), ("i", x))) - 0.5) * 0.02
        mean = images[t].mean() + (one - 0.5) * 0.2
        want = min(max((v + (one - 0.5) * 0.2 - mean) * (0.8 + 0.4 * two) + mean + noise, 0), 1)
        at = (side - 1 - y if three < 0.5 else y, side - 1 - x if four < 0.5 else x)
        flips.add((three < 0.5, four < 0.5))
        assert got[t, label][:2] == at and abs(got[t, label][2] - want) < 1e-12
    assert len(flips) > 1

"""Small networks applied to tiles and graphs in numpy; weights are explicit arguments and travel with the task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cragline.operators.raster import discontinuity_proxy, roughness_proxy, slope_proxy


def convolve(maps: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(in, H, W) to (out, H, W) by mirrored correlation; weights (out, in, k, k)."""
    reach = weights.shape[-1] // 2
    wide = np.pad(maps, ((0, 0), (reach, reach), (reach, reach)), "reflect") if reach else maps
    windows = np.lib.stride_tricks.sliding_window_view(wide, weights.shape[-2:], axis=(1, 2))
    return np.einsum("iyxab,oiab->oyx", windows, weights, optimize=True) + bias[:, None, None]


def seeded_fusion(seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights of the three convolutions 3-16-8-1, drawn from a seed: 1,617 numbers."""
    draw = np.random.default_rng(seed)
    return [(draw.normal(0, 0.2, (o, i, k, k)), np.zeros(o)) for o, i, k in ((16, 3, 3), (8, 16, 3), (1, 8, 1))]


def fusion_weight(image: np.ndarray, physics: np.ndarray, learned: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.stack([image, physics, learned])
    for k, (w, b) in enumerate(layers):
        x = convolve(x, w, b)
        x = np.maximum(x, 0) if k < len(layers) - 1 else 1 / (1 + np.exp(-x))
    return x[0]


def fusion_maps(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(tile, y, x, h_physics, alpha, h_final) from v and h_learned: physics stencils, fusion weight and blend in one group a tile."""
    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        image, learned = np.zeros((2, y.max() + 1, x.max() + 1))
        image[y, x], learned[y, x] = table["v"].to_numpy(), table["h_learned"].to_numpy()
        physics = np.clip(0.4 * slope_proxy(image) + 0.3 * roughness_proxy(image) + 0.3 * discontinuity_proxy(image), 0, 1)
        alpha = fusion_weight(image, physics, learned, layers)
        final = alpha * learned + (1 - alpha) * physics
        return pa.table([table["tile"], table["y"], table["x"], *(pa.array(m[y, x]) for m in (physics, alpha, final))], names=["tile", "y", "x", "h_physics", "alpha", "h_final"])

    return rows.select("tile", "y", "x", "v", "h_learned").groupBy("tile").applyInArrow(run, "tile long, y int, x int, h_physics double, alpha double, h_final double")


MAPS = ("slope", "roughness", "discontinuity", "h_physics", "h_learned", "alpha", "h_final")


def end_to_end(rows: DataFrame, learn: Callable[[np.ndarray], np.ndarray], weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], share: float = 0.1) -> DataFrame:
    """(tile, y, x, maps, penalty): all hazard maps of each image tile (tile, y, x, v) as one struct, from one pass over the tile.

    ``learn`` gives the learned risk of an image and ``weigh`` the fusion weight from the image, the physics map and the learned one; both are injected and travel
    with the tasks. ``penalty`` is ``share`` times the tile's mean of weight times (1 - weight). Pixels a tile doesn't hold count as 0.
    """
    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        image = np.zeros((y.max() + 1, x.max() + 1))
        image[y, x] = table["v"].to_numpy()
        slope, rough, broken = slope_proxy(image), roughness_proxy(image), discontinuity_proxy(image)
        physics = np.clip(0.4 * slope + 0.3 * rough + 0.3 * broken, 0, 1)
        learned = learn(image)
        alpha = weigh(image, physics, learned)
        found = (slope, rough, broken, physics, learned, alpha, alpha * learned + (1 - alpha) * physics)
        maps = pa.StructArray.from_arrays([pa.array(m[y, x]) for m in found], names=list(MAPS))
        penalty = share * float((alpha * (1 - alpha)).mean())
        return pa.table([table["tile"], table["y"], table["x"], maps, pa.array(np.full(len(y), penalty))], names=["tile", "y", "x", "maps", "penalty"])

    kind = ", ".join(f"{m}: double" for m in MAPS)
    return rows.select("tile", "y", "x", "v").groupBy("tile").applyInArrow(run, f"tile long, y int, x int, maps struct<{kind}>, penalty double")


#: Steps of the error function's table to 1, and its end, beyond which it is 1 in double precision.
STEPS, END = 1024, 6
ERF = np.array([math.erf(i / STEPS) for i in range(END * STEPS + 2)])


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of a whole array, by cubics between tabled values with their slopes (within 1e-13)."""
    size = np.minimum(np.abs(x), END)
    at = np.nan_to_num(size * STEPS).astype(int)
    low, t = at / STEPS, size * STEPS - at
    first, last = (2 / math.sqrt(math.pi) / STEPS * np.exp(-np.square(low + k / STEPS)) for k in (0, 1))
    step = ERF[at + 1] - ERF[at]
    return np.copysign(ERF[at] + t * (first + t * (3 * step - 2 * first - last + t * (first + last - 2 * step))), x)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def attend(x: np.ndarray, src: np.ndarray, dst: np.ndarray, physics: np.ndarray, layer: dict) -> np.ndarray:
    """Attention over incoming edges, heads side by side; a node without edges gets the bias."""
    heads = np.einsum("ni,hoi->nho", x, layer["w"])
    cat = np.concatenate([heads[dst], heads[src]], -1)
    logit = (np.where(cat > 0, cat, 0.2 * cat) * layer["att"]).sum(-1) + layer["boost"] * np.exp(-np.abs(physics[src] - physics[dst]).sum(-1))[:, None]
    top = np.full((len(x), logit.shape[1]), -np.inf)
    np.maximum.at(top, dst, logit)
    e = np.exp(logit - top[dst])
    total = np.zeros_like(top)
    np.add.at(total, dst, e)
    out = np.zeros_like(heads)
    np.add.at(out, dst, (e / total[dst])[..., None] * heads[src])
    return out.reshape(len(x), -1) + layer["bias"]


def feed_forward(x: np.ndarray, layer: dict) -> np.ndarray:
    """Normalised by stored statistics, widened, rectified smoothly, narrowed, added to the input."""
    h = (x - layer["mean"]) / np.sqrt(layer["var"] + 1e-5)
    return x + gelu(h @ layer["up"]) @ layer["down"]


def seeded_network(inputs: int, seed: int, heads: int = 4, width: int = 8) -> list[dict]:
    """Weights of two attention layers with feed-forward blocks and a read-out, drawn from a seed."""
    draw = np.random.default_rng(seed)

    def layer(i: int, h: int, o: int) -> dict:
        return {"w": draw.normal(0, 0.3, (h, o, i)), "att": draw.normal(0, 0.3, (h, 2 * o)), "boost": 0.1, "bias": np.zeros(h * o), "mean": np.zeros(h * o), "var": np.ones(h * o),
                "up": draw.normal(0, 0.2, (h * o, 4 * h * o)), "down": draw.normal(0, 0.2, (4 * h * o, h * o))}

    return [layer(inputs, heads, width), layer(heads * width, 1, width), {"out": draw.normal(0, 0.5, width)}]


def forward(x: np.ndarray, src: np.ndarray, dst: np.ndarray, physics: np.ndarray, network: list[dict], keep: list[np.ndarray] | None = None) -> np.ndarray:
    """Risks of nodes; ``keep`` has a dropout mask for the output of each attention layer."""
    for k, layer in enumerate(network[:-1]):
        x = feed_forward(np.maximum(attend(x, src, dst, physics, layer), 0), layer)
        x = x if keep is None else x * keep[k]
    return 1 / (1 + np.exp(-x @ network[-1]["out"]))


def _on_graphs(nodes: DataFrame, edges: DataFrame, inputs: list[str], network: list[dict], names: list[str], score) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        x = np.stack([left[c].to_numpy() for c in inputs], 1)[order]
        src, dst = np.searchsorted(ids, right["src"].to_numpy()), np.searchsorted(ids, right["dst"].to_numpy())
        columns = score(ids, x, src, dst)
        return pa.table([pa.array([left["tile"][0].as_py()] * len(ids), pa.int64()), pa.array(ids), *map(pa.array, columns)], names=["tile", "id", *names])

    return nodes.select("tile", "id", *inputs).groupBy("tile").cogroup(edges.toDF(*edges.columns).groupBy("tile")).applyInArrow(run, "tile long, id long, " + ", ".join(f"{n} double" for n in names))


def node_scores(nodes: DataFrame, edges: DataFrame, inputs: list[str], network: list[dict]) -> DataFrame:
    """(tile, id, risk): one group a tile; the first two inputs are the physics columns of the attention."""
    return _on_graphs(nodes, edges, inputs, network, ["risk"], lambda ids, x, s, t: [forward(x, s, t, x[:, :2], network)])


def stochastic_scores(nodes: DataFrame, edges: DataFrame, inputs: list[str], network: list[dict], passes: int, drop: float = 0.2) -> DataFrame:
    """(tile, id, mean, variance) over ``passes`` with dropout masks seeded by pass and node: reruns agree. One pass has no variance."""
    def score(ids: np.ndarray, x: np.ndarray, s: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        runs = []
        for k in range(passes):
            keep = [np.stack([np.random.default_rng([k, i, int(n)]).random(len(layer["bias"])) >= drop for n in ids]) / (1 - drop) for i, layer in enumerate(network[:-1])]
            runs.append(forward(x, s, t, x[:, :2], network, keep))
        runs = np.stack(runs)
        return [runs.mean(0), runs.var(0, ddof=1) if passes > 1 else np.zeros(len(ids))]

    return _on_graphs(nodes, edges, inputs, network, ["mean", "variance"], score)

"""Region graphs as tables: nodes (tile, id, ...), edges (tile, src, dst). Tiles are independent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators.nearest import nearest_lower
from cragline.sources.shared import pinned

#: Nodes of a tile that are compared with as many others in one task, about.
BLOCK = 2048


def _squares(columns: list[str]) -> Column:
    return sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in columns), F.lit(0.0))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("tile", "src", "dst").union(edges.select("tile", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nearest_in_tile(nodes: DataFrame, columns: list[str], sizes: DataFrame, k: int, measure: Callable[[dict[str, np.ndarray], dict[str, np.ndarray], float], np.ndarray]) -> DataFrame:
    """(tile, src, dst, far): each node's ``k`` others in its tile of least ``measure``, rounded to 12 digits; ties go to the smaller id, the node itself never counts.

    ``measure`` takes the columns of some nodes (as a column vector each) and of others (as rows) and the tile's ``scale``; ``sizes`` has (tile, blocks, scale).
    A tile's nodes are dealt into blocks of about ``BLOCK``; each pair of blocks is one group, of which ``k`` rows a node leave. So a tile of a few
    thousand nodes moves each of them a few times, and no task holds more than two blocks, however many nodes a tile has.
    """
    dealt = nodes.select("tile", "id", *columns).join(sizes, "tile").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    asks = dealt.select("tile", F.col("own").alias("p"), every.alias("q"), "id", "scale", *columns)
    held = dealt.select("tile", every.alias("p"), F.col("own").alias("q"), "id", *columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, far, tile = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
        if len(left) and len(right):
            tile, scale = left["tile"][0].as_py(), left["scale"][0].as_py()
            right = right.sort_by("id")
            a, b = ({c: t[c].to_numpy().astype(np.float64) for c in columns} for t in (left, right))
            ids, others = left["id"].to_numpy(), right["id"].to_numpy()
            for at in range(0, len(ids), 256):
                rows = slice(at, at + 256)
                apart = np.round(measure({c: x[rows, None] for c, x in a.items()}, {c: x[None, :] for c, x in b.items()}, scale), 12)
                apart[ids[rows, None] == others[None, :]] = np.inf
                near = np.argsort(apart, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(apart, near, 1)
                keep = np.isfinite(best)
                src.append(np.repeat(ids[rows], keep.sum(1)))
                dst.append(others[near[keep]])
                far.append(best[keep])
        src, dst, far = map(np.concatenate, (src, dst, far))
        return pa.table([pa.array(np.full(len(src), tile, np.int64)), pa.array(src.astype(np.int64)), pa.array(dst.astype(np.int64)), pa.array(far)], names=["tile", "src", "dst", "far"])

    asks, held = asks.toDF(*asks.columns), held.toDF(*held.columns)
    found = asks.groupBy("tile", "p", "q").cogroup(held.groupBy("tile", "p", "q")).applyInArrow(run, "tile long, src long, dst long, far double")
    nearest = Window.partitionBy("tile", "src").orderBy("far", "dst")
    return found.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= k).drop("k")


def _blocks() -> Column:
    return F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")


def nearest_nodes(nodes: DataFrame, place: list[str], physics: list[str], k: int, diagonal: float, weight: float = 0.5) -> DataFrame:
    """(tile, src, dst, far): each node's ``k`` nearest others in its tile by weighted squared distance in place (over the tile's diagonal) and physics (over
    the diagonal of the tile's ranges); see ``nearest_in_tile``."""
    ranges = nodes.groupBy("tile").agg(_blocks(), *[(F.max(c) - F.min(c)).alias(f"range_{c}") for c in physics])
    spread = sum((F.pow(F.col(f"range_{c}"), 2) for c in physics), F.lit(0.0))
    sizes = ranges.select("tile", "blocks", F.when(spread > 1e-16, spread).otherwise(F.lit(1.0)).alias("scale"))

    def measure(a: dict[str, np.ndarray], b: dict[str, np.ndarray], spread: float) -> np.ndarray:
        squares = lambda names: sum(np.square(a[c] - b[c]) for c in names)
        return weight * squares(place) / diagonal**2 + (1 - weight) * squares(physics) / spread

    return nearest_in_tile(nodes, [*place, *physics], sizes, k, measure)


def knn_edges(nodes: DataFrame, place: list[str], physics: list[str], k: int, diagonal: float, weight: float = 0.5) -> DataFrame:
    """Edges both ways between each node and its ``nearest_nodes``."""
    return symmetric(nearest_nodes(nodes, place, physics, k, diagonal, weight))


def affinity(distance: Column, slope: Column, rough: Column, uncertain: Column, hidden: list[list[float]], output: list[float], bias: float) -> Column:
    """A small perceptron: each row of ``hidden`` has four weights and a bias; rectified, then a sigmoid."""
    units = [F.greatest(distance * w[0] + slope * w[1] + rough * w[2] + uncertain * w[3] + w[4], F.lit(0.0)) for w in hidden]
    return 1 / (1 + F.exp(-(sum((u * o for u, o in zip(units, output)), F.lit(0.0)) + bias)))


def affinity_edges(nodes: DataFrame, k: int, hidden: list[list[float]], output: list[float], bias: float) -> DataFrame:
    """Each node's ``k`` most affine others, both ways: ``affinity`` of distance in px, py and differences in s, r and h; see ``nearest_in_tile``."""
    sizes = nodes.groupBy("tile").agg(_blocks(), F.lit(1.0).alias("scale"))

    def measure(a: dict[str, np.ndarray], b: dict[str, np.ndarray], _: float) -> np.ndarray:
        inputs = [np.sqrt(np.square(a["px"] - b["px"]) + np.square(a["py"] - b["py"])), *(np.abs(a[c] - b[c]) for c in ("s", "r", "h"))]
        units = (np.maximum(sum(x * w for x, w in zip(inputs, row)) + row[4], 0) * o for row, o in zip(hidden, output))
        return -1 / (1 + np.exp(-(sum(units) + bias)))

    return symmetric(nearest_in_tile(nodes, ["px", "py", "s", "r", "h"], sizes, k, measure))


def adjacency(pixels: DataFrame, label: str) -> DataFrame:
    """(tile, a, b), a < b: labels that touch to the right or below."""
    right, below = Window.partitionBy("tile", "y").orderBy("x"), Window.partitionBy("tile", "x").orderBy("y")
    rows = pixels.select("tile", F.col(label).alias("l"), F.lead(label).over(right).alias("r"), F.lead(label).over(below).alias("b"))
    rows = rows.select("tile", "l", F.explode(F.array("r", "b")).alias("m"))
    return rows.where("l <> m").select("tile", F.least("l", "m").alias("a"), F.greatest("l", "m").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tile, id, component): the least id that the node reaches; one group a tile, minimum labels with pointer jumping."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.unique(left["id"].to_numpy())
        parent = np.arange(len(ids))
        a, b = np.searchsorted(ids, right["src"].to_numpy()), np.searchsorted(ids, right["dst"].to_numpy())
        while len(ids):
            before = parent.copy()
            low = np.minimum(parent[a], parent[b])
            np.minimum.at(parent, parent[a], low)
            np.minimum.at(parent, parent[b], low)
            parent = parent[parent]
            if np.array_equal(before, parent):
                break
        tile = left["tile"][0].as_py() if len(left) else None
        return pa.table([pa.array([tile] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(ids[parent], pa.int64())], names=["tile", "id", "component"])

    return nodes.select("tile", "id").groupBy("tile").cogroup(edges.select("tile", "src", "dst").toDF("tile", "src", "dst").groupBy("tile")).applyInArrow(run, "tile long, id long, component long")


def bridges(touching: DataFrame, parts: DataFrame) -> DataFrame:
    """All touching pairs (tile, a, b) that lie in different components, as edges both ways."""
    u, v = parts.select("tile", F.col("id").alias("a"), F.col("component").alias("ca")), parts.select("tile", F.col("id").alias("b"), F.col("component").alias("cb"))
    found = touching.join(u, ["tile", "a"]).join(v, ["tile", "b"]).where("ca <> cb")
    return symmetric(found.select("tile", F.col("a").alias("src"), F.col("b").alias("dst")))


def nearest_bridges(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """For tiles without bridges: each component joined to those of lesser ids by its nearest pair of nodes (see ``nearest.nearest_lower``)."""
    def run(table: pa.Table) -> pa.Table:
        _, other, mine = nearest_lower(table["id"].to_numpy(), table["component"].to_numpy(), np.stack([table["px"].to_numpy(), table["py"].to_numpy()], 1))
        src, dst = np.stack([mine, other], 1).ravel(), np.stack([other, mine], 1).ravel()
        return pa.table([pa.array([table["tile"][0].as_py()] * len(src), pa.int64()), pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["tile", "src", "dst"])

    rows = nodes.select("tile", "id", "px", "py").join(parts, ["tile", "id"])
    return rows.groupBy("tile").applyInArrow(run, "tile long, src long, dst long")


def connected_edges(nodes: DataFrame, edges: DataFrame, touching: DataFrame) -> DataFrame:
    """Edges with bridges between components: all touching pairs across them in a tile that has any, else nearest pairs."""
    parts = pinned(components(nodes, edges))  # read four times, and the bridges twice
    found = pinned(bridges(touching, parts))
    open_tiles = parts.groupBy("tile").agg(F.countDistinct("component").alias("n")).where("n > 1").join(found.select("tile").distinct(), "tile", "left_anti")
    far = nearest_bridges(nodes.join(open_tiles.select("tile"), "tile", "left_semi"), parts)
    return edges.select("tile", "src", "dst").union(found).union(far).distinct()


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with a_* of their source and b_* of their target."""
    a = nodes.select("tile", F.col("id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = nodes.select("tile", F.col("id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return edges.join(a, ["tile", "src"]).join(b, ["tile", "dst"])


def edge_weights(edges: DataFrame, nodes: DataFrame, diagonal: float) -> DataFrame:
    """0.6 mean risk + 0.25 distance over the diagonal + 0.15 slope difference."""
    rows = with_ends(edges, nodes, ["px", "py", "f7", "s"])
    w = 0.6 * (F.col("a_f7") + F.col("b_f7")) / 2 + 0.25 * F.sqrt(_squares(["px", "py"])) / diagonal + 0.15 * F.abs(F.col("a_s") - F.col("b_s"))
    return rows.select("tile", "src", "dst", w.alias("weight"))


def hazardous_neighbours(nodes: DataFrame, edges: DataFrame, flag: Column) -> DataFrame:
    """(tile, id, ratio): hazardous neighbours over the tile's largest number of them; 0 for nodes without edges or tiles without hazard."""
    flags = nodes.select("tile", F.col("id").alias("dst"), flag.cast("int").alias("f"))
    counts = edges.join(flags, ["tile", "dst"]).groupBy("tile", F.col("src").alias("id")).agg(F.sum("f").alias("n"))
    out = nodes.select("tile", "id").join(counts, ["tile", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.max("n").over(Window.partitionBy("tile"))
    return out.select("tile", "id", F.when(most > 0, F.col("n") / most).otherwise(F.lit(0.0)).alias("ratio"))


def node_features(pixels: DataFrame, label: str, value: str, side: int, block: int) -> DataFrame:
    """Centroid, area, mean and spread of each segment and the tier of the block its centroid lies in: one aggregate over the pixels."""
    from cragline.functions.hazard import block as block_of
    from cragline.functions.hazard import tier
    from cragline.operators.raster import block_mean

    rows = pixels.groupBy("tile", F.col(label).alias("id")).agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("area"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    tiers = block_mean(pixels, block, value, side).select("tile", "by", "bx", tier(F.col("mean")).alias("tier"))
    rows = rows.withColumn("by", block_of(F.col("cy"), block, side // block)).withColumn("bx", block_of(F.col("cx"), block, side // block))
    share = F.col("area") / F.max("area").over(Window.partitionBy("tile"))
    return rows.join(tiers, ["tile", "by", "bx"], "left").select(
        "tile", "id", (F.col("cx") / (side - 1)).alias("f0"), (F.col("cy") / (side - 1)).alias("f1"), F.col("mean").alias("f7"), share.alias("f9"),
        F.when(F.col("area") > 1, F.col("std")).otherwise(0.0).alias("f11"), (F.col("mean") > 0.7).cast("int").alias("f12"), F.coalesce("tier", tier(F.col("mean"))).alias("tier"))


def checks(nodes: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Named checks of each tile: finite features, range, node count, one component, weights not negative."""
    finite = F.bool_and(~F.isnan("f7") & F.col("f7").isNotNull())
    per = nodes.groupBy("tile").agg(finite.alias("finite"), F.bool_and(F.col("f7").between(-0.1, 1.1)).alias("in_range"), F.count(F.lit(1)).between(1, 2000).alias("sized"))
    one = components(nodes, edges).groupBy("tile").agg((F.countDistinct("component") == 1).alias("connected"))
    positive = weights.groupBy("tile").agg(F.bool_and(F.col("weight") >= 0).alias("positive"))
    return per.join(one, "tile").join(positive, "tile", "left").withColumn("positive", F.coalesce("positive", F.lit(True)))


def dirichlet_energy(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Half the sum of squared differences over directed edges; 0 for a tile without edges."""
    energy = with_ends(edges, nodes, columns).groupBy("tile").agg((F.sum(_squares(columns)) / 2).alias("energy"))
    return nodes.select("tile").distinct().join(energy, "tile", "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def mean_cosine(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Mean cosine over all ordered pairs of different nodes, by its closed form: one aggregate, no pairs. 1 for a lone node."""
    norm = F.greatest(F.sqrt(sum((F.pow(F.col(c), 2) for c in columns), F.lit(0.0))), F.lit(1e-12))
    sums = nodes.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c) / norm).alias(f"t{i}") for i, c in enumerate(columns)])
    total = sum((F.pow(F.col(f"t{i}"), 2) for i in range(len(columns))), F.lit(0.0))
    return sums.select("tile", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise((total - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cosine"))


def attention(nodes: DataFrame, edges: DataFrame, inputs: list[str], weights: list[list[list[float]]], att: list[list[float]], physics: list[str], boost: float, slope: float = 0.2) -> DataFrame:
    """A graph attention layer in relational form: (tile, id, head, c0, c1, ...).

    Head h projects a node by ``weights[h]`` (outputs by inputs). An edge's logit is att . leaky(source and target projections) plus
    ``boost`` times exp(-L1 distance of the physics columns); it is normalised over a target's edges, and weighs the source's projection.
    """
    outs = len(weights[0])
    heads = F.array(*[F.struct(F.lit(h).alias("head"), *[sum((F.col(c) * w for c, w in zip(inputs, row)), F.lit(0.0)).alias(f"c{o}") for o, row in enumerate(weights[h])],
                               F.array(*[F.lit(a) for a in att[h]]).alias("att")) for h in range(len(weights))])
    flat = nodes.select("tile", "id", *physics, F.explode(heads).alias("p")).select("tile", "id", *physics, "p.*")
    names = [f"c{o}" for o in range(outs)]
    a = flat.select("tile", "head", F.col("id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in [*names, *physics]])
    b = flat.select("tile", "head", F.col("id").alias("dst"), "att", *[F.col(c).alias(f"b_{c}") for c in [*names, *physics]])
    rows = edges.join(a, ["tile", "src"]).join(b, ["tile", "head", "dst"])
    leaky = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(slope * F.col(c))
    logit = sum((F.col("att")[i] * leaky(f"b_{c}") for i, c in enumerate(names)), F.lit(0.0)) + sum((F.col("att")[outs + i] * leaky(f"a_{c}") for i, c in enumerate(names)), F.lit(0.0))
    near = F.exp(-sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in physics), F.lit(0.0)))
    rows = rows.withColumn("__l", logit + boost * near)
    into = Window.partitionBy("tile", "head", "dst")
    rows = rows.withColumn("__e", F.exp(F.col("__l") - F.max("__l").over(into))).withColumn("__w", F.col("__e") / F.sum("__e").over(into))
    return rows.groupBy("tile", F.col("dst").alias("id"), "head").agg(*[F.sum(F.col("__w") * F.col(f"a_{c}")).alias(c) for c in names])

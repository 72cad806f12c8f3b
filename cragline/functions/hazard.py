"""Column expressions for normalising, labelling and fusing hazard layers. Nothing here shuffles by itself.

Functions that need a tile's extremes or means take a ``Window`` over the tile.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Risk of each terrain class, by class id, and class names.
CLASS_RISK = {0: 0.15, 1: 0.90, 2: 0.85, 3: 0.80, 4: 0.50, 5: 0.55, 6: 0.85, 7: 0.45}
CLASS_NAMES = ("other", "crater", "dark_dune", "slope_streak", "bright_dune", "impact_ejecta", "swiss_cheese", "spider")
HAZARD_RISK = 0.7


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def minmax(v: Column, tile: WindowSpec, eps: float = 1e-8) -> Column:
    """Value between the tile's extremes; a constant tile gives 0."""
    low, high = F.min(v).over(tile), F.max(v).over(tile)
    return (v - low) / (high - low + eps)


def minmax_or_zero(v: Column, tile: WindowSpec, flat: float = 1e-6) -> Column:
    """Value between the tile's extremes; 0 where the tile's range is under ``flat``."""
    low, high = F.min(v).over(tile), F.max(v).over(tile)
    return F.when(high - low < flat, F.lit(0.0)).otherwise((v - low) / (high - low))


def zscore(v: Column, tile: WindowSpec, eps: float = 1e-8) -> Column:
    return (v - F.avg(v).over(tile)) / (F.stddev_pop(v).over(tile) + eps)


def filled(v: Column, tile: WindowSpec) -> Column:
    """Nulls become the tile's mean of valid values, 0 where there is none."""
    return F.coalesce(v, F.avg(v).over(tile), F.lit(0.0))


def valid(v: Column, nodata: float | None = None) -> Column:
    """Whether a raw elevation is data: unlike the declared sentinel, or above the float sentinels' range."""
    return F.coalesce(v != nodata, F.lit(False)) if nodata is not None else F.coalesce(v > -1e30, F.lit(False))


def risk_label(slope: Column, rough: Column, ok: Column, slope_limit: float = 30.0, rough_limit: float = 3.0) -> Column:
    """The larger of clipped slope and roughness shares, within 0.05 and 0.95; null on invalid pixels."""
    risk = F.greatest(clip(slope / slope_limit, 0.0, 1.0), clip(rough / rough_limit, 0.0, 1.0))
    return F.when(ok, clip(risk, 0.05, 0.95))


def hazard_mask(slope: Column, rough: Column, ok: Column, slope_limit: float = 15.0, rough_limit: float = 1.0) -> Column:
    return F.when(ok & ((slope > slope_limit) | (rough > rough_limit)), 1).otherwise(0)


def cleaned(risk: Column, low: float = 0.05) -> Column:
    """NaN and null become ``low``."""
    return F.coalesce(F.when(~F.isnan(risk), risk), F.lit(low))


def physics(slope: Column, rough: Column, disc: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    return clip(slope * weights[0] + rough * weights[1] + disc * weights[2], 0.0, 1.0)


def fused(learned: Column, phys: Column, alpha: Column | float) -> Column:
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return alpha * learned + (1 - alpha) * phys


def tier(c: Column, flat: float = 0.25, hazard: float = 0.60) -> Column:
    """0 below ``flat``, 2 above ``hazard``, else 1: both bounds belong to 1."""
    return F.when(c < flat, 0).when(c > hazard, 2).otherwise(1)


def budget(c: Column, low: int = 8, high: int = 64, gamma: float = 1.5) -> Column:
    """Nodes of a block by a power law, rounded half to even."""
    return F.bround(low + (high - low) * F.pow(clip(c, 0.0, 1.0), F.lit(gamma)), 0).cast("int")


def stepped_budget(c: Column, flat: float = 0.25, hazard: float = 0.60) -> Column:
    steep = F.floor(30 + (c - hazard) / max(1 - hazard, 1e-6) * 20)
    return F.when(c < flat, 5).when(c > hazard, F.least(F.greatest(steep, F.lit(30)), F.lit(50))).otherwise(15).cast("int")


def hazardous(risk: Column, over: float = HAZARD_RISK) -> Column:
    return risk > over


def class_risk(class_id: Column) -> Column:
    """Risk of a class id; an unknown one raises an error when it is evaluated, null stays null."""
    table = F.create_map(*[x for k, v in CLASS_RISK.items() for x in (F.lit(k), F.lit(v))])
    found = F.element_at(table, class_id.cast("int"))
    return F.when(class_id.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(found, F.raise_error(F.concat(F.lit("unknown class "), class_id.cast("string"))).cast("double")))


def class_name_risk(name: Column) -> Column:
    """Risk of a class by its name; null for an unknown one."""
    table = F.create_map(*[x for n, k in zip(CLASS_NAMES, CLASS_RISK) for x in (F.lit(n), F.lit(CLASS_RISK[k]))])
    return F.try_element_at(table, name)


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def cooled(p: Column, temperature: float) -> Column:
    """Temperature scaling of a probability."""
    return 1 / (1 + F.exp(-logit(p) / temperature))


def attribution(alpha: Column) -> Column:
    return F.when(alpha < 0.5, F.lit("physics")).otherwise(F.lit("cnn"))


def correlation_verdict(r: Column) -> Column:
    return F.when(r > 0.60, F.lit("validated")).when(r < 0.50, F.lit("limitation")).otherwise(F.lit("marginal"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**")).when(p < 0.05, F.lit("*")).otherwise(F.lit("ns"))


def block(coordinate: Column, size: int = 32, blocks: int | None = None) -> Column:
    """Index of the block that a coordinate lies in, held inside the grid."""
    i = F.floor(coordinate / size).cast("int")
    return i if blocks is None else F.least(i, F.lit(blocks - 1))


def mirror(i: Column, n: Column | int) -> Column:
    """Index folded at the border without repeating the edge pixel; for overruns below n."""
    return (n - 1) - F.abs((n - 1) - F.abs(i))


def mirror_edge(i: Column, n: Column | int) -> Column:
    """Index folded at the border with the edge pixel repeated; for overruns up to n."""
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)

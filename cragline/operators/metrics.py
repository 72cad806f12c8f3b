"""Aggregate expressions and small plans for segmentation, calibration, ranking, loss and path metrics.

Most return Columns for one ``groupBy().agg()``, so a whole family of metrics costs one partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.functions.hazard import clip
from cragline.operators.ranks import running

EPS = 1e-6


def confusion(p: Column, t: Column, mask: Column | None = None, p_over: float = 0.5, t_over: float = 0.7) -> dict[str, Column]:
    """Counts of the four cases; rows outside ``mask`` don't count."""
    ok = F.lit(True) if mask is None else mask
    a, b = p > p_over, t > t_over
    return {"tp": F.count_if(ok & a & b), "fp": F.count_if(ok & a & ~b), "fn": F.count_if(ok & ~a & b), "tn": F.count_if(ok & ~a & ~b)}


def segmentation(c: dict[str, Column]) -> dict[str, Column]:
    """Recall, precision, F1, mean IoU and safe recall from the counts (columns or aggregates)."""
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    return {
        "recall": tp / (tp + fn + EPS), "precision": tp / (tp + fp + EPS), "f1": 2 * tp / (2 * tp + fp + fn + EPS),
        "miou": (tp / (tp + fp + fn + EPS) + tn / (tn + fp + fn + EPS)) / 2, "safe_recall": tn / (tn + fp + EPS),
    }


def weighted_bce(p: Column, t: Column, valid: Column, weight: float = 5.0) -> Column:
    q = clip(p, EPS, 1 - EPS)
    loss = -F.when(t > 0.7, F.lit(weight)).otherwise(F.lit(1.0)) * (t * F.ln(q) + (1 - t) * F.ln(1 - q))
    return F.sum(F.when(valid, loss).otherwise(F.lit(0.0))) / F.greatest(F.count_if(valid), F.lit(1))


def soft_dice(p: Column, t: Column) -> Column:
    return 1 - (2 * F.sum(p * t) + 1) / (F.sum(p) + F.sum(t) + 1)


def auc(rows: DataFrame, by: list[str], p: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by mid-ranks; 0 where a group has one class only.

    Equal scores are summed first, so only distinct scores are ranked, and no task ranks a large group alone (see ``ranks.running``).
    """
    counts = rows.groupBy(*by, F.col(p).alias("__p")).agg(F.count_if(positive).alias("__a"), F.count_if(~positive).alias("__b"))
    counts = running(counts, by, "__p", ["__b"])
    area = F.sum(F.col("__a") * (F.col("before___b") + F.col("__b") / 2.0)) / (F.sum("__a").cast("double") * F.sum("__b"))
    return counts.groupBy(*by).agg(F.when((F.sum("__a") > 0) & (F.sum("__b") > 0), area).otherwise(F.lit(0.0)).alias("auc"))


def average_precision(rows: DataFrame, by: list[str], p: str, positive: Column) -> DataFrame:
    """Sum of precision times the step in recall, by descending distinct score."""
    counts = rows.groupBy(*by, (-F.col(p)).alias("__p")).agg(F.count_if(positive).alias("__a"), F.count(F.lit(1)).alias("__n"))
    counts = running(counts, by, "__p", ["__a", "__n"])
    precision = (F.col("before___a") + F.col("__a")) / (F.col("before___n") + F.col("__n"))
    return counts.groupBy(*by).agg(F.coalesce(F.sum(F.col("__a") * precision) / F.nullif(F.sum("__a"), F.lit(0)), F.lit(0.0)).alias("ap"))


def _edges(bins: int) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def binned(p: Column, bins: int = 10, right_closed: bool = False) -> Column:
    """Bin of a probability, from 0: [low, high), or (low, high]; null outside (1, or 0, falls out)."""
    edges = _edges(bins)
    out = F.when(F.lit(False), 0)
    for k in range(bins):
        inside = (p > edges[k]) & (p <= edges[k + 1]) if right_closed else (p >= edges[k]) & (p < edges[k + 1])
        out = out.when(inside, k)
    return out


def calibration(rows: DataFrame, by: list[str], p: Column, label: Column, bins: int = 10, right_closed: bool = False) -> DataFrame:
    """Expected and maximum calibration error; rows that fall out of the bins still count in the total."""
    counts = rows.select(*by, binned(p, bins, right_closed).alias("__bin"), p.alias("__p"), label.cast("double").alias("__y")).groupBy(*by, "__bin").agg(
        F.count(F.lit(1)).alias("__n"), F.abs(F.avg("__p") - F.avg("__y")).alias("__gap"))
    gap = F.when(F.col("__bin").isNotNull(), F.col("__gap"))
    return counts.groupBy(*by).agg((F.coalesce(F.sum(F.col("__n") * gap), F.lit(0.0)) / F.sum("__n")).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"))


def reliability(rows: DataFrame, p: Column, label: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of the bins that have rows."""
    rows = rows.select(binned(p, bins, True).alias("bin"), p.alias("p"), label.cast("double").alias("y")).where("bin IS NOT NULL")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))


def path_metrics(rows: DataFrame, path: str, seq: str, x: str, y: str) -> DataFrame:
    """Length, straight distance and their ratio of each path (0 with one point; 1 where the ends meet)."""
    w = Window.partitionBy(path).orderBy(seq)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    rows = rows.withColumn("__step", step)
    first, last = F.min_by(F.struct(x, y), seq), F.max_by(F.struct(x, y), seq)
    out = rows.groupBy(path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("length"), first.alias("a"), last.alias("b"))
    out = out.withColumn("straight", F.sqrt(F.pow(F.col(f"b.{x}") - F.col(f"a.{x}"), 2) + F.pow(F.col(f"b.{y}") - F.col(f"a.{y}"), 2)))
    ratio = F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("straight") < 1e-8, F.lit(1.0)).otherwise(F.col("length") / F.col("straight"))
    return out.select(path, "n", "length", "straight", ratio.alias("ratio"))


def crossing_by_tier(risk: Column, tier: Column, over: float = 0.7) -> dict[str, Column]:
    """Share of waypoints on hazardous ground, overall and by tier; an unknown tier counts as 0, an empty one gives 0."""
    t = F.when(tier.isin(0, 1, 2), tier).otherwise(0)
    hit = (risk > over).cast("double")
    return {"all": F.coalesce(F.avg(hit), F.lit(0.0))} | {f"tier{k}": F.coalesce(F.avg(F.when(t == k, hit)), F.lit(0.0)) for k in range(3)}


def failures(rows: DataFrame, tile: str, physics: Column, learned: Column, alpha: Column, uncertainty: Column, shadow: int = 50) -> DataFrame:
    """Failure flags of each tile: hazard that only the physics sees, collapsed fusion, saturated uncertainty."""
    return rows.groupBy(tile).agg(
        (F.count_if((physics > 0.7) & (learned < 0.3)) > shadow).alias("crater_shadow"), (F.stddev_pop(alpha) < 0.02).alias("alpha_collapse"),
        (F.avg((uncertainty > 0.8).cast("double")) > 0.5).alias("uncertainty_saturation"))

"""Statistical comparisons: bootstrap, paired tests, trends and seed aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cragline.operators.ranks import running


#: Modulus, multiplier and shift of the numbers that draw weights (the first powers of the multiplier are too small to mix), and the bounds below which Poisson's distribution with mean 1 gives 0, 1, 2, ...
PRIME, STEP, FIRST, SHIFT = 2**31 - 1, 48271, 16, 16807
BOUNDS = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def drawn_weight(key: Column, draw: Column, draws: int) -> Column:
    """How often a row is in a resample: Poisson with mean 1, from (key * STEP^(draw + FIRST) + SHIFT * (draw + 1)) mod PRIME, so that any engine draws the same."""
    powers = F.array(*[F.lit(pow(STEP, b + FIRST, PRIME)).cast("long") for b in range(draws)])
    number = F.pmod(F.pmod(key, F.lit(PRIME)) * F.get(powers, draw) + SHIFT * (draw + 1), F.lit(PRIME))
    out = F.when(number < BOUNDS[0], 0)
    for k, bound in enumerate(BOUNDS[1:], 1):
        out = out.when(number < bound, k)
    return out.otherwise(len(BOUNDS))


def bootstrap_interval(rows: DataFrame, by: list[str], value: str, key: str, draws: int = 200, level: float = 0.95) -> DataFrame:
    """mean, low and high of each group from the means of ``draws`` resamples in which each row has a whole weight of its own.

    A row's weights follow from its integer ``key`` alone (see ``drawn_weight``; rows of one key share them), so resamples are weighted sums: summed
    where the rows lie, a row for each group, resample and task is shuffled, and nothing is joined, ordered or numbered, whatever a group's size. Null values
    don't count; resamples without a row are left out, limits are linear between the nearest means. Draw -1 stands for the rows themselves.
    """
    given = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), F.col(key).cast("long").alias("__k"), F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("__b"))
    given = given.select(*by, "__b", "__v", F.when(F.col("__b") < 0, 1).otherwise(drawn_weight(F.col("__k"), F.col("__b"), draws)).alias("__w")).where("__w > 0")
    means = given.groupBy(*by, "__b").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("__m"))
    drawn, edge = F.when(F.col("__b") >= 0, F.col("__m")), (1 - level) / 2
    found = means.groupBy(*by).agg(F.max(F.when(F.col("__b") < 0, F.col("__m"))).alias("mean"), F.percentile(drawn, F.lit(edge)).alias("low"), F.percentile(drawn, F.lit(1 - edge)).alias("high"))
    return found.where("mean IS NOT NULL")


def paired_t(d: Column) -> dict[str, Column]:
    """t statistic and degrees of freedom of paired differences."""
    n = F.count(d)
    return {"t": F.avg(d) / (F.stddev_samp(d) / F.sqrt(n)), "df": (n - 1).cast("double")}


def wilcoxon(rows: DataFrame, by: list[str], d: str) -> DataFrame:
    """Signed-rank statistic min(W+, W-) and the number of differences other than 0, by mid-ranks of absolute differences.

    Equal absolute differences are counted first and share their mid-rank; no task ranks a large group alone (see ``ranks.running``).
    """
    counts = rows.where(F.col(d) != 0).groupBy(*by, F.abs(d).alias("__a")).agg(F.count_if(F.col(d) > 0).alias("__plus"), F.count(F.lit(1)).alias("__n"))
    rank = F.col("before___n") + (F.col("__n") + 1) / 2.0
    plus, minus = F.sum(F.col("__plus") * rank), F.sum((F.col("__n") - F.col("__plus")) * rank)
    return running(counts, by, "__a", ["__n"]).groupBy(*by).agg(F.least(plus, minus).alias("w"), F.sum("__n").alias("n"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; a result table has a row for each comparison, so this is never a hot path."""
    return pd.Series([None if pd.isna(a) or pd.isna(n) or n <= 0 else _beta(n / 2, 0.5, n / (n + a * a)) for a, n in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def wilcoxon_p_value(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of the signed-rank statistic by the normal approximation."""
    def one(s: float, k: float) -> float | None:
        sd = math.sqrt(k * (k + 1) * (2 * k + 1) / 24)
        return math.erfc(abs(s - k * (k + 1) / 4) / sd / math.sqrt(2)) if sd else None
    return pd.Series([one(a, k) for a, k in zip(w, n)], dtype="float64")


def seed_aggregate(rows: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and population deviation of each metric over the records that have it."""
    return rows.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def fitted_temperature(rows: DataFrame, logit: str, label: str, start: float = 1.5, rounds: int = 12) -> float:
    """Temperature with the least cross-entropy, by Newton steps on its inverse; each step is one aggregate over ``rows``."""
    beta = 1 / start
    for _ in range(rounds):
        z, y = F.col(logit), F.col(label).cast("double")
        p = 1 / (1 + F.exp(-z * beta))
        row = rows.agg(F.avg((p - y) * z).alias("g"), F.avg(p * (1 - p) * z * z).alias("h")).first()
        if not row["h"]:
            break
        step = row["g"] / row["h"]
        beta = max(beta - step, beta / 4)
        if abs(step) < 1e-9:
            break
    return 1 / beta

"""Queries for metrics, statistics, rollups and experiment grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import hazard as hz
from cragline.operators import metrics as m
from cragline.operators import raster, stats
from cragline.plans.fixtures import nodes, pixels, samples, scores, table, waypoints, with_tables
from cragline.plans.registry import query, r

COUNTS = "sum(CASE WHEN {k} AND p > 0.5 AND t > 0.7 THEN 1.0 ELSE 0.0 END) AS tp, sum(CASE WHEN {k} AND p > 0.5 AND NOT t > 0.7 THEN 1.0 ELSE 0.0 END) AS fp, sum(CASE WHEN {k} AND NOT p > 0.5 AND t > 0.7 THEN 1.0 ELSE 0.0 END) AS fn, sum(CASE WHEN {k} AND NOT p > 0.5 AND NOT t > 0.7 THEN 1.0 ELSE 0.0 END) AS tn"
SEG = "round(tp / (tp + fn + 1e-6), 6) AS recall, round(tp / (tp + fp + 1e-6), 6) AS precision, round(2 * tp / (2 * tp + fp + fn + 1e-6), 6) AS f1, round((tp / (tp + fp + fn + 1e-6) + tn / (tn + fp + fn + 1e-6)) / 2, 6) AS miou, round(tn / (tn + fp + 1e-6), 6) AS safe_recall"


def _segmentation(rows: DataFrame, by: list[str], mask=None) -> DataFrame:
    return rows.groupBy(*by).agg(*[r(c).alias(n) for n, c in m.segmentation(m.confusion(F.col("p"), F.col("t"), mask)).items()])


@query(with_tables(f"SELECT tile, {SEG} FROM (SELECT tile, {COUNTS.format(k='true')} FROM score GROUP BY tile)", "score"))
def m01_m02_m03_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return _segmentation(scores(spark, d), ["tile"])


@query(with_tables(f"SELECT split, {SEG} FROM (SELECT split, {COUNTS.format(k='valid')} FROM score GROUP BY split)", "score"))
def m03_masked_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return _segmentation(scores(spark, d), ["split"], F.col("valid"))


HIT = "CASE WHEN risk > 0.7 THEN 1.0 ELSE 0.0 END"


@query(with_tables(f"SELECT path, round(avg({HIT}), 6) AS hcr FROM waypoint GROUP BY path", "waypoint"))
def m04_crossing_rate(spark: SparkSession, d: str) -> DataFrame:
    return waypoints(spark, d).groupBy("path").agg(r(m.crossing_by_tier(F.col("risk"), F.col("tier"))["all"]).alias("hcr"))


@query(with_tables("""SELECT path, n, round(coalesce(length, 0), 4) AS length, round(straight, 4) AS straight, round(CASE WHEN n < 2 THEN 0 WHEN straight < 1e-8 THEN 1 ELSE length / straight END, 4) AS ratio FROM
 (SELECT path, count(*) AS n, sum(step) AS length, sqrt(pow(max_by(x, seq) - min_by(x, seq), 2) + pow(max_by(y, seq) - min_by(y, seq), 2)) AS straight FROM
 (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM waypoint WINDOW w AS (PARTITION BY path ORDER BY seq)) GROUP BY path)""", "waypoint"))
def m05_path_length_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = m.path_metrics(waypoints(spark, d), "path", "seq", "x", "y")
    return out.select("path", "n", *[r(F.col(c), 4).alias(c) for c in ("length", "straight", "ratio")])


@query(with_tables(f"""SELECT path, round(avg({HIT}), 6) AS h_all, {', '.join(f"round(coalesce(avg(CASE WHEN k = {k} THEN {HIT} END), 0), 6) AS h_tier{k}" for k in range(3))}
 FROM (SELECT *, CASE WHEN tier IN (0, 1, 2) THEN tier ELSE 0 END AS k FROM waypoint) GROUP BY path""", "waypoint"))
def m06_crossing_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return waypoints(spark, d).groupBy("path").agg(*[r(c).alias(f"h_{n}") for n, c in m.crossing_by_tier(F.col("risk"), F.col("tier")).items()])


@query(with_tables("SELECT tile, round(avg(abs(p - t)), 6) AS mae FROM score GROUP BY tile", "score"))
def m07_mae(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("tile").agg(r(F.avg(F.abs(F.col("p") - F.col("t")))).alias("mae"))


@query(with_tables("""SELECT tile, round(CASE WHEN np = 0 OR nn = 0 THEN 0 ELSE (s - np * (np + 1) / 2) / (np * nn) END, 6) AS auc FROM (SELECT tile, sum(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END) AS np, sum(CASE WHEN t > 0.7 THEN 0.0 ELSE 1.0 END) AS nn,
 sum(CASE WHEN t > 0.7 THEN rk ELSE 0 END) AS s FROM (SELECT *, rank() OVER (PARTITION BY tile ORDER BY p) + (count(*) OVER (PARTITION BY tile, p) - 1) / 2.0 AS rk FROM score) GROUP BY tile)""", "score"))
def m08_auc(spark: SparkSession, d: str) -> DataFrame:
    return m.auc(scores(spark, d), ["tile"], "p", F.col("t") > 0.7).select("tile", r(F.col("auc")).alias("auc"))


@query(with_tables("""SELECT tile, round(coalesce(sum(a * prec) / nullif(sum(a), 0), 0), 6) AS ap FROM (SELECT tile, a, sum(a) OVER w / sum(n) OVER w AS prec FROM (SELECT tile, p, sum(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM score GROUP BY tile, p)
 WINDOW w AS (PARTITION BY tile ORDER BY p DESC)) GROUP BY tile""", "score"))
def m09_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return m.average_precision(scores(spark, d), ["tile"], "p", F.col("t") > 0.7).select("tile", r(F.col("ap")).alias("ap"))


EDGES = "edges AS (SELECT k, k * 0.1::DOUBLE AS lo, CASE WHEN k = 9 THEN 1.0::DOUBLE ELSE (k + 1) * 0.1::DOUBLE END AS hi FROM range(0, 10) g(k))"


@query(with_tables(f"WITH {EDGES} SELECT split, round(sum(n * gap) / max(total), 6) AS ece FROM (SELECT split, k, count(*) AS n, abs(avg(p) - avg(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END)) AS gap FROM score JOIN edges ON p >= lo AND p < hi GROUP BY split, k) JOIN (SELECT split, count(*) AS total FROM score GROUP BY split) USING (split) GROUP BY split", "score"))
def m10_ece(spark: SparkSession, d: str) -> DataFrame:
    return m.calibration(scores(spark, d), ["split"], F.col("p"), F.col("t") > 0.7).select("split", r(F.col("ece")).alias("ece"))


@query(with_tables(f"WITH {EDGES} SELECT split, round(sum(n * gap) / max(total), 6) AS ece, round(max(gap), 6) AS mce, round(max(brier), 6) AS brier FROM (SELECT split, k, count(*) AS n, abs(avg(p) - avg(t)) AS gap FROM score JOIN edges ON p > lo AND p <= hi GROUP BY split, k) JOIN (SELECT split, count(*) AS total, avg(pow(p - t, 2)) AS brier FROM score GROUP BY split) USING (split) GROUP BY split", "score"))
def m11_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d)
    out = m.calibration(rows, ["split"], F.col("p"), F.col("t"), right_closed=True).join(rows.groupBy("split").agg(F.avg(F.pow(F.col("p") - F.col("t"), 2)).alias("brier")), "split")
    return out.select("split", *[r(F.col(c)).alias(c) for c in ("ece", "mce", "brier")])


@query(with_tables(f"WITH {EDGES} SELECT CAST(k AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM score JOIN edges ON p > lo AND p <= hi GROUP BY k", "score"))
def m11_reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return m.reliability(scores(spark, d), F.col("p"), F.col("t") > 0.7).select("bin", "n", r(F.col("confidence")).alias("confidence"), r(F.col("accuracy")).alias("accuracy"))


def _temperature_sql(rounds: int = 12) -> str:
    """Newton steps on the inverse temperature, one table a round."""
    clipped = "least(greatest(p, 1e-7), 1 - 1e-7)"
    steps = [f"z AS (SELECT ln({clipped} / (1 - {clipped})) AS z, CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END AS y FROM score)", "b0 AS (SELECT 1 / 1.5 AS beta)"]
    for i in range(rounds):
        steps.append(f"b{i + 1} AS (SELECT CASE WHEN h = 0 THEN beta ELSE greatest(beta - g / h, beta / 4) END AS beta FROM (SELECT any_value(beta) AS beta, avg((q - y) * z) AS g, avg(q * (1 - q) * z * z) AS h "
                     f"FROM (SELECT beta, z, y, 1 / (1 + exp(-z * beta)) AS q FROM z, b{i})))")
    return f"WITH {', '.join(steps)} SELECT round(1 / beta, 6) AS temperature FROM b{rounds}"


@query(with_tables(_temperature_sql(), "score"))
def m12_temperature_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).select(hz.logit(F.col("p")).alias("z"), (F.col("t") > 0.7).alias("y"))
    return spark.createDataFrame([(stats.fitted_temperature(rows, "z", "y"),)], "temperature double").select(r(F.col("temperature")).alias("temperature"))


#: Resamples of the rows of o (g, k, v): each row's whole weight in each, by the same numbers as in Spark.
RESAMPLED = f"""draws AS (SELECT 0 AS b, {pow(stats.STEP, stats.FIRST, stats.PRIME)}::BIGINT AS m UNION ALL SELECT b + 1, (m * {stats.STEP}) % {stats.PRIME} FROM draws WHERE b < 199),
 drawn AS (SELECT g, b, v, (k * m + {stats.SHIFT} * (b + 1)) % {stats.PRIME} AS u FROM o, draws),
 b AS (SELECT g, b, sum(w * v) / nullif(sum(w), 0) AS mean FROM (SELECT g, b, v, {' + '.join(f'CAST(u >= {x} AS INT)' for x in stats.BOUNDS)} AS w FROM drawn) GROUP BY g, b)"""


@query(f"""WITH RECURSIVE o AS (SELECT c_nationkey % 5 AS g, c_custkey AS k, c_acctbal AS v FROM customer), {RESAMPLED}
 SELECT CAST(g AS INT) AS g, round(max(o.v), 4) AS mean, round(quantile_cont(b.mean, 0.025), 4) AS low, round(quantile_cont(b.mean, 0.975), 4) AS high FROM b JOIN (SELECT g, avg(v) AS v FROM o GROUP BY g) o USING (g) GROUP BY g""")
def m13_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select((F.col("c_nationkey") % 5).cast("int").alias("g"), "c_custkey", "c_acctbal")
    return stats.bootstrap_interval(rows, ["g"], "c_acctbal", "c_custkey").select("g", *[r(F.col(c), 4).alias(c) for c in ("mean", "low", "high")])


PAIRS = "pairs AS (SELECT k, a - b AS d, k % 2 AS g FROM (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS b FROM supplier GROUP BY 1) USING (k))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("b"))
    return a.join(b, "k").select("k", (F.col("a") - F.col("b")).alias("d"), (F.col("k") % 2).cast("int").alias("g"))


@query(f"WITH {PAIRS} SELECT CAST(g AS INT) AS g, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM pairs GROUP BY g")
def m14_paired_t(spark: SparkSession, d: str) -> DataFrame:
    t = stats.paired_t(F.col("d"))
    return _pairs(spark, d).groupBy("g").agg(r(t["t"]).alias("t"), t["df"].alias("df"))


@query(f"WITH {PAIRS} SELECT CAST(g AS INT) AS g, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w, count(*) AS n FROM (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS rk FROM pairs WHERE d <> 0) GROUP BY g")
def m15_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(_pairs(spark, d), ["g"], "d")


#: Student's t by its finite sums for whole degrees of freedom (v), and the error function by its series; independent of the operator's continued fraction.
SIGNIFICANCE = f"""WITH RECURSIVE {PAIRS}, o AS (SELECT g, k, d AS v FROM pairs), {RESAMPLED},
 ends AS (SELECT g, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM b GROUP BY g),
 t AS (SELECT g, avg(d) AS mean, atan(abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) / sqrt(count(*) - 1)) AS a, count(*) - 1 AS v FROM pairs GROUP BY g),
 terms AS (SELECT g, a, v, CASE WHEN v % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(a), 2 * j) ELSE sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos(a), 2 * j + 1) END AS term
  FROM t, range(0, 500) r(j) WHERE 2 * j <= v - 2 - v % 2),
 p AS (SELECT t.g, 1 - CASE WHEN t.v % 2 = 0 THEN sin(t.a) * s ELSE 2 / pi() * (t.a + sin(t.a) * s) END AS p FROM t JOIN (SELECT g, sum(term) AS s FROM terms GROUP BY g) USING (g)),
 w AS (SELECT g, abs(least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0) / sqrt(2) AS x
  FROM (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS rk FROM pairs WHERE d <> 0) GROUP BY g),
 q AS (SELECT g, 1 - 2 / sqrt(pi()) * sum((CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * j + 1) * ln(greatest(x, 1e-300)) - lgamma(j + 1)) / (2 * j + 1)) AS p_rank FROM w, range(0, 100) r(j) GROUP BY g)
 SELECT CAST(t.g AS INT) AS g, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high, round(p, 6) AS p, round(p_rank, 6) AS p_rank,
 CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, printf('%.4f [%.4f, %.4f]', mean, low, high) AS text FROM t JOIN ends USING (g) JOIN p USING (g) JOIN q USING (g)"""


@query(SIGNIFICANCE)
def m16_significance_table(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference, interval, p-values of both tests and stars for each condition."""
    pairs = _pairs(spark, d)
    t = stats.paired_t(F.col("d"))
    out = pairs.groupBy("g").agg(t["t"].alias("t"), t["df"].alias("df")).join(stats.bootstrap_interval(pairs, ["g"], "d", "k"), "g").join(stats.wilcoxon(pairs, ["g"], "d"), "g")
    out = out.withColumn("p", stats.t_p_value("t", "df")).withColumn("p_rank", stats.wilcoxon_p_value("w", "n"))
    return out.select("g", *[r(F.col(c), 4).alias(c) for c in ("mean", "low", "high")], r(F.col("p")).alias("p"), r(F.col("p_rank")).alias("p_rank"), hz.stars(F.col("p")).alias("stars"),
                      F.format_string("%.4f [%.4f, %.4f]", "mean", "low", "high").alias("text"))


@query(with_tables(f"WITH h AS (SELECT path % 2 AS g, avg({HIT}) AS hcr FROM waypoint GROUP BY 1) SELECT round(max(CASE WHEN g = 0 THEN hcr END) - max(CASE WHEN g = 1 THEN hcr END), 6) AS delta FROM h", "waypoint"))
def m17_delta(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("risk") > 0.7).cast("double")
    return waypoints(spark, d).agg(r(F.avg(F.when(F.col("path") % 2 == 0, hit)) - F.avg(F.when(F.col("path") % 2 == 1, hit))).alias("delta"))


PER_SEED = "per AS (SELECT seed, 'mae' AS metric, avg(abs(p - t)) AS v FROM score GROUP BY seed UNION ALL SELECT seed, 'brier', avg(pow(p - t, 2)) FROM score WHERE seed <> 3 GROUP BY seed)"


@query(with_tables(f"WITH {PER_SEED} SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM per GROUP BY metric", "score"))
def m18_seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).groupBy("seed").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"), F.avg(F.when(F.col("seed") != 3, F.pow(F.col("p") - F.col("t"), 2))).alias("brier"))
    out = stats.seed_aggregate(rows.unpivot("seed", ["mae", "brier"], "metric", "v"), "metric", "v")
    return out.select("metric", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"))


@query(with_tables("SELECT split, round(avg(mae), 6) AS mae, count(*) AS n_tiles, round(avg(CASE WHEN mae IS NULL THEN 0.0 ELSE 1.0 END), 6) AS success_rate FROM (SELECT split, tile, CASE WHEN tile % 5 = 0 THEN NULL ELSE avg(abs(p - t)) END AS mae FROM score GROUP BY split, tile) GROUP BY split", "score"))
def m19_split_aggregate(spark: SparkSession, d: str) -> DataFrame:
    per = scores(spark, d).groupBy("split", "tile").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae")).withColumn("mae", F.when(F.col("tile") % 5 != 0, F.col("mae")))
    return per.groupBy("split").agg(r(F.avg("mae")).alias("mae"), F.count(F.lit(1)).alias("n_tiles"), r(F.avg(F.col("mae").isNotNull().cast("double"))).alias("success_rate"))


_PARTS = (SEG.replace("round(", "(").replace(", 6)", ")"), COUNTS.format(k="true"))


@query(with_tables(f"""WITH {EDGES}, seg AS (SELECT tile, {_PARTS[0]} FROM (SELECT tile, {_PARTS[1]} FROM score GROUP BY tile)), err AS (SELECT tile, avg(abs(p - t)) AS mae, count(*) AS total FROM score GROUP BY tile),
 roc AS (SELECT tile, CASE WHEN np = 0 OR nn = 0 THEN 0 ELSE (s - np * (np + 1) / 2) / (np * nn) END AS auc FROM (SELECT tile, sum(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END) AS np, sum(CASE WHEN t > 0.7 THEN 0.0 ELSE 1.0 END) AS nn,
 sum(CASE WHEN t > 0.7 THEN rk ELSE 0 END) AS s FROM (SELECT *, rank() OVER (PARTITION BY tile ORDER BY p) + (count(*) OVER (PARTITION BY tile, p) - 1) / 2.0 AS rk FROM score) GROUP BY tile)),
 cal AS (SELECT tile, sum(n * gap) AS g, max(gap) AS mce FROM (SELECT tile, k, count(*) AS n, abs(avg(p) - avg(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END)) AS gap FROM score JOIN edges ON p >= lo AND p < hi GROUP BY tile, k) GROUP BY tile),
 wide AS (SELECT tile, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision, CAST(f1 AS DOUBLE) AS f1, CAST(miou AS DOUBLE) AS miou, CAST(safe_recall AS DOUBLE) AS safe_recall, mae, CAST(auc AS DOUBLE) AS auc, g / total AS ece, mce FROM seg JOIN err USING (tile) JOIN roc USING (tile) JOIN cal USING (tile))
 SELECT tile, metric, round(value, 6) AS value FROM (UNPIVOT wide ON recall, precision, f1, miou, safe_recall, mae, auc, ece, mce INTO NAME metric VALUE value)""", "score"))
def m20_tile_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """All tile metrics in long form (tile, metric, value): one aggregate for the counts, one ranking, one binning."""
    rows = scores(spark, d)
    wide = rows.groupBy("tile").agg(*[c.alias(n) for n, c in m.segmentation(m.confusion(F.col("p"), F.col("t"))).items()], F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))
    wide = wide.join(m.auc(rows, ["tile"], "p", F.col("t") > 0.7), "tile").join(m.calibration(rows, ["tile"], F.col("p"), F.col("t") > 0.7), "tile")
    return wide.unpivot("tile", [c for c in wide.columns if c != "tile"], "metric", "value").withColumn("value", r(F.col("value")))


@query("""SELECT lang, round(avg(CASE WHEN (risk > 0.7) = (mean > 0.1) THEN 1.0 ELSE 0.0 END), 6) AS class_accuracy, count(*) AS n FROM (SELECT lang, CASE doc_id % 8 WHEN 0 THEN 0.15 WHEN 1 THEN 0.90 WHEN 2 THEN 0.85 WHEN 3 THEN 0.80 WHEN 4 THEN 0.50 WHEN 5 THEN 0.55 WHEN 6 THEN 0.85 ELSE 0.45 END AS risk,
 CAST(quality AS DOUBLE) AS mean FROM documents JOIN labels USING (doc_id)) GROUP BY lang""")
def m21_crop_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", hz.class_risk((F.col("doc_id") % 8).cast("int")).alias("risk"), F.col("quality").cast("double").alias("mean"))
    return rows.groupBy("lang").agg(r(F.avg(((F.col("risk") > 0.7) == (F.col("mean") > 0.1)).cast("double"))).alias("class_accuracy"), F.count(F.lit(1)).alias("n"))


@query(with_tables("SELECT round((SELECT avg(abs(p - t)) FROM score WHERE split = 'F') - (SELECT avg(abs(p - t)) FROM score WHERE split = 'O'), 6) AS gap", "score"))
def m22_domain_gap(spark: SparkSession, d: str) -> DataFrame:
    e = F.abs(F.col("p") - F.col("t"))
    return scores(spark, d).agg(r(F.avg(F.when(F.col("split") == "F", e)) - F.avg(F.when(F.col("split") == "O", e))).alias("gap"))


@query(with_tables("SELECT tile, round(corr(s, f7), 6) AS r, round(regr_slope(f7, s), 6) AS slope, round(regr_intercept(f7, s), 6) AS intercept, count(*) AS n FROM node GROUP BY tile HAVING count(*) >= 10", "node"))
def m23_m24_correlation_trend(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("tile").agg(r(F.corr("s", "f7")).alias("r"), r(F.regr_slope("f7", "s")).alias("slope"), r(F.regr_intercept("f7", "s")).alias("intercept"), F.count(F.lit(1)).alias("n")).where("n >= 10")


@query(with_tables("""SELECT round(avg(CASE WHEN hz > 0.31 THEN p END) - avg(CASE WHEN hz < 0.29 THEN p END), 6) AS gap, avg(CASE WHEN hz > 0.31 THEN p END) - avg(CASE WHEN hz < 0.29 THEN p END) > 0.05 AS passes
 FROM (SELECT tile, avg(p) AS p, avg(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END) AS hz FROM score GROUP BY tile)""", "score"))
def m25_risk_ordering_gap(spark: SparkSession, d: str) -> DataFrame:
    per = scores(spark, d).groupBy("tile").agg(F.avg("p").alias("p"), F.avg((F.col("t") > 0.7).cast("double")).alias("hz"))
    gap = F.avg(F.when(F.col("hz") > 0.31, F.col("p"))) - F.avg(F.when(F.col("hz") < 0.29, F.col("p")))
    return per.agg(r(gap).alias("gap"), (gap > 0.05).alias("passes"))


@query("SELECT event_type, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_finite, CAST(sum(CASE WHEN event_id % 7 <> 0 AND (value < -0.01 OR value > 1.01) THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range FROM events GROUP BY event_type")
def m26_sanity_counts(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, d, "events").select("event_type", v.alias("v"))
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    return rows.groupBy("event_type").agg(F.count_if(bad).alias("not_finite"), F.count_if(~bad & ((F.col("v") < -0.01) | (F.col("v") > 1.01))).alias("out_of_range"))


@query(with_tables("SELECT tile, round(avg(CASE WHEN valid THEN CASE WHEN p > 0.7 THEN 1.0 ELSE 0.0 END END), 6) AS fraction, round(quantile_cont(p, 0.5), 6) AS median FROM score GROUP BY tile", "score"))
def m27_m28_hazard_fraction(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("tile").agg(r(F.avg(F.when(F.col("valid"), (F.col("p") > 0.7).cast("double")))).alias("fraction"), r(F.percentile("p", F.lit(0.5))).alias("median"))


NODE_STATS = "round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most"


@query(with_tables(f"SELECT {NODE_STATS}, round(avg(CASE WHEN n % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS bridged_rate, avg(CASE WHEN n % 3 = 0 THEN 1.0 ELSE 0.0 END) > 0.2 AS alarm FROM (SELECT tile, count(*) AS n FROM node GROUP BY tile)", "node"))
def m29_node_stats(spark: SparkSession, d: str) -> DataFrame:
    per = nodes(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    bridged = F.avg((F.col("n") % 3 == 0).cast("double"))
    return per.agg(r(F.avg("n")).alias("mean"), r(F.stddev_samp("n")).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), r(bridged).alias("bridged_rate"), (bridged > 0.2).alias("alarm"))


@query(with_tables(f"SELECT split, tile, n, {SEG} FROM (SELECT split, tile, count(*) AS n, {COUNTS.format(k='true')} FROM score GROUP BY ROLLUP (split, tile))", "score"))
def m30_m31_rollup_by_location(spark: SparkSession, d: str) -> DataFrame:
    out = scores(spark, d).rollup("split", "tile").agg(F.count(F.lit(1)).alias("n"), *[r(c).alias(n) for n, c in m.segmentation(m.confusion(F.col("p"), F.col("t"))).items()])
    return out


@query(with_tables("""SELECT tile, round(avg(alpha), 6) AS mean, round(stddev_pop(alpha), 6) AS std, round(sum(CASE WHEN f7 > 0.7 AND alpha * h + (1 - alpha) * s > 0.5 THEN 1.0 ELSE 0.0 END) / (sum(CASE WHEN f7 > 0.7 THEN 1.0 ELSE 0.0 END) + 1e-6), 6) AS fused,
 round(sum(CASE WHEN f7 > 0.7 AND h > 0.5 THEN 1.0 ELSE 0.0 END) / (sum(CASE WHEN f7 > 0.7 THEN 1.0 ELSE 0.0 END) + 1e-6), 6) AS learned, round(sum(CASE WHEN f7 > 0.7 AND s > 0.5 THEN 1.0 ELSE 0.0 END) / (sum(CASE WHEN f7 > 0.7 THEN 1.0 ELSE 0.0 END) + 1e-6), 6) AS physics FROM node GROUP BY tile""", "node"))
def m32_three_way_recall(spark: SparkSession, d: str) -> DataFrame:
    recall = lambda p: r(m.segmentation(m.confusion(p, F.col("f7")))["recall"])
    return nodes(spark, d).groupBy("tile").agg(r(F.avg("alpha")).alias("mean"), r(F.stddev_pop("alpha")).alias("std"), recall(hz.fused(F.col("h"), F.col("s"), F.col("alpha"))).alias("fused"), recall(F.col("h")).alias("learned"), recall(F.col("s")).alias("physics"))


BCE = "sum(CASE WHEN valid THEN -(CASE WHEN t > 0.7 THEN 5.0 ELSE 1.0 END) * (t * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - t) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))) ELSE 0 END) / greatest(sum(CASE WHEN valid THEN 1 ELSE 0 END), 1)"
DICE = "1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1)"


@query(with_tables(f"SELECT tile, round({BCE}, 6) AS bce, round({DICE}, 6) AS dice, round({BCE} + 0.5 * ({DICE}), 6) AS compound FROM score GROUP BY tile", "score"))
def m33_m34_m35_losses(spark: SparkSession, d: str) -> DataFrame:
    bce, dice = m.weighted_bce(F.col("p"), F.col("t"), F.col("valid")), m.soft_dice(F.col("p"), F.col("t"))
    return scores(spark, d).groupBy("tile").agg(r(bce).alias("bce"), r(dice).alias("dice"), r(bce + 0.5 * dice).alias("compound"))


@query(with_tables("""SELECT tile, round(avg(e), 6) AS loss FROM (SELECT p.tile, p.patch, avg(pow((v - mu) / sqrt(var + 1e-6) - 0.01 * v, 2)) AS e FROM (SELECT tile, CAST(floor(y / 4) * 4 + floor(x / 4) AS INT) AS patch, v FROM pixel) p
 JOIN (SELECT tile, CAST(floor(y / 4) * 4 + floor(x / 4) AS INT) AS patch, avg(v) AS mu, var_samp(v) AS var FROM pixel GROUP BY 1, 2) s ON p.tile = s.tile AND p.patch = s.patch WHERE p.patch % 4 <> 0 GROUP BY 1, 2) GROUP BY tile""", "pixel"))
def m36_masked_patch_loss(spark: SparkSession, d: str) -> DataFrame:
    """Squared error against patches normalised by their mean and sample variance, over masked patches; the prediction here is 0.01 v."""
    rows = raster.patches(pixels(spark, d), 4, 16).where("patch % 4 <> 0").withColumn("n", F.size("values"))
    rows = rows.withColumn("mu", F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    rows = rows.withColumn("var", F.aggregate("values", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("mu"), 2)) / (F.col("n") - 1))
    rows = rows.withColumn("e", F.aggregate("values", F.lit(0.0), lambda a, x: a + F.pow((x - F.col("mu")) / F.sqrt(F.col("var") + 1e-6) - 0.01 * x, 2)) / F.col("n"))
    return rows.groupBy("tile").agg(r(F.avg("e")).alias("loss"))


@query(with_tables("SELECT id, round(avg(p), 6) AS mean, round(coalesce(var_samp(p), 0), 6) AS variance FROM sample GROUP BY id", "sample"))
def m37_pass_variance(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("id").agg(r(F.avg("p")).alias("mean"), r(F.coalesce(F.var_samp("p"), F.lit(0.0))).alias("variance"))


@query(with_tables("SELECT tile, sum(CASE WHEN s > 0.52 AND h < 0.48 THEN 1 ELSE 0 END) > 5 AS crater_shadow, stddev_pop(alpha) < 0.12 AS alpha_collapse, avg(CASE WHEN u > 0.1 THEN 1.0 ELSE 0.0 END) > 0.5 AS uncertainty_saturation FROM node GROUP BY tile", "node"))
def m38_failure_flags(spark: SparkSession, d: str) -> DataFrame:
    """Failure flags on columns stretched to the range of these data."""
    stretch = lambda c, a, b: F.when(F.col(c) > a, 0.9).when(F.col(c) < b, 0.1).otherwise(0.5)
    return m.failures(nodes(spark, d), "tile", stretch("s", 0.52, -1.0), stretch("h", 2.0, 0.48), F.col("alpha") / 6, stretch("u", 0.1, -1.0), 5)


@query(with_tables("""SELECT tile, round(stddev_samp(p), 6) AS std, round(min(p), 6) AS least, round(max(p), 6) AS most, round(avg(CASE WHEN t > 0.7 THEN p END), 6) AS hazardous, round(avg(CASE WHEN NOT t > 0.7 THEN p END), 6) AS safe, stddev_samp(p) < 0.01 AS collapsed FROM score GROUP BY tile""", "score"))
def m40_m42_prediction_spread(spark: SparkSession, d: str) -> DataFrame:
    p, hot = F.col("p"), F.col("t") > 0.7
    return scores(spark, d).groupBy("tile").agg(r(F.stddev_samp(p)).alias("std"), r(F.min(p)).alias("least"), r(F.max(p)).alias("most"), r(F.avg(F.when(hot, p))).alias("hazardous"), r(F.avg(F.when(~hot, p))).alias("safe"), (F.stddev_samp(p) < 0.01).alias("collapsed"))


@query(with_tables("SELECT arg_max(tile, (round(mae, 9), -tile)) AS best FROM (SELECT tile, avg(abs(p - t)) AS mae FROM score GROUP BY tile)", "score"))
def m41_best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    per = scores(spark, d).groupBy("tile").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))
    return per.agg(F.max_by("tile", F.struct(F.round("mae", 9), -F.col("tile"))).alias("best"))


@query(with_tables("SELECT round(avg(p), 6) AS mean, count(*) AS n FROM (SELECT p FROM score ORDER BY (seed * 7919 + tile * 104729) % 10007, tile, seed, p LIMIT 5000)", "score"))
def m43_capped_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample without replacement, at most 5,000 rows: sampling is the feature here."""
    rows = scores(spark, d).orderBy((F.col("seed") * 7919 + F.col("tile") * 104729) % 10007, "tile", "seed", "p").limit(5000)
    return rows.agg(r(F.avg("p")).alias("mean"), F.count(F.lit(1)).alias("n"))


def weight_grid() -> list[tuple[float, float, float]]:
    """Weights that sum to 1 with the third from 0.05 to 0.5, from whole tenths."""
    return [(a / 10, b / 10, (10 - a - b) / 10) for a in range(1, 11) for b in range(1, 11) if 0.5 <= 10 - a - b <= 5]


_GRID = ", ".join(map(str, weight_grid()))


@query(with_tables(f"""SELECT w1, w2, w3, round(avg(h), 6) AS mean, round(corr(h, f7), 6) AS r, round(avg(CASE WHEN f7 > 0.7 THEN h END) - avg(CASE WHEN f7 <= 0.7 THEN h END), 6) AS gap
 FROM (SELECT w1, w2, w3, f7, least(greatest(CAST(w1 AS DOUBLE) * s + CAST(w2 AS DOUBLE) * r + CAST(w3 AS DOUBLE) * d, 0), 1) AS h FROM node, (VALUES {_GRID}) g(w1, w2, w3)) GROUP BY w1, w2, w3""", "node"))
def o03_weight_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every setting of the grid scored on all nodes: its mean, correlation with the risk, and gap between hazardous and safe ones. One aggregate; the grid is a literal in each row."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(f"w{i + 1}") for i, v in enumerate(w)]) for w in weight_grid()])
    rows = nodes(spark, d).select("s", "r", "d", "f7", F.explode(grid).alias("w")).select("f7", "w.*", hz.clip(F.col("w.w1") * F.col("s") + F.col("w.w2") * F.col("r") + F.col("w.w3") * F.col("d"), 0.0, 1.0).alias("h"))
    gap = F.avg(F.when(F.col("f7") > 0.7, F.col("h"))) - F.avg(F.when(F.col("f7") <= 0.7, F.col("h")))
    return rows.groupBy("w1", "w2", "w3").agg(r(F.avg("h")).alias("mean"), r(F.corr("h", "f7")).alias("r"), r(gap).alias("gap"))


@query(with_tables("""SELECT i.tile AS tile, i.split AS inside, o.split AS outside, round(i.mae, 6) AS mae_inside, round(o.mae, 6) AS mae_outside, round(o.mae - i.mae, 6) AS gap FROM (SELECT tile, split, avg(abs(p - t)) AS mae FROM score WHERE split = 'F' GROUP BY ALL) i
 JOIN (SELECT tile, split, avg(abs(p - t)) AS mae FROM score WHERE split <> 'F' GROUP BY ALL) o USING (tile)""", "score"))
def j16_domain_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The error of each tile inside the distribution beside that of each outside split of it."""
    errors = scores(spark, d).groupBy("tile", "split").agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"))
    inside, outside = (errors.where(w).select("tile", F.col("split").alias(n), F.col("mae").alias(f"mae_{n}")) for n, w in (("inside", "split = 'F'"), ("outside", "split <> 'F'")))
    return inside.join(outside, "tile").select("tile", "inside", "outside", r(F.col("mae_inside")).alias("mae_inside"), r(F.col("mae_outside")).alias("mae_outside"), r(F.col("mae_outside") - F.col("mae_inside")).alias("gap"))


ABLATION = "p > th AND t > 0.7"


@query(with_tables("""SELECT CAST(th AS DOUBLE) AS threshold, split, round(sum(CASE WHEN p > th AND t > 0.7 THEN 1.0 ELSE 0.0 END) / (sum(CASE WHEN t > 0.7 THEN 1.0 ELSE 0.0 END) + 1e-6), 6) AS recall FROM score, (VALUES (0.3), (0.5), (0.7)) g(th) GROUP BY th, split""", "score"))
def o04_o05_threshold_ablation(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the predictions for the whole grid: each row meets the grid's few settings in an array."""
    rows = scores(spark, d).withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    counts = m.confusion((F.col("p") > F.col("threshold")).cast("int") * 1.0, F.col("t"))
    return rows.groupBy("threshold", "split").agg(r(m.segmentation(counts)["recall"]).alias("recall"))

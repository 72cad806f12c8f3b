"""Running totals and rank metrics of large groups, by ranges and in one window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.operators import metrics, ranks, stats

SF = "/root/testdata/sf0.1"


@pytest.fixture
def by_ranges(monkeypatch):
    monkeypatch.setattr(ranks, "LARGE", 3)


def test_totals_of_ranges_equal_those_of_a_window(spark, by_ranges, monkeypatch):
    draw = np.random.default_rng(0)
    rows = [(g, float(k), int(n)) for g, size in (("a", 500), ("b", 40), (None, 7), ("c", 1)) for k, n in zip(draw.permutation(size), draw.integers(1, 9, size))]
    table = spark.createDataFrame(rows, "g string, k double, n long")
    got = sorted(map(str, ranks.running(table, ["g"], "k", ["n"], parts=9).collect()))
    monkeypatch.setattr(ranks, "LARGE", 10**6)
    assert got == sorted(map(str, ranks.running(table, ["g"], "k", ["n"]).collect()))
    assert ranks.running(table.limit(0), ["g"], "k", ["n"]).count() == 0


def test_metrics_of_ranges_equal_brute_force(spark, by_ranges):
    draw = np.random.default_rng(1)
    rows = [(g, float(p), bool(y), float(d)) for g, n in ((1, 300), (2, 50), (3, 1)) for p, y, d in zip(draw.integers(0, 90, n) / 90, draw.random(n) < 0.3, draw.integers(-20, 21, n))]
    table = spark.createDataFrame(rows, "g int, p double, y boolean, d double")
    area = {r.g: r.auc for r in metrics.auc(table, ["g"], "p", F.col("y")).collect()}
    precision = {r.g: r.ap for r in metrics.average_precision(table, ["g"], "p", F.col("y")).collect()}
    signed = {r.g: (r.w, r.n) for r in stats.wilcoxon(table, ["g"], "d").collect()}
    for g in (1, 2, 3):
        own = [r for r in rows if r[0] == g]
        pos, neg = [r[1] for r in own if r[2]], [r[1] for r in own if not r[2]]
        want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) if pos and neg else 0.0
        assert np.isclose(area[g], want)
        steps = [(sum(x >= p for x in pos), sum(r[1] >= p for r in own), sum(x == p for x in pos)) for p in {r[1] for r in own}]
        assert np.isclose(precision[g], sum(c * a / n for a, n, c in steps) / len(pos) if pos else 0.0)
        d = [r[3] for r in own if r[3]]
        rank = {a: sum(abs(x) < a for x in d) + (sum(abs(x) == a for x in d) + 1) / 2 for a in map(abs, d)}
        if d:
            assert signed[g] == (min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)), len(d))


def test_one_group_of_different_scores_is_spread(spark, by_ranges, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select((F.col("l_extendedprice") + F.xxhash64("l_orderkey", "l_linenumber") / 2.0**80).alias("p"), (F.col("l_quantity") > 25).alias("y"))
    counts = rows.groupBy("p").agg(F.count_if("y").alias("a"))
    seen = []
    monkeypatch.setattr(ranks, "pinned", lambda df, keep=ranks.pinned: seen.append(keep(df)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        total = ranks.running(counts, [], "p", ["a"], parts=8).agg(F.max(F.col("before_a") + F.col("a"))).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[1] for r in seen[0].groupBy("__part").count().collect()]
    assert total == rows.where("y").count() and len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_resamples_in_one_aggregate(spark):
    draw = np.random.default_rng(2)
    values = {1: draw.normal(5, 2, 400), 2: draw.exponential(1, 900), 3: np.array([4.0])}
    rows = [(g, 1000 * g + i, float(v)) for g, x in values.items() for i, v in enumerate(x)] + [(1, 5000, None)]
    table = spark.createDataFrame(rows, "g int, k long, v double").repartition(6)
    frame = stats.bootstrap_interval(table, ["g"], "v", "k")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 2  # the second is of a row for each group and resample
    got = {r.g: r for r in frame.collect()}
    for g, x in values.items():
        if len(x) > 1:  # the spread is that of the mean
            error = x.std() / np.sqrt(len(x))
            assert np.isclose(got[g].mean, x.mean()) and abs((got[g].high - got[g].low) / (2 * 1.96 * error) - 1) < 0.25
    assert (got[3].mean, got[3].low, got[3].high) == (4.0, 4.0, 4.0)
    whole = stats.bootstrap_interval(table.where("g = 1"), [], "v", "k").first()
    assert np.allclose([whole.low, whole.high], [got[1].low, got[1].high])
    assert stats.bootstrap_interval(table.limit(0), ["g"], "v", "k").count() == 0


def test_weights_are_those_of_poisson(spark):
    keys = spark.range(20_000)
    row = keys.select(*[stats.drawn_weight(F.col("id"), F.lit(b), 200).alias(f"w{b}") for b in (0, 7, 199)]).toPandas()
    for c in row:
        assert abs(row[c].mean() - 1) < 0.03 and abs(row[c].var() - 1) < 0.06
    assert abs(np.corrcoef(row.T.to_numpy())[0, 1]) < 0.03

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cragline.functions import hazard as hz
from cragline.operators import metrics as m
from cragline.operators import stats
from cragline.plans.experiments import assign_splits
from cragline.sources.arrays import NpyTiles, merged


def test_tier_bounds_belong_to_the_middle(spark):
    rows = spark.createDataFrame([(x,) for x in (0.2499, 0.25, 0.60, 0.6001)], "c double")
    assert [r[0] for r in rows.select(hz.tier(F.col("c"))).collect()] == [0, 1, 1, 2]


def test_two_calibration_bins(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 1.0)], "p double")
    half = [r[0] for r in rows.select(m.binned(F.col("p"))).collect()]
    right = [r[0] for r in rows.select(m.binned(F.col("p"), right_closed=True)).collect()]
    assert half == [0, 1, 2, None] and right == [None, 0, 2, 9]


def test_auc_of_ties_and_of_one_class(spark):
    rows = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (2, 0.1, True), (2, 0.9, True)], "g int, p double, y boolean")
    assert {r.g: r.auc for r in m.auc(rows, ["g"], "p", F.col("y")).collect()} == {1: 0.5, 2: 0.0}


def test_empty_input(spark):
    rows = spark.createDataFrame([], "g int, p double, t double")
    assert rows.groupBy("g").agg(*[c.alias(n) for n, c in m.segmentation(m.confusion(F.col("p"), F.col("t"))).items()]).count() == 0


def test_unknown_class_raises_and_weights_are_checked(spark):
    assert spark.range(3, 4).select(hz.class_risk(F.col("id"))).first()[0] == 0.8
    with pytest.raises(Exception, match="unknown class"):
        spark.range(99, 100).select(hz.class_risk(F.col("id"))).collect()
    with pytest.raises(ValueError):
        hz.physics(F.lit(0), F.lit(0), F.lit(0), (0.5, 0.5, 0.5))


@settings(max_examples=40, deadline=None)
@given(st.floats(0.1, 40), st.floats(0.1, 40), st.floats(0.001, 0.999))
def test_incomplete_beta_by_summation(a, b, x):
    if min(a, b) >= 1:
        n = 200_000
        t = (np.arange(n) + 0.5) / n * x
        want = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))).sum() * x / n
        assert abs(stats._beta(a, b, x) - want) < 1e-4


def test_p_values(spark):
    rows = spark.createDataFrame([(2.228, 10.0, 8.0, 10), (0.0, 5.0, 27.5, 10)], "t double, df double, w double, n int")
    got = rows.select(stats.t_p_value("t", "df"), stats.wilcoxon_p_value("w", "n")).collect()
    assert abs(got[0][0] - 0.05) < 1e-3 and abs(got[1][0] - 1) < 1e-9 and abs(got[1][1] - 1) < 1e-9 and got[0][1] < 0.06


def test_fitted_temperature_undoes_a_scale(spark):
    rows = spark.range(4000).select(((F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000) / 250.0).alias("z"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)) / 1e6).alias("u"))
    rows = rows.select((F.col("z") * 2).alias("z"), (F.col("u") < 1 / (1 + F.exp(-F.col("z")))).alias("y"))
    assert abs(stats.fitted_temperature(rows, "z", "y") - 2) < 0.2


def test_split_assignment_covers_all_once():
    rows = [(f"s{i:02d}", f"t{i % 4}", (i * 37 % 100) / 100) for i in range(27)]
    found = assign_splits(rows)
    assert set(found) == {a for a, *_ in rows} and list(found.values()).count("test_ood") == 1
    assert found["s27" if "s27" in found else max(a for a, t, _ in rows if t == "t2")] == "test_ood"
    assert assign_splits([]) == {}


def test_npy_source_and_merge(spark, tmp_path):
    a = np.arange(6, dtype=float).reshape(2, 3)
    np.save(tmp_path / "a.npy", a)
    spark.dataSource.register(NpyTiles)
    got = spark.read.format("npy_tiles").option("paths", str(tmp_path / "a.npy")).load().orderBy("y").collect()
    assert [list(r["values"]) for r in got] == a.tolist()
    assert merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": {"z": 4}}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": {"z": 4}}

"""The driver's work: rounds and steps over small tables take few jobs, as counts come with the checkpoints and minima are broadcast."""

import numpy as np

from cragline.llm import components as comp
from cragline.llm import quality_rules, simhash
from cragline.llm._spark import counted


def jobs_of(spark, work) -> int:
    """Jobs that ``work`` starts."""
    context, group = spark.sparkContext, f"jobs-{id(work)}"
    context.setJobGroup(group, "counted by a test")
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_a_count_comes_with_the_checkpoint(spark):
    for rows in ([(1, 2), (3, 4), (3, 4)], []):
        table, found = counted(spark.createDataFrame(rows, "a long, b long"))
        assert found["n"] == len(rows) and sorted(map(tuple, table.collect())) == rows
    plain = spark.range(10)
    assert jobs_of(spark, lambda: counted(plain)) == 1


def test_jobs_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(20, 21)], "a long, b long")
    got = []
    jobs = jobs_of(spark, lambda: got.extend(map(tuple, comp.components(links).collect())))
    assert sorted(got) == [(i, 0) for i in range(9)] + [(20, 20), (21, 20)]
    assert jobs <= 30


def test_jobs_of_least_determinants(spark):
    draw = np.random.default_rng(3)
    rows = [(f"g{i % 2}", *map(float, x)) for i, x in enumerate(draw.normal(size=(400, 5)))]
    rows = spark.createDataFrame(rows, "mk string, x1 double, x2 double, x3 double, x4 double, x5 double").cache()
    got = []
    jobs = jobs_of(spark, lambda: got.extend(quality_rules.least_determinants(rows).collect()))
    assert {r.mk for r in got} == {"g0", "g1"}
    assert jobs <= 30


def test_jobs_of_no_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "doc_id long, text string")
    distinct = spark.createDataFrame([(5, 1), (6, 2)], "node long, least long")
    none = spark.createDataFrame([], "a long, b long")
    found = []
    assert jobs_of(spark, lambda: found.extend(simhash.same_shingles(docs, 5, 0.8, none, distinct).collect())) <= 2 and not found

"""What queries move between tasks on larger inputs."""

from pyspark.sql import functions as F

import __spark_entry__ as registered
from cragline.operators import grids
from cragline.plans import rasters

SF = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """``run``'s result, and for each stage that it started the rows written for other tasks."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, [n for s, n in stages().items() if s not in before]


def test_replanning_moves_the_last_event_of_a_node_not_every_event(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    for k in range(3):  # files of one stream
        spark.range(k * 10_000, k * 10_000 + 10_000, 1, 2).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts").write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    rows, moved = shuffled(spark, lambda: registered.queries()["w05_streamed_replanning"](spark, f"file://{tmp_path}").collect())
    assert rows and max(moved) < 3_000  # 60 nodes of about 7 edges; 30,000 events


def test_alignment_moves_source_pixels_not_target_pixels(spark):
    pixels = spark.range(4 * 256).selectExpr("id div 256 AS raster", "CAST(id % 256 div 16 AS INT) AS row", "CAST(id % 16 AS INT) AS col", "CAST(id AS DOUBLE) AS v")
    table = spark.range(5).selectExpr("id AS raster", "16 AS height", "16 AS width", "0D AS s0", "1D AS s1", "0D AS s2", "0D AS s3", "0D AS s4", "1D AS s5",
                                      "100 AS to_height", "90 AS to_width", "-1D AS t0", "0.2D AS t1", "0D AS t2", "-1D AS t3", "0D AS t4", "0.18D AS t5")
    for method in ("nearest", "bilinear"):
        rows, moved = shuffled(spark, lambda: grids.aligned(pixels, table, method, 8).selectExpr("raster", "row * 100 + col AS at", "v").collect())
        assert len(rows) == len({r[:2] for r in rows}) == 5 * 100 * 90 and sum(r.v is not None for r in rows) == 4 * 80 * 88
        assert max(moved) < 3_000  # 1,024 pixels, of which some go to two or four tiles; 45,000 target pixels
    assert grids.aligned(pixels, table.withColumn("to_height", F.lit(0))).count() == 0


def test_a_target_without_an_inverse(spark):
    pixels = spark.range(64).selectExpr("1L AS raster", "CAST(id div 8 AS INT) AS row", "CAST(id % 8 AS INT) AS col", "CAST(id AS DOUBLE) AS v")
    table = spark.range(1, 2).selectExpr("id AS raster", "8 AS height", "8 AS width", "0D AS s0", "1D AS s1", "0D AS s2", "0D AS s3", "0D AS s4", "1D AS s5",
                                         "3 AS to_height", "4 AS to_width", "0D AS t0", "1D AS t1", "1D AS t2", "0D AS t3", "1D AS t4", "1D AS t5")
    got = {(r.row, r.col): r.v for r in grids.aligned(pixels, table, "nearest", 4).collect()}
    assert got == {(r, c): 9.0 * (r + c + 1) for r in range(3) for c in range(4)}  # all on the diagonal


def test_the_grids_of_tiles_come_from_partial_counts(spark):
    rows, moved = shuffled(spark, lambda: rasters._gridded(spark, SF)[1].collect())
    full = spark.read.parquet(f"{SF}/orders.parquet").groupBy(F.expr("o_orderkey div 256")).count().where("count = 256").count()
    assert len(rows) == len({r.raster for r in rows}) == full > 0 and max(moved) <= 4 * (full + 2)  # 1,500 orders; no window over all of them


def test_the_built_graph_segments_its_tiles_once(spark):
    plan = registered.queries()["h06_built_graph"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") <= 1 and "FlatMapCoGroupsInArrow" not in plan  # bridges of the nearest nodes; segments, neighbours and components are read

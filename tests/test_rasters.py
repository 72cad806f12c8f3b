"""The raster data source: scans over directories, and a sink that leaves whole files or none."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragline.sources.rasters import RasterFolder, as_rasters


@pytest.fixture
def source(spark):
    spark.dataSource.register(RasterFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("raster_folder").option("push", "true")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def image(seed, shape=(8, 8)):
    return np.random.default_rng(seed).random(shape)


def test_scan_of_several_directories(spark, source, tmp_path):
    for folder, names in (("a", ["t2", "t1", "t3"]), ("b", ["u1"])):
        (tmp_path / folder).mkdir()
        for k, n in enumerate(names):
            np.save(tmp_path / folder / f"{n}.npy", image(k))
    np.save(tmp_path / "b" / "small.npy", image(9, (4, 8)))
    np.save(tmp_path / "b" / "cube.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "b" / "turned.npy", np.asfortranarray(image(5)))
    (tmp_path / "b" / "broken.npy").write_bytes(b"\x93NUMPY no array")
    (tmp_path / "b" / "short.npy").write_bytes((tmp_path / "a" / "t1.npy").read_bytes()[:200])
    (tmp_path / "b" / "notes.txt").write_text("no raster")
    rows = source.option("dirs", f"{tmp_path}/a;file://{tmp_path}/b;{tmp_path}/none").option("size", 8).option("files", 2).load()
    assert rows.rdd.getNumPartitions() == 2 + 3 + 1
    found = {(r.path.rpartition("/")[2], r.status): r.n for r in rows.groupBy("path", "status").agg(F.count("y").alias("n")).collect()}
    assert found == {("t1.npy", "ok"): 8, ("t2.npy", "ok"): 8, ("t3.npy", "ok"): 8, ("u1.npy", "ok"): 8, ("turned.npy", "ok"): 8, ("small.npy", "wrong size"): 0, ("cube.npy", "unreadable"): 0,
                     ("broken.npy", "unreadable"): 0, ("short.npy", "unreadable"): 0, ("none", "missing directory"): 0}
    for name, seed in (("a/t2", 0), ("b/turned", 5)):
        got = rows.where(F.col("path").endswith(f"{name}.npy")).orderBy("y").collect()
        assert np.array_equal([r["values"] for r in got], image(seed)) and [r.y for r in got] == list(range(8))


def test_sizes_are_known_by_the_header(spark, source, tmp_path):
    for k in range(3):
        np.save(tmp_path / f"t{k}.npy", image(k, (8, 8 + k)))
    # the data of the others is cut off: reading it would make them unreadable
    for k in (0, 2):
        (tmp_path / f"t{k}.npy").write_bytes((tmp_path / f"t{k}.npy").read_bytes()[:150])
    rows = source.option("path", str(tmp_path)).load()
    assert {(r.path[-6:], r.status) for r in rows.where("width = 9").collect()} == {("t1.npy", "ok")}
    assert {(r.path[-6:], r.status) for r in rows.where("status = 'unreadable'").collect()} == {("t0.npy", "unreadable"), ("t2.npy", "unreadable")}
    with pytest.raises(Exception, match="no files"):
        source.option("path", str(tmp_path)).option("ending", ".png").load().count()


def pixel_rows(spark):
    rows = [(f"r{k}", y, x, None if (y + x) % 5 == 0 else float(k * 100 + 10 * y + x)) for k in range(4) for y in range(3) for x in range(4) if (y, x) != (2, 3)]
    return spark.createDataFrame(rows, "raster string, row int, col int, v double")


@pytest.mark.parametrize("dtype,nodata", [("float32", None), ("int16", -9999), ("uint16", 65535)])
def test_what_is_written_is_read_back(spark, source, tmp_path, dtype, nodata):
    writer = as_rasters(pixel_rows(spark), 3, 4).write.format("raster_folder").mode("append").option("dtype", dtype)
    (writer if nodata is None else writer.option("nodata", nodata)).save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"r{k}.{e}" for k in range(4) for e in ("json", "npy"))
    band = np.load(tmp_path / "out" / "r1.npy")
    assert band.dtype == dtype and band[1, 1] == 111 and json.loads((tmp_path / "out" / "r1.json").read_text())["nodata"] == nodata
    got = source.option("path", str(tmp_path / "out")).load().select(F.regexp_extract("path", r"(r\d)\.npy", 1).alias("raster"), "y", F.posexplode("values").alias("x", "v")).where("v IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pixel_rows(spark).where("v IS NOT NULL").collect()))


def test_a_failed_write_leaves_no_raster(spark, source, tmp_path):
    def names():  # tasks that still run when a job fails may stage files after that; no scan reads those
        return sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_staging-")) if (tmp_path / "out").exists() else []

    rows = as_rasters(pixel_rows(spark), 3, 4)
    bad = rows.repartition(4, "raster").withColumn("raster", F.when(F.col("raster") == "r2", F.raise_error(F.lit("a task dies"))).otherwise(F.col("raster")))
    write = lambda df, mode="append", **o: df.write.format("raster_folder").mode(mode).options(**o).save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="a task dies"):
        write(bad)
    assert names() == []
    for other, message in ((rows.union(rows), "twice"), (rows.withColumn("values", F.lit(None).cast("array<array<double>>")), "")):
        with pytest.raises(Exception, match=message):
            write(other)
        assert names() == []
    with pytest.raises(Exception, match="can't hold"):
        write(rows.fillna({}), dtype="int8", nodata="-1")
    write(rows)
    with pytest.raises(Exception, match="already"):
        write(rows)
    assert len(names()) == 8
    write(rows.where("raster = 'r0'"), "overwrite")
    assert names() == ["r0.json", "r0.npy"]

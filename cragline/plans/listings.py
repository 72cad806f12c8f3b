"""Queries for catalogs, listings, pairing and stores, on names made from the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.plans.fixtures import elevation, nodes, scores, table, with_tables
from cragline.plans.registry import query, r
from cragline.sources.rasters import RasterFolder, as_rasters
from cragline.sources.shared import new_folder
from cragline.sources import catalog as c

CAT = "cat AS (SELECT p_partkey, trim('  ' || p_name || ' ') AS alias, p_brand AS dem_id, p_type AS terrain, CASE WHEN p_size % 4 = 0 THEN 'Pending' ELSE 'Verified' END AS status FROM part)"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("alias"), F.col("p_brand").alias("dem_id"), F.col("p_type").alias("terrain"), F.when(F.col("p_size") % 4 == 0, " Pending ").otherwise("Verified ").alias("status"))


@query(f"WITH {CAT} SELECT p_partkey, alias, '/dem/' || dem_id || '.IMG' AS dem_file, '/img/' || alias || '.JP2' AS browse_file FROM cat WHERE status = 'Verified'")
def s01_catalog_pairs(spark: SparkSession, d: str) -> DataFrame:
    return c.pairs(_catalog(spark, d), "/dem", "/img").select("p_partkey", "alias", "dem_file", "browse_file")


LIST = "listing AS (SELECT '/dem/' || p_brand || '.IMG' AS path, max(p_retailprice * 6000) AS size FROM part WHERE p_size % 3 = 0 GROUP BY p_brand UNION ALL SELECT '/img/' || p_name || '.JP2', max(p_retailprice * 6000) FROM part WHERE p_size % 5 <> 0 GROUP BY p_name)"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    size = F.max(F.col("p_retailprice") * 6000).alias("size")
    a = part.where("p_size % 3 = 0").groupBy(F.concat(F.lit("/dem/"), "p_brand", F.lit(".IMG")).alias("path")).agg(size)
    return a.union(part.where("p_size % 5 <> 0").groupBy(F.concat(F.lit("/img/"), "p_name", F.lit(".JP2")).alias("path")).agg(size))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return c.pairs(_catalog(spark, d), "/dem", "/img", status=None).select("p_partkey", "dem_file", "browse_file")


PATHS = f"{CAT}, {LIST}, pairs AS (SELECT p_partkey, '/dem/' || dem_id || '.IMG' AS dem_file, '/img/' || alias || '.JP2' AS browse_file FROM cat)"


@query(f"WITH {PATHS} SELECT p_partkey, dem_file IN (SELECT path FROM listing) AS has_dem_file, browse_file IN (SELECT path FROM listing) AS has_browse_file FROM pairs")
def s02_j01_file_existence(spark: SparkSession, d: str) -> DataFrame:
    return c.existing(_pairs(spark, d), _listing(spark, d), ["dem_file", "browse_file"]).select("p_partkey", "has_dem_file", "has_browse_file")


@query(f"WITH {PATHS} SELECT p_partkey, CASE WHEN a.size IS NULL OR b.size IS NULL THEN 'Missing' WHEN a.size > 5242880 AND b.size > 5242880 THEN 'Verified' ELSE 'Corrupt/Small' END AS status FROM pairs LEFT JOIN listing a ON a.path = dem_file LEFT JOIN listing b ON b.path = browse_file")
def s20_integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    return c.audited(_pairs(spark, d), _listing(spark, d), "dem_file", "browse_file").select("p_partkey", "status")


DTM = "dtm AS (SELECT DISTINCT 'DTE' || CASE WHEN o_orderkey % 2 = 0 THEN 'ED' ELSE 'EC' END || '_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '_' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS name FROM orders WHERE o_orderkey % 5 = 0), ortho AS (SELECT DISTINCT 'img_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '_RED' AS name FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"""WITH {DTM}, ids AS (SELECT name AS dtm, unnest(regexp_extract_all(name, '(\\d{{6}})', 1)) AS id FROM dtm), held AS (SELECT name AS ortho, unnest(regexp_extract_all(name, '(\\d{{6}})', 1)) AS id FROM ortho), m AS (SELECT dtm, min(ortho) AS ortho FROM ids JOIN held USING (id) GROUP BY dtm)
 SELECT name AS dtm, m.ortho, CASE WHEN name LIKE '%000015%' THEN 'Crater' ELSE 'Uncategorized' END AS terrain, CASE WHEN name LIKE '%DTEED%' THEN 2.0 ELSE 1.0 END AS scale, substr(name, 1, 20) AS dem_id FROM dtm LEFT JOIN m ON m.dtm = dtm.name""")
def s18_s19_j02_catalog_build(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    six = lambda k: F.lpad(F.col(k).cast("string"), 6, "0")
    dtm = o.where("o_orderkey % 5 = 0").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "DTEED_").otherwise("DTEEC_"), six("o_orderkey"), F.lit("_"), six("o_custkey")).alias("name")).distinct()
    ortho = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("img_"), six("o_orderkey"), F.lit("_RED")).alias("name")).distinct()
    return c.built(dtm, ortho, {"000015": "Crater"})


@query("""WITH a AS (SELECT DISTINCT c_name AS stem FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT DISTINCT c_name || '_x' AS stem FROM customer WHERE c_custkey % 3 = 0)
 SELECT 'a' AS side, stem, substr(stem, 1, 18) IN (SELECT substr(stem, 1, 18) FROM b) AS paired FROM a UNION ALL SELECT 'b', stem, substr(stem, 1, 18) IN (SELECT substr(stem, 1, 18) FROM a) FROM b""")
def s22_j03_prefix_pairing(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer")
    return c.paired_by_prefix(t.where("c_custkey % 2 = 0").select(F.col("c_name").alias("stem")), t.where("c_custkey % 3 = 0").select(F.concat("c_name", F.lit("_x")).alias("stem")), 18)


@query(r"SELECT lower(regexp_extract(name, '(\.[^./]*)$', 1)) AS ext, count(*) AS n, CAST(sum(CASE WHEN contains(name, '(1)') OR lower(regexp_extract(name, '(\.[^./]*)$', 1)) IN ('.lbl', '.xml', '.zip') THEN 1 ELSE 0 END) AS BIGINT) AS odd FROM (SELECT url || CASE page_id % 4 WHEN 0 THEN '.LBL' WHEN 1 THEN '.img' WHEN 2 THEN '(1).IMG' ELSE '' END AS name FROM pages) GROUP BY 1")
def s21_extension_census(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    return c.extension_census(table(spark, d, "pages").select(F.concat("url", F.when(k == 0, ".LBL").when(k == 1, ".img").when(k == 2, "(1).IMG").otherwise("")).alias("name")))


@query("SELECT CASE WHEN size IS NULL THEN 'missing' WHEN size < 10 THEN 'stub' ELSE 'ok' END AS state, count(*) AS n FROM (SELECT CASE WHEN page_id % 9 = 0 THEN NULL ELSE (page_id * 7) % 50 END AS size FROM pages) GROUP BY 1")
def s27_size_audit(spark: SparkSession, d: str) -> DataFrame:
    return c.size_audit(table(spark, d, "pages").select(F.when(F.col("page_id") % 9 != 0, (F.col("page_id") * 7) % 50).alias("size")))


@query("SELECT 'site' || (l_suppkey % 5) AS alias, l_orderkey AS row, CAST(l_partkey % 7 AS BIGINT) AS col FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3 HAVING count(DISTINCT l_linenumber) = 2")
def s09_j04_complete_tiles(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("image", "risk", "hazard", "valid"))), (F.col("l_linenumber") - 1).cast("int"))
    t = table(spark, d, "lineitem").where("l_linenumber <= 4")
    name = F.format_string("site%d_r%05d_c%05d_%s.npy", F.col("l_suppkey") % 5, F.col("l_orderkey"), F.col("l_partkey") % 7, kind)
    out = c.complete_quads(t.select(name.alias("name")), 2)
    return out.select("alias", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("SELECT n_name AS alias, coalesce(r_name, 'unknown') AS split FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def j05_split_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    splits = n.join(table(spark, d, "region").where("r_regionkey < 3"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("split"))
    return c.with_split(n.select(F.col("n_name").alias("alias")), splits)


@query("SELECT DISTINCT trim(line) AS alias FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE trim(line) <> ''")
def s08_split_lists(spark: SparkSession, d: str) -> DataFrame:
    return c.split_list(table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("value"))).distinct()


@query("SELECT 'f' || vec_id || '.jpg' AS file, CAST(label AS INT) AS id, CASE WHEN label < 5 THEN lower('Class ' || label) ELSE CAST(label AS VARCHAR) END AS name FROM (SELECT vec_id, label FROM embeddings)".replace("lower('Class ' || label)", "'class_' || label"))
def s11_j15_labelled_crops(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "embeddings").select(F.concat(F.lit("f"), "vec_id", F.lit(".jpg  "), "label").alias("value"))
    names = c.class_names(spark.range(5).select(F.concat("id", F.lit(",Class "), "id").alias("value")))
    return c.labelled(lines, names)


@query(with_tables("SELECT tile, count(*) AS n, round(avg(f7), 6) AS stats_mean, round(max(u), 6) AS stats_most FROM node GROUP BY tile", "node"))
def s14_s15_flattened_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).groupBy("tile").agg(F.struct(F.count(F.lit(1)).alias("n"), F.struct(r(F.avg("f7")).alias("mean"), r(F.max("u")).alias("most")).alias("stats")).alias("s"))
    return c.flattened(rows, "s")


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity * 100 AS SMALLINT) AS DOUBLE) / 1000 AS height FROM lineitem")
def s23_scaled_heights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.meters(F.col("l_quantity") * 100).alias("height"))


@query(with_tables("SELECT tile, count(*) AS n, max(p) AS most FROM score WHERE split = 'F' GROUP BY tile", "score"))
def s07_s12_s13_store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written by split and read back: one split, three columns."""
    folder = new_folder(spark, "store")
    c.save_quads(scores(spark, d), folder)
    return c.read_store(spark, folder, "F", ["tile", "p"]).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("most"))


@query(with_tables("SELECT tile, id FROM (SELECT tile, id, row_number() OVER (PARTITION BY tile ORDER BY f7 DESC, id) AS k FROM node) WHERE k <= 3", "node"))
def t01_t06_top_k(spark: SparkSession, d: str) -> DataFrame:
    best = Window.partitionBy("tile").orderBy(F.desc("f7"), "id")
    return nodes(spark, d).withColumn("k", F.row_number().over(best)).where("k <= 3").select("tile", "id")


@query(with_tables("SELECT tile, round(avg(t), 6) AS hazard FROM score GROUP BY tile ORDER BY round(avg(t), 6) DESC, (tile * 7919) % 1009 LIMIT 10", "score"))
def t05_t07_ranked_limit(spark: SparkSession, d: str) -> DataFrame:
    """The ten most hazardous locations, ties in a seeded order: the limit is the feature."""
    rows = scores(spark, d).groupBy("tile").agg(r(F.avg("t")).alias("hazard"))
    return rows.orderBy(F.desc("hazard"), (F.col("tile") * 7919) % 1009).limit(10)


@query(with_tables("SELECT tile FROM (SELECT tile, row_number() OVER (ORDER BY tile) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT tile FROM score)) WHERE i IN (SELECT CAST(floor(k * (n - 1) / 4.0) AS BIGINT) FROM range(0, 5) g(k))", "score"))
def t08_even_pick(spark: SparkSession, d: str) -> DataFrame:
    """Five tiles evenly spaced in their order."""
    rows = scores(spark, d).select("tile").distinct()
    w = Window.orderBy("tile")  # a row for each tile's name, not for each pixel
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return rows.where(F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * (F.col("n") - 1) / 4.0)), F.col("i").cast("long"))).select("tile")


@query("SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("customer")))


@query(with_tables("SELECT split, tile, count(*) AS n FROM score GROUP BY split, tile HAVING count(*) >= 2", "score"))
def o01_split_capacity(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("split", "tile").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT to_json({'tile': label, 'n': count(*)}) AS record FROM embeddings GROUP BY label")
def s15_json_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.to_json(F.struct(F.col("label").alias("tile"), "n")).alias("record"))


@query("SELECT p_brand AS folder, p_name || '-' || p_partkey || '.tif' AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name || '-' || p_partkey || '.tif') AS INT) AS place FROM part WHERE p_size % 4 <> 0")
def t04_sorted_listing(spark: SparkSession, d: str) -> DataFrame:
    """The files of each folder in the order of their names, as a scan meets them."""
    files = table(spark, d, "part").where("p_size % 4 <> 0").select(F.col("p_brand").alias("folder"), F.concat("p_name", F.lit("-"), "p_partkey", F.lit(".tif")).alias("file"))
    return files.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("file")))


@query(with_tables("SELECT CAST(tile AS VARCHAR) AS raster, 16 AS height, 16 AS width, count(z) AS n, round(sum(z), 4) AS total FROM elevation GROUP BY tile", "elevation"))
def s06_s10_raster_files(spark: SparkSession, d: str) -> DataFrame:
    """Elevation tiles written as typed rasters with a no-data value, and the folder scanned back."""
    spark.dataSource.register(RasterFolder)
    folder = new_folder(spark, "rasters")
    tiles = elevation(spark, d).select(F.col("tile").alias("raster"), F.col("y").alias("row"), F.col("x").alias("col"), F.col("z").alias("v"))
    as_rasters(tiles, 16, 16).write.format("raster_folder").mode("append").option("dtype", "float64").option("nodata", -9999).save(folder)
    found = spark.read.format("raster_folder").option("path", folder).option("size", 16).load().where("status = 'ok'")
    rows = found.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("raster"), "height", "width", F.explode("values").alias("z"))
    return rows.groupBy("raster", "height", "width").agg(F.count("z").alias("n"), r(F.sum("z"), 4).alias("total"))

"""Catalogs of raster pairs, file listings, manifests and stores as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_TEXT = ("alias", "dem_id", "terrain", "dtm_path", "ortho_path", "status")
CATALOG = StructType([StructField(n, DoubleType() if n == "scale" else StringType()) for n in ("alias", "dem_id", "terrain", "scale", "dtm_path", "ortho_path", "status")])
MANIFEST = StructType([StructField(n, {"row": LongType(), "col": LongType()}.get(n, DoubleType() if n.endswith("_frac") else StringType())) for n in (
    "split", "alias", "row", "col", "image_npy", "risk_npy", "hazard_npy", "valid_npy", "nodata_frac", "sat_frac", "hazardous_frac")])
#: Least size of a whole raster file; smaller ones are broken downloads.
WHOLE = 5 << 20


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CATALOG)


def pairs(catalog: DataFrame, dem_dir: str, browse_dir: str, terrains: list[str] | None = None, status: str | None = "Verified") -> DataFrame:
    """Catalog rows of a status and of some terrains (any case), trimmed, with the paths of both files."""
    rows = catalog.select(*[F.trim(c).alias(c) if c in _TEXT else F.col(c) for c in catalog.columns])
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if terrains is not None:
        rows = rows.where(F.lower("terrain").isin([t.lower() for t in terrains]))
    return rows.withColumn("dem_file", F.concat(F.lit(f"{dem_dir}/"), "dem_id", F.lit(".IMG"))).withColumn("browse_file", F.concat(F.lit(f"{browse_dir}/"), "alias", F.lit(".JP2")))


def existing(rows: DataFrame, listing: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with has_<column> for each path column, by the listing (path, size)."""
    for c in columns:
        found = listing.select(F.col("path").alias(c), F.lit(True).alias(f"has_{c}")).distinct()
        rows = rows.join(found, c, "left").withColumn(f"has_{c}", F.coalesce(f"has_{c}", F.lit(False)))
    return rows


def audited(rows: DataFrame, listing: DataFrame, first: str, second: str) -> DataFrame:
    """status: Verified where both files are there and whole, Corrupt/Small where both are there, else Missing."""
    a = listing.select(F.col("path").alias(first), F.col("size").alias("__a"))
    b = listing.select(F.col("path").alias(second), F.col("size").alias("__b"))
    rows = rows.join(a, first, "left").join(b, second, "left")
    status = F.when(F.col("__a").isNull() | F.col("__b").isNull(), "Missing").when((F.col("__a") > WHOLE) & (F.col("__b") > WHOLE), "Verified").otherwise("Corrupt/Small")
    return rows.withColumn("status", status).drop("__a", "__b")


def orbit_ids(name: Column) -> Column:
    """All runs of six digits in a file name."""
    return F.regexp_extract_all(name, F.lit(r"(\d{6})"), 1)


def built(dtms: DataFrame, orthos: DataFrame, categories: dict[str, str]) -> DataFrame:
    """A catalog row for each elevation file (name): the first image (by name) that holds any of its ids, its category and scale."""
    ids = dtms.select(F.col("name").alias("dtm"), F.explode(orbit_ids(F.col("name"))).alias("id"))
    held = orthos.select(F.col("name").alias("ortho"), F.explode(orbit_ids(F.col("name"))).alias("id"))
    first = ids.join(held, "id").groupBy("dtm").agg(F.min("ortho").alias("ortho"))
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]) if categories else None
    known = F.filter(F.transform(orbit_ids(F.col("dtm")), lambda i: F.try_element_at(table, i)), lambda c: c.isNotNull()) if categories else F.array().cast("array<string>")
    return dtms.select(F.col("name").alias("dtm")).join(first, "dtm", "left").select(
        "dtm", "ortho", F.coalesce(F.get(known, 0), F.lit("Uncategorized")).alias("terrain"),
        F.when(F.col("dtm").contains("DTEED"), 2.0).otherwise(1.0).alias("scale"), F.substring("dtm", 1, 20).alias("dem_id"))


def paired_by_prefix(a: DataFrame, b: DataFrame, length: int = 15) -> DataFrame:
    """Stems of both listings by side: paired (same stem or same first ``length`` characters) or orphan."""
    left, right = a.select("stem").distinct(), b.select("stem").distinct()
    key = F.substring("stem", 1, length).alias("k")
    lk, rk = left.select(key).distinct(), right.select(key).distinct()
    out = left.withColumn("side", F.lit("a")).withColumn("k", F.substring("stem", 1, length)).join(rk.withColumn("hit", F.lit(True)), "k", "left")
    return out.union(right.withColumn("side", F.lit("b")).withColumn("k", F.substring("stem", 1, length)).select("k", "stem", "side").join(lk.withColumn("hit", F.lit(True)), "k", "left")).select(
        "side", "stem", F.col("hit").isNotNull().alias("paired"))


def extension_census(listing: DataFrame) -> DataFrame:
    """Files and doubtful names (copies, labels, archives) by lower-case extension."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^./]*)$", 1))
    odd = F.col("name").contains("(1)") | ext.isin(".lbl", ".xml", ".zip")
    return listing.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"))


def size_audit(listing: DataFrame) -> DataFrame:
    """Files by state: missing (no size), stub (under 10 bytes), ok."""
    state = F.when(F.col("size").isNull(), "missing").when(F.col("size") < 10, "stub").otherwise("ok")
    return listing.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def complete_quads(files: DataFrame, kinds: int = 4) -> DataFrame:
    """(alias, row, col) of the tiles of which every kind of file is there; the key is parsed from the name alias_rNNNNN_cNNNNN_kind.npy."""
    pattern = r"^(.*)_r(\d+)_c(\d+)_([a-z]+)\.npy$"
    rows = files.select(*[F.regexp_extract("name", pattern, i).alias(n) for i, n in enumerate(("alias", "row", "col", "kind"), 1)]).where("kind <> ''")
    out = rows.groupBy("alias", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.countDistinct("kind").alias("n"))
    return out.where(F.col("n") == kinds).drop("n")


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` (alias) with their split, 'unknown' where no list names them."""
    return rows.join(splits.dropDuplicates(["alias"]), "alias", "left").withColumn("split", F.coalesce("split", F.lit("unknown")))


def split_list(lines: DataFrame) -> DataFrame:
    """Aliases of a split list: lines trimmed, blank ones dropped; an alias may hold spaces."""
    return lines.select(F.trim("value").alias("alias")).where("alias <> ''")


def class_names(lines: DataFrame) -> DataFrame:
    """(id, name) of a class map's lines 'id,Name With Spaces'."""
    parts = F.split("value", ",", 2)
    return lines.select(F.trim(parts[0]).cast("int").alias("id"), F.regexp_replace(F.lower(F.trim(parts[1])), " ", "_").alias("name")).where("id IS NOT NULL")


def labelled(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(file, id, name) of label lines 'file id'; an unknown id is its own name."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts[0].alias("file"), parts[1].cast("int").alias("id")).where("id IS NOT NULL")
    return rows.join(names, "id", "left").select("file", "id", F.coalesce("name", F.col("id").cast("string")).alias("name"))


def save_quads(rows: DataFrame, path: str) -> None:
    """Tiles as Parquet by split, so that a reader of one split skips the others; what is there already stays."""
    rows.write.mode("ignore").partitionBy("split").parquet(path)


def read_store(spark: SparkSession, path: str, split: str, columns: list[str]) -> DataFrame:
    """Some columns of one split of a store."""
    return spark.read.parquet(path).where(F.col("split") == split).select(*columns)


def flattened(rows: DataFrame, column: str) -> DataFrame:
    """A struct's fields as columns; fields of an inner struct as outer_inner."""
    out = []
    for f in rows.schema[column].dataType.fields:
        inner = getattr(f.dataType, "fields", None)
        out += [F.col(f"{column}.{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in inner] if inner else [F.col(f"{column}.{f.name}").alias(f.name)]
    return rows.select(*[c for c in rows.columns if c != column], *out)


def meters(millimetres: Column) -> Column:
    """Heights stored as short integers."""
    return millimetres.cast("short") / F.lit(1000.0)


def first_match(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")

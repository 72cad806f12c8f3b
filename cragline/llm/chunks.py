"""Exact duplicates by recipes of content-defined chunks, in DataFrame and SQL functions only.

A text is cut behind line feeds and before words with a rare first letter, so an equal stretch of two texts gives equal chunks
wherever it lies. The 64-bit keys of a text's chunks, in order, are its recipe. A recipe that one row alone has is that
of a different text (its chunks aren't moved unless very many recipes are repeated). The chunks of all others are deduplicated by key and bytes, in their task first:
a key under which a single chunk is found is a verified identifier, and equal lists of such identifiers are equal texts. Where different chunks share a key, the
texts of the recipes that hold it are compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.llm._spark import pinned

#: Characters of a chunk: more than the least only up to the first cut, and never over the most.
LEAST, MOST = 64, 4096
#: Recipes, and groups of copies with their recipes, that are broadcast at most; and the numbers of chunks a recipe has then at most.
FEW_RECIPES, FEW_GROUPS, SHORT = 500_000, 4096, 256
#: Copies of a repeated row that come back from one array.
RUN = 4096
CHUNK = f"(?s).{{{LEAST},{MOST}}}?(?:\\n|\\s(?=[jkqvxzJKQVXZ0-9]))|.{{1,{MOST}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text. Null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK), F.lit(0))


def chunk_key(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def shared_keys(docs: DataFrame, recipes: DataFrame, bits: int, text: str) -> DataFrame:
    """(chunk_key): keys under which the texts with the given recipes hold different chunks.

    Each task sends a chunk once, however often it holds it; so a passage that all texts share is a row a task.
    """
    rows = docs.select(chunks(docs[text]).alias("parts"))
    if recipes.count() <= FEW_RECIPES:  # else every text is checked
        marks = recipes.select(F.xxhash64("recipe").alias("mark")).distinct()
        rows = rows.join(F.broadcast(marks), F.xxhash64(F.transform("parts", lambda c: chunk_key(c, bits))) == F.col("mark"), "left_semi")
    different = rows.select(F.explode("parts").alias("chunk")).select(chunk_key(F.col("chunk"), bits).alias("chunk_key"), "chunk").distinct()
    return different.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_key")


def exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256: one row for each row of ``docs``.

    Texts are equal when their bytes are; null is an empty text. Of equal texts the row with the largest key stays, a null key
    only where all are null; of repeated rows with that key one stays. Keys may repeat under different texts. Other columns
    of ``docs`` are not read; an empty table gives an empty result. ``bits`` of a chunk's key less than 64 are for tests of shared keys.
    """
    rows = docs.select(docs[key].cast("long").alias("id"), F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256).alias("sha"),
                       F.transform(chunks(docs[text]), lambda c: chunk_key(c, bits)).alias("recipe"))
    # repeated rows become one with a number, so that one of them can stay
    rows = pinned(rows.groupBy("id", "recipe", "sha").agg(F.count(F.lit(1)).alias("times")))
    repeated = pinned(rows.groupBy("recipe").agg(F.sum("times").alias("n")).where("n > 1"))
    doubtful = pinned(shared_keys(docs, repeated, bits, text))
    rows = rows.withColumn("whole", F.lit(None).cast("string"))
    if doubtful.count():
        rows = with_whole_texts(docs, rows, repeated, doubtful, bits, text, key)
    groups = pinned(rows.groupBy("recipe", "whole").agg(F.sum("times").alias("n"), F.max("id").alias("keep")).where("n > 1"))
    found = with_groups(rows, groups)
    found = found.select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", "times").alias("group_size"), "sha", "times")
    # a row that is repeated very often comes back in runs, so that no array of them is long
    found = found.withColumn("run", F.explode(F.expr(f"sequence(0L, (times - 1) div {RUN})"))).withColumn("copy", F.explode(F.expr(f"sequence(run * {RUN}, least(times, (run + 1) * {RUN}) - 1)")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return found.select("id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "sha").toDF(key, "keep_id", "group_size", "kept", "text_sha256")


def with_whole_texts(docs: DataFrame, rows: DataFrame, repeated: DataFrame, doubtful: DataFrame, bits: int, text: str, key: str) -> DataFrame:
    """``rows`` where those of repeated recipes with a doubtful key have their text as ``whole``; no others move theirs."""
    held = repeated.select("recipe", F.explode("recipe").alias("chunk_key")).join(doubtful, "chunk_key", "left_semi").select("recipe").distinct()
    held = pinned(held)
    read = docs.select(docs[key].cast("long").alias("id"), F.transform(chunks(docs[text]), lambda c: chunk_key(c, bits)).alias("recipe"), F.coalesce(docs[text], F.lit("")).alias("whole"))
    read = read.join(held, "recipe", "left_semi").groupBy("id", "recipe", "whole").agg(F.count(F.lit(1)).alias("times"))
    read = read.select("id", "recipe", F.sha2(F.col("whole").cast("binary"), 256).alias("sha"), "times", "whole")
    return pinned(rows.join(held, "recipe", "left_anti").select("id", "recipe", "sha", "times", "whole").unionByName(read))


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with n and keep of their group, null where a row is alone.

    The largest groups, at most ``FEW_GROUPS`` of at most ``SHORT`` chunks, are broadcast, so their rows stay where they are; the others meet by recipe.
    """
    hot = groups.where((F.size("recipe") <= SHORT) & (F.coalesce(F.length("whole"), F.lit(0)) <= MOST)).orderBy(F.desc("n"), "recipe", "whole").limit(FEW_GROUPS)
    hot = pinned(hot)
    same = (F.col("recipe") == F.col("of")) & F.col("whole").eqNullSafe(F.col("of_whole"))
    named = lambda g: g.select(F.col("recipe").alias("of"), F.col("whole").alias("of_whole"), "n", "keep")
    met = rows.join(F.broadcast(named(hot)), same, "left")
    if groups.count() <= FEW_GROUPS and hot.count() == groups.count():
        return met.select("id", "sha", "times", "n", "keep")
    done = met.where("n IS NOT NULL").select("id", "sha", "times", "n", "keep")
    rest = met.where("n IS NULL").select(*rows.columns)
    other = named(groups.join(named(hot), same, "left_anti"))
    return done.unionByName(rest.join(other, same, "left").select("id", "sha", "times", "n", "keep"))


DUCK_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""

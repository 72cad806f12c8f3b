"""Small helpers shared by the corpus operators: checkpoints, sizing, column carrying."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def pinned(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only in local tests, where that is
    unset, a temporary folder of this machine is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def counted(df: DataFrame, **more: Column) -> tuple[DataFrame, dict]:
    """``pinned(df)`` with its number of rows (``n``) and other aggregates, observed while the checkpoint is written: no job of their own."""
    seen = Observation()
    kept = pinned(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in more.items())))
    return kept, seen.get


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one of this machine only where Spark runs on it alone and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cragline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def text_volume(docs: DataFrame, text: str) -> tuple[int, int]:
    """(rows, bytes of text) of the whole table, as one aggregate."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def carried(docs: DataFrame, columns: list[str]) -> tuple[list, list[str]]:
    """Columns under neutral names c0, c1, ... so that no input name can clash with an operator's own."""
    names = [f"c{i}" for i in range(len(columns))]
    return [docs[f"`{c}`"].alias(n) for c, n in zip(columns, names)], names

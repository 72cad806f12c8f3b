"""Approximate nearest neighbours by randomly rotated one-bit codes, with error bounds and exact reranking.

Vectors are scaled to unit length, the centre of their cell is taken off and the rest is rotated by a seeded random
rotation; the signs are the code, one bit a dimension. With the length of the rest and its inner product with its own code,
a query's inner product is estimated from the packed bits, and an error bound for it follows. A query keeps
the vectors whose upper bound reaches the k-th largest lower bound, and only those are compared exactly.

Cells are the nearest of a few centres fitted on a bounded sample; every vector is indexed. A query visits the nearest
ones, a share that keeps the recall above 0.9 even on vectors without structure. Cells are cut into blocks of vectors and of queries, so no cell meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm._spark import pinned

#: Vectors in a cell on average, share of the cells that a query visits and their least number, rows in the sample that centres are fitted on, queries in a block.
CELL, PROBED, LEAST_PROBED, SAMPLE, QUERIES = 16_384, 0.6, 24, 20_000, 2048
#: Standard deviations of the estimate's error in its bounds.
SURE = 2.0
SEED = 11


def rotation(dims: int) -> np.ndarray:
    """A seeded random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of ``sample`` (unit vectors) by a few rounds of k-means from seeded rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    found = sample[np.random.default_rng(SEED).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(8 if len(found) > 1 else 1):
        near = np.argmax(sample @ found.T - 0.5 * (found**2).sum(1), axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        many = np.bincount(near, minlength=len(found))
        found = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], found)
    return found


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class Codes:
    """One-bit codes of unit vectors about a centre."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray):
        dims = vectors.shape[1]
        self.turn, self.centre, self.dims = rotation(dims), centre, dims
        rest = (vectors - centre) @ self.turn
        self.length = np.sqrt((rest * rest).sum(1))
        safe = np.maximum(self.length, 1e-300)
        self.packed = np.packbits(rest > 0, axis=1)
        self.own = np.maximum(np.abs(rest).sum(1) / np.sqrt(dims) / safe, 1e-6)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of each query (row) with each vector (column), and their possible error."""
        turned = queries @ self.turn
        signs = np.unpackbits(self.packed, axis=1, count=self.dims).astype(np.float32) * 2 - 1
        about = (turned.astype(np.float32) @ signs.T) / np.sqrt(self.dims)
        scale = self.length / self.own
        # the part of a query that a code can't see is even in all directions across it
        wide = SURE * self.length * np.sqrt(np.maximum(1 - self.own**2, 0)) / self.own / np.sqrt(max(self.dims - 1, 1))
        return (queries @ self.centre)[:, None] + about * scale, np.sqrt((queries**2).sum(1))[:, None] * wide + 1e-6


def nearest(vectors: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, its up to ``k`` nearest distinct vectors and ties at the end, exact cosines), in double precision."""
    a, q = unit(vectors), unit(queries)
    codes = Codes(a, centre)
    norms = np.sqrt((vectors * vectors).sum(1))
    for at in range(0, len(q), 256):
        about, error = codes.bounds(q[at : at + 256])
        low = about - error
        kth = -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] > k else np.full(len(low), -np.inf)
        for i in range(len(low)):
            near = np.flatnonzero(about[i] + error[i] >= kth[i])
            query = queries[at + i]
            exact = (vectors[near] * query).sum(1) / (norms[near] * np.sqrt((query * query).sum()))
            if len(near) > k:
                keep = exact >= -np.partition(-exact, k - 1)[k - 1]
                near, exact = near[keep], exact[keep]
            yield at + i, near, exact


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def searched(table: DataFrame, is_query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", cell_rows: int = CELL, probed: int | None = None) -> DataFrame:
    """query_id, rank, key and score: for each row that the SQL ``is_query`` (on any columns of ``table``) selects, its ``k`` nearest other rows by cosine.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    null keys. Equal vectors are searched as one: of each the k + 1 least keys can be in a result, no others. Repeated
    keys are rows of their own. An empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("v"), F.expr(is_query).alias("is_query")).where(
        "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = dims[0]["d"] if dims else 1
    rows = rows.where(F.size("v") == dims)
    # equal vectors: the least keys of each, first by a salt and then all
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    distinct = pinned(salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")))
    total = distinct.count()
    taken = distinct.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"]
    sample = unit(np.stack(taken.to_list())) if len(taken) else np.zeros((0, dims))
    middle = centres(sample, max(1, min(4096, -(-total // cell_rows))))

    probed = max(LEAST_PROBED, -(-int(100 * PROBED) * len(middle) // 100)) if probed is None else probed

    def assign(many: int, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(_matrix(batch.column("v")))
                apart = (middle**2).sum(1) - 2 * x @ middle.T
                cells = np.argpartition(apart, many - 1, axis=1)[:, :many].astype(np.int32) if many < len(middle) else np.tile(np.arange(len(middle), dtype=np.int32), (len(x), 1))
                yield pa.record_batch([*(batch.column(n) for n in names), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * many, cells.ravel())], names=[*names, "cells"])
        return run

    held = distinct.mapInArrow(assign(1, ["v", "ids"]), "v array<double>, ids array<long>, cells array<int>").select("v", "ids", F.element_at("cells", 1).alias("cell"))
    asked = rows.where("is_query").mapInArrow(assign(min(probed, len(middle)), ["v", "id"]), "v array<double>, id long, cells array<int>").select("v", "id", F.explode("cells").alias("cell"))
    held, asked = pinned(held), pinned(asked)
    per_block = int(min(16_384, max(256, total // 32)))
    sizes = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("blocks"))  # a row for each of at most 4,096 cells
    sizes = sizes.join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")), "cell").withColumnRenamed("cell", "of")
    sizes = F.broadcast(pinned(sizes))
    held = held.join(sizes, F.col("cell") == F.col("of")).select("v", "ids", "cell", F.pmod(F.xxhash64("ids"), "blocks").alias("block"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    asked = asked.join(sizes, F.col("cell") == F.col("of")).select("v", "id", "cell", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))

    def meet(where: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        query, found, score = [], [], []
        if len(left) and len(right):
            ids, keys = left["ids"].to_pylist(), right["id"].to_pylist()
            for i, near, exact in nearest(_matrix(left["v"]), _matrix(right["v"]), middle[where[0].as_py()], k + 1):
                for j, s in zip(near.tolist(), exact.tolist()):
                    own = [x for x in ids[j] if x != keys[i]]
                    query += [keys[i]] * len(own)
                    found += own
                    score += [s] * len(own)
        return pa.table([pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    blocks = ["cell", "block", "part"]
    met = held.groupBy(*blocks).cogroup(asked.groupBy(*blocks)).applyInArrow(meet, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")

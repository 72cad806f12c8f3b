"""Masked reconstruction of patches on given weights: patch tokens, hidden ones, a dense decoder, and the loss over masked patches.

A patch's tokens and its reconstruction hang on that patch alone, so all patches of an Arrow batch, of whatever tiles, go through the dense layers
at once, where they lie: no shuffle beside the one that gathers the patches and the one that masks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cragline.operators.neural import gelu

#: Numbers that a weight table may hold, as it goes to every worker.
MOST = 8_000_000


def weights_from(table: DataFrame, most: int = MOST) -> dict[str, np.ndarray]:
    """The matrices of a weight table (name, row, values), each with its rows 0, 1, ... in order. Over ``most`` numbers, or with gaps, repeats or uneven rows, it is refused."""
    size = table.agg(F.coalesce(F.sum(F.size("values").cast("long")), F.lit(0)).alias("n")).first()["n"]
    if size > most:
        raise ValueError(f"{size} weights, over the bound of {most}")
    held: dict[str, dict[int, list[float]]] = {}
    for name, row, values in table.select("name", "row", "values").collect():
        if row in held.setdefault(name, {}):
            raise ValueError(f"row {row} of {name} is there twice")
        held[name][row] = values
    out = {}
    for name, rows in held.items():
        if sorted(rows) != list(range(len(rows))) or len({len(v) for v in rows.values()}) != 1:
            raise ValueError(f"rows of {name} have gaps or differ in length")
        out[name] = np.array([rows[i] for i in range(len(rows))], float)
    return out


def as_rows(weights: dict[str, np.ndarray]) -> list[tuple[str, int, list[float]]]:
    """(name, row, values) of each row of each matrix, as ``weights_from`` reads them."""
    return [(name, i, list(map(float, row))) for name, matrix in weights.items() for i, row in enumerate(matrix)]


def seeded_weights(patches: int, area: int, dims: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights drawn from a seed: tokens, places, the mask token, and a decoder of three hidden layers and a linear one."""
    draw = np.random.default_rng(seed)
    out = {"embed": draw.normal(0, 0.5, (dims, area)), "embed_scale": draw.normal([[1.0] * dims, [0.0] * dims], 0.1), "place": draw.normal(0, 0.2, (patches, dims)),
           "mask": draw.normal(0, 0.2, (1, dims)), "again": draw.normal(0, 0.2, (patches, dims))}
    wide = [dims, hidden, hidden, hidden, area]
    for k, (i, o) in enumerate(zip(wide, wide[1:])):
        out[f"dense{k}"] = np.c_[draw.normal(0, i**-0.5, (o, i)), draw.normal(0, 0.1, o)]
        if k < 3:
            out[f"scale{k}"] = draw.normal([[1.0] * o, [0.0] * o], 0.1)
    return out


def layer_norm(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows brought to mean 0 and variance 1 (1e-5 added); ``scale`` has a row of factors and one of terms."""
    x = x - x.mean(1, keepdims=True)
    return x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-5) * scale[0] + scale[1]


def tokens(values: np.ndarray, patch: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """A token for each patch: its values projected, normalised, and its place added."""
    return layer_norm(values @ weights["embed"].T, weights["embed_scale"]) + weights["place"][patch]


def decode(x: np.ndarray, patch: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Values of each patch from its token; the last column of a dense layer is its bias."""
    x = x + weights["again"][patch]
    last = sum(name.startswith("dense") for name in weights) - 1
    for k in range(last + 1):
        x = x @ weights[f"dense{k}"][:, :-1].T + weights[f"dense{k}"][:, -1]
        x = x if k == last else layer_norm(gelu(x), weights[f"scale{k}"])
    return x


def reconstructed(rows: DataFrame, weights: dict[str, np.ndarray], hide: bool = False) -> DataFrame:
    """``rows`` (tile, patch, values, masked, ...) with ``token`` and ``predicted``.

    With ``hide`` a masked patch's token is the mask token, else the decoder sees what was there. All columns are kept in their
    order; columns named token or predicted are replaced. A null patch number or null values give null results, a
    null or NaN in the values makes them NaN, a null ``masked`` counts as seen. Values of another length than the weights have, or a patch without a place, are an error.
    """
    rows = rows.drop("token", "predicted")
    area, places, empty = weights["embed"].shape[1], len(weights["place"]), pa.array([], pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("patch").is_valid().to_numpy(False) & batch.column("values").is_valid().to_numpy(False)
            part = batch.filter(pa.array(known))
            found = [empty, empty]
            if len(part):
                patch, values = part.column("patch").to_numpy().astype(int), part.column("values")
                if set(np.diff(values.offsets.to_numpy()).tolist()) != {area}:
                    raise ValueError(f"patches must have {area} values")
                if patch.min() < 0 or patch.max() >= places:
                    raise ValueError(f"patches must lie from 0 to {places - 1}")
                x = tokens(values.flatten().cast(pa.float64()).to_numpy(False).reshape(len(part), area), patch, weights)
                if hide:
                    x = np.where(part.column("masked").fill_null(False).to_numpy(False)[:, None], weights["mask"], x)
                found = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel()) for m in (x, decode(x, patch, weights))]
            at = pa.array(np.where(known, np.cumsum(known) - 1, 0), mask=~known)
            yield pa.record_batch([*batch.columns, *(f.take(at) for f in found)], names=[*batch.schema.names, "token", "predicted"])

    kind = T.StructType([*rows.schema.fields, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("token", "predicted"))])
    return rows.mapInArrow(run, kind)


def patch_error(values: Column, predicted: Column) -> Column:
    """Mean squared distance of ``predicted`` from ``values`` brought to mean 0 and (sample) variance 1, 1e-6 added to the variance."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(F.transform(values, lambda x: F.pow(x - mean, 2)), F.lit(0.0), lambda a, x: a + x) / (n - 1)
    apart = F.zip_with(values, predicted, lambda x, p: F.pow((x - mean) / F.sqrt(var + 1e-6) - p, 2))
    return F.aggregate(apart, F.lit(0.0), lambda a, x: a + x) / n


def masked_loss(rows: DataFrame) -> DataFrame:
    """(tile, loss, n): mean error of each tile's masked patches, from ``reconstructed``; null where none is masked."""
    error = F.when(F.col("masked"), patch_error(F.col("values"), F.col("predicted")))
    return rows.groupBy("tile").agg(F.avg(error).alias("loss"), F.count(error).alias("n"))

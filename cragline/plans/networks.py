"""Queries for networks on given weights, with their layers written out in SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.operators import neural, raster, reconstruct
from cragline.plans.fixtures import nodes, pixels, with_tables
from cragline.plans.graphs import KNN, PHYS, knn
from cragline.plans.registry import query, r


def numbers(row: np.ndarray) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in row) + "]"


def matrix(rows: np.ndarray) -> str:
    return "[" + ", ".join(map(numbers, rows)) + "]"


#: The error function in SQL: its power series up to 4, beyond which it is 1 in seven digits.
_SERIES = numbers(np.array([2 / math.sqrt(math.pi) * (-1) ** n / math.factorial(n) / (2 * n + 1) for n in range(70)]))


def gelu_sql(x: str) -> str:
    """Each of the numbers of a list in the smooth rectifier."""
    return f"[0.5 * h * (1 + CASE WHEN abs(h) > 5.6 THEN sign(h) ELSE list_inner_product({_SERIES}, [pow(h / sqrt(2), 2 * k + 1) FOR k IN range(70)]) END) FOR h IN {x}]"


def dense_sql(x: str, rows: np.ndarray) -> str:
    return f"[list_inner_product({x}, w) FOR w IN {matrix(rows)}]"


def norm_sql(x: str, scale: np.ndarray) -> str:
    """A list brought to mean 0 and variance 1, with factors and terms for each place."""
    n = scale.shape[1]
    return f"[({x}[i] - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5) * {numbers(scale[0])}[i] + {numbers(scale[1])}[i] FOR i IN range(1, {n + 1})]"


def plus_sql(x: str, y: str, n: int) -> str:
    return f"[{x}[i] + {y}[i] FOR i IN range(1, {n + 1})]"


DIMS, WIDTH = 8, 16
WEIGHTS = reconstruct.seeded_weights(16, 16, DIMS, WIDTH, 4)


def _decoder(source: str, name: str) -> str:
    """Steps from tokens ``x`` of ``source`` (tile, patch, masked, vals, x) to values ``x`` of ``name``."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT * REPLACE ({plus_sql('x', f'{matrix(WEIGHTS['again'])}[patch + 1]', DIMS)} AS x) FROM {source})"]
    for k in range(4):
        wide = f"{dense_sql('list_append(x, 1.0)', WEIGHTS[f'dense{k}'])}"
        to = f"{name}_{k}_d"
        steps.append(f"{to} AS MATERIALIZED (SELECT * REPLACE ({wide if k == 3 else gelu_sql(wide)} AS x) FROM {name}_{k})")
        steps.append(f"{name} AS (SELECT * FROM {to})" if k == 3 else f"{name}_{k + 1} AS MATERIALIZED (SELECT * REPLACE ({norm_sql('x', WEIGHTS[f'scale{k}'])} AS x) FROM {to})")
    return ", ".join(steps)


_PATCHES = ("held AS (SELECT tile, patch, list(v ORDER BY y, x) AS vals, row_number() OVER (PARTITION BY tile ORDER BY (patch * 7919 + tile * 104729) % 1009, patch) - 1 >= 4 AS masked"
            " FROM (SELECT *, CAST(floor(y / 4) * 4 + floor(x / 4) AS INT) AS patch FROM pixel) GROUP BY tile, patch), "
            f"laid AS MATERIALIZED (SELECT *, {dense_sql('vals', WEIGHTS['embed'])} AS x FROM held), "
            f"normed AS MATERIALIZED (SELECT * REPLACE ({norm_sql('x', WEIGHTS['embed_scale'])} AS x) FROM laid), "
            f"token AS MATERIALIZED (SELECT * REPLACE ({plus_sql('x', f'{matrix(WEIGHTS['place'])}[patch + 1]', DIMS)} AS x) FROM normed), "
            f"hidden AS MATERIALIZED (SELECT * REPLACE (CASE WHEN masked THEN {numbers(WEIGHTS['mask'][0])} ELSE x END AS x) FROM token)")
_ERROR = "list_avg([pow((vals[i] - list_avg(vals)) / sqrt(list_var_samp(vals) + 1e-6) - x[i], 2) FOR i IN range(1, 17)])"


def _patches(spark: SparkSession, d: str) -> DataFrame:
    return raster.masked(raster.patches(pixels(spark, d), 4, 16), 0.75, (F.col("patch") * 7919 + F.col("tile") * 104729) % 1009)


def _weights(spark: SparkSession) -> dict[str, np.ndarray]:
    """The seeded weights by way of a weight table, as trained ones would come."""
    return reconstruct.weights_from(spark.createDataFrame(reconstruct.as_rows(WEIGHTS), "name string, row int, values array<double>"))


@query(with_tables(f"WITH {_PATCHES}, {_decoder('token', 'seen')} SELECT s.tile, s.patch, s.masked, round(t.x[1], 6) AS token_0, round(list_sum(t.x), 6) AS token_sum, round(s.x[1], 6) AS value_0, round(s.x[16], 6) AS value_15,"
                   f" round(list_sum(s.x), 6) AS value_sum, round(list_inner_product(s.x, s.x), 6) AS value_squares FROM seen s JOIN token t USING (tile, patch)", "pixel"))
def n01_reconstructed_patches(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of patches and the values that the decoder makes of them; it sees masked patches, too."""
    out = reconstruct.reconstructed(_patches(spark, d), _weights(spark))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    found = {"token_0": F.col("token")[0], "token_sum": total("token"), "value_0": F.col("predicted")[0], "value_15": F.col("predicted")[15], "value_sum": total("predicted"),
             "value_squares": total(F.transform("predicted", lambda x: x * x))}
    return out.select("tile", "patch", "masked", *[r(c).alias(n) for n, c in found.items()])


@query(with_tables(f"WITH {_PATCHES}, {_decoder('token', 'seen')}, {_decoder('hidden', 'unseen')}, error AS (SELECT tile, {_ERROR} AS seen, NULL AS hidden FROM seen WHERE masked UNION ALL SELECT tile, NULL, {_ERROR} FROM unseen WHERE masked)"
                   " SELECT tile, round(avg(seen), 6) AS loss_seen, round(avg(hidden), 6) AS loss_hidden, count(seen) AS n FROM error GROUP BY tile", "pixel"))
def n01_masked_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss over each tile's masked patches, where the decoder sees them and where they are hidden behind the mask token: two passes over rows, one sum."""
    rows, weights = _patches(spark, d), _weights(spark)
    both = reconstruct.reconstructed(reconstruct.reconstructed(rows, weights).withColumnRenamed("predicted", "seen"), weights, hide=True)
    error = lambda c: F.when(F.col("masked"), reconstruct.patch_error(F.col("values"), F.col(c)))
    return both.groupBy("tile").agg(r(F.avg(error("seen"))).alias("loss_seen"), r(F.avg(error("predicted"))).alias("loss_hidden"), F.count(error("seen")).alias("n"))


NETWORK = neural.seeded_network(4, 2)


def _attention_sql(k: int, layer: dict, source: str) -> str:
    """Steps from node lists ``x`` of ``source`` (tile, id, s, r, x) to those of ``layer{k}``, over the edges ``edge``: attention, rectified, and the feed-forward block."""
    heads, out, width = layer["w"].shape
    cut = lambda side: f"list_slice({side}.p, {out} * h + 1, {out} * h + {out})"
    seen = f"[CASE WHEN c > 0 THEN c ELSE 0.2 * c END FOR c IN list_concat({cut('b')}, {cut('a')})]"
    return f"""proj{k} AS MATERIALIZED (SELECT *, {dense_sql('x', layer['w'].reshape(heads * out, width))} AS p FROM {source}),
 pull{k} AS MATERIALIZED (SELECT e.tile, e.dst AS id, h, {cut('a')} AS vals, exp(list_inner_product({seen}, {matrix(layer['att'])}[h + 1]) + {layer['boost']!r} * exp(-(abs(a.s - b.s) + abs(a.r - b.r)))) AS w
  FROM edge e CROSS JOIN range({heads}) t(h) JOIN proj{k} a ON a.tile = e.tile AND a.id = e.src JOIN proj{k} b ON b.tile = e.tile AND b.id = e.dst),
 mean{k} AS (SELECT tile, id, list(greatest(v + {numbers(layer['bias'])}[{out} * h + i], 0) ORDER BY h, i) AS m FROM (SELECT tile, id, h, i, sum(w * vals[i]) / sum(w) AS v FROM pull{k} CROSS JOIN range(1, {out + 1}) u(i) GROUP BY tile, id, h, i) GROUP BY tile, id),
 held{k} AS MATERIALIZED (SELECT n.tile, n.id, n.s, n.r, coalesce(m, [greatest(v, 0) FOR v IN {numbers(layer['bias'])}]) AS m FROM {source} n LEFT JOIN mean{k} USING (tile, id)),
 wide{k} AS MATERIALIZED (SELECT *, {gelu_sql(dense_sql(f"[(m[i] - {numbers(layer['mean'])}[i]) / sqrt({numbers(layer['var'])}[i] + 1e-5) FOR i IN range(1, {heads * out + 1})]", layer['up'].T))} AS y FROM held{k}),
 back{k} AS MATERIALIZED (SELECT *, {dense_sql('y', layer['down'].T)} AS z FROM wide{k}),
 layer{k} AS MATERIALIZED (SELECT tile, id, s, r, {plus_sql('m', 'z', heads * out)} AS x FROM back{k})"""


_SCORED = f"WITH {KNN}, start AS (SELECT tile, id, s, r, [{', '.join(PHYS)}] AS x FROM node), {_attention_sql(0, NETWORK[0], 'start')}, {_attention_sql(1, NETWORK[1], 'layer0')}"


@query(with_tables(f"{_SCORED} SELECT tile, id, round(1 / (1 + exp(-list_inner_product(x, {numbers(NETWORK[-1]['out'])}))), 6) AS risk FROM layer1", "node"))
def n06_n07_node_scores(spark: SparkSession, d: str) -> DataFrame:
    """Node risks of the two-layer graph network with seeded weights."""
    return neural.node_scores(nodes(spark, d), knn(spark, d), PHYS, NETWORK).select("tile", "id", r(F.col("risk")).alias("risk"))


@query()
def n09_stochastic_passes(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample variance of node risks over passes with seeded dropout."""
    return neural.stochastic_scores(nodes(spark, d), knn(spark, d), PHYS, NETWORK, passes=5)

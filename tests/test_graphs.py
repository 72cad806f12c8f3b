import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cragline.operators import graph as g
from cragline.operators import neural, planning, raster, segment


def random_graph(seed, n=20, m=60):
    draw = random.Random(seed)
    return pd.DataFrame([(draw.randrange(n), draw.randrange(n), draw.uniform(0.1, 5)) for _ in range(m)], columns=["src", "dst", "cost"]).drop_duplicates(["src", "dst"], keep="last")


def cheapest(edges, start, goal):
    cost = {start: 0.0}
    for _ in range(100):
        for s, d, c in edges.itertuples(index=False):
            if s in cost and cost[s] + c < cost.get(d, math.inf):
                cost[d] = cost[s] + c
    return cost.get(goal)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_search_and_repair_find_the_cheapest(seed):
    edges = random_graph(seed)
    want = cheapest(edges, 0, 7)
    found = planning.best_first(planning.Graph(edges), 0, 7)
    assert (found is None) == (want is None) and (want is None or math.isclose(found[0], want))
    plan = planning.Replanner(planning.Graph(edges), 7)
    draw = random.Random(seed + 1)
    for _ in range(4):
        s, d, c = draw.randrange(20), draw.randrange(20), draw.choice([0.01, 3.0, 999.0])
        edges = pd.concat([edges[(edges.src != s) | (edges.dst != d)], pd.DataFrame([(s, d, c)], columns=edges.columns)])
        plan.change([(s, d, c)])
        want, found = cheapest(edges, 0, 7), plan.path(0)
        assert (found is None) == (want is None) and (want is None or math.isclose(found[0], want))
        if found:
            path = found[1]
            step = {(a, b): c for a, b, c in edges.itertuples(index=False)}
            assert path[0] == 0 and path[-1] == 7 and math.isclose(sum(step[e] for e in zip(path, path[1:])), want)


def test_start_is_goal_and_unreachable():
    graph = planning.Graph(pd.DataFrame({"src": [1], "dst": [2], "cost": [1.0]}))
    assert planning.best_first(graph, 1, 1) == (0.0, [1])
    assert planning.best_first(graph, 2, 1) is None
    assert planning.Replanner(graph, 1).path(2) is None


def test_heuristic_values(spark):
    rows = spark.createDataFrame([(0.2, 0.1), (0.8, 0.5)], "f double, s double")
    at = [F.lit(x) for x in (0.0, 0.0, 100.0, 100.0)]
    got = [r[0] for r in rows.select(planning.heuristic(*at, F.col("f"), F.col("s"))).collect()]
    d = math.sqrt(20000)
    assert np.allclose(got, [1.635 * d, 2.055 * d])


def test_one_node_graph_and_isolated_nodes(spark):
    nodes = spark.createDataFrame([(1, 5, 0.9), (2, 6, 0.1), (2, 7, 0.9)], "tile long, id long, f7 double")
    edges = spark.createDataFrame([(2, 6, 7), (2, 7, 6)], "tile long, src long, dst long")
    assert {tuple(r) for r in g.components(nodes, edges).collect()} == {(1, 5, 5), (2, 6, 6), (2, 7, 6)}
    ratio = {(r.tile, r.id): r.ratio for r in g.hazardous_neighbours(nodes, edges, F.col("f7") > 0.7).collect()}
    assert ratio == {(1, 5): 0.0, (2, 6): 1.0, (2, 7): 0.0}
    energy = {r.tile: r.energy for r in g.dirichlet_energy(nodes, edges, ["f7"]).collect()}
    assert energy[1] == 0 and math.isclose(energy[2], 0.64)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_segments_are_whole_and_contiguous(seed, labels):
    given_ = np.random.default_rng(seed).integers(0, labels, (12, 12))
    out = segment.one_piece(given_)
    assert sorted(np.unique(out)) == list(range(out.max() + 1)) and out.max() < labels
    parts = segment.connected_parts(out)
    assert len(np.unique(parts)) == out.max() + 1


def test_adaptive_segments_of_a_large_tile():
    y, x = np.indices((512, 512)) / 512
    image = np.clip(0.5 + 0.5 * np.sin(9 * x) * np.cos(7 * y) + 0.02 * np.random.default_rng(2).standard_normal((512, 512)), 0, 1)
    labels, stats = segment.adaptive_labels(image, None, True, 10.0, 32, 60, 80)
    blocks = image.reshape(16, 32, 16, 32).mean((1, 3))
    assert stats["budget"] == np.rint(8 + 56 * blocks**1.5).sum()
    assert stats["refined"] > 0
    assert stats["segments"] == labels.max() + 1 > stats["coarse"] >= 80
    parts = segment.connected_parts(labels)
    assert len(np.unique(parts)) == labels.max() + 1


def test_segment_edge_cases():
    assert (segment.clusters(np.ones((4, 4)), np.zeros((4, 4), bool), 3, 10.0) == -1).all()
    labels, stats = segment.adaptive_labels(np.zeros((16, 16)), None, True, 10.0, 4, 12, 8)
    assert stats["refined"] == 0 and stats["segments"] == labels.max() + 1
    ring = np.zeros((5, 5), int)
    ring[1:4, 1:4], ring[2, 2] = 1, 0  # a part inside another label takes that label
    assert segment.one_piece(ring)[2, 2] == segment.one_piece(ring)[1, 1] != segment.one_piece(ring)[0, 0]


def test_constant_tile():
    flat = np.full((16, 16), 0.4)
    for f in (raster.slope_proxy, raster.roughness_proxy):
        assert np.allclose(f(flat), 0.9999, atol=1e-3)
    assert np.all(raster.sobel_edges(flat) == 0)


def test_box_mean_equals_windows():
    x = np.random.default_rng(0).random((20, 17))
    for mode in ("reflect", "symmetric"):
        want = raster.correlate(x, np.full((7, 7), 1 / 49), mode)
        assert np.allclose(raster.box_mean(x, 7, mode), want)


@given(st.integers(-15, 30))
def test_index_folding(i):
    from cragline.plans.rasters import FOLD  # noqa: F401

    n = 16
    mirror = (n - 1) - abs((n - 1) - abs(i))
    assert mirror == np.pad(np.arange(n), 15, "reflect")[i + 15]


def test_fusion_parameters_and_range():
    layers = neural.seeded_fusion(1)
    assert sum(w.size + b.size for w, b in layers) == 1617
    a = neural.fusion_weight(*np.random.default_rng(1).random((3, 8, 8)), layers)
    assert a.shape == (8, 8) and (a > 0).all() and (a < 1).all()


def test_stochastic_passes_agree_and_vary(spark):
    nodes = spark.createDataFrame([(1, i, i / 7, 1 - i / 7) for i in range(8)], "tile long, id long, s double, r double")
    edges = spark.createDataFrame([(1, i, (i + 1) % 8) for i in range(8)], "tile long, src long, dst long")
    runs = [sorted(map(tuple, neural.stochastic_scores(nodes, edges, ["s", "r"], neural.seeded_network(2, 1), 5).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and any(x[3] > 0 for x in runs[0])
    one = neural.stochastic_scores(nodes, edges, ["s", "r"], neural.seeded_network(2, 1), 1).collect()
    assert all(x.variance == 0 for x in one)


def test_nearest_nodes_in_several_blocks(spark, monkeypatch):
    import numpy as np

    from cragline.operators import graph

    draw = np.random.default_rng(4)
    rows = [(t, i, *map(float, draw.integers(0, 9, 4))) for t, n in ((1, 60), (2, 3), (3, 1)) for i in range(n)]
    nodes = spark.createDataFrame(rows, "tile long, id long, px double, py double, s double, r double")
    want = set()
    for t in (1, 2, 3):
        own = [r for r in rows if r[0] == t]
        spread = sum((max(r[c] for r in own) - min(r[c] for r in own)) ** 2 for c in (4, 5)) or 1.0
        for x in own:
            near = sorted((round(0.5 * sum((x[c] - y[c]) ** 2 for c in (2, 3)) / 100 + 0.5 * sum((x[c] - y[c]) ** 2 for c in (4, 5)) / spread, 12), y[1]) for y in own if y[1] != x[1])[:3]
            want |= {(t, x[1], j) for _, j in near} | {(t, j, x[1]) for _, j in near}
    for block in (2048, 7):
        monkeypatch.setattr(graph, "BLOCK", block)
        assert {tuple(r) for r in graph.knn_edges(nodes, ["px", "py"], ["s", "r"], 3, 10.0).collect()} == want


def test_a_goal_without_edges_out_of_it_has_its_place(spark):
    from cragline.operators import planning

    nodes = spark.createDataFrame([(1, 0, 50.0, 50.0, 0.0, 0.0), (1, 1, 99.0, 99.0, 0.0, 0.0), (1, 2, 10.0, 10.0, 0.0, 0.0), (1, 3, 100.0, 100.0, 0.0, 0.0)], "tile long, id long, px double, py double, f7 double, s double")
    costs = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 2, 1.0), (1, 1, 3, 1.0), (1, 2, 3, 1.0)], "tile long, src long, dst long, cost double")
    missions = spark.createDataFrame([(1, 0, 3)], "tile long, start long, goal long")
    steps = planning.routes(missions, costs, nodes, guided=True).orderBy("seq").collect()
    assert [r.node for r in steps] == [0, 1, 3]


def test_affinity_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(g, "BLOCK", 7)
    draw = np.random.default_rng(4)
    frame = pd.DataFrame({"tile": np.repeat([0, 1, 2], [30, 12, 1]), "id": [*range(30), *range(12), 0], **{c: draw.random(43) for c in ("px", "py", "s", "r", "h")}})
    hidden, output, bias = [[-0.5, 0.2, -0.1, 0.3, 0.1], [0.4, -0.6, 0.2, 0.1, 0.3]], [0.7, -0.4], 0.1
    got = {tuple(x) for x in g.affinity_edges(spark.createDataFrame(frame), 3, hidden, output, bias).collect()}
    want = set()
    for tile, rows in frame.groupby("tile"):
        for a in rows.itertuples():
            near = []
            for b in rows.itertuples():
                if a.id != b.id:
                    x = (math.hypot(a.px - b.px, a.py - b.py), abs(a.s - b.s), abs(a.r - b.r), abs(a.h - b.h))
                    z = sum(o * max(sum(w * v for w, v in zip(unit, x)) + unit[4], 0) for unit, o in zip(hidden, output)) + bias
                    near.append((-round(1 / (1 + math.exp(-z)), 12), b.id))
            for _, other in sorted(near)[:3]:
                want |= {(tile, a.id, other), (tile, other, a.id)}
    assert got == want


def test_all_maps_from_one_pass(spark):
    from cragline.functions import hazard as hz

    draw = np.random.default_rng(3)
    rows = [(t, y, x, float(draw.random())) for t in (1, 2) for y in range(12) for x in range(12)]
    image = spark.createDataFrame(rows, "tile long, y int, x int, v double")
    layers = neural.seeded_fusion(4)
    out = neural.end_to_end(image, lambda v: v**2, lambda v, h, c: neural.fusion_weight(v, h, c, layers))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    got = {(r.tile, r.y, r.x): (*r.maps, r.penalty) for r in out.collect()}
    parts = raster.stencils(image, ["slope", "roughness", "discontinuity"]).withColumn("h", hz.physics(F.col("slope"), F.col("roughness"), F.col("discontinuity")))
    weights = {(r.tile, r.y, r.x): r for r in neural.fusion_maps(image.withColumn("h_learned", F.col("v") ** 2), layers).collect()}
    penalty = {t: 0.1 * np.mean([w.alpha * (1 - w.alpha) for k, w in weights.items() if k[0] == t]) for t in (1, 2)}
    value = {r[:3]: r[3] for r in rows}
    for p in parts.collect():
        w = weights[p.tile, p.y, p.x]
        assert np.allclose(got[p.tile, p.y, p.x], (p.slope, p.roughness, p.discontinuity, p.h, value[p.tile, p.y, p.x] ** 2, w.alpha, w.alpha * value[p.tile, p.y, p.x] ** 2 + (1 - w.alpha) * p.h, penalty[p.tile]), atol=1e-12)


def test_segments_refuse_odd_blocks_and_missing_pixels(spark):
    full = [(1, y, x, 0.5) for y in range(8) for x in range(8)]
    frame = lambda rows: spark.createDataFrame(rows, "tile long, y int, x int, v double")
    assert segment.segmented(frame(full), 8).count() == 64
    with pytest.raises(ValueError, match="multiple"):
        segment.segmented(frame(full), 8, block=3)
    for rows in (full[1:], full[:-1] + full[:1], full[1:] + [(1, 0, 0, None)], full[1:] + [(1, 0, 0, float("nan"))]):
        with pytest.raises(Exception, match="each of its 64 pixels"):
            segment.segmented(frame(rows), 8).collect()

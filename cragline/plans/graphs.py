"""Queries for region graphs, routes, attention and segmentation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.functions import hazard as hz
from cragline.operators import graph as g
from cragline.operators import neural, planning, replanning, segment
from cragline.plans.fixtures import by_tile, elevation, nodes, pixels, with_tables
from cragline.plans.rasters import BUNDLE, _image
from cragline.plans.registry import query, r
from cragline.sources.shared import pinned

DIAGONAL = math.sqrt(2 * 16**2)
K = 5
PHYS = ["s", "r", "d", "h"]
_D2 = f"0.5 * (pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) / {DIAGONAL**2!r} + 0.5 * ({' + '.join(f'pow(a.{c} - b.{c}, 2)' for c in PHYS)}) / a.spread"
KNN = (f"spread AS (SELECT *, {' + '.join(f'pow(max({c}) OVER (PARTITION BY tile) - min({c}) OVER (PARTITION BY tile), 2)' for c in PHYS)} AS spread FROM node), "
       f"near AS (SELECT tile, src, dst FROM (SELECT a.tile, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.tile, a.id ORDER BY round({_D2}, 12), b.id) AS k FROM spread a JOIN spread b ON a.tile = b.tile AND a.id <> b.id) WHERE k <= {K}), "
       "edge AS (SELECT tile, src, dst FROM near UNION SELECT tile, dst, src FROM near)")


def knn(spark: SparkSession, d: str) -> DataFrame:
    return g.knn_edges(nodes(spark, d), ["px", "py"], PHYS, K, DIAGONAL)


@query(with_tables(f"WITH {KNN} SELECT tile, src, dst FROM edge", "node"))
def j06_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return knn(spark, d)


HIDDEN, OUTPUT, BIAS = [[-0.5, 0.2, -0.1, 0.3, 0.1], [0.4, -0.6, 0.2, 0.1, 0.3], [-0.2, -0.3, -0.4, -0.5, 0.6]], [0.7, -0.4, 0.9], -0.2
_UNITS = [f"greatest(dist * {w[0]} + ds * {w[1]} + dr * {w[2]} + du * {w[3]} + {w[4]}, 0)" for w in HIDDEN]
_AFF = f"1 / (1 + exp(-({' + '.join(f'{u} * {o}' for u, o in zip(_UNITS, OUTPUT))} + {BIAS})))"
_GAPS = "sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS dist, abs(a.s - b.s) AS ds, abs(a.r - b.r) AS dr, abs(a.h - b.h) AS du"


def _affinity() -> object:
    gap = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    return g.affinity(F.sqrt(F.pow(F.col("a_px") - F.col("b_px"), 2) + F.pow(F.col("a_py") - F.col("b_py"), 2)), gap("s"), gap("r"), gap("h"), HIDDEN, OUTPUT, BIAS)


@query(with_tables(f"""WITH scored AS (SELECT tile, src, dst, {_AFF} AS w FROM (SELECT a.tile, a.id AS src, b.id AS dst, {_GAPS} FROM node a JOIN node b ON a.tile = b.tile AND a.id <> b.id)),
 near AS (SELECT tile, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY tile, src ORDER BY round(w, 12) DESC, dst) AS k FROM scored) WHERE k <= 3) SELECT tile, src, dst FROM near UNION SELECT tile, dst, src FROM near""", "node"))
def j07_affinity_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.affinity_edges(nodes(spark, d), 3, HIDDEN, OUTPUT, BIAS)


@query(with_tables(f"WITH {KNN} SELECT tile, src, dst, round({_AFF}, 6) AS affinity FROM (SELECT e.tile, src, dst, {_GAPS} FROM edge e JOIN node a ON a.tile = e.tile AND a.id = src JOIN node b ON b.tile = e.tile AND b.id = dst)", "node"))
def n08_edge_affinity(spark: SparkSession, d: str) -> DataFrame:
    return g.with_ends(knn(spark, d), nodes(spark, d), ["px", "py", "s", "r", "h"]).select("tile", "src", "dst", r(_affinity()).alias("affinity"))


RAG = "rag AS (SELECT DISTINCT tile, least(l, m) AS a, greatest(l, m) AS b FROM (SELECT tile, usr AS l, lead(usr) OVER (PARTITION BY tile, y ORDER BY x) AS m FROM pixel UNION ALL SELECT tile, usr, lead(usr) OVER (PARTITION BY tile, x ORDER BY y) FROM pixel) WHERE l <> m)"


@query(with_tables(f"WITH {RAG} SELECT tile, a, b FROM rag", "pixel"))
def j08_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return g.adjacency(pixels(spark, d), "user")


@query(with_tables(f"WITH {KNN} SELECT e.tile, src, dst, round(a.f7 - b.f7, 6) AS step FROM edge e JOIN node a ON a.tile = e.tile AND a.id = src JOIN node b ON b.tile = e.tile AND b.id = dst", "node"))
def j10_edge_ends(spark: SparkSession, d: str) -> DataFrame:
    return g.with_ends(knn(spark, d), nodes(spark, d), ["f7"]).select("tile", "src", "dst", r(F.col("a_f7") - F.col("b_f7")).alias("step"))


#: Sparse edges, so that tiles fall apart: only a node's nearest, and only from every third node.
SPARSE = KNN.replace(f"k <= {K})", "k <= 1 AND src % 3 = 0)")
REACH = "reach AS (SELECT tile, id, id AS seen FROM node UNION SELECT reach.tile, reach.id, e.dst FROM reach JOIN edge e ON e.tile = reach.tile AND e.src = reach.seen), part AS (SELECT tile, id, min(seen) AS component FROM reach GROUP BY tile, id)"


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return g.symmetric(g.nearest_nodes(nodes(spark, d), ["px", "py"], PHYS, 1, DIAGONAL).where("src % 3 = 0"))


@query(with_tables(f"WITH RECURSIVE {SPARSE}, {REACH} SELECT tile, id, component FROM part", "node").replace("WITH node", "WITH RECURSIVE node", 1).replace(", RECURSIVE", ", ").replace("RECURSIVE  spread", "spread"))
def h01_components(spark: SparkSession, d: str) -> DataFrame:
    return g.components(nodes(spark, d), sparse(spark, d))


TOUCH = """touch AS (SELECT x.tile, x.id AS a, y.id AS b FROM node x JOIN node y ON x.tile = y.tile AND y.id = x.id + 70 AND x.tile % 2 = 0),
 met AS (SELECT t.tile, a, b FROM touch t JOIN part u ON u.tile = t.tile AND u.id = a JOIN part v ON v.tile = t.tile AND v.id = b WHERE u.component <> v.component)"""
#: Each component but the least meets all smaller ones by its nearest pair.
FAR = """placed AS (SELECT n.tile, n.id, px, py, component FROM node n JOIN part p ON p.tile = n.tile AND p.id = n.id),
 far AS (SELECT tile, mine, other FROM (SELECT o.tile, m.id AS mine, o.id AS other, row_number() OVER (PARTITION BY o.tile, o.component ORDER BY pow(o.px - m.px, 2) + pow(o.py - m.py, 2), o.id, m.id) AS k
 FROM placed o JOIN placed m ON m.tile = o.tile AND m.component < o.component) WHERE k = 1)"""


def recursive(sql: str, *names: str) -> str:
    """``with_tables`` for common table expressions of which some are recursive."""
    return with_tables(f"WITH {sql}", *names).replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(f"""{SPARSE}, {REACH}, {TOUCH}, {FAR}, alone AS (SELECT tile FROM part WHERE tile NOT IN (SELECT tile FROM met) GROUP BY tile HAVING count(DISTINCT component) > 1)
 SELECT tile, src, dst FROM edge UNION SELECT tile, a, b FROM met UNION SELECT tile, b, a FROM met UNION SELECT tile, mine, other FROM far JOIN alone USING (tile) UNION SELECT tile, other, mine FROM far JOIN alone USING (tile)""", "node"))
def h02_connected_edges(spark: SparkSession, d: str) -> DataFrame:
    """Sparse edges with bridges: by adjacency where there is any between components, else between nearest nodes."""
    n = nodes(spark, d)
    touching = n.alias("x").join(n.alias("y"), F.expr("x.tile = y.tile AND y.id = x.id + 70 AND x.tile % 2 = 0")).select(F.col("x.tile").alias("tile"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return g.connected_edges(n, sparse(spark, d), touching)


@query(with_tables(f"""WITH RECURSIVE {SPARSE}, {REACH}, touch AS (SELECT x.tile, x.id AS a, y.id AS b FROM node x JOIN node y ON x.tile = y.tile AND y.id = x.id + 70 AND x.tile % 2 = 0),
 met AS (SELECT t.tile, a, b FROM touch t JOIN part u ON u.tile = t.tile AND u.id = a JOIN part v ON v.tile = t.tile AND v.id = b WHERE u.component <> v.component) SELECT tile, a AS src, b AS dst FROM met UNION SELECT tile, b, a FROM met""", "node").replace("WITH node", "WITH RECURSIVE node", 1).replace(", RECURSIVE", ", "))
def j11_bridges(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    touching = n.alias("x").join(n.alias("y"), F.expr("x.tile = y.tile AND y.id = x.id + 70 AND x.tile % 2 = 0")).select(F.col("x.tile").alias("tile"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return g.bridges(touching, g.components(n, sparse(spark, d)))


@query(recursive(f"{SPARSE}, {REACH}, {FAR} SELECT tile, mine AS src, other AS dst FROM far UNION ALL SELECT tile, other, mine FROM far", "node"))
def j12_nearest_bridges(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return g.nearest_bridges(n, g.components(n, sparse(spark, d)))


WEIGHT = f"0.6 * (a.f7 + b.f7) / 2 + 0.25 * sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) / {DIAGONAL!r} + 0.15 * abs(a.s - b.s)"
ENDS = "FROM edge e JOIN node a ON a.tile = e.tile AND a.id = src JOIN node b ON b.tile = e.tile AND b.id = dst"


@query(with_tables(f"WITH {KNN} SELECT e.tile, src, dst, round({WEIGHT}, 6) AS weight {ENDS}", "node"))
def h03_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return g.edge_weights(knn(spark, d), nodes(spark, d), DIAGONAL).select("tile", "src", "dst", r(F.col("weight")).alias("weight"))


@query(with_tables(f"""WITH {KNN}, hot AS (SELECT e.tile, src AS id, sum(CASE WHEN b.f7 > 0.6 THEN 1 ELSE 0 END) AS n FROM edge e JOIN node b ON b.tile = e.tile AND b.id = dst GROUP BY e.tile, src)
 SELECT n.tile, n.id, round(CASE WHEN max(coalesce(hot.n, 0)) OVER (PARTITION BY n.tile) > 0 THEN coalesce(hot.n, 0) / max(coalesce(hot.n, 0)) OVER (PARTITION BY n.tile) ELSE 0 END, 6) AS ratio FROM node n LEFT JOIN hot ON hot.tile = n.tile AND hot.id = n.id""", "node"))
def h04_hazardous_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return g.hazardous_neighbours(nodes(spark, d), knn(spark, d), F.col("f7") > 0.6).select("tile", "id", r(F.col("ratio")).alias("ratio"))


@query(with_tables("""WITH image AS (SELECT tile, y, x, usr, (v - min(v) OVER (PARTITION BY tile)) / (max(v) OVER (PARTITION BY tile) - min(v) OVER (PARTITION BY tile) + 1e-8) AS v FROM pixel),
 seg AS (SELECT tile, usr AS id, avg(x) AS cx, avg(y) AS cy, count(*) AS area, avg(v) AS mean, stddev_pop(v) AS std FROM image GROUP BY tile, usr),
 blocks AS (SELECT tile, CAST(floor(y / 4) AS INT) AS by, CAST(floor(x / 4) AS INT) AS bx, avg(v) AS c FROM image GROUP BY 1, 2, 3)
 SELECT seg.tile, id, round(cx / 15, 6) AS f0, round(cy / 15, 6) AS f1, round(mean, 6) AS f7, round(area / max(area) OVER (PARTITION BY seg.tile), 6) AS f9, round(CASE WHEN area > 1 THEN std ELSE 0 END, 6) AS f11, CASE WHEN mean > 0.7 THEN 1 ELSE 0 END AS f12,
 CASE WHEN c < 0.25 THEN 0 WHEN c > 0.60 THEN 2 ELSE 1 END AS tier FROM seg JOIN blocks b ON b.tile = seg.tile AND b.by = least(CAST(floor(cy / 4) AS INT), 3) AND b.bx = least(CAST(floor(cx / 4) AS INT), 3)""", "pixel"))
def h05_j09_node_features(spark: SparkSession, d: str) -> DataFrame:
    out = g.node_features(_image(spark, d), "user", "v", 16, 4)
    return out.select("tile", "id", *[r(F.col(c)).alias(c) for c in ("f0", "f1", "f7", "f9", "f11")], "f12", "tier")


@query()
def h06_built_graph(spark: SparkSession, d: str) -> DataFrame:
    """Tiles to segments, node features and weighted edges: the whole build in one plan, a row for each edge."""
    image = _image(spark, d).withColumnRenamed("user", "seg")
    labelled = pinned(segment.segmented(image, 16))  # what follows reads it many times
    rows = g.node_features(labelled, "seg", "v", 16, 4)
    n = rows.select("tile", "id", (F.col("f0") * 15).alias("px"), (F.col("f1") * 15).alias("py"), F.col("f11").alias("s"), F.col("f9").alias("r"), F.col("f7").alias("d"), F.col("f7").alias("h"), "f7")
    n = pinned(n)
    edges = g.connected_edges(n, pinned(g.knn_edges(n, ["px", "py"], PHYS, K, DIAGONAL)), g.adjacency(labelled, "seg"))
    return g.edge_weights(edges, n, DIAGONAL)


@query(with_tables(f"""WITH RECURSIVE {KNN}, {REACH}, w AS (SELECT e.tile, {WEIGHT} AS weight {ENDS}) SELECT tile, bool_and(NOT isnan(f7)) AS finite, bool_and(f7 BETWEEN -0.1 AND 1.1) AS in_range, count(*) BETWEEN 1 AND 2000 AS sized,
 (SELECT count(DISTINCT component) = 1 FROM part p WHERE p.tile = n.tile) AS connected, (SELECT bool_and(weight >= 0) FROM w WHERE w.tile = n.tile) AS positive FROM node n GROUP BY tile""", "node").replace("WITH node", "WITH RECURSIVE node", 1).replace(", RECURSIVE", ", "))
def h07_graph_checks(spark: SparkSession, d: str) -> DataFrame:
    n, e = nodes(spark, d), knn(spark, d)
    return g.checks(n, e, g.edge_weights(e, n, DIAGONAL))


COST = "cost AS (SELECT e.tile, src, dst, greatest(exp(3 * (a.f7 + b.f7) / 2) * (0.6 * (a.f7 + b.f7) / 2 + 0.25 * sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) / dg.diag + 0.15 * abs(a.s - b.s)) * CASE WHEN a.u > 0.3 THEN 1 + 2 * a.u ELSE 1 END, 1e-10) AS cost " + ENDS + " JOIN (SELECT tile, greatest(sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2)), 1e-6) AS diag FROM node GROUP BY tile) dg ON dg.tile = e.tile)"


@query(with_tables(f"WITH {KNN}, {COST} SELECT tile, src, dst, round(cost, 6) AS cost FROM cost", "node"))
def h08_edge_costs(spark: SparkSession, d: str) -> DataFrame:
    return planning.edge_costs(knn(spark, d), nodes(spark, d)).select("tile", "src", "dst", r(F.col("cost")).alias("cost"))


@query(with_tables("""SELECT n.tile, n.id, round(sqrt(pow(n.px - g.px, 2) + pow(n.py - g.py, 2)), 6) AS euclid, round(1.5 * sqrt(pow(n.px - g.px, 2) + pow(n.py - g.py, 2)) * (1 + 0.4 * n.f7 + 0.1 * n.s), 6) AS aware
 FROM node n JOIN (SELECT tile, arg_min(px, id) AS px, arg_min(py, id) AS py FROM node GROUP BY tile) g USING (tile)""", "node"))
def h09_heuristics(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    goal = n.groupBy("tile").agg(F.min_by("px", "id").alias("gx"), F.min_by("py", "id").alias("gy"))
    at = [F.col(c) for c in ("px", "py", "gx", "gy")]
    return n.join(goal, "tile").select("tile", "id", r(planning.heuristic(*at)).alias("euclid"), r(planning.heuristic(*at, F.col("f7"), F.col("s"))).alias("aware"))


MISSION = """mission AS (SELECT tile, start, CASE WHEN start = goal THEN other ELSE goal END AS goal FROM (SELECT tile, arg_min(id, (round(pow(px, 2) + pow(py, 2), 12), id)) AS start, arg_min(id, (round(pow(px - mx, 2) + pow(py - my, 2), 12), id)) AS goal, arg_min(id, (-round(pow(px, 2) + pow(py, 2), 12), id)) AS other
 FROM (SELECT *, max(px) OVER (PARTITION BY tile) AS mx, max(py) OVER (PARTITION BY tile) AS my FROM node) GROUP BY tile))"""


@query(with_tables(f"WITH {MISSION} SELECT tile, start, goal FROM mission", "node"))
def j14_corner_missions(spark: SparkSession, d: str) -> DataFrame:
    return planning.corner_missions(nodes(spark, d))


@query(with_tables("SELECT tile, point, arg_min(id, (round(pow(px - x, 2) + pow(py - y, 2), 12), id)) AS id FROM node, (VALUES (0, 0.0, 0.0), (1, 0.1, -0.1), (2, -0.2, 0.05)) p(point, x, y) GROUP BY tile, point", "node"))
def j13_nearest_node(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    points = n.select("tile").distinct().withColumn("p", F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, x, y in ((0, 0.0, 0.0), (1, 0.1, -0.1), (2, -0.2, 0.05))])))
    return planning.nearest_node(n, points.select("tile", "p.*"))


def _costs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = nodes(spark, d)
    return planning.corner_missions(n), planning.edge_costs(knn(spark, d), n), n


#: Cheapest costs by rounds of relaxation; routes here have far fewer steps than 40.
RELAX = """best AS (SELECT m.tile, m.start AS node, 0.0::DOUBLE AS cost, 0 AS i FROM mission m UNION ALL SELECT tile, node, min(cost), i FROM (SELECT b.tile, c.dst AS node, b.cost + c.cost AS cost, b.i + 1 AS i FROM best b JOIN cost c ON c.tile = b.tile AND c.src = b.node WHERE b.i < 14) GROUP BY tile, node, i)"""


@query(with_tables(f"WITH RECURSIVE {KNN}, {COST}, {MISSION}, {RELAX} SELECT m.tile, m.start, m.goal, round(min(b.cost), 6) AS cost FROM mission m JOIN best b ON b.tile = m.tile AND b.node = m.goal GROUP BY m.tile, m.start, m.goal", "node").replace("WITH node", "WITH RECURSIVE node", 1).replace(", RECURSIVE", ", "))
def h10_dijkstra_cost(spark: SparkSession, d: str) -> DataFrame:
    missions, costs, n = _costs(spark, d)
    return planning.routes(missions, costs, n).where("seq = 0").select("tile", "start", "goal", r(F.col("cost")).alias("cost"))


@query()
def h10_guided_routes(spark: SparkSession, d: str) -> DataFrame:
    return planning.routes(*_costs(spark, d), guided=True)


#: The cheapest route backwards from the goal, and what it amounts to.
TRAJECTORY = """dist AS (SELECT tile, node, min(cost) AS cost FROM best GROUP BY tile, node),
 back AS (SELECT m.tile, m.start, m.goal AS node, 0 AS k FROM mission m JOIN dist d ON d.tile = m.tile AND d.node = m.goal UNION ALL
 SELECT tile, start, src, k + 1 FROM (SELECT b.tile, b.start, c.src, b.k, row_number() OVER (PARTITION BY b.tile ORDER BY d.cost + c.cost, c.src) AS o
 FROM back b JOIN cost c ON c.tile = b.tile AND c.dst = b.node JOIN dist d ON d.tile = b.tile AND d.node = c.src WHERE b.node <> b.start AND b.k < 40) WHERE o = 1),
 walk AS (SELECT b.tile, f7, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)) AS step FROM back b JOIN node n ON n.tile = b.tile AND n.id = b.node WINDOW w AS (PARTITION BY b.tile ORDER BY k)),
 sums AS (SELECT tile, count(*) AS n, sum(coalesce(step, 0)) AS length, avg(CASE WHEN f7 > 0.7 THEN 1.0 ELSE 0.0 END) AS hcr FROM walk GROUP BY tile),
 ends AS (SELECT m.tile, m.start, m.goal, d.cost, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS straight FROM mission m JOIN dist d ON d.tile = m.tile AND d.node = m.goal JOIN node a ON a.tile = m.tile AND a.id = m.start JOIN node b ON b.tile = m.tile AND b.id = m.goal)
 SELECT tile, start, goal, round(cost, 6) AS cost, n, round(length, 6) AS length, round(straight, 6) AS straight, round(length / greatest(straight, 1e-6), 6) AS plr, round(hcr, 6) AS hcr FROM ends JOIN sums USING (tile)"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("tile", "start", "goal", "n", *[r(F.col(c)).alias(c) for c in ("cost", "length", "straight", "plr", "hcr")])


@query(recursive(f"{KNN}, {COST}, {MISSION}, {RELAX}, {TRAJECTORY}", "node"))
def h11_trajectories(spark: SparkSession, d: str) -> DataFrame:
    missions, costs, n = _costs(spark, d)
    return _rounded(planning.trajectories(planning.routes(missions, costs, n), n))


@query()
def h12_rerouted(spark: SparkSession, d: str) -> DataFrame:
    missions, costs, _ = _costs(spark, d)
    return planning.rerouted(missions, costs)


#: The start moves over its cheapest edge and the edges behind it become dear, then once more; costs of all three steps by rounds of relaxation.
MOVES = """first AS (SELECT m.tile, m.start, m.goal, arg_min(c.dst, (c.cost, c.dst)) AS n1 FROM mission m JOIN cost c ON c.tile = m.tile AND c.src = m.start GROUP BY ALL),
 second AS (SELECT f.tile, f.start, f.goal, f.n1, arg_min(c.dst, (c.cost, c.dst)) AS n2 FROM first f JOIN cost c ON c.tile = f.tile AND c.src = f.n1 AND c.dst <> f.start GROUP BY ALL),
 stepcost AS (SELECT k AS step, c.tile, c.src, c.dst, CASE WHEN k >= 1 AND c.src = s.start THEN 999 WHEN k = 2 AND c.src = s.n1 THEN 5 * c.cost ELSE c.cost END AS cost FROM cost c JOIN second s ON s.tile = c.tile, range(0, 3) g(k)),
 places AS (SELECT tile, start, goal, unnest([0, 1, 2]) AS step, unnest([start, n1, n2]) AS spot FROM second),
 walk AS (SELECT p.step, p.tile, p.spot AS node, 0.0::DOUBLE AS cost, 0 AS i FROM places p UNION ALL SELECT step, tile, node, min(cost), i FROM (SELECT b.step, b.tile, c.dst AS node, b.cost + c.cost AS cost, b.i + 1 AS i
 FROM walk b JOIN stepcost c ON c.step = b.step AND c.tile = b.tile AND c.src = b.node WHERE b.i < 14) GROUP BY step, tile, node, i)
 SELECT p.tile, p.start, p.goal, CAST(p.step AS INTEGER) AS step, p.spot AS at, round(min(w.cost), 6) AS cost FROM places p JOIN walk w ON w.step = p.step AND w.tile = p.tile AND w.node = p.goal GROUP BY ALL"""


@query(recursive(f"{KNN}, {COST}, {MISSION}, {MOVES}", "node"))
def h12_moving_start(spark: SparkSession, d: str) -> DataFrame:
    missions, costs, n = _costs(spark, d)
    cheapest = F.min_by("dst", F.struct("cost", "dst"))
    first = missions.join(costs.withColumnRenamed("src", "start"), ["tile", "start"]).groupBy("tile", "start", "goal").agg(cheapest.alias("n1"))
    second = first.join(costs.withColumnRenamed("src", "n1"), ["tile", "n1"]).where("dst <> start").groupBy("tile", "start", "goal", "n1").agg(cheapest.alias("n2"))
    moves = second.select("tile", "start", "goal", F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.col(to).alias("node"), F.col(behind).alias("src")) for k, to, behind in ((1, "n1", "start"), (2, "n2", "n1"))])))
    events = moves.join(costs, ["tile", "src"]).select("tile", "start", "goal", "step", "node", "src", "dst", F.when(F.col("step") == 1, F.lit(999.0)).otherwise(5 * F.col("cost")).alias("cost"))
    out = replanning.replanned(second.select("tile", "start", "goal"), events, costs, n).where("found")
    return out.select("tile", "start", "goal", "step", "at", r(F.col("cost")).alias("cost"))


_SQ = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in PHYS)


@query(with_tables(f"WITH {KNN} SELECT e.tile, round(sum({_SQ}) / 2, 6) AS energy {ENDS} GROUP BY e.tile", "node"))
def h13_dirichlet_energy(spark: SparkSession, d: str) -> DataFrame:
    return g.dirichlet_energy(nodes(spark, d), knn(spark, d), PHYS).select("tile", r(F.col("energy")).alias("energy"))


@query(with_tables("""SELECT a.tile, round(avg((a.s * b.s + a.r * b.r + a.d * b.d + a.h * b.h) / sqrt(a.s * a.s + a.r * a.r + a.d * a.d + a.h * a.h) / sqrt(b.s * b.s + b.r * b.r + b.d * b.d + b.h * b.h)), 6) AS cosine FROM node a JOIN node b ON a.tile = b.tile AND a.id <> b.id GROUP BY a.tile""", "node"))
def h14_mean_cosine(spark: SparkSession, d: str) -> DataFrame:
    return g.mean_cosine(nodes(spark, d), PHYS).select("tile", r(F.col("cosine")).alias("cosine"))


@query(with_tables("SELECT tile, round((var_samp(s) + var_samp(r) + var_samp(d) + var_samp(h)) / 4, 6) AS variance, count(*) AS n FROM node GROUP BY tile", "node"))
def h15_h17_variance_and_size(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("tile").agg(r(sum((F.var_samp(c) for c in PHYS), F.lit(0.0)) / 4).alias("variance"), F.count(F.lit(1)).alias("n"))


WEIGHTS = [[[0.3, -0.2, 0.5, 0.1], [0.1, 0.4, -0.3, 0.2]], [[-0.4, 0.2, 0.1, 0.6], [0.5, -0.1, 0.2, -0.3]]]
ATT = [[0.3, -0.5, 0.2, 0.4], [0.1, 0.6, -0.2, 0.3]]


def _head(h: int) -> str:
    c = [" + ".join(f"n.{x} * {w}" for x, w in zip(PHYS, row)) for row in WEIGHTS[h]]
    return f"SELECT tile, id, {h} AS head, s, r, {c[0]} AS c0, {c[1]} AS c1, {', '.join(f'{a} AS t{i}' for i, a in enumerate(ATT[h]))} FROM node n"


_LK = lambda e: f"CASE WHEN {e} > 0 THEN {e} ELSE 0.2 * {e} END"


ATTENDED = f"""proj AS ({_head(0)} UNION ALL {_head(1)}), logit AS (SELECT e.tile, e.dst AS id, a.head, a.c0, a.c1, b.t0 * {_LK('b.c0')} + b.t1 * {_LK('b.c1')} + b.t2 * {_LK('a.c0')} + b.t3 * {_LK('a.c1')} + 0.1 * exp(-(abs(a.s - b.s) + abs(a.r - b.r))) AS l
 FROM edge e JOIN proj a ON a.tile = e.tile AND a.id = e.src JOIN proj b ON b.tile = e.tile AND b.id = e.dst AND b.head = a.head),
 attended AS (SELECT tile, id, head, sum(exp(l) * c0) / sum(exp(l)) AS c0, sum(exp(l) * c1) / sum(exp(l)) AS c1 FROM logit GROUP BY tile, id, head)"""


@query(with_tables(f"WITH {KNN}, {ATTENDED} SELECT tile, id, head, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM attended", "node"))
def n05_graph_attention(spark: SparkSession, d: str) -> DataFrame:
    out = g.attention(nodes(spark, d), knn(spark, d), PHYS, WEIGHTS, ATT, ["s", "r"], 0.1)
    return out.select("tile", "id", "head", r(F.col("c0")).alias("c0"), r(F.col("c1")).alias("c1"))


def _layer_sql(k: int, layer: tuple, source: str) -> str:
    """A convolution with mirrored borders of the maps ``source`` (tile, y, x, vals) in SQL, as products of patches with rows of weights; rectified, or the logistic function after the last."""
    weights, _ = layer
    reach = weights.shape[-1] // 2
    rows = "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in w.transpose(1, 2, 0).ravel()) + "]" for w in weights) + "]"
    fold = lambda c: f"15 - abs(15 - abs(c.{c} + k.d{c}))"
    value = "1 / (1 + exp(-list_inner_product(patch, w)))" if weights.shape[0] == 1 else "greatest(list_inner_product(patch, w), 0)"
    return (f"l{k} AS MATERIALIZED (SELECT tile, y, x, [{value} FOR w IN {rows}] AS vals FROM (SELECT c.tile, c.y, c.x, flatten(list(p.vals ORDER BY k.dy, k.dx)) AS patch FROM {source} c"
            f" CROSS JOIN (SELECT dy, dx FROM range({-reach}, {reach + 1}) a(dy), range({-reach}, {reach + 1}) b(dx)) k JOIN {source} p ON p.tile = c.tile AND p.y = {fold('y')} AND p.x = {fold('x')} GROUP BY c.tile, c.y, c.x))")


FUSION = neural.seeded_fusion(1)
FUSED = (f"{BUNDLE}, l0 AS MATERIALIZED (SELECT tile, y, x, [m.v, b.h, 1 - m.v] AS vals FROM image m JOIN bundle b USING (tile, y, x)), "
         + ", ".join(_layer_sql(k + 1, layer, f"l{k}") for k, layer in enumerate(FUSION))
         + ", fused AS (SELECT b.*, 1 - m.v AS learned, a.vals[1] AS alpha, a.vals[1] * (1 - m.v) + (1 - a.vals[1]) * b.h AS final FROM bundle b JOIN image m USING (tile, y, x) JOIN l3 a USING (tile, y, x))")


@query(with_tables(f"WITH {FUSED} SELECT tile, y, x, round(h, 5) AS h_physics, round(alpha, 5) AS alpha, round(final, 5) AS h_final FROM fused", "pixel"))
def n03_fusion_map(spark: SparkSession, d: str) -> DataFrame:
    """Fusion weights of a tile's image, physics and learned maps by the three small convolutions, and the fused map."""
    out = neural.fusion_maps(_image(spark, d).withColumn("h_learned", 1 - F.col("v")), FUSION)
    return out.select("tile", "y", "x", *[r(F.col(c), 5).alias(c) for c in ("h_physics", "alpha", "h_final")])


@query(with_tables(f"WITH {FUSED} SELECT tile, y, x, round(s, 5) AS slope, round(r, 5) AS roughness, round(d, 5) AS discontinuity, round(h, 5) AS h_physics, round(learned, 5) AS h_learned, round(alpha, 5) AS alpha, round(final, 5) AS h_final,"
                   " round(0.1 * avg(alpha * (1 - alpha)) OVER (PARTITION BY tile), 6) AS penalty FROM fused", "pixel"))
def n04_u05_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """All maps of a tile from one pass, with an injected risk model (dark pixels are risky) and fusion model."""
    out = neural.end_to_end(_image(spark, d), lambda image: 1 - image, lambda image, physics, learned: neural.fusion_weight(image, physics, learned, FUSION))
    return out.select("tile", "y", "x", *[r(F.col(f"maps.{c}"), 5).alias(c) for c in neural.MAPS], r(F.col("penalty")).alias("penalty"))


@query()
def g01_g05_segments(spark: SparkSession, d: str) -> DataFrame:
    """Superpixels whose number follows from each tile's budget."""
    return segment.segmented(_image(spark, d), 16).select("tile", "y", "x", "seg")


@query()
def g05_segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment_stats(segment.segmented(_image(spark, d), 16))


@query(with_tables("""SELECT tile, CAST(sum(CASE WHEN c < 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS flat, CAST(sum(CASE WHEN c > 0.60 THEN 1 ELSE 0 END) AS BIGINT) AS hazard, CAST(sum(CAST(round_even(8 + 56 * pow(least(greatest(c, 0), 1), 1.5), 0) AS INT)) AS BIGINT) AS budget
 FROM (SELECT tile, avg(v) AS c FROM (SELECT tile, y, x, (v - min(v) OVER (PARTITION BY tile)) / (max(v) OVER (PARTITION BY tile) - min(v) OVER (PARTITION BY tile) + 1e-8) AS v FROM pixel) GROUP BY tile, CAST(floor(y / 4) AS INT), CAST(floor(x / 4) AS INT)) GROUP BY tile""", "pixel"))
def g04_tier_budget(spark: SparkSession, d: str) -> DataFrame:
    return segment.tier_budget(_image(spark, d), 4, 16)


@query()
def g06_fixed_segments(spark: SparkSession, d: str) -> DataFrame:
    """The same number of segments in every tile, for comparison."""
    return segment.segmented(_image(spark, d), 16, 16, refine=False).select("tile", "y", "x", "seg")


@query(with_tables("""WITH c AS (SELECT tile, CAST(floor(avg(y) / 4) AS INT) AS by, CAST(floor(avg(x) / 4) AS INT) AS bx, usr AS seg, count(*) AS area FROM pixel GROUP BY tile, usr HAVING count(*) > 1),
 b AS (SELECT tile, CAST(floor(y / 4) AS INT) AS by, CAST(floor(x / 4) AS INT) AS bx, avg(v) AS c FROM (SELECT tile, y, x, (v - min(v) OVER (PARTITION BY tile)) / (max(v) OVER (PARTITION BY tile) - min(v) OVER (PARTITION BY tile) + 1e-8) AS v FROM pixel) GROUP BY 1, 2, 3)
 SELECT c.tile, seg, c.by, c.bx, area FROM c JOIN b ON b.tile = c.tile AND b.by = c.by AND b.bx = c.bx WHERE b.c > 0.2""", "pixel"))
def g02_refinement_candidates(spark: SparkSession, d: str) -> DataFrame:
    return segment.refinement_candidates(_image(spark, d).withColumnRenamed("user", "seg"), 4, 16, over=0.2, larger=1)


BLOCKS = """filled AS (SELECT tile, y, x, coalesce(z, avg(z) OVER (PARTITION BY tile), 0) AS v FROM elevation),
 scaled AS (SELECT tile, y, x, CAST(y // 4 * 4 + x // 4 AS BIGINT) AS seg, (v - min(v) OVER (PARTITION BY tile)) / (max(v) OVER (PARTITION BY tile) - min(v) OVER (PARTITION BY tile) + 1e-8) AS v FROM filled),
 node AS (SELECT tile, seg AS id, avg(x) AS px, avg(y) AS py, avg(v) AS f7, stddev_pop(v) AS s, 0.0 AS u FROM scaled GROUP BY tile, seg),
 edge AS (SELECT a.tile, a.id AS src, b.id AS dst FROM node a JOIN node b ON a.tile = b.tile AND abs(a.id // 4 - b.id // 4) + abs(a.id % 4 - b.id % 4) = 1)"""


@query(recursive(f"{BLOCKS}, {COST}, {MISSION}, {RELAX}, {TRAJECTORY}", "elevation"))
def o07_route_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Elevation tiles to the least-risk route over their blocks: slope, hazard, blocks as nodes, edges, costs, route, trajectory."""
    rows = elevation(spark, d).select("tile", "y", "x", hz.filled(F.col("z"), by_tile()).alias("v"))
    image = rows.withColumn("v", hz.minmax(F.col("v"), by_tile())).withColumn("seg", hz.block(F.col("y"), 4) * 4 + hz.block(F.col("x"), 4))
    f = g.node_features(image, "seg", "v", 16, 4)
    n = f.select("tile", F.col("id").cast("long").alias("id"), (F.col("f0") * 15).alias("px"), (F.col("f1") * 15).alias("py"), F.col("f11").alias("s"), "f7", F.col("f7").alias("h"), F.col("f11").alias("r"), F.col("f7").alias("d"), F.lit(0.0).alias("u"))
    edges = g.symmetric(g.adjacency(image, "seg").select("tile", F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst")))
    return _rounded(planning.trajectories(planning.routes(planning.corner_missions(n), planning.edge_costs(edges, n), n), n))

"""Least-risk routes over region graphs: edge costs, searches for each mission, re-planning, trajectories."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.operators.graph import with_ends

PATH = "tile long, start long, goal long, found boolean, cost double, seq int, node long"


def edge_costs(edges: DataFrame, nodes: DataFrame, uncertain: float = 0.3) -> DataFrame:
    """exp(3 risk) times weighted risk, distance (over the diagonal of the tile's positions) and slope step; more from an uncertain source; at least 1e-10."""
    tile = Window.partitionBy("tile")
    diag = F.greatest(F.sqrt(F.pow(F.max("px").over(tile) - F.min("px").over(tile), 2) + F.pow(F.max("py").over(tile) - F.min("py").over(tile), 2)), F.lit(1e-6))
    rows = with_ends(edges, nodes.withColumn("diag", diag), ["px", "py", "f7", "s", "u", "diag"])
    risk = (F.col("a_f7") + F.col("b_f7")) / 2
    distance = F.sqrt(F.pow(F.col("a_px") - F.col("b_px"), 2) + F.pow(F.col("a_py") - F.col("b_py"), 2)) / F.col("a_diag")
    cost = F.exp(3 * risk) * (0.6 * risk + 0.25 * distance + 0.15 * F.abs(F.col("a_s") - F.col("b_s")))
    cost = cost * F.when(F.col("a_u") > uncertain, 1 + 2 * F.col("a_u")).otherwise(1.0)
    return rows.select("tile", "src", "dst", F.greatest(cost, F.lit(1e-10)).alias("cost"))


def heuristic(px: Column, py: Column, gx: Column, gy: Column, risk: Column | None = None, slope: Column | None = None, weight: float = 1.5) -> Column:
    """Straight distance to the goal; with risk and slope, weighted and raised by both."""
    d = F.sqrt(F.pow(px - gx, 2) + F.pow(py - gy, 2))
    return d if risk is None else weight * d * (1 + 0.4 * risk + 0.1 * slope)


def corner_missions(nodes: DataFrame) -> DataFrame:
    """(tile, start, goal): the nodes nearest to the origin and to the far corner; the farthest from the start if both are one."""
    tile = Window.partitionBy("tile")
    rows = nodes.select("tile", "id", "px", "py", F.max("px").over(tile).alias("mx"), F.max("py").over(tile).alias("my"))
    near = F.pow(F.col("px"), 2) + F.pow(F.col("py"), 2)
    far = F.pow(F.col("px") - F.col("mx"), 2) + F.pow(F.col("py") - F.col("my"), 2)
    out = rows.groupBy("tile").agg(F.min_by("id", F.struct(F.round(near, 12), "id")).alias("start"), F.min_by("id", F.struct(F.round(far, 12), "id")).alias("goal"),
                                   F.min_by("id", F.struct(F.round(-near, 12), "id")).alias("other"))
    return out.select("tile", "start", F.when(F.col("start") == F.col("goal"), F.col("other")).otherwise(F.col("goal")).alias("goal"))


def nearest_node(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(tile, point, id): for each point (tile, point, x, y) the nearest node of its tile, the least id among equals."""
    d = F.round(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2), 12)
    return points.join(nodes.select("tile", "id", "px", "py"), "tile").groupBy("tile", "point").agg(F.min_by("id", F.struct(d, "id")).alias("id"))


class Graph:
    """Adjacency of one tile, edges by (src, dst)."""

    def __init__(self, edges: pd.DataFrame):
        self.out: dict[int, dict[int, float]] = {}
        self.into: dict[int, set[int]] = {}
        for s, d, c in edges.sort_values(["src", "dst"])[["src", "dst", "cost"]].itertuples(index=False):
            self.set(int(s), int(d), float(c))

    def set(self, s: int, d: int, cost: float) -> None:
        self.out.setdefault(s, {})[d] = max(cost, 1e-10)
        self.out.setdefault(d, {})
        self.into.setdefault(d, set()).add(s)


def best_first(graph: Graph, start: int, goal: int, guide: Callable[[int], float] = lambda n: 0.0) -> tuple[float, list[int]] | None:
    """Best-first search by cost plus guide; first come first served among equals, settled nodes stay settled. Without a guide it is Dijkstra's."""
    if start == goal:
        return 0.0, [start]
    cost, before, settled, turn = {start: 0.0}, {}, set(), 0
    queue = [(guide(start), turn, start)]
    while queue:
        _, _, here = heapq.heappop(queue)
        if here == goal:
            path = [here]
            while here != start:
                here = before[here]
                path.append(here)
            return cost[goal], path[::-1]
        if here in settled:
            continue
        settled.add(here)
        for there, step in graph.out.get(here, {}).items():
            if there not in settled and cost[here] + step < cost.get(there, math.inf):
                cost[there], before[there], turn = cost[here] + step, here, turn + 1
                heapq.heappush(queue, (cost[there] + guide(there), turn, there))
    return None


class Replanner:
    """Costs to a goal that survive changes of single edges and moves of the start: only nodes whose best way out changes are visited again.

    Each node has a settled and a looked-ahead cost; nodes where they differ are queued under the smaller one, and raised ones are first
    reset. Keys take no guide, so costs are always exact.
    """

    def __init__(self, graph: Graph, goal: int):
        self.graph, self.goal = graph, goal
        self.settled: dict[int, float] = {}
        self.ahead: dict[int, float] = {goal: 0.0}
        self.queue, self.turn = [(0.0, 0, goal)], 0
        self.repair()

    def _look(self, n: int) -> None:
        if n != self.goal:
            self.ahead[n] = min((c + self.settled.get(m, math.inf) for m, c in self.graph.out.get(n, {}).items()), default=math.inf)
        if self.ahead.get(n, math.inf) != self.settled.get(n, math.inf):
            self.turn += 1
            heapq.heappush(self.queue, (min(self.ahead.get(n, math.inf), self.settled.get(n, math.inf)), self.turn, n))

    def repair(self) -> None:
        while self.queue:
            key, _, n = heapq.heappop(self.queue)
            a, s = self.ahead.get(n, math.inf), self.settled.get(n, math.inf)
            if a == s or key != min(a, s):
                continue  # settled meanwhile, or queued again under another key
            self.settled[n] = a if a < s else math.inf
            for m in [*self.graph.into.get(n, ()), *([n] if a > s else [])]:
                self._look(m)

    def change(self, edges: list[tuple[int, int, float]]) -> None:
        for s, d, c in edges:
            self.graph.set(s, d, c)
            self._look(s)
        self.repair()

    def path(self, start: int) -> tuple[float, list[int]] | None:
        if self.settled.get(start, math.inf) == math.inf:
            return None
        path = [start]
        while path[-1] != self.goal:
            out = self.graph.out[path[-1]]
            path.append(min(out, key=lambda m: (out[m] + self.settled.get(m, math.inf), m)))
        return self.settled[start], path


def _rows(tile: int, start: int, goal: int, found: tuple[float, list[int]] | None) -> pd.DataFrame:
    cost, path = found or (None, [])
    n = max(len(path), 1)
    return pd.DataFrame({"tile": [tile] * n, "start": start, "goal": goal, "found": found is not None, "cost": pd.Series([cost] * n, dtype="float64"),
                         "seq": range(n), "node": pd.array(path or [None], dtype="Int64")})


def routes(missions: DataFrame, costs: DataFrame, nodes: DataFrame, guided: bool = False) -> DataFrame:
    """The least-cost route of each mission (tile, start, goal), a row for each step; one row with found = false where there is none.

    ``guided`` follows the risk-weighted straight distance, which is fast and not optimal. Missions of a tile share its graph; tiles run apart.
    """
    ends = nodes.select("tile", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("cost"), "px", "py", "f7", "s")
    # edges and nodes of a tile in one table: a node without an edge out of it has a place, too
    table = costs.select("tile", "src", "dst", "cost").unionByName(ends, allowMissingColumns=True)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        placed = right["dst"].isna()
        graph = Graph(right[~placed].astype({"dst": "int64"}))
        at = {int(i): (x, y, f, s) for i, x, y, f, s in right.loc[placed, ["src", "px", "py", "f7", "s"]].itertuples(index=False)}
        out = []
        for tile, start, goal in left[["tile", "start", "goal"]].itertuples(index=False):
            gx, gy = at.get(goal, (0, 0))[:2]

            def guide(n: int) -> float:
                x, y, f, s = at.get(n, (gx, gy, 0, 0))
                return 1.5 * math.hypot(x - gx, y - gy) * (1 + 0.4 * f + 0.1 * s)

            out.append(_rows(tile, start, goal, best_first(graph, int(start), int(goal), guide if guided else lambda n: 0.0)))
        return pd.concat(out) if out else _rows(0, 0, 0, None).iloc[:0]

    return missions.groupBy("tile").cogroup(table.toDF(*table.columns).groupBy("tile")).applyInPandas(run, PATH)


def rerouted(missions: DataFrame, costs: DataFrame, raised: float = 999.0) -> DataFrame:
    """Each mission's route after every edge out of its first route's middle node costs ``raised``; repaired, not searched anew."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tile, start, goal in left[["tile", "start", "goal"]].itertuples(index=False):
            plan = Replanner(Graph(right), int(goal))
            first = plan.path(int(start))
            if first and len(first[1]) > 2:
                middle = first[1][len(first[1]) // 2]
                plan.change([(middle, n, raised) for n in list(plan.graph.out[middle])])
            out.append(_rows(tile, start, goal, plan.path(int(start))))
        return pd.concat(out) if out else _rows(0, 0, 0, None).iloc[:0]

    return missions.groupBy("tile").cogroup(costs.toDF(*costs.columns).groupBy("tile")).applyInPandas(run, PATH)


def trajectories(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length, straight distance, length ratio and share of hazardous steps of each found route."""
    at = nodes.select("tile", F.col("id").alias("node"), "px", "py", "f7")
    rows = steps.where("found").join(at, ["tile", "node"])
    order = Window.partitionBy("tile", "start", "goal").orderBy("seq")
    step = F.sqrt(F.pow(F.col("px") - F.lag("px").over(order), 2) + F.pow(F.col("py") - F.lag("py").over(order), 2))
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0.0)))
    first, last = F.min_by(F.struct("px", "py"), "seq"), F.max_by(F.struct("px", "py"), "seq")
    out = rows.groupBy("tile", "start", "goal").agg(F.max("cost").alias("cost"), F.count(F.lit(1)).alias("n"), F.sum("step").alias("length"), F.avg((F.col("f7") > 0.7).cast("double")).alias("hcr"), first.alias("a"), last.alias("b"))
    straight = F.sqrt(F.pow(F.col("a.px") - F.col("b.px"), 2) + F.pow(F.col("a.py") - F.col("b.py"), 2))
    return out.select("tile", "start", "goal", "cost", "n", "length", straight.alias("straight"), (F.col("length") / F.greatest(straight, F.lit(1e-6))).alias("plr"), "hcr")

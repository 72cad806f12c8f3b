"""Least-cost routes for a start that moves while costs change: a backward search whose results survive both."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.operators.planning import Graph

INF = math.inf
STEPS = "tile long, start long, goal long, step int, at long, found boolean, cost double, path array<long>, visited long"


class MovingReplanner:
    """Costs to ``goal`` around the way from ``start``; only nodes that can lie on a better way are visited.

    A node has a settled cost and one looked ahead over its edges; where they differ it waits under a key of two parts: the lesser of
    both plus a guide from the start plus the modifier, then the lesser of both. A move raises the modifier by the guide from the old start to the new one, so keys of
    waiting nodes stay lower bounds and none is made anew. Membership tells which entry of a node counts, older ones are dropped when met.
    The guide is a straight distance times the least cost for a unit of distance among all edges, so it never exceeds a cost, costs are exact and
    the search may end as soon as the start is settled and no waiting key is below its own. An edge that becomes cheaper than that lowers the
    factor once, and the waiting keys are made again.
    """

    def __init__(self, graph: Graph, places: dict[int, tuple[float, float]], start: int, goal: int):
        self.graph, self.places, self.start, self.goal = graph, places, start, goal
        self.settled: dict[int, float] = {}
        self.ahead: dict[int, float] = {goal: 0.0}
        self.modifier, self.visited = 0.0, 0
        self.factor = min((self._unit(s, d, c) for s, out in graph.out.items() for d, c in out.items()), default=0.0)
        self.factor = 0.0 if self.factor == INF else self.factor
        self.queue: list[tuple[float, float, int]] = []
        self.member: dict[int, tuple[float, float]] = {}
        self._put(goal)
        self._search()

    def _apart(self, a: int, b: int) -> float:
        (ax, ay), (bx, by) = self.places[a], self.places[b]
        return math.hypot(ax - bx, ay - by)

    def _unit(self, s: int, d: int, cost: float) -> float:
        """Cost of a unit of distance, a little less for rounding; 0 where an end has no place."""
        if s not in self.places or d not in self.places:
            return 0.0
        apart = self._apart(s, d)
        return cost / apart * (1 - 1e-9) if apart else INF

    def _guide(self, n: int) -> float:
        return self.factor * self._apart(self.start, n) if self.factor else 0.0

    def _key(self, n: int) -> tuple[float, float]:
        least = min(self.settled.get(n, INF), self.ahead.get(n, INF))
        return least + self._guide(n) + self.modifier, least

    def _put(self, n: int) -> None:
        self.member[n] = key = self._key(n)
        heapq.heappush(self.queue, (*key, n))

    def _look(self, n: int) -> None:
        if n != self.goal:
            self.ahead[n] = min((c + self.settled.get(m, INF) for m, c in self.graph.out.get(n, {}).items()), default=INF)
        self.member.pop(n, None)
        if self.ahead.get(n, INF) != self.settled.get(n, INF):
            self._put(n)

    def _search(self) -> None:
        while self.queue:
            *key, n = self.queue[0]
            if self.member.get(n) != tuple(key):
                heapq.heappop(self.queue)
                continue
            if tuple(key) >= self._key(self.start) and self.ahead.get(self.start, INF) == self.settled.get(self.start, INF):
                break
            heapq.heappop(self.queue)
            del self.member[n]
            if tuple(key) < self._key(n):  # it waited under the key of an earlier start
                self._put(n)
                continue
            self.visited += 1
            a, s = self.ahead.get(n, INF), self.settled.get(n, INF)
            self.settled[n] = a if a < s else INF
            for m in [*self.graph.into.get(n, ()), *([n] if a > s else [])]:
                self._look(m)

    def replan(self, moved_to: int | None = None, changes: list[tuple[int, int, float]] = ()) -> tuple[float, list[int]] | None:
        """Moves the start, sets the costs of edges (new ones are added), and returns the route from there."""
        if moved_to is not None and moved_to != self.start:
            self.modifier += self.factor * self._apart(self.start, moved_to) if self.factor else 0.0
            self.start = moved_to
        least = min((self._unit(s, d, max(c, 1e-10)) for s, d, c in changes), default=INF)
        if least < self.factor:
            self.factor, self.modifier = least, 0.0
            waiting, self.queue, self.member = [*self.member], [], {}
            for n in waiting:
                self._put(n)
        for s, d, c in changes:
            self.graph.set(s, d, c)
        for s in dict.fromkeys(s for s, *_ in changes):
            self._look(s)
        self._search()
        return self.path()

    def path(self) -> tuple[float, list[int]] | None:
        """(cost, nodes) from the start, ties to the lesser node; None where the goal can't be reached."""
        if self.settled.get(self.start, INF) == INF and self.start != self.goal:
            return None
        path = [self.start]
        while path[-1] != self.goal:
            out = self.graph.out[path[-1]]
            path.append(min(out, key=lambda m: (out[m] + self.settled.get(m, INF), m)))
        return self.settled.get(self.start, 0.0), path


def replanned(missions: DataFrame, events: DataFrame, costs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The route of each mission (tile, start, goal) at step 0 and after each step of its ``events``, with the nodes visited for it.

    ``events``: (tile, start, goal, step from 1, node, src, dst, cost). Rows of one step are applied together: the start moves to ``node`` (the greatest
    that isn't null), and edges get costs (in the order of src, dst, cost; null where a row has none). Events of unknown missions are passed over. Missions
    of a tile are searched apart, each on its own copy of the tile's graph.
    """
    table = costs.select("tile", "src", "dst", "cost").unionByName(nodes.select("tile", F.col("id").alias("src"), "px", "py"), allowMissingColumns=True)
    asks = missions.select("tile", "start", "goal", F.lit(0).alias("step")).unionByName(events.select("tile", "start", "goal", F.col("step").cast("int").alias("step"), "node", "src", "dst", "cost"), allowMissingColumns=True)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        placed = right["dst"].isna()
        edges = right[~placed].astype({"dst": "int64"})
        places = {int(i): (x, y) for i, x, y in right.loc[placed, ["src", "px", "py"]].itertuples(index=False)}
        out = []
        for (start, goal), rows in left.groupby(["start", "goal"]):
            if not (rows["step"] == 0).any():
                continue
            plan = MovingReplanner(Graph(edges), places, int(start), int(goal))
            seen = 0
            for step, own in rows.groupby("step"):
                if step:
                    moves, set_ = own["node"].dropna(), own[own["src"].notna()].sort_values(["src", "dst", "cost"])
                    found = plan.replan(int(moves.max()) if len(moves) else None, [(int(s), int(d), float(c)) for s, d, c in set_[["src", "dst", "cost"]].itertuples(index=False)])
                else:
                    found = plan.path()
                out.append((int(left["tile"].iloc[0]), int(start), int(goal), int(step), plan.start, found is not None, found[0] if found else None, found[1] if found else [], plan.visited - seen))
                seen = plan.visited
        return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    return asks.groupBy("tile").cogroup(table.toDF(*table.columns).groupBy("tile")).applyInPandas(run, STEPS)

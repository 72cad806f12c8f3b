"""Moving-start replanning against Dijkstra anew at each step."""

import math
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from cragline.operators import planning, replanning


def placed_graph(seed, n=40, k=4):
    """Nodes on a plane with costs of at least a fraction of the distance; some edges cost much more."""
    draw = random.Random(seed)
    places = {i: (draw.uniform(0, 10), draw.uniform(0, 10)) for i in range(n)}
    rows = []
    for i in range(n):
        near = sorted(range(n), key=lambda j: math.dist(places[i], places[j]))[1 : k + 1]
        rows += [(i, j, math.dist(places[i], places[j]) * draw.choice([0.3, 0.5, 2.0, 9.0])) for j in near if draw.random() < 0.9]
    return places, pd.DataFrame(rows, columns=["src", "dst", "cost"])


def anew(edges, start, goal):
    return planning.best_first(planning.Graph(edges), start, goal)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_every_step_equals_a_search_anew(seed):
    places, edges = placed_graph(seed)
    draw = random.Random(seed + 1)
    start, goal = 0, 7
    plan = replanning.MovingReplanner(planning.Graph(edges), places, start, goal)
    costs = {(s, d): c for s, d, c in edges.itertuples(index=False)}
    for _ in range(8):
        found, want = plan.path(), anew(pd.DataFrame([(*e, c) for e, c in costs.items()], columns=["src", "dst", "cost"]), start, goal)
        assert (found is None) == (want is None)
        if found:
            assert math.isclose(found[0], want[0], abs_tol=1e-12) and found[1][0] == start and found[1][-1] == goal
            assert math.isclose(sum(costs[e] for e in zip(found[1], found[1][1:])), want[0], abs_tol=1e-12)
            start = draw.choice([found[1][min(1, len(found[1]) - 1)], draw.randrange(40)])
        else:
            start = draw.randrange(40)
        changes = [(*draw.choice([*costs]), draw.choice([0.001, 0.5, 3.0, 999.0])) for _ in range(draw.randrange(3))] + [(draw.randrange(40), draw.randrange(40), 1.0)] * (draw.random() < 0.3)
        plan.replan(start, changes)
        costs |= {(s, d): c for s, d, c in changes}


def test_fewer_nodes_are_visited_than_by_searches_anew():
    side = 40
    at = lambda x, y: x * side + y
    places = {at(x, y): (float(x), float(y)) for x in range(side) for y in range(side)}
    draw = random.Random(3)
    rows = [(at(x, y), at(x + a, y + b), 1 + draw.random()) for x in range(side) for y in range(side) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x + a < side and 0 <= y + b < side]
    edges = pd.DataFrame(rows, columns=["src", "dst", "cost"])
    plan = replanning.MovingReplanner(planning.Graph(edges), places, at(0, 0), at(30, 30))
    first = plan.visited
    assert first < side * side  # the guide and the early end leave nodes out
    for _ in range(10):
        _, path = plan.path()
        before = plan.visited
        plan.replan(path[1], [(path[2], path[3], 50.0)])
        assert plan.visited - before < first / 2
    costs = {(s, d): c for s, out in plan.graph.out.items() for d, c in out.items()}
    want = anew(pd.DataFrame([(*e, c) for e, c in costs.items()], columns=["src", "dst", "cost"]), plan.start, plan.goal)
    assert math.isclose(plan.path()[0], want[0])


def test_nodes_without_a_place_and_no_way():
    graph = planning.Graph(pd.DataFrame({"src": [1, 2], "dst": [2, 3], "cost": [1.0, 1.0]}))
    plan = replanning.MovingReplanner(graph, {}, 1, 3)
    assert plan.path() == (2.0, [1, 2, 3]) and plan.factor == 0
    assert plan.replan(3) == (0.0, [3]) and plan.replan(2, [(2, 1, 1.0), (2, 3, 5.0)]) == (5.0, [2, 3])
    lone = replanning.MovingReplanner(planning.Graph(pd.DataFrame({"src": [1], "dst": [2], "cost": [1.0]})), {1: (0, 0), 2: (1, 0)}, 2, 1)
    assert lone.path() is None and lone.replan(None, [(2, 1, 4.0)]) == (4.0, [2, 1])


def test_missions_of_a_table(spark):
    nodes = spark.createDataFrame([(t, i, float(i), 0.0) for t in (1, 2) for i in range(5)], "tile long, id long, px double, py double")
    costs = spark.createDataFrame([(t, a, b, 1.0) for t in (1, 2) for a in range(5) for b in (a - 1, a + 1) if 0 <= b < 5] + [(1, 1, 4, 9.0)], "tile long, src long, dst long, cost double")
    missions = spark.createDataFrame([(1, 0, 4), (1, 2, 0), (2, 0, 4), (3, 0, 1)], "tile long, start long, goal long")
    events = spark.createDataFrame([(1, 0, 4, 1, 1, 2, 3, 100.0), (1, 0, 4, 2, 3, None, None, None), (1, 2, 0, 1, None, 2, 1, 7.0), (2, 9, 9, 1, 1, None, None, None)],
                                   "tile long, start long, goal long, step int, node long, src long, dst long, cost double")
    got = {(r.tile, r.start, r.step): (r.at, r.found, r.cost, list(r.path)) for r in replanning.replanned(missions, events, costs, nodes).collect()}
    assert got == {(1, 0, 0): (0, True, 4.0, [0, 1, 2, 3, 4]), (1, 0, 1): (1, True, 9.0, [1, 4]), (1, 0, 2): (3, True, 1.0, [3, 4]), (1, 2, 0): (2, True, 2.0, [2, 1, 0]),
                   (1, 2, 1): (2, True, 8.0, [2, 1, 0]), (2, 0, 0): (0, True, 4.0, [0, 1, 2, 3, 4]), (3, 0, 0): (0, False, None, [])}
    assert replanning.replanned(missions.limit(0), events, costs, nodes).count() == 0

import random
from datetime import datetime, timedelta

import pandas as pd

from cragline.operators import planning
from cragline.streaming import events
from cragline.streaming import missions as missions_stream

SF = "/root/testdata/sf0.001"


def test_stream_of_windows_equals_batch(spark):
    table = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = events.windowed(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("hours").select("start", "event_type", "n").collect())
    last = table.agg({"ts": "max"}).first()[0]  # windows stay open until the watermark has passed their end
    want = sorted(tuple(r) for r in events.windowed(table, "1 hour").select("start", "event_type", "n").collect() if r.start + timedelta(hours=1) <= last - timedelta(minutes=10))
    assert got == want and len(got) > 0


def test_stream_drops_repeated_events(spark):
    table = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = events.deduplicated(stream.union(stream)).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == table.count() == events.deduplicated(table.union(table)).count()


def graphs_of(spark, missions, costs, places):
    rows = [(m, s, g, a, b, c, None, None) for m, s, g in missions for a, b, c in costs] + [(m, s, g, n, None, None, x, y) for m, s, g in missions for n, (x, y) in places.items()]
    return spark.createDataFrame(rows, f"mission long, {missions_stream.GIVEN}")


MESSAGE = "mission long, seq long, ts timestamp, node long, src long, dst long, cost double"


def test_missions_are_kept_by_a_stream(spark, tmp_path):
    draw = random.Random(0)
    places = {i: (draw.random(), draw.random()) for i in range(30)}
    costs = {(a, b): draw.uniform(1, 3) for a in range(30) for b in draw.sample(range(30), 4)}
    missions = [(1, 0, 7), (2, 5, 9), (3, 1, 2)]
    batches, at, want = [], {m: s for m, s, _ in missions}, []
    of = {m: dict(costs) for m, *_ in missions}
    for k in range(4):
        rows = []
        for m, _, goal in missions[:2]:
            for i in range(3):
                edge, c = draw.choice([*costs]), draw.choice([0.1, 5.0, 99.0])
                of[m][edge] = c
                rows.append((m, 10 * k + i, datetime(2024, 1, 1, k), None, *edge, c))
            at[m] = draw.randrange(30)
            rows.append((m, 10 * k + 5, datetime(2024, 1, 1, k), at[m], None, None, None))
            found = planning.best_first(planning.Graph(pd.DataFrame([(*e, c) for e, c in of[m].items()], columns=["src", "dst", "cost"])), at[m], goal)
            want.append((m, 10 * k + 5, at[m], found is not None, found and round(found[0], 9)))
        rows.append((99, k, datetime(2024, 1, 1, k), 1, None, None, None))  # nobody's mission
        batches.append(rows)
    for k, rows in enumerate(batches):  # a file, and so a batch, each
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    graphs = graphs_of(spark, missions, [(*e, c) for e, c in costs.items()], places)
    got = missions_stream.into_table(missions_stream.kept_routes(stream, graphs), f"file://{tmp_path}/out").collect()
    assert sorted((r.mission, r.seq, r.at, r.found, r.cost and round(r.cost, 9)) for r in got) == sorted(want)
    assert all(not r.found or (r.path[0] == r["at"] and r.path[-1] == dict((m, g) for m, _, g in missions)[r.mission]) for r in got) and not any(r.ended for r in got)


def test_idle_missions_end(spark, tmp_path):
    graphs = graphs_of(spark, [(1, 0, 2), (2, 0, 2)], [(0, 1, 1.0), (1, 2, 1.0)], {0: (0.0, 0.0), 1: (0.0, 1.0), 2: (0.0, 2.0)})
    for k, rows in enumerate([[(1, 1, datetime(2024, 1, 1, 0), 1, None, None, None), (2, 1, datetime(2024, 1, 1, 0), 1, None, None, None)], [(2, 2, datetime(2024, 1, 1, 5), None, 1, 2, 4.0)],
                              [(1, 3, datetime(2024, 1, 1, 6), 0, None, None, None), (2, 3, datetime(2024, 1, 1, 6), None, 1, 2, 5.0)]]):
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    got = [(r.mission, r.seq, r.cost, r.ended) for r in missions_stream.into_table(missions_stream.kept_routes(stream, graphs, idle="2 hours", late="1 minute"), f"file://{tmp_path}/out").collect()]
    # mission 1 ends once the watermark passes two hours after its message; what comes later finds no mission
    assert (1, 1, 1.0, False) in got and (1, 1, None, True) in got and not any(m == 1 and seq == 3 for m, seq, *_ in got)
    assert (2, 1, 1.0, False) in got and (2, 2, 4.0, False) in got

"""Route repair as keyed state: each mission's search lives in the state store and goes on with the messages of its key.

Graphs come as initial state, a row for each edge and each placed node; they are held as a list of packed parts until a mission's first message, so no
driver or closure holds them. Messages move the start or set the costs of edges (new ones too). A timer ends missions without messages.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cragline.operators.planning import Graph
from cragline.operators.replanning import MovingReplanner

ROUTE = "mission long, seq long, at long, found boolean, cost double, path array<long>, visited long, ended boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Columns of a mission's initial rows: its ends, and an edge or (without dst) a node with its place.
GIVEN = "start long, goal long, src long, dst long, cost double, px double, py double"


class RouteKeeper(StatefulProcessor):
    """Keeps a mission's search; ``idle`` milliseconds of event time after its last message the mission ends."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getListState("given", "part binary")
        self.plan = handle.getValueState("plan", "plan binary, seq long, ends long")

    def handleInitialState(self, key: tuple, rows: pd.DataFrame, timer: object) -> None:
        """A large graph comes in several parts; each is one value of the state, as a row a value costs a call each."""
        names = [c.split()[0] for c in GIVEN.split(", ")]
        self.given.appendValue((pickle.dumps(rows[names].astype(dict.fromkeys(names[:4], "Int64") | dict.fromkeys(names[4:], "float64"))),))

    def _opened(self) -> MovingReplanner | None:
        parts = [pickle.loads(part) for (part,) in self.given.get()]
        if not parts:
            return None
        self.given.clear()
        rows = pd.concat(parts, ignore_index=True)
        edge, ends = rows["dst"].notna(), rows.dropna(subset=["start", "goal"])
        edges = rows.loc[edge, ["src", "dst", "cost"]].astype({"src": "int64", "dst": "int64"})
        placed = rows.loc[~edge, ["src", "px", "py"]].dropna()
        places = {int(s): (x, y) for s, x, y in placed.itertuples(index=False)}
        return MovingReplanner(Graph(edges), places, int(ends["start"].iloc[0]), int(ends["goal"].iloc[0]))

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timer: object) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        held = self.plan.get() if self.plan.exists() else None
        if held and held[2] is not None and held[2] <= timer.getCurrentWatermarkInMs():  # it ended before this batch
            yield from self.handleExpiredTimer(key, timer, None)
            return
        plan = pickle.loads(held[0]) if held else self._opened()
        if plan is None:  # unknown or ended: its messages have nothing to act on
            return
        before, moves, changes = plan.visited, rows["node"].dropna(), rows[rows["src"].notna()].drop_duplicates(["src", "dst"], keep="last")
        found = plan.replan(int(moves.iloc[-1]) if len(moves) else None, [(int(s), int(d), float(c)) for s, d, c in changes[["src", "dst", "cost"]].itertuples(index=False)])
        ends = None if self.idle is None else int(rows["ts"].max().timestamp() * 1000) + self.idle
        self.plan.update((pickle.dumps(plan), int(rows["seq"].iloc[-1]), ends))
        if ends is not None:
            self._drop_timers()
            self.handle.registerTimer(ends)
        yield self._row(key, int(rows["seq"].iloc[-1]), plan.start, found, plan.visited - before, False)

    def handleExpiredTimer(self, key: tuple, timer: object, expired: object) -> Iterator[pd.DataFrame]:
        plan, seq, _ = self.plan.get()
        self.plan.clear()
        self._drop_timers()
        yield self._row(key, seq, pickle.loads(plan).start, None, 0, True)

    def _drop_timers(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)

    @staticmethod
    def _row(key: tuple, seq: int, at: int, found: tuple[float, list[int]] | None, visited: int, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"mission": [int(key[0])], "seq": [seq], "at": [at], "found": [found is not None], "cost": pd.Series([found[0] if found else None], dtype="float64"),
                             "path": [found[1] if found else []], "visited": [visited], "ended": [ended]})

    def close(self) -> None:
        pass


def kept_routes(messages: DataFrame, graphs: DataFrame, idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The route of each mission after each batch of its messages, and a last row (``ended``) where it had none for ``idle``.

    ``messages``, a stream: mission, seq, ts, and node (the start moves there; the last of a batch counts) or src, dst and cost. Those of a batch are applied
    together in the order of ``seq``. ``graphs``, a batch: mission and the columns of ``GIVEN``. Messages to unknown or ended missions are passed over. With ``idle``,
    event time counts, messages later than ``late`` are dropped, and a mission ends once the watermark has passed its time. The session's state store must be RocksDB (see ``into_table``).
    """
    span = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = messages.select("mission", "seq", F.col("ts").cast("timestamp").alias("ts"), "node", "src", "dst", "cost")
    rows = rows if span is None else rows.withWatermark("ts", late)
    given = graphs.select("mission", *[c.split()[0] for c in GIVEN.split(", ")]).groupBy("mission")
    return rows.groupBy("mission").transformWithStateInPandas(RouteKeeper(span), ROUTE, "Append", "None" if span is None else "EventTime", given)


def into_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, into a Parquet table in ``folder``; returns the table."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

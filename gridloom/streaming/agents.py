"""Agents as streams: tracking state, submaps, liveness, upserts and batch sinks.

State is kept by agent with applyInPandasWithState. The same functions run over a whole
table in one batch, which is how the tests compare stream and batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.session import ship

#: Motion and scale change that make a keyframe, failures in a row that reset tracking, keyframes of a submap and least number to close one early.
MOVED, SCALED, FAILURES, STEP, LEAST = 0.1, 0.4, 3, 11, 3
SILENT_MS = 100_000

EVENT = "user_id long, event_id long, ts timestamp, event_type string, value double"
TRACK = "user_id long, event_id long, keyframe boolean, tracked boolean, submap long, in_room boolean, registered boolean"
STATE = "last double, failures long, keyframes long, submap long, in_room boolean"


def start() -> list:
    return [None, 0, 0, 0, False]


def step(state: list, value: float, kind: str) -> tuple[bool, bool, bool]:
    """One frame of an agent: (keyframe, tracked, room registered). The state is changed in place.

    A frame far from the last keyframe becomes one; a frame that cannot be tracked
    (a negative value) counts as a failure, and enough of them start anew. Submaps close
    after STEP keyframes, or on leaving a room once they have more than LEAST.
    """
    last, failures, keyframes, submap, in_room = state
    tracked = value is not None and value >= 0
    keyframe = False
    if not tracked:
        failures += 1
        if failures >= FAILURES:
            last, failures = None, 0
    else:
        failures = 0
        keyframe = last is None or abs(value - last) > max(MOVED, SCALED * abs(last))
        if keyframe:
            last, keyframes = value, keyframes + 1
    inside = kind in ("click", "purchase")
    left = in_room and not inside
    if keyframe and keyframes >= STEP or left and keyframes > LEAST:
        submap, keyframes = submap + 1, 0
    state[:] = [last, failures, keyframes, submap, inside]
    return keyframe, tracked, left


def _rows(state: list, pdf: pd.DataFrame) -> Iterator[tuple]:
    for user, event, _, kind, value in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
        submap = state[3]
        keyframe, tracked, left = step(state, None if pd.isna(value) else value, kind)
        yield int(user), int(event), keyframe, tracked, submap, state[4], left


_COLUMNS = ["user_id", "event_id", "keyframe", "tracked", "submap", "in_room", "registered"]


def track_batch(events: DataFrame) -> DataFrame:
    """Tracking over a whole table, agent by agent."""
    ship(events.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_rows(start(), pdf)), columns=_COLUMNS)

    return events.select("user_id", "event_id", "ts", "event_type", "value").groupBy("user_id").applyInPandas(run, TRACK)


def track_stream(events: DataFrame) -> DataFrame:
    """Tracking of a stream: state by agent, from micro-batch to micro-batch."""
    ship(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else start()
        pdf = pd.concat(list(frames))
        out = pd.DataFrame(list(_rows(now, pdf)), columns=_COLUMNS)
        state.update(tuple(now))
        yield out

    return events.select("user_id", "event_id", "ts", "event_type", "value").groupBy("user_id").applyInPandasWithState(run, TRACK, STATE, "append", GroupStateTimeout.NoTimeout)


def liveness(events: DataFrame, silent_ms: int = SILENT_MS) -> DataFrame:
    """One row (user_id, last_event) for each agent that has been silent for so long, by processing time; its state goes."""
    ship(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({"user_id": [key[0]], "last_event": [state.get[0]]})
            state.remove()
            return
        last = max(int(pdf["event_id"].max()) for pdf in frames)
        state.update((max(last, state.get[0]) if state.exists else last,))
        state.setTimeoutDuration(silent_ms)

    return events.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(run, "user_id long, last_event long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window; the watermark bounds the state, and later rows are left out by it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row by key of a table and its changes."""
    both = state.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("m"))
    return last.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def upsert_sink(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps the latest row by key in numbered Parquet folders; a repeated batch writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/{number - 1}"
        state = spark.read.schema(batch.schema).parquet(before) if number else batch.limit(0)
        upsert(state, batch, keys, version).write.mode("overwrite").parquet(f"{path}/{number}")

    return write


def withdrawn(state: DataFrame, gone: DataFrame, key: str, heavy: list[str]) -> DataFrame:
    """Rows of agents that withdrew lose their heavy columns; the others stay."""
    out = state.join(gone.select(key, F.lit(True).alias("__gone")), key, "left")
    for c in heavy:
        out = out.withColumn(c, F.when(F.col("__gone").isNull(), F.col(c)))
    return out.drop("__gone")


def drained(queue: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """The rows that a consumer takes at a time: by key, numbered drains of at most so many."""
    from gridloom.operators.sequences import reindex

    return reindex(queue, [key], [order], "__i").withColumn("drain", F.floor(F.col("__i") / most).cast("long")).drop("__i")


def active_submaps(tracked: DataFrame) -> DataFrame:
    """The two latest submaps of each agent stay active; older ones are to be saved."""
    top = tracked.groupBy("user_id").agg(F.max("submap").alias("newest"))
    return tracked.select("user_id", "submap").distinct().join(top, "user_id").select("user_id", "submap", F.when(F.col("submap") == F.col("newest"), "main").when(F.col("submap") == F.col("newest") - 1, "reference").otherwise("saved").alias("role"))

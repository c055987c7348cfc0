"""Responses assembled from a stream of their events, while they come in.

State per turn: the list of its events, and when the last one came; the turns of a bucket are held and told together.
A turn is told anew in every batch that brings it events, and closed by an event-time timer once the watermark has
passed its last event by ``gap``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from merchlens.operators.spread import latest_by
from merchlens.operators.transcripts import assemble_turns
from merchlens.streaming.states import TOLD, Deadlines, bucket_of, rocks_state, triggered, write_batch

_OUT = "turn_id string, seq long, event_type string, payload string, closed boolean"
#: The fields of all events as JSON: one value goes to the state and back much faster than arrays do.
_HELD = "last_ms long, events string"
#: Events of a bucket that are held before they go to the state.
_MOST = 100_000


class _Turns(StatefulProcessor):
    """Tells all events of the turns of a bucket that got new ones; a row without an event says that a turn is closed.

    A turn's deadline comes with whether the turn is closed; then nothing else is held of it.
    """

    def __init__(self, gap_ms: int, keep_ms: int) -> None:
        self.gap_ms, self.keep_ms = gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "turn_id string", _HELD)
        self.deadlines = Deadlines(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.deadlines.read()
        due, held, kept, n = self.deadlines.due, {}, set(), 0
        for part in rows:
            for turn, at_ms, *event in zip(*[part[c].tolist() for c in ("turn_id", "at_ms", "seq", "event_type", "payload")]):
                known = turn in due
                if known and due[turn][1]:
                    continue
                if turn not in held:
                    held[turn] = self._stored(turn) if known else [0, [], [], []]
                    n += len(held[turn][1])
                row = held[turn]
                if at_ms == at_ms:  # a NULL time says nothing
                    row[0] = max(row[0], int(at_ms))
                due[turn] = [row[0] + self.gap_ms, False]
                for column, value in zip(row[1:], event):
                    column.append(value)
                n += 1
            if n >= _MOST:
                self._keep(held)
                kept |= set(held)
                held, n = {}, 0
        self._keep(held)
        self.deadlines.write()
        yield from self._told(chain(held.items(), ((turn, self._stored(turn)) for turn in kept.difference(held))))

    def _stored(self, turn: str) -> list:
        """Time of the last event and the fields of all events."""
        last, events = self.events.getValue((turn,))
        return [last, *json.loads(events)]

    def _keep(self, held: dict[str, list]) -> None:
        for turn, (last, *fields) in held.items():
            self.events.updateValue((turn,), (last, json.dumps(fields, ensure_ascii=False)))

    @staticmethod
    def _told(turns: Iterator) -> Iterator[pd.DataFrame]:
        columns = ([], [], [], [])
        for turn, (_, *fields) in turns:
            for column, values in zip(columns, ([turn] * len(fields[0]), *fields)):
                column.extend(values)
            if len(columns[0]) >= TOLD:
                yield pd.DataFrame({**dict(zip(("turn_id", "seq", "event_type", "payload"), columns)), "closed": False})
                columns = ([], [], [], [])
        if columns[0]:
            yield pd.DataFrame({**dict(zip(("turn_id", "seq", "event_type", "payload"), columns)), "closed": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone, closing = self.deadlines.passed(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        for turn, (ms, closed) in gone.items():
            if not closed:  # the others are forgotten altogether
                self.events.removeKey((turn,))
                self.deadlines.due[turn] = [ms + self.keep_ms, True]
                closing.append(turn)
        self.deadlines.write()
        if closing:
            yield pd.DataFrame({"turn_id": closing, "seq": -1, "event_type": None, "payload": None, "closed": True})

    def close(self) -> None:
        pass


def stream_turns(
    events: DataFrame, sink: str, checkpoint: str, late: str = "10 minutes", gap_ms: int = 600_000, keep_ms: int = 3_600_000,
    interval: str | None = None,
) -> StreamingQuery:
    """Fold a stream ``events(turn_id, seq, event_type, payload, ts)`` into turns, as ``assemble_turns`` does at once.

    Events that are ``late`` behind the newest are dropped by the watermark; so are events of a turn that was closed,
    for ``keep_ms`` after it was. Each batch writes the turns it changed under ``sink``/turns and those it closed
    under ``sink``/closed; a batch that is run again writes the same folders. One turn's events are held by one task.
    The first start fixes the checkpoint's state; one of an earlier version, by turn, can't be gone on with.
    """
    spark = events.sparkSession
    named = events.select(
        F.col("turn_id").cast("string").alias("turn_id"), "seq", "event_type", "payload", F.col("ts").cast("timestamp").alias("ts")
    ).filter("turn_id is not null").withWatermark("ts", late)
    told = named.withColumn("at_ms", F.unix_millis("ts")).withColumn("bucket", bucket_of("turn_id")).groupBy("bucket").transformWithStateInPandas(
        _Turns(gap_ms, keep_ms), _OUT, "Append", "EventTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{sink}/events", batch_id)  # the state is folded once, both tables start from what was written
        held = spark.read.schema(_OUT).parquet(f"{sink}/events/batch={batch_id}")
        write_batch(assemble_turns(held.filter("NOT closed")), f"{sink}/turns", batch_id)
        write_batch(held.filter("closed").select("turn_id"), f"{sink}/closed", batch_id)

    with rocks_state(spark):
        writer = told.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        return triggered(writer, interval).start()


def turns_so_far(spark: SparkSession, sink: str) -> DataFrame:
    """Every turn as last told, with whether it is ``closed``."""
    told = spark.read.parquet(f"{sink}/turns")
    newest = latest_by(told, ["turn_id"], [F.col("batch")]).drop("batch")
    closed = spark.read.parquet(f"{sink}/closed").select("turn_id").distinct().withColumn("closed", F.lit(True))
    return newest.join(closed, "turn_id", "left").withColumn("closed", F.coalesce("closed", F.lit(False)))

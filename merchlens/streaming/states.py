"""What the stateful streams share: the state store they need, keys dealt to buckets, and tables kept as one folder per batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Every call of a state has frames of its own, which cost more than its rows; so many keys share a call.
_BUCKETS = 1024
#: Rows told in one frame.
TOLD = 10_000


def bucket_of(key: str) -> Column:
    """The bucket that holds a key's state; fixed, since state outlives a restart."""
    return F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int").alias("bucket")


class Deadlines:
    """Event times by which the keys of a bucket are due, under one timer for the earliest.

    They are one value, since every call of a state is a round trip: ``due`` holds a list for each key, its time first,
    and is read, changed by the caller and written once for all rows of a bucket.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("due", "keys string")
        self.due: dict[str, list] = {}

    def read(self) -> None:
        self.rings, self.due = json.loads(self.state.get()[0]) if self.state.exists() else (None, {})

    def write(self) -> None:
        first = min((ms for ms, *_ in self.due.values()), default=None)
        if first != self.rings:
            if self.rings is not None:
                self.handle.deleteTimer(self.rings)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update((json.dumps([first, self.due], ensure_ascii=False),))

    def passed(self, rung: int, watermark: int) -> dict[str, list]:
        """What is read and due when the timer of ``rung`` has gone off; it is taken out."""
        self.read()
        self.rings = None
        gone = {key: of for key, of in self.due.items() if of[0] <= rung or of[0] < watermark}
        for key in gone:
            del self.due[key]
        return gone


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """While a stream starts: states by name need the RocksDB store. A started stream keeps the setting it began with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def triggered(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, overwritten when the batch is run again after a failure."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

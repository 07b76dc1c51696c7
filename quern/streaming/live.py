"""Messages, queues, sketches and expiring keys over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.operators import sketches
from quern.shared import ship


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each message of a stream for each subscriber of a table: a stream-static join, without state."""
    return messages.join(subscriptions.select("channel", "client").distinct(), "channel")


def consume(entries: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hand each batch of new entries to ``handle(batch, number)``; with ``once``, stop when nothing is left."""
    w = entries.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


class LiveRegisters:
    """HyperLogLog registers kept up to date by the batches of a stream, as a table for each batch in a folder.

    The folder goes with the stream's checkpoint: after a restart the registers
    are those of the last whole table, and a batch that comes again is merged
    into the table before it once more.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.root}/batch={number}"

    def _whole(self) -> list[int]:
        """Numbers of the batches whose tables are complete."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]
        return sorted(int(d.getName()[6:]) for d in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = sketches.pfadd(batch)
        before = [n for n in self._whole() if n < number]
        if before:
            old = self.spark.read.parquet(self._path(before[-1])).select(*new.columns)
            new = old.union(new).groupBy("key", "idx").agg(F.max("rho").alias("rho"))
        new.write.mode("overwrite").parquet(self._path(number))
        for n in before[:-1]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(n))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def table(self) -> DataFrame:
        whole = self._whole()
        return self.spark.read.parquet(self._path(whole[-1])) if whole else self.spark.createDataFrame([], "key string, idx int, rho int")

    def count(self) -> DataFrame:
        return sketches.pfcount(self.table())


class _LastValue(StatefulProcessor):
    """The last value of a key; the store drops it once its time to live has passed."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        got = self.value.get()
        self.value.update((str(batch["value"].iloc[-1]),))
        yield pd.DataFrame({"key": [key[0]], "old_value": [got[0] if got is not None else None], "value": [str(batch["value"].iloc[-1])]})

    def close(self) -> None:
        pass


def getset_expiring(writes: DataFrame, ttl_ms: int) -> DataFrame:
    """``key, old_value, value`` of a stream ``writes(key, value, seq)``: what was there, unless it has expired."""
    ship(writes.sparkSession)
    kind = writes.schema["key"].dataType.simpleString()
    return writes.groupBy("key").transformWithStateInPandas(statefulProcessor=_LastValue(ttl_ms), outputStructType=f"key {kind}, old_value string, value string", outputMode="Update", timeMode="ProcessingTime")

"""Time series as streams: compaction rules, and samples accepted in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.operators.timeseries import AGGREGATES
from quern.shared import ship


def rule(samples: DataFrame, agg: str, bucket: str, lateness: str = "10 minutes") -> DataFrame:
    """``key, bucket, value`` of ``samples(key, time, value)`` in buckets of a duration such as ``1 hour``, aligned to time 0."""
    w = samples.withWatermark("time", lateness).groupBy("key", F.window("time", bucket)).agg(AGGREGATES[agg]("value").alias("value"))
    return w.select("key", F.col("window.start").alias("bucket"), "value")


class RuleSet:
    """Running compaction rules by source and destination; each is a streaming query that keeps its destination up to date."""

    def __init__(self, samples: DataFrame, root: str):
        self.samples, self.root, self.running = samples, root, {}

    def create(self, src: str, dst: str, agg: str, bucket: str, lateness: str = "10 minutes", once: bool = False) -> None:
        own = rule(self.samples.where(F.col("key") == src), agg, bucket, lateness).withColumn("key", F.lit(dst))
        out = own.writeStream.format("parquet").outputMode("append").option("path", f"{self.root}/{dst}").option("checkpointLocation", f"{self.root}/{dst}-checkpoint")
        self.running[src, dst] = (out.trigger(availableNow=True) if once else out).start()

    def delete(self, dst: str) -> int:
        """Stop all rules to a destination; how many there were."""
        gone = [k for k in self.running if k[1] == dst]
        for k in gone:
            self.running.pop(k).stop()
        return len(gone)


class _InOrder(StatefulProcessor):
    """Keeps each series' last time; drops what is older. Within a batch, rows go by ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        got = self.last.get()
        top = got[0] if got is not None else None
        run = batch["ts"].cummax() if top is None else batch["ts"].cummax().clip(lower=top)
        kept = batch[batch["ts"] >= run]
        self.last.update((int(run.iloc[-1]),))
        if len(kept):
            yield pd.DataFrame({"key": key[0], "ts": kept["ts"], "value": kept["value"], "seq": kept["seq"]})

    def close(self) -> None:
        pass


def accept(samples: DataFrame) -> DataFrame:
    """``samples(key, ts, value, seq)`` that aren't older than an earlier one of their key, across batches."""
    ship(samples.sparkSession)
    kind = samples.schema["key"].dataType.simpleString()
    return samples.groupBy("key").transformWithStateInPandas(statefulProcessor=_InOrder(), outputStructType=f"key {kind}, ts long, value double, seq long", outputMode="Append", timeMode="None")

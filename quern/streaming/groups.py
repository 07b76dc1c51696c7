"""Consumer groups as a stateful stream: entries are dealt in turn and stay pending until they are acknowledged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.shared import ship


class _Group(StatefulProcessor):
    """State of one stream and group: the last id delivered, whose turn it is, and what is pending with whom."""

    def __init__(self, consumers: int):
        self.consumers = consumers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "last_id string, turn long")
        self.pending = handle.getMapState("pending", "id string", "consumer string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival")
        got = self.position.get()
        last, turn = (got[0], got[1]) if got is not None else ("", 0)
        out = []
        for op, id_, arrival in zip(batch["op"], batch["id"], batch["arrival"], strict=True):
            if op == "ack":
                if self.pending.containsKey((id_,)):
                    who = self.pending.getValue((id_,))[0]
                    self.pending.removeKey((id_,))
                    out.append((id_, who, "acked", arrival))
            elif id_ > last:
                who = f"c{turn % self.consumers}"
                self.pending.updateValue((id_,), (who,))
                last, turn = id_, turn + 1
                out.append((id_, who, "delivered", arrival))
        self.position.update((last, turn))
        if out:
            yield pd.DataFrame({"key": key[0], "grp": key[1], "id": [x[0] for x in out], "consumer": [x[1] for x in out], "what": [x[2] for x in out], "arrival": [x[3] for x in out]})

    def close(self) -> None:
        pass


def deliver(entries: DataFrame, consumers: int) -> DataFrame:
    """``key, grp, id, consumer, what`` for a stream ``entries(key, grp, op, id, arrival)``, op add or ack."""
    ship(entries.sparkSession)
    kind = entries.schema["key"].dataType.simpleString()
    return entries.groupBy("key", "grp").transformWithStateInPandas(
        statefulProcessor=_Group(consumers), outputStructType=f"key {kind}, grp string, id string, consumer string, what string, arrival long", outputMode="Append", timeMode="None",
    )

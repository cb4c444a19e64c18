"""LRU over a stream of accesses: state per cache, in the state store."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "cache string, hits long, misses long"


class Lru(StatefulProcessor):
    """A cache per grouping key: its entries in order of use, and its counters. Emits the counters after every batch."""

    def __init__(self, slots: int) -> None:
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key long", "used long")
        self.totals = handle.getValueState("totals", "clock long, hits long, misses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, hits, misses = self.totals.get() if self.totals.exists() else (0, 0, 0)
        held = OrderedDict(sorted(((k[0], v[0]) for k, v in self.entries.iterator()), key=lambda x: x[1]))
        before = dict(held)
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for k in pdf["key"].tolist():
            clock += 1
            if k in held:
                hits += 1
                held.move_to_end(k)
            else:
                misses += 1
                while len(held) >= self.slots:
                    held.popitem(last=False)
            held[k] = clock
        for k in before:
            if k not in held:
                self.entries.removeKey((k,))
        for k, used in held.items():
            if before.get(k) != used:
                self.entries.updateValue((k,), (used,))
        self.totals.update((clock, hits, misses))
        yield pd.DataFrame({"cache": [key[0]], "hits": [hits], "misses": [misses]})

    def close(self) -> None:
        pass


def lru_stream(accesses: DataFrame, slots: int) -> DataFrame:
    """accesses: a stream of (cache, seq, key), in order of seq from batch to batch -> running (cache, hits, misses).

    Caches are independent, so they are dealt over tasks; a cache's state is as large as its slots. Needs the RocksDB state
    store, which PROVIDER names.
    """
    return accesses.groupBy("cache").transformWithStateInPandas(Lru(slots), RESULT, "Update", "None")


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_counts(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window of event time and type, with a watermark: late rows beyond it are dropped by Spark, as declared."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))

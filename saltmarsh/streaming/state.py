"""Stateful operators: the newest value of each key, and the semantic cache with its time to live.

Both are processors over keyed state in the RocksDB store, so state spills to disk and is restored from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestWins(StatefulProcessor):
    """Emits a key's row when a newer sequence number than any so far arrives; deletes come out as such."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "seq long, value string, is_delete boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.newest.get()[0] if self.newest.exists() else -1
        found = None
        for pdf in rows:
            row = pdf.loc[pdf["seq"].idxmax()]
            if row["seq"] > best:
                best, found = int(row["seq"]), row
        if found is not None:
            value = None if found["is_delete"] else str(found["value"])
            self.newest.update((best, value, bool(found["is_delete"])))
            yield pd.DataFrame({"key": [key[0]], "value": [value], "seq": [best], "is_delete": [bool(found["is_delete"])]})

    def close(self) -> None:
        pass


def latest_view(changes: DataFrame) -> DataFrame:
    """changes (key, value, seq, is_delete) -> every change of the current value of a key."""
    return changes.groupBy("key").transformWithStateInPandas(LatestWins(), outputStructType="key string, value string, seq long, is_delete boolean", outputMode="Update", timeMode="None")


class SemanticCache(StatefulProcessor):
    """Each query either hits a similar live entry of its partition key or becomes an entry itself.

    Capacity holds for each key, not for all together; the entry used least recently goes first.
    """

    def __init__(self, threshold: float = 0.92, ttl_ms: int = 3_600_000, capacity: int = 1_000):
        self.threshold, self.ttl_ms, self.capacity = threshold, ttl_ms, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "entry_id string", "embedding array<double>, used long", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        out = []
        for pdf in rows:
            for row in pdf.sort_values("query_id").itertuples():
                v = np.asarray(row.embedding, float)
                norm = float(np.linalg.norm(v))
                best, name = -1.0, None
                for (entry,), (e, _) in self.entries.iterator() if self.entries.exists() else ():
                    e = np.asarray(e, float)
                    if norm and len(e) == len(v) and (n := float(np.linalg.norm(e))):
                        sim = float(v @ e) / (norm * n)
                        if sim >= self.threshold and (sim > best or sim == best and entry < name):
                            best, name = sim, entry
                if name is None:
                    if norm:
                        known = [(used, entry) for (entry,), (_, used) in self.entries.iterator()] if self.entries.exists() else []
                        if len(known) >= self.capacity:
                            self.entries.removeKey((min(known)[1],))
                        self.entries.updateValue((str(row.query_id),), (v.tolist(), now))
                else:
                    self.entries.updateValue((name,), (self.entries.getValue((name,))[0], now))
                out.append((str(key[0]), str(row.query_id), name, best if name else None))
        if out:
            yield pd.DataFrame(out, columns=["key", "query_id", "entry_id", "similarity"])

    def close(self) -> None:
        pass


def cached(queries: DataFrame, threshold: float = 0.92, ttl_ms: int = 3_600_000, capacity: int = 1_000) -> DataFrame:
    """queries (key, query_id, embedding array<double>) -> (key, query_id, entry_id or null, similarity)."""
    processor = SemanticCache(threshold, ttl_ms, capacity)
    return queries.groupBy("key").transformWithStateInPandas(processor, outputStructType="key string, query_id string, entry_id string, similarity double", outputMode="Append", timeMode="ProcessingTime")

"""Structured Streaming forms: windowed log summaries, changed-path batches, the session evidence ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(log: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Calls by tool and window; later rows than ``late`` behind the newest are dropped."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", size), "tool")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms")).select(F.col("window.start").alias("hour"), "tool", "n", "total_ms")


def changed_paths(stream: DataFrame, act: Callable[[DataFrame, int], None], every: str = "750 milliseconds", checkpoint: str | None = None):
    """Distinct changed paths of each trigger handed to ``act``: the debounced watcher."""
    w = stream.writeStream.trigger(processingTime=every).foreachBatch(lambda df, n: act(df.select("path").distinct(), n))
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def ledger(stream: DataFrame, ttl: str = "1 day") -> DataFrame:
    """session, key, reused: whether the session had the key before, in the snapshot it is in now.

    State is one snapshot id for each session and key, so a batch reads and writes only the keys that it has; it goes
    after ``ttl`` without rows.  Snapshots follow one another: one that has been left does not come back.
    """
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in pdfs:
            now = pdf["snapshot"].tolist()
            before = [last, *now[:-1]]
            last = now[-1] if now else last
            yield pd.DataFrame({"session": key[0], "key": key[1], "reused": [a == b for a, b in zip(before, now)]})
        state.update((last,))
        state.setTimeoutDuration(ms)

    return stream.groupBy("session", "key").applyInPandasWithState(run, "session string, key string, reused boolean", "snapshot string", "append", "ProcessingTimeTimeout")

"""One fold in event order, run over a table or over a stream.

A fold is a state a key, a step that takes a row and says what to emit, and, if it has deadlines, what happens at one.  Over a table
the rows of a key pass in order through one task, which holds a key's state and one batch of rows.  Over a stream rows wait in the
state store until the watermark has passed them, so rows that come out of order, or again, are folded once and in order: both forms
emit the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Rows = list[dict[str, Any]]


@dataclass(frozen=True)
class Fold:
    """``step(state, row)`` and ``expire(state, ms)`` change a state (of JSON's kinds) and give the rows to emit.

    Rows have the columns of ``columns``; ``time`` (milliseconds) orders a key's rows, then ``order``.  ``deadline(state)`` is the next
    time at which ``expire`` is due, or None; it comes before rows of that time.
    """

    key: str
    columns: str
    time: str
    order: str
    start: Callable[[], dict]
    step: Callable[[dict, dict], Rows]
    emits: str
    deadline: Callable[[dict], int | None] | None = None
    expire: Callable[[dict, int], Rows] | None = None

    def until(self, state: dict, ms: int) -> Rows:
        """What deadlines up to ``ms`` emit."""
        out: Rows = []
        while self.deadline and (at := self.deadline(state)) is not None and at <= ms:
            out += self.expire(state, at)
        return out

    def take(self, state: dict, row: dict) -> Rows:
        return self.until(state, row[self.time]) + self.step(state, row)


def folded(rows: DataFrame, fold: Fold, end: int | None = None) -> DataFrame:
    """What ``fold`` emits over a table; ``end``: deadlines up to there are due when a key has no more rows.

    Rows without a key or time take no part; of rows of one time and order in a key the first is taken.
    """
    schema = T.StructType.fromDDL(fold.columns)
    emits = T.StructType.fromDDL(fold.emits)
    arrow = to_arrow_schema(emits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, None, None
        for batch in batches:
            out: Rows = []
            for row in batch.to_pylist():
                if state is None or row[fold.key] != key:
                    out += fold.until(state, end) if state is not None and end is not None else []
                    key, state, last = row[fold.key], fold.start(), None
                if (row[fold.time], row[fold.order]) != last:
                    out += fold.take(state, row)
                last = row[fold.time], row[fold.order]
            yield pa.RecordBatch.from_pylist(out, arrow)
        if state is not None and end is not None:
            yield pa.RecordBatch.from_pylist(fold.until(state, end), arrow)

    own = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).filter(F.col(fold.key).isNotNull() & F.col(fold.time).isNotNull())
    return own.repartition(fold.key).sortWithinPartitions(fold.key, fold.time, fold.order).mapInArrow(run, emits)


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getMapState("waiting", "ms long, place string", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due = set()
        for row in rows:
            own = {c: row[c] for c in self.fold.names}
            place = json.dumps(own[self.fold.order])
            ms = own[self.fold.time]
            if not self.waiting.containsKey((ms, place)):
                self.waiting.updateValue((ms, place), (json.dumps(own),))
            due.add(ms)
        for ms in due:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # no row up to the watermark can come any more
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.fold.start()
        ready = sorted((k[0], json.loads(k[1]), k[1]) for k in self.waiting.keys() if k[0] <= now)
        out: Rows = []
        for ms, _, place in ready:
            out += self.fold.take(state, json.loads(self.waiting.getValue((ms, place))[0]))
            self.waiting.removeKey((ms, place))
        out += self.fold.until(state, now)
        self.state.update((json.dumps(state),))
        if self.fold.deadline and (at := self.fold.deadline(state)) is not None:
            self.handle.registerTimer(at)
        for x in out:
            yield Row(**{f: x.get(f) for f in self.fold.emitted})

    def close(self) -> None:
        pass


def stream_folded(stream: DataFrame, fold: Fold, at: str, delay: str = "10 minutes") -> DataFrame:
    """What ``fold`` emits over a stream with the event time ``at`` (a timestamp; its milliseconds become ``fold.time``), once the
    watermark, ``delay`` behind the newest row, has passed a row; later rows are dropped.

    The session needs the RocksDB state store.  State: a key's state, and its rows within the delay.
    """
    schema = T.StructType.fromDDL(fold.columns)
    object.__setattr__(fold, "names", [f.name for f in schema])
    object.__setattr__(fold, "emitted", [f.name for f in T.StructType.fromDDL(fold.emits)])
    rows = stream.withWatermark(at, delay).withColumn(fold.time, F.unix_millis(at))
    rows = rows.select(at, *(F.col(f.name).cast(f.dataType) for f in schema)).filter(F.col(fold.key).isNotNull())
    return rows.groupBy(fold.key).transformWithState(_Processor(fold), T.StructType.fromDDL(fold.emits), "Append", "EventTime")


#: The state store that ``stream_folded`` needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def sessions(most: int = 64) -> Fold:
    """Which evidence a server has given to a session before (server, ms, id, session, snapshot, evidence): emits server, id, reused.

    A session's evidence is forgotten when the snapshot changes, and a server keeps its ``most`` newest sessions: the one that began
    first goes, and begins anew if it comes back.
    """
    def step(state: dict, row: dict) -> Rows:
        kept, name = state["sessions"], row["session"]
        own = kept.get(name)
        if own is None or own["snapshot"] != row["snapshot"]:
            own = kept[name] = {"snapshot": row["snapshot"], "seen": {}}  # a session whose snapshot changes keeps its place
            while len(kept) > most:
                del kept[next(iter(kept))]
        reused = row["evidence"] in own["seen"]
        if not reused:
            own["seen"][row["evidence"]] = 1
        return [{"server": row["server"], "id": row["id"], "reused": reused}]

    return Fold("server", "server string, ms long, id long, session string, snapshot string, evidence string", "ms", "id", lambda: {"sessions": {}}, step, "server string, id long, reused boolean")


#: What a file of a review is called before it has a path.
UNPARSED = "<unparsed-diff-block>"


def review(timeout_ms: int = 3_600_000, attempts: int = 2) -> Fold:
    """Manifests of batched reviews, from events (review, ms, id, event, path, status, hunks, resolved, complete, failed).

    ``open`` adds a file with its hunks (again: more hunks), ``batch`` says what became of a file: failed; else reviewed, if the batch was
    complete or the file has no hunks and is resolved or deleted; else omitted.  A file without an answer ``timeout_ms`` after it was opened
    is asked for again, and has failed after ``attempts``; a later answer still counts.  Each event emits the manifest's coverage: review, n (of
    its row), ms, id (null at a deadline), retry (the path asked for again), complete, settled (no file is pending), eligible, resolved, hunks, reviewed_hunks, omitted.
    """
    def coverage(state: dict, review_id: str, ms: int, event: int | None, retry: str | None = None) -> dict:
        files = state["files"].values()
        done = [f for f in files if f["state"] == "reviewed"]
        state["n"] += 1
        return {"review": review_id, "n": state["n"], "ms": ms, "id": event, "retry": retry, "complete": len(done) == len(files), "settled": all(f["state"] != "pending" for f in files),
                "eligible": sum(f["status"] != "deleted" for f in files), "resolved": sum(f["status"] != "deleted" and f["graph"] == "resolved" for f in files),
                "hunks": sum(f["hunks"] for f in files), "reviewed_hunks": sum(f["hunks"] for f in done), "omitted": len(files) - len(done)}

    def step(state: dict, row: dict) -> Rows:
        state["review"] = row["review"]
        path = row["path"] if row["path"] is not None else UNPARSED
        own = state["files"].get(path)
        if row["event"] == "open":
            if own is None:
                state["files"][path] = {"status": row["status"], "hunks": max(0, row["hunks"] or 0), "graph": "pending", "state": "pending", "due": row["ms"] + timeout_ms, "left": attempts - 1}
            else:
                own["hunks"] += max(0, row["hunks"] or 0)
        elif own is not None:
            deleted = own["status"] == "deleted"
            own["graph"] = "unsupported" if deleted else "resolved" if row["resolved"] and not row["failed"] else "failed"
            if row["failed"]:
                own["state"] = "failed"
            else:
                own["state"] = "reviewed" if row["complete"] or (own["hunks"] == 0 and own["graph"] != "failed") else "omitted"
        return [coverage(state, row["review"], row["ms"], row["id"])]

    def deadline(state: dict) -> int | None:
        return min((f["due"] for f in state["files"].values() if f["state"] == "pending"), default=None)

    def expire(state: dict, ms: int) -> Rows:
        out = []
        for path, f in sorted(state["files"].items()):
            if f["state"] == "pending" and f["due"] <= ms:
                if f["left"] > 0:
                    f["left"], f["due"] = f["left"] - 1, ms + timeout_ms
                    out.append(coverage(state, state["review"], ms, None, path))
                else:
                    f["state"], f["graph"] = "failed", "unsupported" if f["status"] == "deleted" else "failed"
                    out.append(coverage(state, state["review"], ms, None))
        return out

    columns = "review string, ms long, id long, event string, path string, status string, hunks int, resolved boolean, complete boolean, failed boolean"
    emits = "review string, n long, ms long, id long, retry string, complete boolean, settled boolean, eligible int, resolved int, hunks int, reviewed_hunks int, omitted int"
    return Fold("review", columns, "ms", "id", lambda: {"files": {}, "review": None, "n": 0}, step, emits, deadline, expire)


def last_coverage(coverage: DataFrame) -> DataFrame:
    """Each review's last row of what ``review`` emits: its outcome so far."""
    rest = [c for c in coverage.columns if c not in ("review", "retry", "id")]
    best = coverage.groupBy("review").agg(F.max_by(F.struct(*rest), "n").alias("b"))
    return best.select("review", *(F.col(f"b.{c}").alias(c) for c in rest))

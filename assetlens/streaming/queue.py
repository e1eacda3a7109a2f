"""A work queue as a stateful stream, and a versioned cache of its results.

Every key is a piece of work. What happens to it comes as rows of a stream: it is new, its call gave a result, or its call failed. The
state of a key is its status, its attempts and when it was called last; it lives in Spark's state store, so a stream that starts again
from its checkpoint goes on where it was and hands out nothing twice. The cache is a table of (key, version, value); a reader who asks
for a version gets the newest one up to it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIONS = "key string, attempt int, action string, at timestamp, value string"
#: A key's state: 'waiting', 'done' or 'failed', attempts so far, and the time of the last call in milliseconds.
STATE = "status string, attempts int, called long"


def turns(rows: Iterable[tuple[int, str, str | None]], status: str | None, attempts: int, called: int, most: int) -> tuple[list[tuple[int, str, int, str | None]], str | None, int, int]:
    """Actions (attempt, action, time, value) that rows (time, kind, value) of one key lead to, in order, and the state after them.

    'new' calls a key that isn't known yet; 'error' calls one again that waits, until it was called ``most`` times; 'ok' stores a
    value, also of a key that is known as failed. Anything else, and rows of a key that is done, lead to nothing."""
    out: list[tuple[int, str, int, str | None]] = []
    for at, kind, value in sorted(rows, key=lambda r: (r[0], {"new": 0, "error": 1}.get(r[1], 2), r[2] or "")):
        if kind == "new" and status is None:
            status, attempts, called = "waiting", 1, at
            out.append((attempts, "call", at, None))
        elif kind == "ok" and status in ("waiting", "failed"):
            status = "done"
            out.append((attempts, "store", at, value))
        elif kind == "error" and status == "waiting":
            if attempts < most:
                attempts, called = attempts + 1, at
                out.append((attempts, "call", at, None))
            else:
                status = "failed"
                out.append((attempts, "give up", at, None))
    return out, status, attempts, called


def work_queue(events: DataFrame, most: int = 3, patience: int = 600, late: str = "10 minutes") -> DataFrame:
    """events (key string, ts timestamp, kind string, value string), a stream, to what is to be done (key, attempt, action, at, value).

    A call without an answer for ``patience`` seconds of the stream's own time counts as failed. Rows without a key are left out."""

    def frame(key: str, out: list[tuple[int, str, int, str | None]]) -> pd.DataFrame:
        return pd.DataFrame([(key, n, action, pd.Timestamp(at, unit="ms"), value) for n, action, at, value in out], columns=["key", "attempt", "action", "at", "value"])

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, called = state.get if state.exists else (None, 0, 0)
        if state.hasTimedOut:
            rows = [(called + 1000 * patience, "error", None)]
        else:
            rows = [(int(t.timestamp() * 1000), k, None if v is None or v != v else v) for b in batches for t, k, v in zip(b.ts, b.kind, b.value, strict=True)]
        out, status, attempts, called = turns(rows, status, attempts, called, most)
        if status is not None:
            state.update((status, attempts, called))
            if status == "waiting":
                state.setTimeoutTimestamp(max(called + 1000 * patience, state.getCurrentWatermarkMs() + 1))
        if out:
            yield frame(key[0], out)

    seen = events.filter("key is not null and ts is not null").withWatermark("ts", late).select("key", "ts", "kind", "value")
    return seen.groupBy("key").applyInPandasWithState(step, ACTIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def cached(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (key, version) with the version found and its value: the newest one up to the version asked for, null if there is none.

    Of several values of a version the largest counts. Versions that are asked for and versions that are there stand in one list per
    key, so a request looks back to the last entry before it: one shuffle by key, and no pairs of requests and versions."""
    have = cache.filter("key is not null and version is not null").groupBy("key", "version").agg(F.max("value").alias("value")).select("key", "version", F.lit(0).alias("_asks"), F.struct(F.col("version").alias("found"), "value").alias("_entry"))
    ask = requests.select("key", "version", F.lit(1).alias("_asks"), F.lit(None).cast(have.schema["_entry"].dataType).alias("_entry"))
    back = Window.partitionBy("key").orderBy("version", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = have.unionByName(ask).withColumn("_last", F.last("_entry", ignorenulls=True).over(back)).filter("_asks = 1")
    return rows.select("key", "version", F.col("_last.found").alias("found"), F.col("_last.value").alias("value"))

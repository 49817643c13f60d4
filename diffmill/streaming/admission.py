"""Admission of single requests (X2): a limit per client and window, decided in order.

A client's window begins with a request and ends ``window`` later; the next request after that
begins the next one. Requests count in their window whether admitted or not, and those
beyond the limit are refused. So where windows begin depends on all requests before.

A batch cuts time into segments. Alone, a segment can say for any window that is open at its
beginning which window is open at its end: that map has as many steps as there are
different outcomes, few, because windows fall into step. The maps of a client, one small row per
segment, are followed in order; then every segment decides its requests. A client with
many requests is spread over its segments.

A stream keeps per client the open window and the requests that the watermark has not passed
yet, decides these in order once it has, and drops the state when the window is over.
"""

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: No window is open.
NEVER = -(1 << 62)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _decided(at: np.ndarray, start: int, count: int, limit: int, window: int) -> tuple[np.ndarray, int, int]:
    """Which of the requests, in order, are admitted; and the window open after them."""
    admitted = np.zeros(len(at), bool)
    done = 0
    while done < len(at):
        end = int(np.searchsorted(at, start + window, "left"))
        if end > done:
            admitted[done:end] = count + np.arange(1, end - done + 1) <= limit
            count += end - done
            done = end
        if done < len(at):
            start, count = int(at[done]), 0
    return admitted, start, count


def _outcomes(at: np.ndarray, begin: int, window: int) -> tuple[list[int], list[int], list[int]]:
    """For each request that a window can begin with in a segment, up to the last one with the same
    outcome: its time, the last window's start, and how many requests that one has."""
    n = len(at)
    following = np.searchsorted(at, at + window, "left")
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            last[i] = last[following[i]]
    entries = min(n, int(np.searchsorted(at, begin + window, "left")) + 1)
    ends = [i for i in range(entries) if i + 1 == entries or last[i] != last[i + 1]]
    return [int(at[i]) for i in ends], [int(at[last[i]]) for i in ends], [int(n - last[i]) for i in ends]


def admitted(
    requests: DataFrame,
    limit: int,
    window: timedelta = timedelta(minutes=1),
    key: str = "client",
    request: str = "request_id",
    ts: str = "ts",
    segment: timedelta | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """``key, request, ts, admitted`` of every request, on a batch or a stream.

    Requests of one time go by their id. A segment, ten windows if not given, may not be shorter than
    the window. Requests without a client or time are refused. On a stream a
    request that is later than the watermark is left out, as it can't be decided in order.
    """
    rows = requests.select(key, request, ts)
    length, wide = int(window.total_seconds() * 1e6), int((segment or 10 * window).total_seconds() * 1e6)
    if length <= 0 or wide < length:
        raise ValueError("a segment is no shorter than a window")
    if requests.isStreaming:
        return _admitted_stream(rows, limit, length, key, request, ts, watermark)
    usable = F.col(ts).isNotNull() & F.col(key).isNotNull()
    timed = rows.filter(usable).withColumn("at", _micros(ts)).withColumn("segment", F.floor(F.col("at") / wide))
    kind, own = rows.schema[key].dataType, [key, "segment"]
    step = T.StructType(
        [T.StructField(key, kind), T.StructField("segment", T.LongType()), T.StructField("n", T.LongType())]
        + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("until", "start", "count")]
    )

    def outcomes(name: tuple, part: pa.Table) -> pa.Table:
        at = np.sort(part["at"].to_numpy())
        found = _outcomes(at, name[1].as_py() * wide, length)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in found]
        return pa.Table.from_arrays([pa.array([name[0].as_py()], name[0].type), pa.array([name[1].as_py()], pa.int64()), pa.array([len(at)], pa.int64()), *lists], step.names)

    carry = T.StructType([T.StructField(key, kind)] + [T.StructField(name, T.LongType()) for name in ("segment", "open", "used")])

    def followed(name: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("segment")
        start, count, opened, used = NEVER, 0, [], []
        for n, until, starts, counts in zip(*[part[c].to_pylist() for c in ("n", "until", "start", "count")]):
            opened.append(start)
            used.append(count)
            at = int(np.searchsorted(np.asarray(until), start + length, "left"))
            if at < len(until):
                start, count = starts[at], counts[at]
            else:  # the open window takes them all
                count += n
        segments = part["segment"].combine_chunks()
        return pa.Table.from_arrays([pa.array([name[0].as_py()] * len(opened), name[0].type), segments, pa.array(opened, pa.int64()), pa.array(used, pa.int64())], carry.names)

    # Arrow tables: the groups are many and small, and a pandas frame of each costs more than its work
    steps = timed.select(*own, "at").groupBy(*own).applyInArrow(outcomes, step)
    carries = steps.groupBy(key).applyInArrow(followed, carry)
    schema = T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])

    def decide(name: tuple, part: pa.Table, begin: pa.Table) -> pa.Table:
        part = part.sort_by([("at", "ascending"), (request, "ascending")])
        start, count = (begin["open"][0].as_py(), begin["used"][0].as_py()) if len(begin) else (NEVER, 0)
        found, _, _ = _decided(part["at"].to_numpy(), start, count, limit, length)
        return part.append_column("admitted", pa.array(found)).select(schema.names)

    decided = timed.groupBy(*own).cogroup(carries.groupBy(*own)).applyInArrow(decide, schema)
    return decided.unionByName(rows.filter(~usable).withColumn("admitted", F.lit(False)))


def _admitted_stream(rows: DataFrame, limit: int, length: int, key: str, request: str, ts: str, watermark: str) -> DataFrame:
    fields = rows.schema
    state_schema = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("count", T.LongType())]
        + [T.StructField("at", T.ArrayType(T.LongType())), T.StructField("request", T.ArrayType(fields[request].dataType))]
    )
    schema = T.StructType([*[fields[c] for c in (key, request)], T.StructField("at", T.LongType()), T.StructField("admitted", T.BooleanType())])

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count, at, ids = state.get if state.exists else (NEVER, 0, [], [])
        waiting = list(zip(at, ids))
        if not state.hasTimedOut:
            for part in parts:
                waiting += zip(part["at"].tolist(), part[request].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [x for x in waiting if x[0] < passed]
        waiting = waiting[len(ready) :]
        if ready:
            found, start, count = _decided(np.array([x for x, _ in ready]), start, count, limit, length)
            yield pd.DataFrame({key: [name[0]] * len(ready), request: [i for _, i in ready], "at": [x for x, _ in ready], "admitted": found})
        if not waiting and start + length <= passed:
            if state.exists:
                state.remove()
            return
        state.update((start, count, [x for x, _ in waiting], [i for _, i in waiting]))
        wake = waiting[0][0] if waiting else start + length
        state.setTimeoutTimestamp(max(wake // 1000 + 1, passed // 1000 + 1))

    timed = rows.filter(F.col(key).isNotNull()).withWatermark(ts, watermark).withColumn("at", _micros(ts))
    found = timed.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, request, F.timestamp_micros("at").cast(fields[ts].dataType).alias(ts), "admitted")

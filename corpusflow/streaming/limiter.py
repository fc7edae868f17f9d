"""A sliding-window limit per client: in batches and as a stateful stream.

An event passes if fewer than ``limit`` events of its key passed within the last ``window`` seconds; events that are turned
away don't count.  That makes each decision depend on those before it, so a key's events are walked in order of time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW = 30, 60.0


def walk(times, passed: deque, limit: int, window: float) -> list[bool]:
    """Decisions for times in order; ``passed`` holds the times that passed within the window and is kept up to date."""
    out = []
    for t in times:
        while passed and passed[0] <= t - window:
            passed.popleft()
        ok = len(passed) < limit
        if ok:
            passed.append(t)
        out.append(ok)
    return out


def limited(events: DataFrame, key: list[str], at: str = "at", limit: int = LIMIT, window: float = WINDOW, order: str | None = None) -> DataFrame:
    """Events with ``allowed``.  ``at``: seconds; ties by ``order``.

    Rows come to a task sorted by key and time and are walked in one pass, so a key with very many events needs no more
    memory than ``limit`` times; only a key's own order is sequential.
    """
    names = [f.name for f in events.schema.fields]
    by = [*key, at, *([order] if order else [])]
    rows = events.repartition(*key).sortWithinPartitions(*by)
    spots = [names.index(k) for k in key]
    when = names.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passed = object(), deque()
        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in spots], strict=True))
            out = []
            for k, t in zip(keys, b.column(when).to_pylist(), strict=True):
                if k != now:
                    now, passed = k, deque()
                out += walk([t], passed, limit, window)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*names, "allowed"])

    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    return rows.mapInArrow(run, f"{schema}, allowed boolean")


def limited_stream(events: DataFrame, key: str, at: str = "at", limit: int = LIMIT, window: float = WINDOW, order: str = "event_id") -> DataFrame:
    """The same over a stream: a key's state is the times that passed, at most ``limit`` of them; idle keys are dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(events.dtypes)
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{at}` double, allowed boolean"

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = deque(state.get[0]) if state.exists else deque()
        whole = pd.concat(list(batches)).sort_values([at, order])
        ok = walk(whole[at].tolist(), passed, limit, window)
        state.update((list(passed),))
        state.setTimeoutDuration(int(window * 2000))
        yield pd.DataFrame({key: k[0], order: whole[order], at: whole[at], "allowed": ok})

    return events.groupBy(key).applyInPandasWithState(step, out, "passed array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows, with a watermark; batch and stream alike.  events: ts, event_type, value."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")

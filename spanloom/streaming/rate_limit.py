"""A sliding rate limit over request streams, for batches and for Structured Streaming.

Per client at most ``limit`` admitted requests in any ``window`` seconds; rejected requests do not count. The decision depends on
earlier decisions, so a client's requests are walked in order; state is the times admitted within the window, ``limit`` at most.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def admit(times: list[float], recent: deque, limit: int, window: float) -> list[bool]:
    """Decisions for requests in order of time; ``recent`` holds the admitted times and is carried on."""
    out = []
    for t in times:
        while recent and recent[0] <= t - window:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def admitted(events: DataFrame, client: str, at: str, key: str, limit: int, window: float = 60.0) -> DataFrame:
    """``key, client, admitted`` of every request of a batch. A client's requests come sorted in Arrow batches, never all at once."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rows = events.selectExpr(f"`{key}` AS k", f"`{client}` AS c", f"unix_micros(timestamp(`{at}`)) / 1e6 AS t").repartition("c").sortWithinPartitions("c", "t", "k")

    def walk(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = object(), deque()
        for pdf in pdfs:
            out = []
            for c, t in zip(pdf["c"], pdf["t"]):
                if c != now:
                    now, recent = c, deque()
                out += admit([t], recent, limit, window)
            yield pd.DataFrame({"k": pdf["k"], "c": pdf["c"], "admitted": out})

    return rows.mapInPandas(walk, f"k {kinds[key]}, c {kinds[client]}, admitted boolean").toDF(key, client, "admitted")


def admitted_stream(events: DataFrame, client: str, at: str, key: str, limit: int, window: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream, with the admitted times as the state of each client; state idle for longer than the delay is dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else [])
        for pdf in pdfs:
            pdf = pdf.sort_values([at, key])
            seconds = (pd.to_datetime(pdf[at]).astype("int64") / (1e6 if str(pdf[at].dtype).startswith("datetime64[us") else 1e9)).tolist()
            yield pd.DataFrame({key: pdf[key], client: group[0], "admitted": admit(seconds, recent, limit, window)})
        state.update((list(recent),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(recent[-1] * 1000) if recent else 0) + int(window * 1000) + 1)

    return (
        events.withWatermark(at, delay)
        .groupBy(client)
        .applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{client}` {kinds[client]}, admitted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    )

"""The chat operators on streams: an extension, since the batch operators count windows from the first message and streams from the epoch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import stages


def spike_counts(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds", delay: str = "2 minutes", least: int = 3) -> DataFrame:
    """Sliding windows with enough messages; late ones within the delay still count.  events: time (timestamp), weight."""
    w = events.withWatermark("time", delay).groupBy(F.window("time", width, step)).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return w.filter(F.col("n") >= least).select("window.start", "window.end", "n", "weight")


def greedy(windows: dict[int, tuple[int, float]], apart: float, least: int, most: int) -> list[tuple[int, int, float]]:
    """k, n, weight of the windows that are kept, by weight, none nearer to one before than `apart` steps."""
    kept: list[tuple[int, int, float]] = []
    for k, (n, weight) in sorted(windows.items(), key=lambda x: (-x[1][1], x[0])):
        if len(kept) == most:
            break
        if n >= least and all(abs(k - x[0]) >= apart for x in kept):
            kept.append((k, n, weight))
    return kept


def spike_selection(events: DataFrame, width: float = 60.0, step: float = 10.0, least: int = 3, most: int = 20, delay: str = "2 minutes", idle: float = 3600.0) -> DataFrame:
    """video, revision, k, n, weight, rank: the spikes that are kept of each video, anew whenever messages of it arrive; the last revision counts.

    events: video (string), time (timestamp), weight.  A video's state is a number and a weight for each of its windows, counted from the epoch, whatever the number of
    messages; a message that comes late, but within the delay, changes its windows and so the selection.  The state goes once the stream is `idle` seconds
    beyond a video's last message.  For update mode.  With windows that begin at the same times, a stream that has ended has the spikes of
    chat.select_spikes.
    """
    stages.prepare(events.sparkSession)

    def revise(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import numpy as np

        if state.hasTimedOut:
            state.remove()
            return
        revision, latest, windows = 0, 0.0, {}
        if state.exists:
            revision, latest, ks, ns, weights = state.get
            windows = {int(k): (int(n), float(w)) for k, n, w in zip(ks, ns, weights, strict=True)}
        for df in frames:
            ts, weight = df["ts"].to_numpy(), df["weight"].to_numpy()
            latest = max(latest, float(ts.max()))
            last = np.floor(ts / step).astype(int)
            first = np.maximum(0, np.floor((ts - width) / step).astype(int) + 1)
            for a, b, w in zip(first.tolist(), last.tolist(), weight.tolist(), strict=True):
                for k in range(a, b + 1):
                    n, held = windows.get(k, (0, 0.0))
                    windows[k] = (n + 1, held + w)
        revision += 1
        ks = sorted(windows)
        state.update((revision, latest, ks, [windows[k][0] for k in ks], [windows[k][1] for k in ks]))
        state.setTimeoutTimestamp(max(int((latest + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        kept = greedy(windows, width / 2 / step, least, most)
        yield pd.DataFrame([(key[0], revision, k, n, w, i + 1) for i, (k, n, w) in enumerate(kept)], columns=["video", "revision", "k", "n", "weight", "rank"])

    rows = events.withWatermark("time", delay).select("video", "time", (F.unix_micros("time") / 1e6).alias("ts"), F.col("weight").cast("double").alias("weight"))
    out, held = "video string, revision long, k long, n long, weight double, rank int", "revision long, latest double, ks array<long>, ns array<long>, weights array<double>"
    return rows.groupBy("video").applyInPandasWithState(revise, out, held, "update", "EventTimeTimeout")


def mention_sessions(events: DataFrame, key: str, gap: str = "60 seconds", delay: str = "2 minutes") -> DataFrame:
    s = events.withWatermark("time", delay).groupBy(F.session_window("time", gap), key).agg(F.count("*").alias("n"))
    return s.select(key, "session_window.start", "session_window.end", "n")


def density(events: DataFrame, width: str = "120 seconds", delay: str = "2 minutes") -> DataFrame:
    return events.withWatermark("time", delay).groupBy(F.window("time", width)).agg(F.count("*").alias("n")).select("window.start", "n")


def distinct_messages(events: DataFrame, key: str = "message_id", delay: str = "2 minutes") -> DataFrame:
    return events.withWatermark("time", delay).dropDuplicatesWithinWatermark([key])


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every finished batch goes through a batch operator, such as the selection of spikes."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()

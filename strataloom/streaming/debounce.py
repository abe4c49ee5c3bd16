"""Trailing-edge debounce of change events, and the rebuild state machine behind it.

Events are (ts, path, kind). A burst ends when nothing came for the gap; its end is when a rebuild fires. These functions
work on batch and streaming DataFrames alike; a stream needs its watermark first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "500 milliseconds"
QUEUE_CAP = 1000
COOLDOWN_MS = 200
RECHECK_MS = 2000
# Paths under a repository's metadata whose change means a change of the tree.
WATCHED = r"(^|/)\.git/(HEAD|index|refs/heads/.+)$"


def watched(events: DataFrame) -> DataFrame:
    """The events on watched metadata paths."""
    return events.where(F.col("path").rlike(WATCHED))


def with_watermark(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(events: DataFrame, gap: str = GAP, keys: tuple[str, ...] = (), cap: int = QUEUE_CAP) -> DataFrame:
    """(keys, fired_at, started_at, n, dirty): one row for each burst; past the cap only the flag `dirty` says so.

    On a stream at least one key is needed, such as the repository.
    """
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.end").alias("fired_at"), F.col("w.start").alias("started_at"), F.least("n", F.lit(cap)).alias("n"), (F.col("n") > cap).alias("dirty"))


def rebuilds(fires: list[int], busy: list[tuple[int, int]], cooldown: int = COOLDOWN_MS, recheck: int = RECHECK_MS) -> list[int]:
    """When rebuilds run, in milliseconds: a fire during a busy interval waits in steps of recheck, one within the cooldown
    of the last rebuild is dropped."""
    out: list[int] = []
    for at in sorted(fires):
        while any(a <= at < b for a, b in busy):
            at += recheck
        if not out or at - out[-1] >= cooldown:
            out.append(at)
    return out


def debounced_stream(events: DataFrame, busy: list[tuple[int, int]] = (), gap_ms: int = 500, cooldown: int = COOLDOWN_MS, recheck: int = RECHECK_MS) -> DataFrame:
    """(repo, fired_ms, n): the state machine on a stream of (repo, ts): a timer fires gap_ms after a repo's last event,
    waits while busy, and drops what the cooldown covers. State is four numbers for each repo."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pdfs, state):
        last, n, built = state.get if state.exists else (0, 0, -(10**15))
        if state.hasTimedOut:
            at = last + gap_ms
            while any(a <= at < b for a, b in busy):
                at += recheck
            state.update((last, 0, max(built, at)))
            if n and at - built >= cooldown:
                yield pd.DataFrame({"repo": [key[0]], "fired_ms": [at], "n": [n]})
            return
        for pdf in pdfs:
            ms = pdf.ts.astype("datetime64[ms]").astype("int64")
            for t in sorted(ms):
                if n and t - last > gap_ms:
                    at = last + gap_ms
                    while any(a <= at < b for a, b in busy):
                        at += recheck
                    if at - built >= cooldown:
                        built = at
                        yield pd.DataFrame({"repo": [key[0]], "fired_ms": [at], "n": [n]})
                    n = 0
                last, n = max(last, int(t)), n + 1
        state.update((last, n, built))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))

    return events.groupBy("repo").applyInPandasWithState(step, "repo string, fired_ms long, n long", "last long, n long, built long", "append", GroupStateTimeout.EventTimeTimeout)

"""Incremental forms on event streams: tumbling sums, sessions, late rows. Each works on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Sums and counts by type and window; on streams late rows up to `late` still count."""
    g = _marked(events, late).groupBy(F.window("ts", width), "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "total", "n")


def sliding(events: DataFrame, width: str = "6 hours", slide: str = "2 hours", late: str | None = None) -> DataFrame:
    g = _marked(events, late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """Runs of a user's events with no pause of gap or longer."""
    g = _marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "last", "n")


def running_months(events: DataFrame) -> DataFrame:
    """A stream's count and sum per user so far, kept as state (the incremental form of a column upsert)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)

"""Streaming forms of the temporal operators.

``ts`` is a timestamp column. Late rows beyond the watermark are dropped; append
mode emits a window once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.triage import level_counts


def _window(stream: DataFrame, ts: str, timeframe: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).withColumn("_w", F.window(F.col(ts), timeframe))


def _opened(frame: DataFrame) -> DataFrame:
    return frame.withColumn("window_start", F.col("_w.start")).drop("_w")


def count_over(stream: DataFrame, keys: list[str], ts: str, timeframe: str, delay: str, more_than: int) -> DataFrame:
    counted = _window(stream, ts, timeframe, delay).groupBy("_w", *keys).agg(F.count(F.lit(1)).alias("n"))
    return _opened(counted.filter(F.col("n") > more_than))


def distinct_over(
    stream: DataFrame, keys: list[str], ts: str, timeframe: str, delay: str, value: str, more_than: int
) -> DataFrame:
    """Exact distinct counts: each value is let through once per key and window, then counted.

    State holds one row per (window, key, value) and no growing set.
    """
    once = _window(stream, ts, timeframe, delay).dropDuplicates(["_w", *keys, value])
    counted = once.groupBy("_w", *keys).agg(F.count(F.lit(1)).alias("n"))
    return _opened(counted.filter(F.col("n") > more_than))


def values_seen(stream: DataFrame, keys: list[str], ts: str, timeframe: str, delay: str, value: str) -> DataFrame:
    """How often each value was seen per key and window, as it grows (update mode).

    The rows of a window are its distinct values; state holds one row for each.
    """
    counted = _window(stream, ts, timeframe, delay).groupBy("_w", *keys, value).agg(F.count(F.lit(1)).alias("times"))
    return _opened(counted)


def sum_over(
    stream: DataFrame, keys: list[str], ts: str, timeframe: str, delay: str, value: Column, more_than
) -> DataFrame:
    summed = _window(stream, ts, timeframe, delay).groupBy("_w", *keys).agg(F.sum(value).alias("total"))
    return _opened(summed.filter(F.col("total") > more_than))


def near(
    stream: DataFrame, key: str, ts: str, event_id: str, span: str, anchor: Column, required: dict[str, Column]
) -> DataFrame:
    """Anchors with every required selection within ``span``: a chain of semi joins, so no pairs come out."""
    frame = stream.filter(anchor).withWatermark(ts, span).select(event_id, F.col(key), F.col(ts)).alias("a")
    for name, test in required.items():
        other = stream.filter(test).withWatermark(ts, span).select(F.col(key).alias("_key"), F.col(ts).alias("_ts")).alias(name)
        close = F.expr(f"_ts BETWEEN {ts} - INTERVAL {span} AND {ts} + INTERVAL {span}")
        frame = frame.join(other, (F.col(key) == F.col("_key")) & close, "left_semi")
    return frame


def followed_by(
    stream: DataFrame, first: Column, second: Column, first_key: str, second_key: str, ts: str, event_id: str, span: str
) -> DataFrame:
    """First events that a second one follows within ``span``; the keys may be different columns."""
    a = stream.filter(first).withWatermark(ts, span).select(event_id, F.col(first_key).alias("key"), F.col(ts))
    b = stream.filter(second).withWatermark(ts, span).select(F.col(second_key).alias("_key"), F.col(ts).alias("_ts"))
    later = F.expr(f"_ts > {ts} AND _ts <= {ts} + INTERVAL {span}")
    return a.join(b, (F.col("key") == F.col("_key")) & later, "left_semi")


def gap_sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Closed gap sessions with first and last time and number of events."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.session_window(F.col(ts), gap).alias("_w"), *keys)
    return grouped.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("_w")


def without_duplicates(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def running_levels(matches: DataFrame, by: list[str], ts: str, timeframe: str, delay: str) -> DataFrame:
    """Matches per level, window and ``by``, updated as they come (update mode)."""
    counted = _window(matches, ts, timeframe, delay).groupBy("_w", *by).agg(*level_counts().values())
    return _opened(counted)

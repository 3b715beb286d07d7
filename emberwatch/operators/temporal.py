"""Thresholds, proximity and ordered sequences over event tables.

A slice of the time axis is an hour whatever the span: what a slice needs from
the others comes as one row per slice, so a long span makes no large slice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.predicates import all_of, two_valued
from emberwatch.operators.timeline import HOUR, nearest, trailing_total

# ---------------------------------------------------------------- thresholds


def windowed(events: DataFrame, keys: list[str], ts: str, timeframe: str, *aggregates: Column) -> DataFrame:
    """Aggregates per key and tumbling window, with the window's start as ``window_start``."""
    grouped = events.groupBy(F.window(F.col(ts), timeframe).alias("_w"), *keys).agg(*aggregates)
    return grouped.withColumn("window_start", F.col("_w.start")).drop("_w")


def count_over(events: DataFrame, keys: list[str], ts: str, timeframe: str, more_than: int) -> DataFrame:
    """Keys and windows with more than so many events; no keys means all events together."""
    return windowed(events, keys, ts, timeframe, F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def distinct_over(events: DataFrame, keys: list[str], ts: str, timeframe: str, value: str, more_than: int) -> DataFrame:
    """More than so many distinct values; Spark counts them by (key, window, value) first."""
    counted = windowed(events, keys, ts, timeframe, F.count_distinct(value).alias("n"))
    return counted.filter(F.col("n") > more_than)


def sum_over(events: DataFrame, keys: list[str], ts: str, timeframe: str, value: Column, more_than) -> DataFrame:
    return windowed(events, keys, ts, timeframe, F.sum(value).alias("total")).filter(F.col("total") > more_than)


def count_under(events: DataFrame, keys: list[str], ts: str, timeframe: str, less_than: int) -> DataFrame:
    """Keys and windows seen, but fewer than so many times."""
    return windowed(events, keys, ts, timeframe, F.count(F.lit(1)).alias("n")).filter(F.col("n") < less_than)


def count_total(events: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """A count test without a timeframe: over the whole table."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def trailing_count_over(events: DataFrame, keys: list[str], order: str, span: int, more_than: int) -> DataFrame:
    """Events that are the last of more than so many within ``span``, with the count as ``n``."""
    counted = trailing_total(events, keys, order, span, {"n": F.lit(1).cast("long")}, HOUR)
    return counted.filter(F.col("n") > more_than)


def trailing_distinct_over(
    events: DataFrame, keys: list[str], order: str, span: int, value: str, more_than: int
) -> DataFrame:
    """Keys and times with more than so many distinct values within the ``span`` before.

    A value counts from one occurrence until its next, or until it is ``span`` old.
    """
    seen = events.select(*keys, value, order).distinct()
    again = nearest(seen, [*keys, value], order, {"_again": (F.lit(True), {})}, HOUR)
    counted = trailing_total(
        again, keys, order, span, {"n": F.lit(1).cast("long")}, HOUR, F.col("_again.at")
    )
    return counted.groupBy(*keys, order).agg(F.max("n").alias("n")).filter(F.col("n") > more_than)


# ---------------------------------------------------------------- proximity


def near(
    events: DataFrame,
    keys: list[str],
    order: str,
    span: int,
    anchor: Column,
    required: dict[str, Column],
    excluded: dict[str, Column] | None = None,
) -> DataFrame:
    """Anchor events with every required selection, and no excluded one, within ``span`` on either side.

    The nearest event of each selection decides, so pairs are never formed.
    """
    excluded = excluded or {}
    tests = {**required, **excluded}
    frame = events.withColumn("_anchor", two_valued(anchor))
    frame = frame.filter(F.col("_anchor") | reduce(lambda a, b: a | b, [two_valued(t) for t in tests.values()]))
    width = HOUR
    after = {f"_after_{n}": (two_valued(t), {}) for n, t in tests.items()}
    before = {f"_before_{n}": (two_valued(t), {}) for n, t in tests.items()}
    frame = nearest(frame, keys, order, after, width, later=True, same=True)
    frame = nearest(frame, keys, order, before, width, later=False, same=True)

    def close(name: str) -> Column:
        later = F.col(f"_after_{name}.at") - F.col(order) <= span
        earlier = F.col(order) - F.col(f"_before_{name}.at") <= span
        return two_valued(later) | two_valued(earlier)

    kept = frame.filter(
        F.col("_anchor") & all_of([close(n) for n in required] + [~close(n) for n in excluded])
    )
    return kept.drop("_anchor", *after, *before)


def tagged_union(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Selections from different log sources as one table with a ``selection`` column."""
    frames = [df.select(*columns, F.lit(name).alias("selection")) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---------------------------------------------------------------- sequences


@dataclass(frozen=True)
class Stage:
    """A step of a sequence: its test and the column that holds the shared key."""

    name: str
    test: Column
    key: str


def sequence(
    events: DataFrame,
    stages: list[Stage],
    order: str,
    event_id: str,
    span: int | None = None,
    until: Column | None = None,
    width: int = HOUR,
) -> DataFrame:
    """Ordered stages with a shared key: the earliest completion for every first event.

    Each stage may keep the key in a column of its own. ``span`` bounds the time
    from the first to the last event; ``until`` ends a sequence whose key sees
    such an event before the last stage. Worked out from the last stage
    backwards: every event learns the nearest next stage, which already carries
    the rest, so no pairs are formed.
    """
    rows = []
    for stage in stages:
        picked = events.filter(two_valued(stage.test))
        rows.append(_marked(picked, stage.key, order, event_id, stage.name))
    if until is not None:
        rows.append(_marked(events.filter(two_valued(until)), stages[0].key, order, event_id, "_until"))
    frame = reduce(lambda a, b: a.unionByName(b), rows).filter(F.col("key").isNotNull())
    is_stage = lambda name: F.col("stage") == name

    carried: dict[str, Column] = {}
    for index in range(len(stages) - 1, 0, -1):
        test = is_stage(stages[index].name)
        payload = {"id": F.col("id"), **carried}
        # a stage leads on only when the later stages were found
        complete = F.col("_next.at").isNotNull() if "_next" in frame.columns else F.lit(True)
        looked = nearest(frame, ["key"], "at", {"_found": (test & complete, payload)}, width)
        frame = looked.drop("_next").withColumnRenamed("_found", "_next")
        later = stages[index + 1 :]
        carried = {f"{stages[index].name}_at": F.col("_next.at"), f"{stages[index].name}_id": F.col("_next.id")}
        for stage in later:
            carried[f"{stage.name}_at"] = F.col(f"_next.{stage.name}_at")
            carried[f"{stage.name}_id"] = F.col(f"_next.{stage.name}_id")
    last = carried[f"{stages[-1].name}_at"]
    if until is not None:
        frame = nearest(frame, ["key"], "at", {"_end": (is_stage("_until"), {})}, width)
    found = frame.filter(is_stage(stages[0].name) & F.col("_next.at").isNotNull())
    if span is not None:
        found = found.filter(last - F.col("at") <= span)
    if until is not None:
        found = found.filter(F.col("_end.at").isNull() | (F.col("_end.at") >= last))
    first = stages[0].name
    return found.select(
        "key",
        F.col("id").alias(f"{first}_id"),
        F.col("at").alias(f"{first}_at"),
        *[column.alias(name) for name, column in carried.items()],
    )


def _marked(rows: DataFrame, key: str, order: str, event_id: str, stage: str) -> DataFrame:
    return rows.select(
        F.col(key).alias("key"), F.col(order).alias("at"), F.col(event_id).alias("id"), F.lit(stage).alias("stage")
    )


def sequence_bind(
    events: DataFrame,
    first: Column,
    second: Column,
    keys: list[str],
    binding: dict[str, tuple[Column, Column]],
    order: str,
    event_id: str,
    span: int,
    width: int = HOUR,
) -> DataFrame:
    """Two stages where the second refers to fields of the first.

    ``binding`` gives, per name, the value in the first event and the value the
    second must have: bound values become part of the key, so the search stays
    an equality on (key, value) in slices.
    """
    names = list(binding)
    one = events.filter(two_valued(first)).select(
        *keys, F.col(order).alias("at"), F.col(event_id).alias("id"), F.lit("first").alias("stage"),
        *[binding[n][0].alias(n) for n in names],
    )
    two = events.filter(two_valued(second)).select(
        *keys, F.col(order).alias("at"), F.col(event_id).alias("id"), F.lit("second").alias("stage"),
        *[binding[n][1].alias(n) for n in names],
    )
    both = one.unionByName(two)
    found = nearest(both, [*keys, *names], "at", {"_next": (F.col("stage") == "second", {"id": F.col("id")})}, width)
    hits = found.filter((F.col("stage") == "first") & (F.col("_next.at") - F.col("at") <= span))
    return hits.select(
        *keys, *names, F.col("id").alias("first_id"), F.col("at").alias("first_at"),
        F.col("_next.id").alias("second_id"), F.col("_next.at").alias("second_at"),
    )

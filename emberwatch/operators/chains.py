"""Correlation chains: runs of related events with at least one detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.detection import hits_of_rows
from emberwatch.operators.rules import Rule
from emberwatch.operators.skew import once
from emberwatch.operators.timeline import sessions
from emberwatch.operators.triage import LEVEL_WEIGHT

#: Order of the levels.
LEVEL_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def _lookup(level: Column, table: dict[str, int]) -> Column:
    value = F.lit(table["low"])
    for name, number in table.items():
        value = F.when(level == name, F.lit(number)).otherwise(value)
    return value


def per_event(matches: DataFrame, key: str) -> DataFrame:
    """Number, weight and highest level of the matches of each event."""
    level = F.coalesce("level", F.lit("low"))
    return matches.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.sum(_lookup(level, LEVEL_WEIGHT)).alias("weight"),
        F.max(_lookup(level, LEVEL_RANK)).alias("rank"),
    )


def detected_events(events: DataFrame, rules: list[Rule], keep: list[str], **options) -> DataFrame:
    """Every event with number, weight and highest level of its matches, from the detecting scan itself."""
    frame, found = hits_of_rows(events, rules, keep, **options)
    of_level = {name: [r.rule_id for r in rules if (r.level or "low") == name] for name in LEVEL_RANK}

    def number(hit: Column, table: dict[str, int]) -> Column:
        value = F.lit(table["low"])
        for name, ids in of_level.items():
            value = F.when(hit["rule_id"].isin(ids), F.lit(table[name])).otherwise(value) if ids else value
        return value

    rows = once(frame.select(*keep, found.alias("_found")), F.col("_found"), "_hits")
    weight = F.aggregate(F.transform("_hits", lambda h: number(h, LEVEL_WEIGHT)), F.lit(0), lambda a, x: a + x)
    rank = F.coalesce(F.array_max(F.transform("_hits", lambda h: number(h, LEVEL_RANK))), F.lit(0))
    counts = {"n_matches": F.size("_hits").cast("long"), "weight": weight.cast("long"), "rank": rank}
    return rows.select(*keep, *(c.alias(n) for n, c in counts.items()))


def chain_events(
    events: DataFrame, matches: DataFrame, keys: list[str], order: str, event_id: str, gap: int
) -> DataFrame:
    """Every event with its session start and the weight of its matches.

    ``sessions`` cuts hot hosts into time slices; the list of a chain's events
    is this table, so it is never gathered into one row.
    """
    weighted = events.join(per_event(matches, event_id), event_id, "left").fillna(0, ["n_matches", "weight", "rank"])
    return sessions(weighted, keys, order, gap)


def chains(members: DataFrame, keys: list[str], order: str, event_id: str) -> DataFrame:
    """Sessions of two or more events with a match: length, score, severity and summary."""
    grouped = members.groupBy(*keys, "session_start").agg(
        F.count(F.lit(1)).alias("length"),
        F.min(event_id).alias("first_event"),
        F.max(order).alias("session_end"),
        F.sum("n_matches").alias("n_matches"),
        F.sum("weight").alias("score"),
        F.max("rank").alias("_rank"),
    )
    kept = grouped.filter((F.col("length") >= 2) & (F.col("n_matches") >= 1))
    severity = F.element_at(F.array(*[F.lit(n) for n in LEVEL_RANK]), F.col("_rank").cast("int"))
    summary = F.format_string("%d events, %d matches", "length", "n_matches")
    return kept.withColumns({"severity": severity, "summary": summary}).drop("_rank")


def chain_members(members: DataFrame, kept: DataFrame, keys: list[str], event_id: str) -> DataFrame:
    """Event ids of the chains, one row each."""
    return members.join(kept.select(*keys, "session_start"), [*keys, "session_start"], "left_semi").select(
        *keys, "session_start", event_id
    )


def analytics(kept: DataFrame) -> DataFrame:
    """Totals over all chains."""
    return kept.agg(
        F.count(F.lit(1)).alias("total_chains"),
        F.round(F.avg("length"), 6).alias("avg_length"),
        F.coalesce(F.max("score"), F.lit(0)).alias("max_score"),
    )


def top_processes(members: DataFrame, kept: DataFrame, keys: list[str], process: str, limit: int = 5) -> DataFrame:
    """Programs most often seen in chains."""
    inside = members.join(kept.select(*keys, "session_start"), [*keys, "session_start"], "left_semi")
    counted = inside.groupBy(process).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), process).limit(limit)

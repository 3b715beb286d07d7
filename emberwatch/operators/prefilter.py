"""Cheap reject of (event, rule) pairs before the full predicates.

A pair is a candidate when the rule has no filters, when the event has none of
the filters' fields, or when any filter value hits. Rule sets repeat the same
few filters, so every distinct filter is tested once per event; events with the
same outcome are then counted together, and rules meet outcomes, not events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.fields import extract_field
from emberwatch.operators.predicates import any_of
from emberwatch.operators.skew import spread


@dataclass(frozen=True)
class QuickFilter:
    field: str
    kind: str
    values: tuple[str, ...]

    def test(self, lowered: Column) -> Column:
        values = [v.lower() for v in self.values]
        if self.kind == "equals":
            return lowered.isin(values)
        return any_of([getattr(lowered, self.kind)(v) for v in values])


@dataclass(frozen=True)
class PrefilterRule:
    rule_id: str
    filters: tuple[QuickFilter, ...]


def _outcomes(events: DataFrame, rules: list[PrefilterRule], keep: list[str]) -> tuple[DataFrame, dict, dict]:
    """Events with ``present``, a bit per field, and ``hit``, a bit per distinct filter."""
    filters = sorted({f for r in rules for f in r.filters}, key=lambda f: (f.field, f.kind, f.values))
    fields = sorted({f.field for f in filters})
    column_of = {name: f"_v{i}" for i, name in enumerate(fields)}
    values = events.select(*keep, *[F.lower(extract_field(n)).alias(column_of[n]) for n in fields])
    present = F.array(*[F.col(column_of[n]) != "" for n in fields])
    hit = F.array(*[(F.col(column_of[f.field]) != "") & f.test(F.col(column_of[f.field])) for f in filters])
    flags = lambda bits: F.array_join(F.transform(bits, lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0"))), "")
    frame = values.select(*keep, flags(present).alias("present"), flags(hit).alias("hit"))
    return frame, {n: i for i, n in enumerate(fields)}, {f: i for i, f in enumerate(filters)}


def _classes(rules: list[PrefilterRule], field_at: dict, filter_at: dict) -> dict[str, tuple[list[int], list[int], list[str]]]:
    """Rules with the same filters, grouped: name -> (field bits, filter bits, rule ids)."""
    groups: dict[frozenset, list[str]] = {}
    for rule in rules:
        groups.setdefault(frozenset(rule.filters), []).append(rule.rule_id)
    return {
        f"class{i}": (
            sorted({field_at[f.field] for f in filters}),
            sorted({filter_at[f] for f in filters}),
            ids,
        )
        for i, (filters, ids) in enumerate(groups.items())
    }


def _candidates(classes: dict) -> Column:
    """The classes whose rules an event with this outcome may match, picked inside the row."""
    on = lambda bits: lambda i: F.substr(F.col(bits), i + 1, F.lit(1)) == "1"
    packed = F.array(*[_class_literal(name, fields, filters) for name, (fields, filters, _) in classes.items()])
    return F.filter(
        packed,
        lambda c: (F.size(c["filters"]) == 0) | ~F.exists(c["fields"], on("present")) | F.exists(c["filters"], on("hit")),
    )


def _members(events: DataFrame, classes: dict) -> DataFrame:
    rows = [(name, ids) for name, (_, _, ids) in classes.items()]
    return events.sparkSession.createDataFrame(rows, "class string, rule_ids array<string>")


def prefilter_counts(events: DataFrame, rules: list[PrefilterRule]) -> DataFrame:
    """Comparisons, candidates and quick rejects per rule.

    Events shrink to one row per distinct outcome before rules are looked at:
    the first shuffle carries outcomes, and hot outcomes are summed map-side.
    An outcome is then spread over its candidate classes only.
    """
    frame, field_at, filter_at = _outcomes(events, rules, [])
    outcomes = frame.groupBy("present", "hit").agg(F.count(F.lit(1)).alias("n"))
    classes = _classes(rules, field_at, filter_at)
    own = spread(outcomes, ["n"], F.transform(_candidates(classes), lambda c: c["class"]), "class")
    counted = own.groupBy("class").agg(F.sum("n").alias("candidates"))
    total = events.agg(F.count(F.lit(1)).alias("comparisons")).scalar()
    members = _members(events, classes).select("class", F.explode("rule_ids").alias("rule_id"))
    joined = members.join(counted, "class", "left").withColumn("comparisons", total)
    candidates = F.coalesce("candidates", F.lit(0))
    return joined.select("rule_id", "comparisons", candidates.alias("candidates"), (F.col("comparisons") - candidates).alias("rejects"))


def _class_literal(name: str, fields: list[int], filters: list[int]) -> Column:
    numbers = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    return F.struct(F.lit(name).alias("class"), numbers(fields).alias("fields"), numbers(filters).alias("filters"))


def prefilter_candidates(events: DataFrame, rules: list[PrefilterRule], key: str) -> DataFrame:
    """The candidate pairs themselves, as (key, rule class) with the class's rules at hand.

    Returns (key, class, rule_ids): the pairs of all rules of a class stay one row.
    """
    frame, field_at, filter_at = _outcomes(events, rules, [key])
    classes = _classes(rules, field_at, filter_at)
    pairs = spread(frame, [key], F.transform(_candidates(classes), lambda c: c["class"]), "class")
    return pairs.join(_members(events, classes), "class")


def prefilter_totals(counts: DataFrame) -> DataFrame:
    """The three totals over all rules."""
    return counts.agg(
        F.sum("comparisons").alias("comparisons"),
        F.sum("candidates").alias("candidates"),
        F.sum("rejects").alias("rejects"),
    )

"""Sequences whose later events speak of the first one: text that starts with, contains or equals one of its fields.

The first events' distinct values are filed under an expression of theirs: a prefix of power-of-two length, or one
gram. Each distinct later text makes the same expressions, equal ones are joined, and the whole value is confirmed.
Later events get their text's values, joined by salts as a text may be hot, and keep those that a first event of their
key has in reach. So they meet distinct values, never first events, and are not copied for every gram; the value then
becomes part of the key, and the nearest later event is looked up in slices as for other sequences. What a stage
reads twice is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.grams import GRAM
from emberwatch.operators.predicates import two_valued
from emberwatch.operators.skew import SALTS
from emberwatch.operators.timeline import HOUR, nearest
from emberwatch.session import written

#: Longest prefix that is filed; a longer value is filed under its first so many characters.
LONGEST = 4096


@dataclass(frozen=True)
class BoundStage:
    """A later event: its test, its text, and the field of the first event that the text must have (``how``)."""

    name: str
    test: Column
    text: Column
    value: Column
    how: str = "startswith"
    ignore_case: bool = False


def _lengths() -> list[int]:
    return [1 << i for i in range(LONGEST.bit_length())]


def _grams(text: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.array_distinct(every)


def _expression(value: Column, how: str) -> Column:
    """What a value is filed under; "" for values shorter than a gram."""
    if how == "equals":
        return value
    if how == "startswith":
        length = F.array_max(F.filter(F.array(*(F.lit(n) for n in _lengths())), lambda n: n <= F.char_length(value)))
        return F.left(value, length)
    # of all its grams the one with the least hash: the text that has the value has it too
    least = F.array_min(F.transform(_grams(value), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    return F.coalesce(least["g"], F.lit(""))


def _expressions(text: Column, how: str) -> Column:
    """Under which expressions values may be filed that the text has."""
    if how == "equals":
        return F.array(text)
    if how == "startswith":
        fitting = F.filter(F.array(*(F.lit(n) for n in _lengths())), lambda n: n <= F.char_length(text))
        return F.transform(fitting, lambda n: F.left(text, n))
    return F.concat(F.array(F.lit("")), _grams(text))


def _has(text: Column, value: Column, how: str) -> Column:
    return {"equals": text == value, "startswith": text.startswith(value), "contains": text.contains(value)}[how]


def _pairs(texts: DataFrame, values: DataFrame, how: str) -> DataFrame:
    """(text, value) for every distinct value that a distinct text has.

    Texts are exploded by their hash alone and are fetched again to confirm, so texts that share a hash do no harm.
    """
    of = F.xxhash64("text").alias("_of")
    filed = values.select("value", _expression(F.col("value"), how).alias("_expression"))
    asked = texts.select(of, F.explode(_expressions(F.col("text"), how)).alias("_expression"))
    # the planner takes an exploded table for as small as its source, and so for one to broadcast
    near = asked.hint("merge").join(filed, "_expression").select("_of", "value").distinct()
    met = texts.select("text", of).join(near, "_of")
    return met.filter(_has(F.col("text"), F.col("value"), how)).select("text", "value")


def _with_values(later: DataFrame, firsts: DataFrame, keys: list[str], stage: BoundStage, span: int) -> DataFrame:
    """Later events (keys, at, id, text) with each value of a first event of up to ``span`` before that their text has."""
    slice_of = lambda at: F.floor(at / F.lit(span + 1)).cast("long")
    # an event looks into its own slice only: values are filed under the next one too
    slices = F.explode(F.array(slice_of(F.col("at")), slice_of(F.col("at")) + 1)).alias("_slice")
    values = firsts.select(*keys, "value", slices).distinct()
    rows = later.select(*keys, "at", "id", "text", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_salt"))
    salted = rows.select("text", "_salt").distinct()
    pairs = _pairs(salted.select("text").distinct(), firsts.select("value").distinct(), stage.how)
    met = rows.hint("merge").join(salted.join(pairs, "text"), ["text", "_salt"]).withColumn("_slice", slice_of(F.col("at")))
    return met.join(values, [*keys, "_slice", "value"]).select(*keys, "value", "at", "id")


def sequence_bound(
    events: DataFrame, first: Column, stages: list[BoundStage], keys: list[str], order: str, event_id: str, span: int, width: int = HOUR
) -> DataFrame:
    """For every first event the earliest later ones, stage after stage, that share its keys and have its values.

    All stages refer to the first event; each must come after the one before, and the last at most ``span`` after
    the first. Events with a null key, and first events with a null or empty value, make no sequence.
    """
    fold = lambda column, stage: F.lower(column) if stage.ignore_case else column
    values = [fold(s.value, s).alias(f"_value{i}") for i, s in enumerate(stages)]
    chains = events.filter(two_valued(first)).select(*keys, F.col(order).alias("first_at"), F.col(event_id).alias("first_id"), *values)
    filled = [F.col(c).isNotNull() for c in keys] + [F.coalesce(F.col(f"_value{i}"), F.lit("")) != "" for i in range(len(stages))]
    chains = chains.filter(reduce(lambda a, b: a & b, filled)).withColumn("_at", F.col("first_at"))
    for i, stage in enumerate(stages):
        later = events.filter(two_valued(stage.test)).select(
            *keys, F.col(order).alias("at"), F.col(event_id).alias("id"), fold(stage.text, stage).alias("text")
        )
        later = later.filter(F.col("text").isNotNull())
        found = _with_values(later, chains.select(*keys, F.col("first_at").alias("at"), F.col(f"_value{i}").alias("value")), keys, stage, span)
        carried = [c for c in chains.columns if c not in keys]
        open_chains = chains.select(*keys, F.col(f"_value{i}").alias("value"), F.col("_at").alias("at"), F.struct(*carried).alias("chain"))
        # the look-up reads both twice, and the next stage its chains: each is worked out once, so plans do not double
        both = written(open_chains.unionByName(found, allowMissingColumns=True), "bound")
        looked = nearest(both, [*keys, "value"], "at", {"_next": (F.col("chain").isNull(), {"id": F.col("id")})}, width)
        ended = looked.filter(F.col("chain").isNotNull() & (F.col("_next.at") - F.col("chain.first_at") <= span))
        chains = ended.select(
            *keys, *(F.col(f"chain.{c}").alias(c) for c in carried if c != "_at"), F.col("_next.at").alias("_at"),
            F.col("_next.id").alias(f"{stage.name}_id"), F.col("_next.at").alias(f"{stage.name}_at"),
        )
        chains = written(chains, "bound") if i + 1 < len(stages) else chains
    return chains.drop("_at", *(f"_value{i}" for i in range(len(stages))))

"""String helpers as Columns."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_as_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[empty_as_null(c) for c in columns])


def basename(column: Column) -> Column:
    """Last part of a Windows path."""
    return F.substring_index(column, "\\", -1)


def cut(column: Column, limit: int) -> Column:
    """Keep ``limit`` characters and mark longer values with dots."""
    return F.when(F.length(column) > limit, F.concat(F.left(column, F.lit(limit)), F.lit("..."))).otherwise(column)


def quote_regex(text: str) -> str:
    """A literal for Java regular expressions."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def like_pattern(text: str) -> str:
    """A literal for LIKE with the backslash as its escape character."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def regex_whole(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The whole value matches the pattern."""
    flag = "(?i)" if ignore_case else ""
    return column.rlike(f"{flag}^(?:{pattern})$")


def base64_literal(text: bytes) -> str:
    return base64.b64encode(text).decode("ascii")


def base64_offset_literals(text: bytes) -> list[str]:
    """The three base64 forms ``text`` can take inside a longer encoded value."""
    head = {0: 0, 1: 2, 2: 3}
    tail = {0: 0, 1: 3, 2: 2}
    forms = []
    for offset in range(3):
        encoded = base64.b64encode(b" " * offset + text).decode("ascii")
        end = len(encoded) - tail[(len(text) + offset) % 3]
        forms.append(encoded[head[offset] : end])
    return forms


def occurrences(column: Column, pattern: str) -> Column:
    """Non-overlapping regex hits as array<struct<start, text>> (start is 0-based).

    The pieces between the hits come from ``split``; their lengths and those
    of the hits, summed from the left, give every start.
    """
    hits = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(column, pattern, -1), lambda piece: F.length(piece))
    steps = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("text")))
    steps = F.filter(steps, lambda step: step["text"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("found"))
    folded = F.aggregate(
        steps,
        start,
        lambda acc, step: F.struct(
            (acc["at"] + step["gap"] + F.length(step["text"])).alias("at"),
            F.concat(
                acc["found"],
                F.array(F.struct((acc["at"] + step["gap"]).alias("start"), step["text"].alias("text"))),
            ).alias("found"),
        ),
    )
    return folded["found"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row: a lambda's variable is a value, a plain Column a formula."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_wins_map(keys: Column, values: Column) -> Column:
    """A map of two arrays where a repeated key keeps its first place and its last value.

    Both arrays are worked out once, not anew for each key.
    """

    def parts(both: Column) -> Column:
        k = both["k"]
        return F.struct(F.array_distinct(k).alias("unique"), F.reverse(k).alias("backwards"), F.size(k).alias("n"), both["v"].alias("v"))

    def last(p: Column, key: Column) -> Column:
        return F.get(p["v"], p["n"] - F.array_position(p["backwards"], key).cast("int"))

    def made(p: Column) -> Column:
        return F.map_from_arrays(p["unique"], F.transform(p["unique"], lambda key: last(p, key)))

    return let(F.struct(keys.alias("k"), values.alias("v")), lambda both: let(parts(both), made))


def stripped(column: Column) -> Column:
    """Without white space, tabs included, on either side."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def leading_int(column: Column) -> Column:
    """The whole number a text starts with, NULL if it starts with none."""
    return empty_as_null(F.regexp_extract(column, r"^\s*([+-]?\d+)", 1)).try_cast("long")

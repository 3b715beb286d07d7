"""Many literals in one pass: every literal gives one gram of four characters, and a text's grams meet these in the row.

The known grams are a hash set in the plan, so a text costs one look-up per place, however many literals there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 4


def grams(literal: str) -> list[str]:
    return [literal[i : i + GRAM] for i in range(len(literal) - GRAM + 1)]


def rarest(literal: str, common: Counter[str]) -> str | None:
    """The literal's gram with the lowest count; None for a literal without one."""
    return min(grams(literal), key=lambda g: (common[g], g), default=None)


def found_grams(text: Column, known: Iterable[str]) -> Column:
    """The known grams that the text has, each once. One scan of the text, at every place."""
    known = sorted(set(known))
    if not known:
        return F.array().cast("array<string>")
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.coalesce(F.array_distinct(F.filter(every, lambda g: g.isin(known))), F.array().cast("array<string>"))

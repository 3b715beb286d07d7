"""Indicators of compromise: extraction, counting, pivots and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.skew import spread

_H = "[A-Fa-f0-9]{1,4}"
#: All eight groups, or a double colon behind one group and more.
_IPV6 = "|".join([rf"(?:{_H}:){{7}}{_H}\b"] + [rf"(?:{_H}:){{{n}}}(?::{_H}){{1,{7 - n}}}\b" for n in range(6, 0, -1)] + [rf"(?:{_H}:){{1,7}}:"])

#: One pattern per indicator type, in the subset that regex engines agree on.
PATTERNS = {
    "ip": r"\b(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\b",
    "ipv6": rf"\b(?:{_IPV6})",
    "domain": r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b",
    "url": r"https?://[^\s\"'<>]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "filepath": r"[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n\s]+\\)*[^\\/:*?\"<>|\r\n\s]+",
    "registry": r"\b(?:HKLM|HKCU|HKCR|HKU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER)\\[^\s\"'<>|]+",
    "hash": r"\b(?:[A-Fa-f0-9]{64}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{32})\b",
    "base64": r"\b[A-Za-z0-9+/]{40,}={0,2}",
}

#: A cheap test that must hold before a pattern is worth running.
GATES = {
    "ip": ".",
    "ipv6": ":",
    "domain": ".",
    "url": "://",
    "email": "@",
    "filepath": ":\\",
    "registry": "\\",
    "hash": None,
    "base64": None,
}


def _hits(text: Column, name: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0))
    if GATES[name]:
        hits = F.when(text.contains(GATES[name]), hits).otherwise(F.array().cast("array<string>"))
    return F.transform(hits, lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))


def extract(rows: DataFrame, text: str, keep: list[str], types: list[str] | None = None) -> DataFrame:
    """(keep.., type, value), one row per occurrence in the whole text."""
    found = [_hits(F.col(text), name) for name in types or list(PATTERNS)]
    every = F.concat(*found) if len(found) > 1 else found[0]
    return spread(rows, keep, every, "_found").select(*keep, "_found.*")


def extract_events(events: DataFrame, key: str, types: list[str] | None = None) -> DataFrame:
    """Indicators of every text field and event data value: (key, field, type, value)."""
    from emberwatch.operators.search import searched_fields

    names = [n for n in ("rawLine", "message", "ip", "processName", "processCmd", "path") if n in events.columns]
    return extract(searched_fields(events, key, names), "text", [key, "field"], types)


def counts(found: DataFrame, key: str) -> DataFrame:
    """Occurrences and distinct events per indicator.

    Grouped by event first, so a frequent indicator is counted by many tasks.
    """
    per_event = found.groupBy("type", "value", key).agg(F.count(F.lit(1)).alias("n"))
    return per_event.groupBy("type", "value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_events"))


def pivot(found: DataFrame, events: DataFrame, key: str, type_: str, value: str) -> DataFrame:
    """All events that hold an indicator."""
    hits = found.filter((F.col("type") == type_) & (F.col("value") == value)).select(key).distinct()
    return events.join(hits, key, "left_semi")


def normalised(type_: Column, value: Column) -> Column:
    """How indicator values are compared: trimmed, and lower-cased unless base64."""
    return F.when(type_ == "base64", F.trim(value)).otherwise(F.lower(F.trim(value)))

"""Which events a rule's log source lets it see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.operators.predicates import all_of, any_of, two_valued
from emberwatch.operators.rules import CATEGORY_EVENTS, SERVICE_SOURCES


def unknown_source(logsource: dict) -> str | None:
    """Why a Windows log source cannot be routed; such a rule sees no event."""
    if logsource.get("product", "windows") != "windows":
        return None
    for kind, known in (("category", CATEGORY_EVENTS), ("service", SERVICE_SOURCES)):
        name = logsource.get(kind)
        if name and name not in known and (logsource.get("product") or kind == "category"):
            return f"unknown {kind}: {name}"
    return None


def route_test(logsource: dict) -> Column:
    """Which events a log source lets a rule see."""
    if unknown_source(logsource):
        return F.lit(False)
    tests = []
    category, service = logsource.get("category"), logsource.get("service")
    if category in CATEGORY_EVENTS:
        pairs = CATEGORY_EVENTS[category]
        tests.append(any_of([(F.col("eventId") == e) & F.col("source").contains(s) for s, e in pairs]))
    if service in SERVICE_SOURCES and logsource.get("product", "windows") == "windows":
        tests.append(F.col("source").contains(SERVICE_SOURCES[service]))
    if logsource.get("product"):
        tests.append(F.col("platform") == logsource["product"])
    return two_valued(all_of(tests)) if tests else F.lit(True)

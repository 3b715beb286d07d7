"""Field lookup on the event schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.text import empty_as_null, first_filled, quote_regex

#: Rule field names that stand for an event column.
ALIASES = {
    "message": ["message"],
    "hostname": ["host", "computer"],
    "host": ["host", "computer"],
    "processname": ["processName"],
    "processcmd": ["processCmd"],
    "commandline": ["processCmd"],
}

#: Event columns that rules may name directly.
DIRECT = {"eventid": "eventId", "channel": "source", "provider_name": "source", "computer": "computer", "user": "user"}


def map_value(data: Column, name: str) -> Column:
    """Value of a map key: the exact key first, then the first key equal but for case."""
    wanted = name.lower()
    loose = F.map_values(F.map_filter(data, lambda k, v: F.lower(k) == wanted))
    return F.coalesce(empty_as_null(F.element_at(data, name)), F.get(loose, F.lit(0)))


def raw_data_value(raw: Column, name: str) -> Column:
    """Value of a ``<Data Name="...">`` element in the raw line."""
    pattern = f'(?i)<Data Name="{quote_regex(name)}"[^>]*>([^<]*)</Data>'
    return F.when(raw.contains("<Data Name"), empty_as_null(F.regexp_extract(raw, pattern, 1)))


def extract_field(name: str) -> Column:
    """Text of a field, "" when the event has none (the prefilter's lookup)."""
    columns = ALIASES.get(name.lower())
    own = first_filled(*[F.col(c) for c in columns]) if columns else empty_as_null(map_value(F.col("eventData"), name))
    return F.coalesce(own, raw_data_value(F.col("rawLine"), name), F.lit(""))


def resolve_field(name: str, mapping: dict[str, str] | None = None) -> Column:
    """Text of a field for rule predicates: NULL when absent, "" when present and empty."""
    name = (mapping or {}).get(name, name)
    lowered = name.lower()
    data = F.col("eventData")
    in_map = F.element_at(data, name)
    if lowered in DIRECT:
        return F.coalesce(F.col(DIRECT[lowered]).cast("string"), in_map)
    loose = F.get(F.map_values(F.map_filter(data, lambda k, v: F.lower(k) == lowered)), F.lit(0))
    found = F.coalesce(in_map, loose, raw_data_value(F.col("rawLine"), name))
    if lowered in ALIASES:
        return F.coalesce(first_filled(*[F.col(c) for c in ALIASES[lowered]]), found)
    return found


def path_field(path: str) -> Column:
    """``eventData.X`` or an event column, for user-defined columns."""
    if path.startswith("eventData."):
        return map_value(F.col("eventData"), path.split(".", 1)[1])
    return F.col(path).cast("string")

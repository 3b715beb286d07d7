"""Column projections and comparisons of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.fields import path_field
from emberwatch.functions.text import basename, first_filled

#: Fixed value: what an empty cell shows.
EMPTY = "—"


def _shown(*columns: Column) -> Column:
    return F.coalesce(first_filled(*columns), F.lit(EMPTY))


def display_columns() -> dict[str, Column]:
    """Display name -> value, with the fallbacks of the event table."""
    data = lambda key: F.element_at(F.col("eventData"), key)
    # a number of zero shows as empty, like a missing one
    number = lambda name: _shown(F.when(F.col(name) != 0, F.col(name).cast("string")))
    return {
        "timestamp": F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(EMPTY)),
        "computer": _shown(F.col("computer")),
        "eventId": number("eventId"),
        "source": _shown(F.col("source")),
        "message": _shown(F.col("message")),
        "ip": _shown(F.col("ip")),
        "statusCode": number("statusCode"),
        "method": _shown(F.col("method")),
        "path": _shown(F.col("path")),
        "sourceFile": _shown(F.col("sourceFile")),
        "user": _shown(F.col("user"), data("SubjectUserName")),
        "processName": F.coalesce(basename(first_filled(F.col("processName"), data("Image"))), F.lit(EMPTY)),
        "provider": _shown(F.col("source"), F.col("sourceType")),
    }


def display(events: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    columns = display_columns()
    return events.select(*keep, *[columns[n].alias(n) for n in names])


def custom_column(source: str, pattern: str | None = None, group: int = 1) -> Column:
    """A user-defined column: a field path, or a regex group of one."""
    value = path_field(source)
    return F.regexp_extract(value, pattern, group) if pattern else value


def rename_fields(events: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under the names the user's mapping gives them."""
    return events.withColumnsRenamed(mapping)


def in_file(events: DataFrame, source_file: str | None, column: str = "sourceFile") -> DataFrame:
    """Events of one source file, or all of them."""
    return events.filter(F.col(column) == source_file) if source_file else events


def _dotted(name: str) -> Column:
    entries = F.transform(
        F.map_entries(name),
        lambda e: F.struct(F.concat(F.lit(f"{name}."), e["key"]).alias("key"), e["value"].alias("value")),
    )
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))


def flattened(events: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """Every column of an event as a map of text; event data keys get a dotted name."""
    fields = [f for f in events.schema if f.name not in skip]
    plain = F.array(
        *[
            F.struct(F.lit(f.name).alias("key"), F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias("value"))
            for f in fields
            if f.dataType.typeName() != "map"
        ]
    )
    for f in fields:
        if f.dataType.typeName() == "map":
            plain = F.concat(plain, _dotted(f.name))
    return F.map_from_entries(plain)


def compare(left: DataFrame, right: DataFrame, skip: tuple[str, ...] = (), keys: list[str] | None = None) -> DataFrame:
    """Key by key difference of two events, or of two events per ``keys``."""
    keys = keys or []
    a = left.select(*keys, F.explode(flattened(left, skip)).alias("key", "val_a"))
    b = right.select(*keys, F.explode(flattened(right, skip)).alias("key", "val_b"))
    joined = a.join(b, [*keys, "key"], "full").fillna("", ["val_a", "val_b"])
    return joined.withColumn("same", F.col("val_a") == F.col("val_b"))

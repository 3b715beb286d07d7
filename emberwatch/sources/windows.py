"""Windows events: XML to the event schema, and XML carved out of raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.text import cut, empty_as_null, last_wins_map, leading_int, quote_regex
from emberwatch.operators.skew import first_n, once, spread
from emberwatch.operators.timeline import running_total
from emberwatch.schema import to_event_schema

#: Names of the event levels.
LEVEL_NAMES = {
    "0": "LogAlways",
    "1": "Critical",
    "2": "Error",
    "3": "Warning",
    "4": "Information",
    "5": "Verbose",
}

#: Event data names that hold the client's address.
ADDRESS_NAMES = ["IpAddress", "IPAddress", "SourceAddress", "ClientIP"]

#: Limits of the compact form.
COMPACT_FIELDS = 25
COMPACT_VALUE = 256
COMPACT_MESSAGE = 1024
COMPACT_RAW = 2048

#: Fixed value: the namespace of event XML.
NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"

_EVENT = (
    "System struct<Provider: struct<_Name: string>, EventID: struct<_VALUE: string, _Qualifiers: string>, "
    "Level: string, TimeCreated: struct<_SystemTime: string>, Computer: string>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)

CLOSING_TAG = "</Event>"


def level_name(level: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in LEVEL_NAMES.items() for v in pair])
    return F.coalesce(F.element_at(names, level), level)


def read_event_xml(spark, path: str, pattern: str = "*") -> DataFrame:
    """Event XML files as one row of text per event.

    The closing tag is the line separator, so a large file is split between
    tasks and each event's text stays as it was.
    """
    reader = spark.read.option("lineSep", CLOSING_TAG).option("recursiveFileLookup", True)
    frame = reader.option("pathGlobFilter", pattern).text(path)
    body = F.regexp_extract("value", r"(?s)(<Event[\s>].*)$", 1)
    rows = frame.select(
        body.alias("_body"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ).filter(F.col("_body") != "")
    return rows.select(F.concat("_body", F.lit(CLOSING_TAG)).alias("value"), "source_file", "_block", "_row")


_OPENING = r"<Event[\s>]"


def event_starts(line: Column) -> Column:
    """Events that begin on a line."""
    return F.regexp_count(line, F.lit(_OPENING))


def event_records(lines: DataFrame) -> DataFrame:
    """Lines of XML files (source_file, pos, value) as one row of text per event, however events and lines lie.

    A line is cut where events begin, pieces are numbered by the events begun so far in their file, in slices, and
    the pieces of one event are put together. No file is one group.
    """
    piece = F.posexplode(F.split("value", rf"(?={_OPENING})", -1)).alias("_piece", "_text")
    pieces = lines.select("source_file", "pos", piece).withColumn("_order", F.col("pos").cast("long") * (1 << 31) + F.col("_piece"))
    begins = F.col("_text").rlike(f"^{_OPENING}").cast("long")
    numbered = running_total(pieces, ["source_file"], "_order", {"_number": begins}, (1 << 31) * 4096).filter(F.col("_number") > 0)
    part = F.struct(F.col("_order").alias("at"), F.col("pos").alias("pos"), F.col("_text").alias("text"))
    events = numbered.groupBy("source_file", "_number").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    # pieces of different lines had a line break between them
    broken = lambda i: (i > 0) & (F.get(F.col("_parts"), i - 1)["pos"] != F.get(F.col("_parts"), i)["pos"])
    texts = F.transform("_parts", lambda p, i: F.concat(F.when(broken(i), F.lit("\n")).otherwise(F.lit("")), p["text"]))
    whole = F.regexp_extract(F.array_join(texts, ""), rf"(?s)^(.*?{CLOSING_TAG})", 1)
    return events.select("source_file", whole.alias("value")).filter(F.col("value") != "")


def parse_event_xml(
    rows: DataFrame, keep: list[str] | None = None, compact: bool = False, data_fields: int = COMPACT_FIELDS
) -> DataFrame:
    """``<Event>`` texts in ``value`` to events; rows without a System part are left out."""
    parsed = F.from_xml(F.col("value"), _EVENT, {"ignoreNamespace": "true", "rowTag": "Event", "mode": "PERMISSIVE"})
    frame = once(rows, parsed, "_event").filter(F.col("_event.System").isNotNull())
    data = F.coalesce(F.col("_event.EventData.Data"), F.array().cast("array<struct<_Name:string,_VALUE:string>>"))
    named = F.filter(data, lambda d: F.coalesce(d["_Name"], F.lit("")) != "")
    if compact:
        named = F.slice(named, 1, data_fields)
    frame = frame.withColumn(
        "_data",
        F.transform(named, lambda d: F.struct(d["_Name"].alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v"))),
    )

    def holds_address(d: Column) -> Column:
        result = F.lit(False)
        for name in ADDRESS_NAMES:
            result = result | d["k"].contains(name)
        return result

    values = F.transform("_data", lambda d: cut(d["v"], COMPACT_VALUE) if compact else d["v"])
    names = F.transform("_data", lambda d: d["k"])
    system = lambda path: empty_as_null(F.col(f"_event.System.{path}"))
    frame = frame.withColumns(
        {
            "_map": last_wins_map(names, values),
            "_computer": F.coalesce(system("Computer"), F.lit("Unknown")),
            "_source": F.coalesce(system("Provider._Name"), F.lit("Unknown")),
            "_id": F.coalesce(leading_int(F.col("_event.System.EventID._VALUE")), F.lit(0)),
            "_address": F.try_element_at(F.filter("_data", holds_address), F.lit(-1))["v"],
        }
    )
    filled = F.filter(F.map_entries("_map"), lambda e: e["value"] != "")
    message = F.array_join(F.transform(filled, lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    unknown_host = F.col("_computer") == "Unknown"
    return to_event_schema(
        frame.select(
            *(keep or []),
            F.try_to_timestamp(F.col("_event.System.TimeCreated._SystemTime")).alias("timestamp"),
            F.coalesce("_address", F.when(unknown_host, F.lit("N/A")).otherwise(F.col("_computer"))).alias("ip"),
            F.left("_source", F.lit(20)).alias("method"),
            F.concat(F.lit("Event "), F.col("_id").cast("string")).alias("path"),
            F.col("_id").alias("statusCode"),
            F.lit(0).alias("size"),
            (cut(F.col("value"), COMPACT_RAW) if compact else F.col("value")).alias("rawLine"),
            F.col("_id").alias("eventId"),
            level_name(F.coalesce(system("Level"), F.lit("Information"))).alias("level"),
            F.col("_source").alias("source"),
            F.col("_computer").alias("computer"),
            F.col("_computer").alias("host"),
            (cut(message, COMPACT_MESSAGE) if compact else message).alias("message"),
            F.when(F.size("_map") > 0, F.col("_map")).alias("eventData"),
            (F.col("source_file") if "source_file" in rows.columns else F.lit(None)).cast("string").alias("sourceFile"),
            F.lit("windows").alias("platform"),
            F.lit("evtx-xml").alias("sourceType"),
        ),
        keep,
    )


def first_events(rows: DataFrame, n: int, file: str = "source_file", order: list[Column] | None = None) -> DataFrame:
    """The first ``n`` events of each file, taken before anything is parsed."""
    order = order or [F.col("_block"), F.col("_row")]
    return first_n(rows, [file], order, n, F.struct(*order))


@F.pandas_udf(T.ArrayType(T.StringType()))
def decoded(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as UTF-16LE and as UTF-8 text; what is not valid becomes a replacement mark."""
    for batch in contents:
        yield batch.map(lambda b: [b.decode("utf-16-le", "replace"), b.decode("utf-8", "replace")])


def carve(texts: DataFrame, text: str, tag: str, must_hold: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Distinct ``<tag ...>...</tag>`` fragments of whole texts, without control characters."""
    pattern = f"(?is)<{quote_regex(tag)}(?:\\s[^>]*)?>.*?</{quote_regex(tag)}>"
    found = spread(texts, keep or [], F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), "fragment")
    clean = F.trim(F.regexp_replace("fragment", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    rows = found.withColumn("fragment", clean)
    if must_hold:
        rows = rows.filter(F.col("fragment").contains(must_hold))
    return rows.distinct()


def carve_events(blobs: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Event XML out of raw bytes; the namespace is added where it is missing."""
    texts = spread(blobs, keep or [], decoded(F.col(content)), "text")
    found = carve(texts, "text", "Event", "<System", keep)
    with_namespace = F.regexp_replace("fragment", "^<Event", f'<Event xmlns="{NAMESPACE}"')
    whole = F.when(F.col("fragment").contains("xmlns="), F.col("fragment")).otherwise(with_namespace)
    return found.select(*(keep or []), whole.alias("value")).distinct()


#: Leading bytes of known containers.
MAGIC = {"456C6646696C6500": "evtx", "504B0304": "zip", "504B0506": "zip", "504B0708": "zip"}


def container_class(content: Column) -> Column:
    """``evtx``, ``zip`` or ``other`` by the leading bytes."""
    result = F.lit("other")
    for prefix, name in MAGIC.items():
        starts = F.substring(content, 1, len(prefix) // 2) == F.unhex(F.lit(prefix))
        result = F.when(starts, F.lit(name)).otherwise(result)
    return result

"""The one event schema that every source is normalised to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ip", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("statusCode", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("rawLine", T.StringType()),
        T.StructField("eventId", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("computer", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("eventData", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sourceFile", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("ppid", T.LongType()),
        T.StructField("processName", T.StringType()),
        T.StructField("processCmd", T.StringType()),
        T.StructField("sourceType", T.StringType()),
        T.StructField("facility", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)

EVENT_COLUMNS = [field.name for field in EVENT_SCHEMA]


def to_event_schema(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Cast the known columns, add the missing ones as NULL, keep ``keep`` besides."""
    columns: list[Column] = [F.col(name) for name in keep or []]
    for field in EVENT_SCHEMA:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def union_events(*frames: DataFrame) -> DataFrame:
    """Concatenate event frames whose columns may differ."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result

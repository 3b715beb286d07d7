"""Writers for matches and rule reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_matches(matches: DataFrame, path: str) -> None:
    """Matches partitioned by level, for readers that look at one severity."""
    matches.write.mode("overwrite").partitionBy("level").parquet(path)


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """A sorted report as CSV with a header, or as JSON lines."""
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)

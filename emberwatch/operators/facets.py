"""Counts, breakdowns and fingerprints of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.skew import first_n


def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value) rows of several columns from one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull())


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count per value of each column."""
    return _stacked(df, columns).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column, as rows."""
    return _stacked(df, columns).distinct()


def distinct_counts(df: DataFrame, columns: list[str], error: float = 0.05) -> DataFrame:
    """Approximate number of distinct values of each column, from sketches of fixed size."""
    return df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in columns])


def counts(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, ts: str, unit: str) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, ts).alias("time")).agg(F.count(F.lit(1)).alias("n"))


def share_per_file(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each source file; nothing when there is only one.

    The total is a scalar subquery over the counts, not a window over one task.
    """
    per_file = df.groupBy(F.coalesce(F.col(column), F.lit("Unknown")).alias("file")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = per_file.agg(F.sum("n")).scalar()
    files = per_file.agg(F.count(F.lit(1))).scalar()
    return (
        per_file.filter(files > 1)
        .withColumn("percentage", F.round(F.col("n") / total * 100, 6))
        .orderBy(F.col("n").desc(), "file")
    )


def file_info(df: DataFrame, column: str, ts: str, event_id: str) -> DataFrame:
    """Records, first and last time, first and last id per file."""
    return df.groupBy(column).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.min(event_id).alias("first_id"),
        F.max(event_id).alias("last_id"),
    )


def top_counts(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Most frequent combinations."""
    return counts(df, *columns).orderBy(F.col("n").desc(), *columns).limit(limit)


def top_per_group(df: DataFrame, group: str, value: str, limit: int) -> DataFrame:
    """Most frequent values of each group with their rank."""
    counted = counts(df, group, value)
    return first_n(counted, [group], [F.col("n").desc(), F.col(value)], limit, F.col(value), "rank")


def set_digest(value: Column) -> Column:
    """Aggregate: a number for a set of distinct values, whatever their order.

    The values are hashed and the hashes summed, so nothing is gathered.
    """
    head = F.conv(F.left(F.sha2(value, 256), F.lit(12)), 16, 10).cast("decimal(20,0)")
    return F.sum(head).cast("decimal(38,0)").cast("string")


def dataset_fingerprint(df: DataFrame, file: str, ts: str, platform: str, format_: str) -> DataFrame:
    """SHA-256 over platform, format, row count, files and first and last time."""
    per_file = df.groupBy(file).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros(ts)).alias("first"), F.max(F.unix_micros(ts)).alias("last")
    )
    parts = per_file.agg(
        F.sum("n").alias("n"), set_digest(F.col(file)).alias("files"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    text = F.concat_ws("|", F.lit(platform), F.lit(format_), "n", "files", "first", "last")
    return parts.select(F.sha2(text, 256).alias("fingerprint"))


def ruleset_fingerprint(rules: DataFrame, kind: str, options: str = "") -> DataFrame:
    """SHA-256 over the kind, the set of rule ids and the options."""
    ids = rules.select("rule_id").distinct().agg(
        F.count(F.lit(1)).alias("n"), set_digest(F.col("rule_id")).alias("ids")
    )
    return ids.select(F.sha2(F.concat_ws("|", F.lit(kind), "n", "ids", F.lit(options)), 256).alias("fingerprint"))

"""Housekeeping over a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.predicates import any_of

#: Order of levels and statuses, lowest first.
LEVEL_ORDER = ["informational", "low", "medium", "high", "critical"]
STATUS_ORDER = ["unsupported", "deprecated", "experimental", "test", "stable"]


def last_change() -> Column:
    return F.coalesce("modified", "date")


def deprecated_summary(rules: DataFrame) -> DataFrame:
    """Deprecated rules by their last change."""
    rows = rules.filter(F.col("status") == "deprecated")
    return rows.select("rule_id", "title", "date", last_change().alias("modified")).orderBy("modified", "rule_id")


def promotion_candidates(rules: DataFrame, as_of: Column, days: int = 300) -> DataFrame:
    """Experimental rules unchanged for at least so many days."""
    age = F.datediff(as_of, last_change())
    return rules.filter((F.col("status") == "experimental") & (age >= days)).withColumn("age", age)


def new_references(rules: DataFrame, archived: DataFrame) -> DataFrame:
    """Web references not archived yet, sorted without case."""
    links = rules.select(F.explode("references").alias("reference")).filter(F.col("reference").startswith("http"))
    return links.distinct().join(archived.select("reference"), "reference", "left_anti").orderBy(F.lower("reference"), "reference")


def _rank(name: str, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.lower(name))


def package(
    rules: DataFrame,
    levels: list[str] | None = None,
    statuses: list[str] | None = None,
    min_level: str | None = None,
    min_status: str | None = None,
) -> DataFrame:
    """Rules of a release: by listed or by lowest level and status."""
    if levels:
        rules = rules.filter(F.col("level").isin(levels))
    if statuses:
        rules = rules.filter(F.col("status").isin(statuses))
    if min_level:
        rules = rules.filter(_rank("level", LEVEL_ORDER) >= LEVEL_ORDER.index(min_level) + 1)
    if min_status:
        rules = rules.filter(_rank("status", STATUS_ORDER) >= STATUS_ORDER.index(min_status) + 1)
    return rules


def select_rules(
    rules: DataFrame,
    levels: list[str] | None = None,
    categories: list[str] | None = None,
    tags: list[str] | None = None,
) -> DataFrame:
    """Rules by criteria; a criterion counts only for rules that have the field."""
    if levels:
        rules = rules.filter(F.col("level").isNull() | F.col("level").isin(levels))
    if categories:
        rules = rules.filter(F.col("category").isNull() | F.col("category").isin(categories))
    if tags:
        wanted = F.exists("tags", lambda t: any_of([t.contains(tag) for tag in tags]))
        rules = rules.filter(F.col("tags").isNull() | wanted)
    return rules


def summary(rules: DataFrame) -> DataFrame:
    """Rules by level and by category in one pass."""
    level = F.coalesce("level", F.lit("medium"))
    category = F.coalesce("category", F.lit("unknown"))
    cells = F.array(
        F.struct(F.lit("level").alias("by"), level.alias("value")),
        F.struct(F.lit("category").alias("by"), category.alias("value")),
    )
    return rules.select(F.inline(cells)).groupBy("by", "value").agg(F.count(F.lit(1)).alias("n"))


def bundle_manifest(rules: DataFrame) -> DataFrame:
    """Rules and bytes per platform and category (the first part of the path)."""
    category = F.substring_index("path", "/", 1).alias("category")
    return rules.groupBy("platform", category).agg(
        F.count(F.lit(1)).alias("rule_count"), F.sum(F.octet_length("content")).alias("size_bytes")
    )


def platform_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("platform").agg(F.sum("rule_count").alias("rules"))


def write_bundles(rules: DataFrame, folder: str) -> None:
    """Rules partitioned by platform and category, so readers prune to what they need."""
    bundled = rules.withColumn("category", F.substring_index("path", "/", 1))
    bundled.write.mode("overwrite").partitionBy("platform", "category").parquet(folder)

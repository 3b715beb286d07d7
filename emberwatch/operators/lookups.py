"""Joins with supplied tables: actors, reputation, caches, bookmarks, review notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.indicators import normalised


def actor_indicators(actors: DataFrame) -> DataFrame:
    """Actors with an ``iocs`` array as unique (actor_id, type, value) rows; an actor may have several rows."""
    rows = actors.select("actor_id", "name", F.explode("iocs").alias("ioc"))
    return rows.select(
        "actor_id", "name", F.col("ioc.type").alias("type"), normalised(F.col("ioc.type"), F.col("ioc.value")).alias("value")
    ).dropDuplicates(["actor_id", "type", "value"])


def actor_matches(found: DataFrame, actors: DataFrame) -> DataFrame:
    """Indicators that an actor of the repository is known for."""
    keyed = found.withColumn("value", normalised(F.col("type"), F.col("value")))
    return keyed.join(actor_indicators(actors), ["type", "value"])


def with_reputation(addresses: DataFrame, reputation: DataFrame, key: str) -> DataFrame:
    """Addresses with score, verdict and detail; unknown ones count as clean.

    ``reputation`` has (key, score, reports, country, isp), any of them NULL.
    """
    joined = addresses.join(reputation, key, "left")
    score = F.coalesce("score", F.lit(0))
    detail = F.format_string(
        "%d%% confidence, %d reports, %s, ISP: %s",
        score,
        F.coalesce("reports", F.lit(0)),
        F.coalesce(F.nullif("country", F.lit("")), F.lit("?")),
        F.coalesce(F.nullif("isp", F.lit("")), F.lit("?")),
    )
    return joined.select(
        *addresses.columns, score.alias("score"), (score > 25).alias("malicious"), detail.alias("detail")
    )


def cache_key(type_: Column, value: Column) -> Column:
    return F.concat_ws(":", type_, value)


def cache_split(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Lookups marked ``cached`` or not; results still loading are not in the cache."""
    done = cache.filter(~F.col("loading")).select("key").distinct().withColumn("_hit", F.lit(True))
    keyed = wanted.withColumn("key", cache_key(F.col("type"), F.col("value")))
    return keyed.join(done, "key", "left").select(
        *keyed.columns, F.coalesce("_hit", F.lit(False)).alias("cached")
    )


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key of both tables.

    An aggregate with a partial step, so a key written very often is reduced
    before the shuffle.
    """
    every = current.unionByName(changes)
    others = [c for c in every.columns if c not in keys]
    latest = every.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in others if c != version])).alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*every.columns)


def remove(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def flag(rows: DataFrame, marks: DataFrame, keys: list[str], name: str = "bookmarked") -> DataFrame:
    """Whether a row's key is in the marks."""
    marked = marks.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_review(rules: DataFrame, notes: DataFrame) -> DataFrame:
    """Rules with their latest review status and note."""
    latest = notes.groupBy("rule_id").agg(F.max(F.struct("updated_at", "status", "note")).alias("_note"))
    joined = rules.join(latest, "rule_id", "left")
    return joined.select(
        *rules.columns,
        F.coalesce("_note.status", F.lit("unreviewed")).alias("review_status"),
        F.coalesce("_note.note", F.lit("")).alias("review_note"),
    )

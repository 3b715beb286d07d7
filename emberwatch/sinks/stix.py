"""Indicators as STIX 2.1 objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identity of this library in the exported objects.
IDENTITY = "identity--emberwatch"


def pattern(type_: Column, value: Column) -> Column:
    """STIX pattern by type, NULL for types that have none; hashes by their length."""
    # a backslash and a quote are escaped in a pattern's text
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    quoted = lambda path: F.concat(F.lit(f"[{path} = '"), text, F.lit("']"))
    hashed = (
        F.when(F.length(value) == 32, quoted("file:hashes.MD5"))
        .when(F.length(value) == 40, quoted("file:hashes.'SHA-1'"))
        .otherwise(quoted("file:hashes.'SHA-256'"))
    )
    return (
        F.when(type_ == "ip", quoted("ipv4-addr:value"))
        .when(type_ == "ipv6", quoted("ipv6-addr:value"))
        .when(type_ == "domain", quoted("domain-name:value"))
        .when(type_ == "url", quoted("url:value"))
        .when(type_ == "hash", hashed)
        .when(type_ == "email", quoted("email-addr:value"))
    )


def indicator_objects(indicators: DataFrame, now: Column, random_ids: bool = True) -> DataFrame:
    """(type, value, n) to one indicator object per row.

    Ids are random, or derived from type and value so that a second export agrees.
    """
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    digest = F.sha2(F.concat_ws(":", "type", "value"), 256)
    stable = F.concat_ws(
        "-", *[F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    rows = indicators.withColumn("pattern", pattern(F.col("type"), F.col("value"))).filter(F.col("pattern").isNotNull())
    return rows.select(
        F.lit("indicator").alias("type"),
        F.lit("2.1").alias("spec_version"),
        F.concat(F.lit("indicator--"), F.uuid() if random_ids else stable).alias("id"),
        stamp.alias("created"),
        stamp.alias("modified"),
        F.concat(F.upper("type"), F.lit(": "), F.col("value")).alias("name"),
        "pattern",
        F.lit("stix").alias("pattern_type"),
        stamp.alias("valid_from"),
        F.array(F.lit("malicious-activity")).alias("indicator_types"),
        F.lit(IDENTITY).alias("created_by_ref"),
        F.array(F.concat(F.lit("ioc-type:"), F.col("type"))).alias("labels"),
        F.least(F.lit(100), F.lit(50) + F.col("n") * 5).cast("int").alias("confidence"),
    )


def identity_object(spark, now: Column) -> DataFrame:
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return spark.range(1).select(
        F.lit("identity").alias("type"),
        F.lit("2.1").alias("spec_version"),
        F.lit(IDENTITY).alias("id"),
        stamp.alias("created"),
        stamp.alias("modified"),
        F.lit("emberwatch").alias("name"),
        F.lit("tool").alias("identity_class"),
    )


def export_stix(indicators: DataFrame, now: Column, path: str) -> None:
    """The objects of a bundle as JSON lines, one file per task."""
    identity = identity_object(indicators.sparkSession, now)
    objects = indicator_objects(indicators, now).unionByName(identity, allowMissingColumns=True)
    objects.write.mode("overwrite").json(path)

"""Triage score: factor points from matches and events, for a data set or per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.text import basename, first_filled
from emberwatch.operators.predicates import any_of, two_valued
from emberwatch.operators.skew import first_n

#: Points per match level; unknown levels count as low.
LEVEL_WEIGHT = {"critical": 25, "high": 12, "medium": 5, "low": 2}

#: Programs that raise the score when they run.
SUSPICIOUS_PROGRAMS = [
    "cmd.exe",
    "powershell.exe",
    "wscript.exe",
    "cscript.exe",
    "mshta.exe",
    "certutil.exe",
    "bitsadmin.exe",
    "rundll32.exe",
    "regsvr32.exe",
]

#: Folders programs seldom run from.
SUSPICIOUS_FOLDERS = [
    "\\temp\\",
    "\\tmp\\",
    "\\appdata\\local\\temp",
    "\\downloads\\",
    "\\public\\",
    "\\users\\public",
    "\\programdata\\",
]

#: Address prefixes that do not count as external.
INTERNAL_PREFIXES = ["127.", "10.", "192.168.", "::1"]

#: Fixed value: tactics and programs named in a detail text; all of them count.
NAMES_SHOWN = 5

#: Lowest score of each label.
LABELS = [(80, "Critical"), (55, "High"), (30, "Medium"), (10, "Low")]


def level_counts(n: Column | None = None) -> dict[str, Column]:
    """Matches per level; a missing or unknown level is low. ``n`` weighs rows that stand for several."""
    level = F.coalesce("level", F.lit("low"))
    total = (lambda test: F.count_if(test)) if n is None else (lambda test: F.sum(F.when(test, n).otherwise(0)))
    named = {name: total(level == name).alias(name) for name in ("critical", "high", "medium")}
    return {**named, "low": total(~level.isin(*named)).alias("low")}


def _grouped(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def _factor(df: DataFrame, by: list[str], name: str, points: Column, detail: Column, holds: Column) -> DataFrame:
    return df.filter(holds).select(
        *by, F.lit(name).alias("factor"), points.cast("long").alias("points"), detail.alias("detail")
    )


def _with_names(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct values of ``name`` as n, and the first ``NAMES_SHOWN`` of them as names.

    The distinct names of a host are few, so they are numbered in one window and counted in one aggregate.
    """
    distinct = rows.select(*by, name).distinct()
    if not by:
        # the lists leave nulls out
        shown = first_n(distinct, by, [F.col(name).asc_nulls_last()], NAMES_SHOWN, F.col(name))
        names = shown.agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))
        return distinct.agg(F.count(name).alias("n")).withColumn("names", names.scalar())
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(name).asc_nulls_last()))
    shown = F.array_sort(F.collect_list(F.when(F.col("_place") <= NAMES_SHOWN, F.col(name))))
    return distinct.withColumn("_place", place).groupBy(*by).agg(F.count(name).alias("n"), F.array_join(shown, ", ").alias("names"))


def match_totals(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Matches per rule: what all match factors are worked out from.

    The factors read the same totals, so the matches are found once and their
    exchange is used again.
    """
    return matches.groupBy(*(by or []), "level", "tags").agg(F.count(F.lit(1)).alias("n"))


def event_totals(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events per suspicious program, folder test and external address, for the event factors."""
    keys = [suspicious_process().alias("process"), in_suspicious_folder().alias("folder"), external_address().alias("address")]
    rows = events.select(*(by or []), *keys)
    return rows.groupBy(*(by or []), "process", "folder", "address").agg(F.count(F.lit(1)).alias("n"))


def detection_points(totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = _grouped(totals, by, *level_counts(F.col("n")).values())
    raw = sum((F.col(n) * w for n, w in LEVEL_WEIGHT.items()), F.lit(0))
    detail = F.format_string("%d critical, %d high, %d medium, %d low", "critical", "high", "medium", "low")
    return _factor(counts, by, "detections", F.least(F.lit(40), raw), detail, raw > 0)


def tactic_breadth(totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct tags that name no technique."""
    by = by or []
    tag = F.regexp_replace(F.lower("tag"), r"^(.*?)attack\.", "$1")
    tags = totals.filter(F.col("n") > 0).select(*by, F.explode("tags").alias("tag")).select(*by, tag.alias("tag"))
    kept = tags.filter(~F.col("tag").startswith("t") & (F.length("tag") > 2))
    counts = _with_names(kept, by, "tag")
    detail = F.format_string("%d distinct tactic(s): %s", "n", "names")
    return _factor(counts, by, "tactics", F.least(F.lit(15), F.col("n") * 3), detail, F.col("n") > 0)


def _image(name: str) -> Column:
    return F.element_at(F.col("eventData"), name)


def suspicious_process() -> Column:
    """File name of the event's program when it is a suspicious one."""
    text = first_filled(_image("Image"), _image("ParentImage"), _image("CommandLine"))
    lowered = F.lower(text)
    name = F.coalesce(F.nullif(basename(text), F.lit("")), text)
    return F.when(any_of([lowered.contains(p) for p in SUSPICIOUS_PROGRAMS]), name)


def in_suspicious_folder() -> Column:
    lowered = F.lower(_image("Image"))
    return two_valued(any_of([lowered.contains(p) for p in SUSPICIOUS_FOLDERS]))


def external_address() -> Column:
    """Destination address of a network event when it is not an internal one."""
    address = F.nullif(_image("DestinationIp"), F.lit(""))
    return F.when(~any_of([address.startswith(p) for p in INTERNAL_PREFIXES]), address)


def suspicious_processes(totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = _with_names(totals.filter(F.col("n") > 0), by, "process")
    detail = F.col("names")
    return _factor(counts, by, "processes", F.least(F.lit(15), F.col("n") * 3), detail, F.col("n") > 0)


def unusual_folders(totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = _grouped(totals, by, F.sum(F.when(F.col("folder"), F.col("n")).otherwise(0)).alias("n"))
    detail = F.format_string("%d execution(s) from unusual folders", "n")
    return _factor(counts, by, "folders", F.least(F.lit(10), F.ceil(F.col("n") / 5)), detail, F.col("n") > 0)


def external_connections(totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = _grouped(totals.filter(F.col("n") > 0), by, F.count_distinct("address").alias("n"))
    detail = F.format_string("%d unique external address(es)", "n")
    return _factor(counts, by, "network", F.least(F.lit(10), F.col("n") * 2), detail, F.col("n") > 0)


def match_volume(totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = _grouped(totals, by, F.sum("n").alias("n"))
    detail = F.format_string("%d total matches", "n")
    points = F.least(F.lit(10), F.floor(F.col("n") / 50) * 2)
    return _factor(counts, by, "volume", points, detail, F.col("n") > 50)


def factors(events: DataFrame, matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All factor rows that score."""
    found, seen = match_totals(matches, by), event_totals(events, by)
    parts = [
        detection_points(found, by),
        tactic_breadth(found, by),
        suspicious_processes(seen, by),
        unusual_folders(seen, by),
        external_connections(seen, by),
        match_volume(found, by),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def score(events: DataFrame, matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score 0-100 and its label, for the whole data set or per ``by``."""
    by = by or []
    total = F.least(F.lit(100), F.coalesce(F.sum("points"), F.lit(0))).cast("long").alias("score")
    scored = _grouped(factors(events, matches, by), by, total)
    label = F.when(F.lit(False), F.lit(""))
    for lowest, name in LABELS:
        label = label.when(F.col("score") >= lowest, F.lit(name))
    return scored.withColumn("label", label.otherwise(F.lit("Informational")))

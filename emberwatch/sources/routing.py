"""Which parser reads which file, and what came of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.text import stripped
from emberwatch.operators.predicates import any_of
from emberwatch.schema import union_events
from emberwatch.session import cut_lineage, scratch_path
from emberwatch.sources import linux, tables, windows

#: File names that hint at a format.
SYSLOG_HINTS = ["syslog", "messages", "auth.log", "secure", "kern.log", "daemon.log"]
JOURNAL_HINTS = ["journal", "journalctl", "jsonl", "ndjson"]

@dataclass(frozen=True)
class LogFormat:
    """A parser plug-in: how a file is recognised, how many rows a line gives, the parser, and what makes records of lines.

    ``records`` turns the lines of all files of the format (source_file, pos, value) into one row per record, so
    a record may span lines; without it each line is one.
    """

    name: str
    platform: str
    recognised: Column | Callable[[], Column]
    yields: Callable[[], Column]
    parse: Callable[..., DataFrame]
    records: Callable[[DataFrame], DataFrame] | None = None
    needs_time: bool = False


def _named(hints: list[str]) -> Column:
    return any_of([F.lower("file").contains(h) for h in hints])


def _recognised_xml() -> Column:
    return F.lower("file").rlike(r"\.(xml|evtx)$") & F.col("xml_like")


def _recognised_journal() -> Column:
    return F.col("first_is_journal") | (_named(JOURNAL_HINTS) & F.col("first_is_object"))


#: Formats in the order they are tried.
FORMATS = [
    LogFormat("evtx", "windows", _recognised_xml, lambda: windows.event_starts(F.col("value")), windows.parse_event_xml, windows.event_records),
    LogFormat(
        "linux-journal",
        "linux",
        _recognised_journal,
        lambda: linux.is_journal(linux.journal_map(stripped(F.col("value")))),
        linux.parse_journal,
    ),
    LogFormat(
        "linux-auditd",
        "linux",
        lambda: F.col("has_audit"),
        lambda: F.col("value").contains(linux.AUDIT_MARK),
        linux.parse_auditd,
    ),
    LogFormat(
        "linux-syslog",
        "linux",
        lambda: F.col("has_syslog") | _named(SYSLOG_HINTS),
        lambda: stripped(F.col("value")).rlike(linux.SYSLOG_LINE),
        linux.parse_syslog,
        needs_time=True,
    ),
]


def _marks() -> list[Column]:
    """What all lines of a file show, as aggregates with a partial step."""
    text = stripped(F.col("value"))
    first = lambda test: F.coalesce(F.min_by(test, F.when(text != "", F.col("pos"))), F.lit(False))
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return [
        (first(text.startswith("<?xml")) | some(text.rlike(r"<Events?[\s>]"))).alias("xml_like"),
        first(linux.is_journal(linux.journal_map(text))).alias("first_is_journal"),
        first(text.startswith("{") & text.endswith("}")).alias("first_is_object"),
        some(text.rlike(r"^type=\w+\s+msg=audit\(")).alias("has_audit"),
        some(text.rlike(linux.SYSLOG_LINE)).alias("has_syslog"),
    ]


def route(lines: DataFrame, platform: str, formats: list[LogFormat] | None = None) -> DataFrame:
    """(file, format, rows, reason): the first recognised format that yields a row.

    Decides on whole files (file, pos, value), wherever their marks stand. Marks
    and rows per format come from one pass with a partial aggregate on every
    task; no text is shuffled.
    """
    own = [f for f in formats or FORMATS if f.platform == platform]
    counts = [F.coalesce(F.sum(f.yields().cast("long")), F.lit(0)).alias(f"_n_{i}") for i, f in enumerate(own)]
    frame = lines.groupBy("file").agg(*counts, *_marks())
    chosen, rows, known = F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(False)
    for i, f in reversed(list(enumerate(own))):
        fits = f.recognised()
        chosen = F.when(fits & (F.col(f"_n_{i}") > 0), F.lit(f.name)).otherwise(chosen)
        rows = F.when(fits & (F.col(f"_n_{i}") > 0), F.col(f"_n_{i}")).otherwise(rows)
        known = known | fits
    # fixed values: the two reasons
    reason = F.when(~known, F.lit("Unsupported log format")).when(chosen.isNull(), F.lit("No parseable events found"))
    return frame.select("file", chosen.alias("format"), rows.alias("rows"), reason.alias("reason"))


def dataset_format(routes: DataFrame) -> DataFrame:
    """``unknown``, the one format, or ``mixed``."""
    known = routes.filter(F.col("format").isNotNull())
    both = known.agg(F.min("format").alias("a"), F.max("format").alias("b"))
    label = F.when(F.col("a").isNull(), F.lit("unknown")).when(F.col("a") == F.col("b"), F.col("a"))
    return both.select(label.otherwise(F.lit("mixed")).alias("format"))


def report(routes: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Per file: parsed, skipped or error, with the reason and the number of rows."""
    frame = routes
    if broken is not None:
        frame = frame.join(broken.select("file", "error"), "file", "left")
    else:
        frame = frame.withColumn("error", F.lit(None).cast("string"))
    status = (
        F.when(F.col("error").isNotNull() & (F.col("rows") > 0), F.lit("partial"))
        .when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("format").isNotNull(), F.lit("parsed"))
        .otherwise(F.lit("skipped"))
    )
    return frame.select("file", status.alias("status"), "format", "rows", F.coalesce("error", "reason").alias("reason"))


def report_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


def parse_routed(lines: DataFrame, routes: DataFrame, as_of: Column, formats: list[LogFormat] | None = None) -> DataFrame:
    """Every file's lines, as records of its format, through the parser it was routed to.

    Lines are written once, in a folder per format, and each parser reads its own folder.
    """
    spark = lines.sparkSession
    tagged = lines.withColumnRenamed("file", "source_file").join(
        routes.filter(F.col("format").isNotNull()).select(F.col("file").alias("source_file"), "format"), "source_file"
    )
    path = scratch_path(spark, "routed")
    tagged.select("source_file", "pos", "value", "format").write.partitionBy("format").parquet(path)
    schema = tagged.select("source_file", "pos", "value", "format").schema
    kept = spark.read.schema(schema).parquet(path)
    frames = []
    for f in formats or FORMATS:
        own = kept.filter(F.col("format") == f.name).drop("format")
        own = f.records(own) if f.records else own
        frames.append(f.parse(own, as_of) if f.needs_time else f.parse(own))
    return union_events(*frames)


def read_lines(spark: SparkSession, folder: str, name: Column | None = None) -> DataFrame:
    """All lines below a folder as (file, pos, value), in files' order also where a file is split among tasks.

    A file that cannot be read to its end gives the lines up to there. ``name`` says what a file is
    called, its path by default.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    path, block = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    rows = reader.text(folder).select(path, block, F.monotonically_increasing_id().alias("row"), "value")
    # a line's number in its block is at most its place in bytes there, so the sums are in order
    first = rows.groupBy("path", "block").agg(F.min("row").alias("first"))
    placed = rows.join(first, ["path", "block"])
    return placed.select((F.col("path") if name is None else name).alias("file"), (F.col("block") + F.col("row") - F.col("first")).alias("pos"), "value")


def ingest_folder(
    spark: SparkSession, folder: str, platform: str, as_of: Column, name: Column | None = None, formats: list[LogFormat] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The events of all files below a folder, and a report with one row per file, whatever became of it.

    The report has file, status, format, rows (records seen), events (records read) and reason. Files come from
    the listing that Spark's readers hold on the driver anyway, so those without a byte are there too. ``parsed``: all records were read; ``partial``: some;
    ``error``: none, or the file has bytes but no line could be read; ``skipped``: empty, or of no known format.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = (F.col("path") if name is None else name).alias("file")
    listed = spark.createDataFrame([(path,) for path in listing.inputFiles()], "path string").select(named, F.lit(0).alias("length"))
    # readers pass over files without a byte
    files = listing.select(named, "length").union(listed).groupBy("file").agg(F.sum("length").alias("length"))
    lines = read_lines(spark, folder, name)
    routes = cut_lineage(route(lines, platform, formats))
    events = parse_routed(lines, routes, as_of, formats)
    read = events.groupBy(F.col("sourceFile").alias("file")).agg(F.count(F.lit(1)).alias("events"))
    frame = files.join(routes, "file", "left").join(read, "file", "left")
    frame = frame.withColumns({"rows": F.coalesce("rows", F.lit(0)), "events": F.coalesce("events", F.lit(0))})
    lost = F.col("rows") - F.col("events")
    unread = (F.col("length") > 0) & F.col("format").isNull() & F.col("reason").isNull()
    status = (
        F.when(unread | (F.col("format").isNotNull() & (F.col("events") == 0)), F.lit("error"))
        .when(F.col("format").isNull(), F.lit("skipped"))
        .when(lost > 0, F.lit("partial"))
        .otherwise(F.lit("parsed"))
    )
    shown = F.concat(lost.cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" records could not be read"))
    reason = (
        F.when(F.col("length") == 0, F.lit("Empty file"))
        .when(unread, F.lit("File could not be read"))
        .when(F.col("format").isNotNull() & (lost > 0), shown)
        .otherwise(F.col("reason"))
    )
    return events, frame.select("file", status.alias("status"), "format", "rows", "events", reason.alias("reason"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every XML, EVTX-XML, CSV and TSV file below a folder as one event table; other files yield nothing.

    One scan per kind of file, however many files there are.
    """
    xml = windows.parse_event_xml(windows.read_event_xml(spark, folder, "*.{xml,XML,evtx,EVTX}"))
    csv = tables.read_tables(spark, folder, "*.{csv,CSV}", ",")
    tsv = tables.read_tables(spark, folder, "*.{tsv,TSV}", "\t")
    return union_events(xml, csv, tsv)


#: Entries that are no samples.
EXCLUDED_FOLDERS = ["EVTX_ATT&CK_Metadata", ".git"]


def pretty_name(file: Column) -> Column:
    """``some_FILE.evtx`` to ``Some FILE``: words get a capital, acronyms stay."""
    words = F.split(F.regexp_replace(F.regexp_replace(file, r"(?i)\.evtx$", ""), "_", " "), " ")
    word = lambda w: F.when((w == F.upper(w)) & (F.length(w) > 1), w).otherwise(
        F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    )
    return F.array_join(F.transform(words, word), " ")


def file_catalog(paths: DataFrame, suffix: str = ".evtx") -> DataFrame:
    """``category/file`` paths as (category, name, file) of the files that count."""
    frame = paths.select(
        F.substring_index("path", "/", 1).alias("category"), F.substring_index("path", "/", -1).alias("file")
    )
    kept = frame.filter(~F.col("category").isin(EXCLUDED_FOLDERS) & F.lower("file").endswith(suffix))
    return kept.select("category", pretty_name(F.col("file")).alias("name"), "file").orderBy("category", "name", "file")

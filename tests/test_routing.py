"""Records over several lines, whole folders with what became of each file, IPv6 indicators, STIX patterns."""

import gzip
import ipaddress
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from emberwatch.operators.indicators import PATTERNS, extract
from emberwatch.sinks.stix import pattern
from emberwatch.sources import routing, windows




def event(i, text=""):
    return f'<Event xmlns="x">\n <System>\n  <EventID>{i}</EventID></System>\n\n<EventData><Data Name="T">{text}</Data></EventData>\n</Event>'


def test_events_lie_on_lines_in_any_way(spark):
    pick = random.Random(1)
    rows, expected = [], Counter()
    for file in ("a.xml", "b.xml", "c.xml"):
        whole = pick.choice(["<?xml version='1.0'?>\n<Events>", "<Events>\n", ""])
        for i in range(300 if file == "a.xml" else 7):
            text = event(i, "line\nbreak" * (i % 3))
            expected[file, text] += 1
            whole += text + pick.choice(["", "\n", "\n\n", " "])
        whole += "</Events>"
        rows += [(file, n, line) for n, line in enumerate(whole.split("\n"))]
    rows += [("d.xml", 0, "<Event><System>"), ("d.xml", 1, "never closed"), ("e.xml", 0, None), ("f.xml", 0, "<Eventual/>")]
    pick.shuffle(rows)
    lines = spark.createDataFrame(rows, "source_file string, pos long, value string")
    found = Counter((r.source_file, r.value) for r in windows.event_records(lines).collect())
    assert found == expected


def test_counted_rows_are_parsed_rows(spark):
    text = "<Events>" + event(1) + event(2) + "\n" + event(3) + "</Events>"
    lines = spark.createDataFrame([("x.xml", i, v) for i, v in enumerate(text.split("\n"))], "file string, pos long, value string")
    routes = routing.route(lines, "windows")
    assert [(r.format, r.rows) for r in routes.collect()] == [("evtx", 3)]
    assert sorted(r.eventId for r in routing.parse_routed(lines, routes, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()) == [1, 2, 3]


def test_folder_report(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.xml").write_text("<?xml version='1.0'?>\n" + "\n".join(event(i) for i in range(50)))
    (tmp_path / "sub" / "half.xml").write_text(event(1) + "\n<Event><System><EventID>2</EventID>\n" + event(3))
    (tmp_path / "bad.xml").write_text("<Event>\n</Event>")
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "notes.txt").write_text("nothing here\n")
    whole = gzip.compress("".join(event(i, str(i)) for i in range(2000)).encode())
    (tmp_path / "cut.xml.gz").write_bytes(b"\x1f\x8b\x08\x00broken" + whole[50:80])
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    events, report = routing.ingest_folder(spark, str(tmp_path), "windows", F.lit("2024-01-01 00:00:00").cast("timestamp"), name)
    rows = {r.file: (r.status, r.rows, r.events, r.reason) for r in report.collect()}
    assert rows["good.xml"] == ("parsed", 50, 50, None)
    assert rows["half.xml"] == ("partial", 3, 2, "1 of 3 records could not be read")
    assert rows["bad.xml"] == ("error", 1, 0, "1 of 1 records could not be read")
    assert rows["empty.xml"] == ("skipped", 0, 0, "Empty file")
    assert rows["notes.txt"] == ("skipped", 0, 0, "Unsupported log format")
    assert rows["cut.xml.gz"] == ("error", 0, 0, "File could not be read")
    assert events.count() == 52


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "big.log").write_text("\n".join(f"line {i}" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = sorted((r.pos, r.value) for r in routing.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [v for _, v in rows] == [f"line {i}" for i in range(20_000)] and len({p for p, _ in rows}) == 20_000


ADDRESSES = ["2001:db8::1", "fe80::1:2:3:4", "1:2:3:4:5:6:7:8", "2001:0DB8:0:0:0:ff00:42:8329", "2001:db8::", "a::b:c", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7"]
NONE = ["12:34:56", "aa:bb:cc:dd:ee:ff", "std::vector", "10.0.0.1", "x::y", "1:2"]


def test_ipv6(spark):
    rows = spark.createDataFrame([(f"from [{a}] to {a}, then", a) for a in ADDRESSES + NONE], "text string, a string")
    found = Counter((r.a, r.value) for r in extract(rows, "text", ["a"], ["ipv6"]).collect())
    assert found == Counter({(a, a): 2 for a in ADDRESSES})
    pick = random.Random(5)
    for _ in range(3000):
        text = str(ipaddress.IPv6Address(pick.getrandbits(128) & pick.getrandbits(128) & pick.choice([2**128 - 1, 2**128 - 2**64, 0xFFFF << 112 | 0xFFFF])))
        if not text.startswith("::"):
            assert re.findall(PATTERNS["ipv6"], text) == [text]


def test_quotes_in_stix_patterns(spark):
    row = spark.createDataFrame([("url", "http://x/a'b\\c"), ("ipv6", "2001:db8::1")], "type string, value string")
    assert [r[0] for r in row.select(pattern(F.col("type"), F.col("value"))).collect()] == ["[url:value = 'http://x/a\\'b\\\\c']", "[ipv6-addr:value = '2001:db8::1']"]

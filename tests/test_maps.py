"""Maps of repeated keys, and what they cost: their arrays are worked out once per row, not once per key."""

import time

from pyspark.sql import functions as F

from emberwatch.functions.text import last_wins_map
from emberwatch.sources import linux, tables


def test_last_value_at_the_first_place(spark):
    row = "keys array<string>, vals array<string>"
    rows = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"]), (["a"], None), (None, ["1"]), ([], [])], row)
    found = [r.m for r in rows.select(last_wins_map(F.col("keys"), F.col("vals")).alias("m")).collect()]
    assert found == [{"a": "3", "b": "2"}, {"a": None}, None, {}] and list(found[0]) == ["a", "b"]


def _seconds(frame):
    start = time.time()
    frame.write.format("noop").mode("overwrite").save()
    return time.time() - start


def test_audit_line_of_many_pairs_takes_linear_time(spark):
    pairs = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit('="v w"'))))
    lines = spark.range(0, 200, 1, 8).select(F.concat(F.lit("type=X msg=audit(1.002:3): "), pairs).alias("value"))
    events = linux.parse_auditd(lines).select(F.size("eventData").alias("n"))
    assert _seconds(events) < 8
    assert {r.n for r in events.collect()} == {602}


def test_csv_lines_of_many_cells_and_blank_lines(spark):
    names = ",".join(f"c {i}" for i in range(300))
    cells = ",".join(f'"x ""{i}"""' for i in range(300))
    lines = [("f", 0, names)] + [("f", i, cells if i % 10 else "  ") for i in range(1, 101)]
    frame = spark.createDataFrame(lines, "file string, pos long, value string")
    events = tables.parse_cells(tables.cells_of_lines(frame)).collect()
    assert len(events) == 90 and {r.eventData["c 7"] for r in events} == {'x "7"'} and {len(r.eventData) for r in events} == {300}

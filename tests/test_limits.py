"""No result is cut where it grows large: long chains, hot processes, late marks, full counts."""

from pyspark.sql import functions as F

from emberwatch.operators import lineage, network, search, signatures
from emberwatch.sources import routing


def test_descendants_of_a_long_chain_and_of_a_cycle(spark):
    chain = [(i, i - 1 if i else None, i == 0) for i in range(300)]
    cycle = [(1000 + i, 1000 + (i + 1) % 7, False) for i in range(7)]
    rows = spark.createDataFrame(chain + cycle, "id long, up long, bad boolean")
    found = lineage.descendants(rows, "id", "up", F.col("bad"))
    assert sorted(r.id for r in found.collect()) == list(range(1, 300))


def test_first_row_of_a_repeated_parent(spark):
    rows = spark.createDataFrame([(1, None, 5, "late"), (1, None, 2, "early"), (2, 1, 9, "child")], "id long, up long, at long, name string")
    found = lineage.with_parent(rows, "id", "up", ["name"], ["at"])
    assert [(r.name, r.parent_name) for r in found.collect()] == [("child", "early")]


def test_hot_process_has_one_row_and_full_counts(spark):
    data = F.create_map(F.lit("ProcessGuid"), F.lit("{g}"), F.lit("Image"), F.lit("a.exe"), F.lit("DestinationIp"), F.lit("1.2.3.4"), F.lit("DestinationPort"), F.col("id").cast("string"))
    events = spark.range(10_000).select(
        "id", F.lit(3).alias("eventId"), F.timestamp_seconds("id").alias("timestamp"), data.alias("eventData"), F.lit("").alias("rawLine")
    )
    assert [(r.guid, r.connections, r.lookups) for r in network.process_map(events, "id").collect()] == [("{g}", 10_000, 0)]
    assert network.process_activity(events, "id").count() == 10_000
    odd = events.withColumn("eventData", F.map_concat("eventData", F.create_map(F.lit("destinationPort"), F.lit("x"))))
    assert len(network.destinations(odd, "id").first().ports.split(", ")) == 10_000


def test_all_saved_queries_run(spark):
    queries = [search.SavedQuery(f"q{i}", "word", False, f"2024-01-{i % 28 + 1:02d}") for i in range(60)]
    rows = spark.createDataFrame([(1, "a word")], "id long, text string")
    assert search.run_saved(rows, queries, "id", F.col("text")).count() == 60
    assert len(search.kept_queries(queries)) == search.SAVED_QUERIES


def test_format_marks_anywhere_in_a_file(spark):
    lines = [("x.log", i, "nothing to see here, only filling" * 10) for i in range(200)]
    lines += [("x.log", 200, "type=SYSCALL msg=audit(1700000000.123:42): pid=1")]
    rows = routing.route(spark.createDataFrame(lines, "file string, pos long, value string"), "linux").collect()
    assert [(r.format, r.rows) for r in rows] == [("linux-auditd", 1)]


def test_strictness_counts_everything(spark):
    words = tuple(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(i, "f", " ".join(words)) for i in range(20)], "id long, file string, text string")
    signature = signatures.Signature("s", "w0", words, 10)
    text = signatures.event_text([F.col("text")])
    files = signatures.scan(rows, [signature], "file", text)
    found = signatures.enough_by_itself(rows, files, [signature], "file", text, "id")
    passing = signatures.passing_rules(files, found, "strict").collect()
    assert [(r.n_events, r.n_literals) for r in passing] == [(20, 12)]
    shown = signatures.shown_events(found, "id").collect()
    assert len(shown) == 8 and all(len(r.event_literals) == 8 for r in shown)


def test_csv_with_long_cells_and_line_breaks(spark, tmp_path):
    from emberwatch.sources import tables

    long = "x" * 100_000
    (tmp_path / "a.csv").write_text('\ufeffTimestamp,Message,Extra\n2024-01-02 03:04:05,"one\ntwo ""quoted""",1\n2024-01-02 03:04:06,"' + long + '",2\n')
    (tmp_path / "b.csv").write_text("Message,User,More,Wide\nhello,kim,m\n")
    rows = {r.message: r for r in tables.read_tables(spark, str(tmp_path)).collect()}
    assert set(rows) == {'one\ntwo "quoted"', long, "hello"}
    assert rows["hello"].user == "kim" and rows[long].eventData["Extra"] == "2"
    line = spark.createDataFrame([(f'a,"{long}",b',)], "value string")
    assert line.select(tables.split_cells(F.col("value"), ",").alias("c")).first().c == ["a", long, "b"]

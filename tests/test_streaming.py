"""Streams over several files, rows out of order between them."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberwatch.streaming import jobs
from emberwatch.streaming.run import STATE_STORE, append_to_table, append_whole, read_parquet_stream, write_with_progress
from emberwatch.streaming.sequences import sequences, staged

HOUR = 3_600_000_000
BASE = 1_704_067_200_000_000

random.seed(3)
ROWS = [(random.randint(0, 4), BASE + i * HOUR // 6 + random.randint(-HOUR, HOUR), random.choice("abc")) for i in range(600)]


@pytest.fixture()
def stream(spark, tmp_path):
    # four files; each holds rows around its quarter of the time
    for part in range(4):
        rows = spark.createDataFrame(ROWS[part * 150 : part * 150 + 150], "k long, us long, kind string")
        rows.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = read_parquet_stream(spark, str(tmp_path / "in"), "*.parquet")
    return source.select("k", "us", "kind", "ts")


@pytest.mark.parametrize("key", ["k", "name", "half"])
def test_sequence_over_batches(stream, key):
    """Keys of several types; rows of one hour come in several files; all is out at the end."""
    name = F.concat(F.lit("user-"), "k")
    named = stream.select("k", name.alias("name"), (F.col("k") / 2).alias("half"), "ts", "kind")
    stages = [(F.col("kind") == n, key) for n in "abc"]
    found = append_whole(named, "ts", lambda s: sequences(staged(s, stages, "ts"), 3, 8 * HOUR, "3 hours"), "s", STATE_STORE)
    number = {"k": lambda v: v, "name": lambda v: int(v.removeprefix("user-")), "half": lambda v: int(2 * v)}[key]
    got = [(number(r["key"]), r["first_us"], r["last_us"]) for r in found.collect()]
    expected = set()
    for k, c, kind in ROWS:
        if kind != "c":
            continue
        starts = [
            a for k1, a, k_a in ROWS if k1 == k and k_a == "a" and c - 8 * HOUR <= a
            and any(k2 == k and k_b == "b" and a < b < c for k2, b, k_b in ROWS)
        ]
        if starts:
            expected.add((k, max(starts), c))
    assert set(got) == expected and len(got) == len(expected) > 50


def test_sessions_to_the_end(stream):
    found = append_whole(stream.select("k", "ts"), "ts", lambda s: jobs.gap_sessions(s, ["k"], "ts", "2 hours", "3 hours"), "g")
    got = {(r.k, r.n) for r in found.select("k", F.unix_micros("last_ts").alias("last"), "n").collect()}
    expected = set()
    for k in {k for k, *_ in ROWS}:
        times, n = sorted(us for other, us, _ in ROWS if other == k), 1
        for a, b in zip(times, [*times[1:], None]):
            if b is None or b - a >= 2 * HOUR:
                expected.add((k, n))
                n = 0
            n += 1
    assert got == expected


def test_distinct_over_batches(stream):
    found = jobs.distinct_over(stream, ["k"], "ts", "5 hours", "3 hours", "kind", 0)
    got = {(r["k"], r["w"]): r["n"] for r in append_to_table(found.withColumn("w", F.unix_micros("window_start")), "d").collect()}
    closed = (max(us for _, us, _ in ROWS) // 1000 - 3 * 3_600_000) * 1000
    expected = {}
    for k, us, kind in ROWS:
        start = us - us % (5 * HOUR)
        if start + 5 * HOUR <= closed:
            expected.setdefault((k, start), set()).add(kind)
    assert got == {key: len(kinds) for key, kinds in expected.items()}


def test_progress_adds_up_and_a_repeated_batch_counts_once(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = read_parquet_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    measures = {"rows": F.count(F.lit(1)), "total": F.sum("id"), "most": F.max("id")}
    rows, progress = write_with_progress(source, "p", **measures)
    seen = {(r.batch, r.measure): r.value for r in progress.collect()}
    assert {b for b, _ in seen} == {0, 1, 2} and sum(v for (_, m), v in seen.items() if m == "total") == sum(range(30))
    assert rows.count() == 30 and sorted(r.batch for r in rows.collect()) == [b for b in range(3) for _ in range(10)]


def test_a_file_of_a_batch_can_be_split(spark, tmp_path):
    from pathlib import Path

    import pyarrow.parquet as pq

    from emberwatch.plans.q_streaming import in_files

    folder = str(tmp_path / "parts")
    in_files(spark.range(2_000_000).select("id", F.xxhash64("id").alias("h")), F.col("id") % 4, folder)
    files = [pq.ParquetFile(f).metadata for f in Path(folder).rglob("*.parquet")]
    assert len(files) == 4 and sum(f.num_rows for f in files) == 2_000_000 and all(f.num_row_groups > 1 for f in files)


def _expected(rows, span):
    """(key, first, last) of signup "a", then "b", then "c", by brute force."""
    found = set()
    for k, c, kind in rows:
        if kind == "c" and k is not None and c is not None:
            mine = [(us, other) for k1, us, other in rows if k1 == k and us is not None and c - span <= us < c]
            starts = [a for a, other in mine if other == "a" and any(b > a for b, third in mine if third == "b")]
            if starts:
                found.add((k, max(starts), c))
    return found


def _files(spark, folder, parts):
    for part in parts:
        rows = spark.createDataFrame(part, "k long, us long, kind string").withColumn("ts", F.timestamp_micros("us"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    return read_parquet_stream(spark, folder, "*.parquet", files_per_batch=1).select("k", "us", "kind", "ts")


def _sequences(source, span, delay):
    stages = [(F.col("kind") == n, "k") for n in "abc"]
    found = append_whole(source, "ts", lambda s: sequences(staged(s, stages, "ts"), 3, span, delay), "s", STATE_STORE)
    return sorted(tuple(r) for r in found.collect())


def test_sequence_without_key_or_time_and_twice_at_an_instant(spark, tmp_path):
    """A row without a key or a time is in no sequence; an instant is reported once, as in SQL."""
    big = 2**53 + 1
    rows = [(k, BASE + i * HOUR, kind) for k in (None, 7, big) for i, kind in enumerate("abc")]
    rows += [(7, BASE + 2 * HOUR, "c"), (7, None, "a"), (None, None, "c")]
    got = _sequences(_files(spark, str(tmp_path / "in"), [rows]), 8 * HOUR, "3 hours")
    assert got == [(7, BASE, BASE + 2 * HOUR), (big, BASE, BASE + 2 * HOUR)]


def test_sequence_of_keys_that_are_fractions(spark, tmp_path):
    """NaN is a key like others, and both zeros are one, as in SQL."""
    rows = [(key, BASE + i * HOUR, kind) for key in ("NaN", "0.5") for i, kind in enumerate("abc")]
    rows += [("-0.0", BASE, "a"), ("0.0", BASE + HOUR, "b"), ("-0.0", BASE + 2 * HOUR, "c")]
    frame = spark.createDataFrame(rows, "k string, us long, kind string").withColumn("ts", F.timestamp_micros("us"))
    frame.withColumn("k", F.col("k").cast("double")).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = _sequences(read_parquet_stream(spark, str(tmp_path / "in"), "*.parquet"), 8 * HOUR, "3 hours")
    assert sorted(map(repr, got)) == sorted(repr((key, BASE, BASE + 2 * HOUR)) for key in (0.0, 0.5, float("nan")))


def test_sequence_whose_span_ends_in_a_waiting_hour(spark, tmp_path):
    """A start is kept for the rows that wait in an hour of which the watermark has passed a part."""
    minute = HOUR // 60
    first = [(1, BASE, "a"), (1, BASE + 5 * minute, "b"), (1, BASE + 125 * minute, "c")]
    # the watermark comes to 2:30; the span ends at 2:10, and the last row of the sequence, of 2:05, still waits
    parts = [first, [(2, BASE + 210 * minute, "a")], [(2, BASE + 211 * minute, "a")], [(2, BASE + 900 * minute, "a")]]
    got = _sequences(_files(spark, str(tmp_path / "in"), parts), 130 * minute, "1 hour")
    assert got == [(1, BASE, BASE + 125 * minute)]


def test_sequence_state_is_shared_by_keys(spark, tmp_path):
    """Many keys and hours make few state rows: keys share buckets, and hours share pieces."""
    keys, hours = 600, 10
    rows = spark.range(keys * hours * 3).selectExpr(f"id % {keys} AS k", f"{BASE} + id DIV {keys} * {HOUR // 3} AS us")
    rows = rows.withColumn("kind", F.element_at(F.array(*map(F.lit, "abc")), (F.floor((F.col("us") - BASE) / (HOUR // 3)) % 3 + 1).cast("int")))
    rows.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = read_parquet_stream(spark, str(tmp_path / "in"), "*.parquet")
    found = sequences(staged(source, [(F.col("kind") == n, "k") for n in "abc"], "ts"), 3, 8 * HOUR, "1 day")
    before = spark.conf.get(next(iter(STATE_STORE)))
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        run = writer.trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(next(iter(STATE_STORE)), before)
    written = max(p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress)
    assert 0 < written < 5 * keys  # a key and an hour a row were 6,000 rows and as many timers


class _Store:
    """A value or a map of values."""

    def __init__(self):
        self.kept = {}

    def get(self):
        return self.kept.get(())

    def exists(self):
        return () in self.kept

    def update(self, value):
        self.kept[()] = value

    def clear(self):
        self.kept.clear()

    def getValue(self, key):
        return self.kept[key]

    def updateValue(self, key, value):
        assert key not in self.kept, "a piece is written once"
        self.kept[key] = value

    def removeKey(self, key):
        del self.kept[key]


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Store())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("most, piece", [(10, 4), (50, 7), (1 << 18, 1 << 12)])
def test_sequence_pieces_against_brute_force(monkeypatch, most, piece):
    """One bucket of 12 keys by itself: small batches, rows out of order, pieces that overlap; nothing is left behind."""
    import pyarrow as pa

    from emberwatch.streaming import sequences as module

    monkeypatch.setattr(module, "SORTED", most)
    monkeypatch.setattr(module, "PIECE", piece)
    draw = random.Random(most)
    span, delay, mark, newest = 5 * HOUR, 2 * HOUR, 0, 0
    steps = HOUR // 12  # a few instants an hour, so that rows meet at one
    handle, rows, got = _Handle(), [], []
    processor = module._Sequences(3, span, pa.int64())
    processor.init(handle)

    def timers():
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        for at in sorted(t for t in handle.timers if t <= mark):
            for found in processor.handleExpiredTimer((3,), values, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)):
                got.extend(found.itertuples(index=False, name=None))
            handle.timers.discard(at)

    for batch in range(60):
        drawn = [(draw.randrange(12), BASE + batch * HOUR + draw.randrange(-30, 30) * steps, draw.choice("abc")) for _ in range(draw.choice([0, 3, 90]))]
        drawn = [row for row in drawn if row[1] > mark * 1000]
        rows += drawn
        if drawn:
            frame = pd.DataFrame([(3, k, us, "abc".index(kind)) for k, us, kind in drawn], columns=["bucket", "key", "us", "stage"])
            frames = [frame[i : i + 25] for i in range(0, len(frame), 25)]
            assert not list(processor.handleInputRows((3,), iter(frames), None))
            newest = max(newest, *(us for _, us, _ in drawn))
        timers()
        mark = max(mark, (newest - delay) // 1000)
    mark = (BASE + 10_000 * HOUR) // 1000
    timers()
    assert len(got) == len(set(got)) and set(got) == _expected(rows, span) and len(got) > 100
    assert not handle.timers and not any(store.kept for store in handle.states.values())

"""Sliced windows against brute force, with one key that holds a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import temporal as T
from emberwatch.operators.skew import first_n
from emberwatch.operators.timeline import nearest, running_total, sessions, trailing_total

random.seed(7)
ROWS = [
    (i, 0 if i % 3 == 0 else random.randint(1, 20), random.randint(0, 5000), random.choice("abc"), random.randint(0, 9))
    for i in range(900)
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "id long, k long, at long, kind string, v long").cache()


@pytest.mark.parametrize("later", [True, False])
@pytest.mark.parametrize("same", [True, False])
def test_nearest(events, later, same):
    found = nearest(events, ["k"], "at", {"hit": (F.col("kind") == "b", {"id": F.col("id")})}, 100, later, same)
    got = {r["id"]: r["hit"]["at"] if r["hit"] else None for r in found.collect()}
    for i, k, at, _, _ in ROWS:
        times = [a for _, k2, a, kind, _ in ROWS if k2 == k and kind == "b"]
        if later:
            times = [a for a in times if a > at or (same and a == at)]
            assert got[i] == (min(times) if times else None)
        else:
            times = [a for a in times if a < at or (same and a == at)]
            assert got[i] == (max(times) if times else None)


def test_running_and_trailing(events):
    run = {r["id"]: r["s"] for r in running_total(events, ["k"], "at", {"s": F.col("v")}, 70).collect()}
    trail = {r["id"]: r["s"] for r in trailing_total(events, ["k"], "at", 130, {"s": F.col("v")}, 70).collect()}
    for i, k, at, _, _ in ROWS:
        assert run[i] == sum(v for _, k2, a, _, v in ROWS if k2 == k and a <= at)
        assert trail[i] == sum(v for _, k2, a, _, v in ROWS if k2 == k and at - 130 <= a <= at)


def test_trailing_distinct(events):
    found = T.trailing_distinct_over(events, ["k"], "at", 60, "kind", 0)
    got = {(r["k"], r["at"]): r["n"] for r in found.collect()}
    for _, k, at, _, _ in ROWS:
        assert got[(k, at)] == len({kind for _, k2, a, kind, _ in ROWS if k2 == k and at - 60 <= a <= at})


@pytest.mark.parametrize("width", [40, 500])
def test_sessions(events, width):
    got = {r["id"]: r["session_start"] for r in sessions(events, ["k"], "at", 35, width).collect()}
    for key in {r[1] for r in ROWS}:
        start = previous = None
        for i, _, at, _, _ in sorted((r for r in ROWS if r[1] == key), key=lambda r: r[2]):
            if previous is None or at - previous > 35:
                start = at
            previous = at
            assert got[i] == start


def test_near(events):
    found = T.near(events, ["k"], "at", 25, F.col("kind") == "a", {"b": F.col("kind") == "b"}, {"c": F.col("kind") == "c"})
    close = lambda k, at, kind: any(k2 == k and kd == kind and abs(a - at) <= 25 for _, k2, a, kd, _ in ROWS)
    expected = {i for i, k, at, kind, _ in ROWS if kind == "a" and close(k, at, "b") and not close(k, at, "c")}
    assert {r["id"] for r in found.collect()} == expected


@pytest.mark.parametrize("span", [None, 90])
def test_sequence(events, span):
    stages = [T.Stage(n, F.col("kind") == n, "k") for n in "abc"]
    found = {r["a_id"]: (r["b_at"], r["c_at"]) for r in T.sequence(events, stages, "at", "id", span, width=100).collect()}
    after = lambda k, at, kind: min((a for _, k2, a, kd, _ in ROWS if k2 == k and kd == kind and a > at), default=None)
    expected = {}
    for i, k, at, kind, _ in ROWS:
        b = after(k, at, "b") if kind == "a" else None
        c = after(k, b, "c") if b is not None else None
        if c is not None and (span is None or c - at <= span):
            expected[i] = (b, c)
    assert found == expected


def test_first_n(events):
    got = {r["id"] for r in first_n(events, ["k"], [F.col("at"), F.col("id")], 5, F.col("id")).collect()}
    expected = set()
    for key in {r[1] for r in ROWS}:
        expected |= {r[0] for r in sorted((r for r in ROWS if r[1] == key), key=lambda r: (r[2], r[0]))[:5]}
    assert got == expected

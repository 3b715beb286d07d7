"""Sequences with values of the first event in later texts, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators.boundsequence import BoundStage, sequence_bound


def plain(rows, how, span, fold):
    """rows are (id, key, at, kind, value, text); first is kind a, then b and c refer to a's value."""
    same = str.lower if fold else str
    fits = {"startswith": str.startswith, "contains": lambda t, v: v in t, "equals": lambda t, v: t == v}
    found = set()
    for i, key, at, kind, value, _ in rows:
        if kind != "a" or not value or key is None:
            continue
        last, ids = at, []
        for stage, test in zip("bc", how):
            later = [(t, j) for j, k, t, other, _, text in rows if other == stage and k == key and t > last and text is not None and fits[test](same(text), same(value))]
            if not later:
                break
            last, j = min(later)
            ids.append(j)
        if len(ids) == 2 and last - at <= span:
            found.add((i, *ids))
    return found


@pytest.mark.parametrize("how, fold", [(("startswith", "contains"), False), (("contains", "startswith"), True), (("equals", "contains"), True)])
def test_bound_sequences(spark, how, fold):
    pick = random.Random(str(how))
    values = ["/tmp/a", "/tmp/ab", "/tmp/abc/long/path/file.sh", "x", "ab", "", None, "file.sh", "FILE.sh"]
    texts = ["/tmp/abc/long/path/file.sh -x", "/tmp/ab", "run file.sh", "x", "", None, "chmod +x /tmp/ab", "/TMP/AB file.SH"]
    times = pick.sample(range(100_000), 500)
    rows = [(i, pick.choice(["hot"] * 6 + ["k", None]), t, pick.choice("abbcc"), pick.choice(values), pick.choice(texts)) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "id long, key string, at long, kind string, value string, text string").withColumnRenamed("at", "t")
    is_kind = lambda k: F.col("kind") == k
    stages = [BoundStage(n, is_kind(n), F.col("text"), F.col("value"), h, fold) for n, h in zip("bc", how)]
    found = sequence_bound(events, is_kind("a"), stages, ["key"], "t", "id", 2500, width=1000)
    expected = plain(rows, how, 2500, fold)
    assert {(r.first_id, r.b_id, r.c_id) for r in found.collect()} == expected and len(expected) > 2
    joins = [line for line in found._jdf.queryExecution().toString().split("\n") if "NestedLoop" in line or "Cartesian" in line]
    assert not joins


def test_long_values(spark):
    long = "p" * 9000
    rows = [(1, "k", 1, "a", long, None), (2, "k", 2, "b", None, long + "x"), (3, "k", 3, "b", None, "p" * 5000)]
    events = spark.createDataFrame(rows, "id long, key string, at long, kind string, value string, text string")
    stages = [BoundStage("b", F.col("kind") == "b", F.col("text"), F.col("value"))]
    found = sequence_bound(events, F.col("kind") == "a", stages, ["key"], "at", "id", 100)
    assert [(r.first_id, r.b_id) for r in found.collect()] == [(1, 2)]


def test_plan_does_not_double_with_the_stages(spark):
    rows = [(i, "k", i, "abcd"[i % 4], "file.sh", f"run file.sh {i % 3}") for i in range(200)] + [(200, "k", 200, "d", "x", "x")]
    events = spark.createDataFrame(rows, "id long, key string, at long, kind string, value string, text string")
    stages = [BoundStage(n, F.col("kind") == n, F.col("text"), F.col("value"), "contains") for n in "bcd"]
    found = sequence_bound(events, F.col("kind") == "a", stages, ["key"], "at", "id", 10)
    assert {(r.first_id, r.b_id, r.c_id, r.d_id) for r in found.collect()} == {(i, i + 1, i + 2, i + 3) for i in range(0, 200, 4)}
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() <= 2 and len(plan.toString().split("\n")) < 30

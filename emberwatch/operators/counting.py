"""Count tests of rules over hits: sliding windows with a span per rule, or whole groups without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.rules import Rule
from emberwatch.operators.timeline import nearest, trailing_total


def _of_rule(rules: dict[str, Rule], value) -> Column:
    """A value per rule id, as one column."""
    found = F.lit(None)
    for rule_id, rule in rules.items():
        found = F.when(F.col("rule_id") == rule_id, value(rule)).otherwise(found)
    return found


def _passes(rules: dict[str, Rule], count: Column) -> Column:
    return F.coalesce(_of_rule(rules, lambda r: r.count_test.holds(count)), F.lit(False))


def _text_key(column: str) -> Column:
    """A value as a key that plain equality joins, null too."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(column)))


def _in_groups(hits: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Hits of the groups (rule, key) that pass. Counts go through (group, value) first, so a hot group is many partial rows."""
    hits = hits.withColumn("_by", _text_key("by"))
    values = hits.groupBy("rule_id", "_by", "value").agg(F.count(F.lit(1)).alias("n"))
    groups = values.groupBy("rule_id", "_by").agg(F.sum("n").alias("_n"), F.count("value").alias("_distinct"))
    count = _of_rule(rules, lambda r: F.col("_distinct" if r.count_test.field else "_n"))
    return hits.join(groups.filter(_passes(rules, count)).select("rule_id", "_by"), ["rule_id", "_by"], "left_semi").drop("_by")


def _in_windows(hits: DataFrame, rules: dict[str, Rule], time: str) -> DataFrame:
    """Hits inside a passing window: one as long as the rule's ``timeframe`` that ends at a hit of the same key.

    All rules go through one running total: each row takes back what it added once its own rule's span is over,
    or where its value comes again. Only (rule, key, time), with the value for distinct counts, is sorted and
    counted; a hit without a time is in no window.
    """
    hits = hits.filter(F.col(time).isNotNull()).withColumns({"_by": _text_key("by"), "_micros": F.unix_micros(time)})
    span = _of_rule(rules, lambda r: F.lit(r.timeframe * 1_000_000)).cast("long")
    counting = [i for i, r in rules.items() if r.count_test.field]
    distinct = F.col("rule_id").isin(counting) if counting else F.lit(False)
    light = hits.withColumn("_span", span)
    nothing = F.lit(None).cast("long")
    parts = []
    if len(counting) < len(rules):
        rows = light.filter(~distinct).groupBy("rule_id", "_by", "_micros", "_span").agg(F.count(F.lit(1)).alias("_amount"))
        parts.append(rows.withColumn("_until", nothing))
    if counting:
        rows = light.filter(distinct).withColumn("_value", _text_key("value")).select("rule_id", "_by", "_value", "_micros", "_span").distinct()
        rows = nearest(rows, ["rule_id", "_by", "_value"], "_micros", {"_again": (F.lit(True), {})})
        amount = (F.col("_value") != "-").cast("long").alias("_amount")
        parts.append(rows.select("rule_id", "_by", "_micros", "_span", amount, F.col("_again.at").alias("_until")))
    steps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    totals = trailing_total(steps, ["rule_id", "_by"], "_micros", F.col("_span"), {"_n": F.col("_amount")}, expires=F.col("_until"))
    # a window that ends later counts for all hits in it: the nearest such end decides
    ends = totals.select("rule_id", "_by", "_micros", "_span", _passes(rules, F.col("_n")).alias("_ends")).distinct()
    ends = nearest(ends, ["rule_id", "_by"], "_micros", {"_end": (F.col("_ends"), {})}, same=True)
    passing = ends.filter(F.col("_end.at") - F.col("_micros") <= F.col("_span")).select("rule_id", "_by", "_micros")
    return hits.join(passing, ["rule_id", "_by", "_micros"], "left_semi").drop("_by", "_micros")


def counted_hits(hits: DataFrame, rules: dict[str, Rule], time: str) -> DataFrame:
    """Of the hits (rule_id, by, value, time and more) of rules with a count test those that pass it."""
    found = None
    for some, count in (
        ({i: r for i, r in rules.items() if r.timeframe}, lambda h, r: _in_windows(h, r, time)),
        ({i: r for i, r in rules.items() if not r.timeframe}, _in_groups),
    ):
        if some:
            part = count(hits.filter(F.col("rule_id").isin(list(some))), some)
            found = part if found is None else found.unionByName(part)
    return found

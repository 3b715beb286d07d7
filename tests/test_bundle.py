"""Bundles of rules through the index against the predicate form, and sliding count tests against plain counting."""

import datetime
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_predicates import CASES

from emberwatch.operators import bundle
from emberwatch.operators.detection import rule_hits
from emberwatch.operators.rules import Rule
from emberwatch.plans.binding import log_events
from emberwatch.plans.q_detection import COUNT_RULES, RULES, bundle_rules
from emberwatch.schema import to_event_schema

SF = "/root/testdata/sf0.001"


def both(events, rules, **options):
    """Hits of both forms, as (id, rule), counted."""
    forms = [rule_hits(events, rules, ["id"], indexed=indexed, **options).collect() for indexed in (False, True)]
    return [Counter((r.id, r.rule_id) for r in rows) for rows in forms]


def events_of(spark, rows):
    """(id, raw line, fields)"""
    frame = spark.createDataFrame(rows, "id long, rawLine string, eventData map<string,string>")
    return to_event_schema(frame, ["id"])


def test_rules_of_the_log(spark):
    events = log_events(spark, SF).withColumnRenamed("event_id", "id")
    for route in (False, True):
        plain, indexed = both(events, RULES, route=route)
        assert plain == indexed and len({r for _, r in plain}) == len(RULES)
    plain, indexed = both(events, COUNT_RULES)
    assert plain == indexed and plain


def test_every_modifier(spark):
    values = sorted({v for v, *_ in CASES if v is not None}) + ["IEX Cmd.exe -ma x", "172.20.1.1", "éÄß *%_", "c:\\a\\b\\"]
    events = events_of(spark, [(i, f"<{v}>", {"V": v, "W": values[-1 - i]}) for i, v in enumerate(values)] + [(99, "", {"W": "x"})])
    cases = [(v, m) for _, v, m, _ in CASES] + [(["W"], ["fieldref"]), (["W"], ["fieldref", "all"]), (["one", "cmd"], ["contains"]), ([], [])]
    rules = []
    for i, (value, modifiers) in enumerate(cases):
        selections = {"s": {"|".join(["V", *modifiers]): value}, "t": {"W|contains": "x"}, "k": ["cmd", "<a"]}
        rules += [Rule(f"{i}-{text}", "", {**selections, "condition": text}) for text in ("s", "not s", "s and not t", "(s or k) and not (s and t)", "all of them", "1 of s* or not t")]
    plain, indexed = both(events, rules)
    assert plain == indexed and len(plain) > 300


WORDS = ["alpha", "beta.exe", "GAMMA", "del", "x", "a*b?", "al", "^be.a\\.exe", "l{2}", "(?i)gam", "ta|pha", "\\d+9", "9"]


def random_rule(pick, number):
    def selection():
        key = lambda: pick.choice(["A", "B", "C"]) + pick.choice(["", "|contains", "|startswith", "|endswith", "|contains|all", "|re"])
        body = {}
        for _ in range(pick.randint(1, 3)):
            k = key()
            # patterns of the plain words are no regular expressions
            body[k] = pick.sample(WORDS[7:] if k.endswith("|re") else [*WORDS[:7], None] if "|" not in k else WORDS[:7], pick.randint(1, 2))
        return body

    own = {f"s{i}": selection() if pick.random() < 0.7 else [selection(), selection()] for i in range(pick.randint(1, 3))}
    own["words"] = pick.sample(["alpha", "be", "gamma del"], 2)
    names = list(own)
    text = pick.choice(["1 of s*", "all of s*", "s0 and not words", "s0 or words", f"not {pick.choice(names)}", "s0 and not 1 of s*", "not all of them", "(s0 or words) and not (s0 and words)"])
    source = pick.choice([{}, {"product": "windows"}, {"category": "process_creation"}, {"category": "unheard"}])
    return Rule(f"r{number}", "", {**own, "condition": text}, logsource=source)


def test_random_rules(spark):
    pick = random.Random(11)
    texts = ["alpha beta.exe", "Beta.EXE", "gamma", "GAMMA del", "a1b2", "axbc", "", "pha 99", "all", None]
    rows = []
    for i in range(150):
        data = {n: v for n in "ABC" if (v := pick.choice(texts)) is not None}
        rows.append((i, pick.choice(texts), data))
    events = events_of(spark, rows).withColumn("platform", F.when(F.col("id") % 3 > 0, F.lit("windows")))
    events = events.withColumns({"eventId": F.col("id") % 2, "source": F.lit("Microsoft-Windows-Sysmon")})
    rules = [random_rule(pick, i) for i in range(60)]
    for route in (False, True):
        plain, indexed = both(events, rules, route=route)
        assert plain == indexed and len(plain) > 500


def test_rules_too_wide_stay_predicates(spark):
    rule = Rule("wide", "", {"s": {f"F{i}|contains": ["abcd", "x*y"] for i in range(10)}, "t": {"G": "no"}, "condition": "s or t"})
    assert bundle.compile_bundle([rule, RULES[0]]).left_out == [rule]
    fields = {f"F{i}": "abcd" if i % 2 else "x-y" for i in range(10)}
    plain, indexed = both(events_of(spark, [(1, "", {"F0": "abcd"}), (2, "", fields)]), [rule, RULES[0]])
    assert plain == indexed == Counter([(2, "wide")])


def test_nothing_to_find(spark):
    assert rule_hits(events_of(spark, []), bundle_rules(50), ["id"], indexed=True).count() == 0
    assert rule_hits(events_of(spark, [(1, None, None)]), [], ["id"], indexed=True).count() == 0


def test_building_is_quick(spark):
    events = log_events(spark, SF)
    rule_hits(events, bundle_rules(100), ["event_id"], indexed=True)
    started = time.perf_counter()
    rule_hits(events, bundle_rules(), ["event_id"], indexed=True)
    assert (time.perf_counter() - started) / 2000 < 0.01


@pytest.mark.parametrize(
    "pattern, texts",
    [("abc", ["abc"]), ("A.*bcd", ["a", "bcd"]), ("ab|cd", []), ("a+bcd", ["bcd"]), ("(ab)cd", ["cd"]), ("\\Qab\\E", []), ("ab\\1", []), ("(?i)AB[cd]ef", ["ab", "ef"]), ("(", [])],
)
def test_fixed_texts_of_patterns(pattern, texts):
    assert bundle.pattern_texts(pattern) == texts


# count tests

START = datetime.datetime(2024, 1, 1, 9, 59, 50)


def plain_counts(rows, rule):
    """The hits in a window, as long as the timeframe and up to a hit of the key, whose count passes; rows are (id, seconds, key, value)."""
    found, test = set(), rule.count_test
    for _, end, key, _ in rows:
        near = [(i, v) for i, t, k, v in rows if k == key and end - rule.timeframe <= t <= end]
        n = len({v for _, v in near if v is not None}) if test.field else len(near)
        if {">": n > test.threshold, ">=": n >= test.threshold, "<": n < test.threshold, "=": n == test.threshold}[test.operator]:
            found |= {(i, rule.rule_id) for i, _ in near}
    return found


def count_rule(name, condition, timeframe):
    return Rule(name, "", {"s": {"EventID": "7"}, "timeframe": timeframe, "condition": f"s | {condition}"})


def counting_events(spark, rows):
    shown = [(i, START + datetime.timedelta(seconds=at), {k: v for k, v in (("Key", key), ("Value", value)) if v is not None}) for i, at, key, value in rows]
    frame = spark.createDataFrame(shown, "id long, timestamp timestamp, eventData map<string,string>")
    return to_event_schema(frame.withColumns({"eventId": F.lit(7), "rawLine": F.lit("")}), ["id"])


def test_events_over_an_hour_border(spark):
    rule = count_rule("two", "count() by Key >= 2", "1h")
    found = rule_hits(counting_events(spark, [(1, 0, "a", None), (2, 15, "a", None), (3, 3616, "a", None), (4, 20, "b", None)]), [rule], ["id"])
    assert sorted(r.id for r in found.collect()) == [1, 2]


@pytest.mark.parametrize("indexed", [False, True])
def test_sliding_counts(spark, indexed):
    pick = random.Random(6)
    rows = [(i, pick.randint(0, 6000), pick.choice(["a", "a", "a", "b", None]), pick.choice(["x", "y", "z", None])) for i in range(220)]
    rules = [
        count_rule("c1", "count() by Key > 6", "5m"), count_rule("c2", "count(Value) by Key >= 3", "2m"), count_rule("c3", "count() by Key < 3", "1m"),
        count_rule("c4", "count(Value) > 2", "90s"), count_rule("c5", "count() = 4", "1m"), count_rule("c6", "count(Value) by Key < 2", "1h"),
    ]
    found = rule_hits(counting_events(spark, rows), rules, ["id"], indexed=indexed).collect()
    keyless = lambda r: [(i, at, k if r.count_test.by else None, v) for i, at, k, v in rows]
    assert Counter((r.id, r.rule_id) for r in found) == Counter(x for r in rules for x in plain_counts(keyless(r), r))

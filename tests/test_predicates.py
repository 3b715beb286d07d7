"""Truth tables of the rule predicates and conditions."""

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.net import in_networks, ip_scope, ipv6_hex
from emberwatch.functions.text import base64_offset_literals
from emberwatch.operators.conditions import condition, split_count
from emberwatch.operators.predicates import Field, predicate


def holds(spark, value, values, modifiers=(), **options):
    row = spark.createDataFrame([(value,)], "v string")
    return row.select(predicate(Field.of(F.col("v")), values, list(modifiers), **options)).first()[0]


CASES = [
    ("CMD.exe", ["cmd.EXE"], [], True),
    ("cmd.exe", ["a", "b"], [], False),
    (None, ["cmd.exe"], [], False),
    (None, [None], [], True),
    ("", [None], [], False),
    ("", [""], [], True),
    (None, [""], [], False),
    ("abcde", ["a*e"], [], True),
    ("abcde", ["a?cde"], [], True),
    ("a*e", ["a\\*e"], [], True),
    ("abe", ["a\\*e"], [], False),
    ("100%_x", ["*%_*"], [], True),
    ("100ab", ["*%_*"], [], False),
    ("C:\\a\\b", ["\\A\\"], ["contains"], True),
    ("xaby", ["a?y"], ["contains"], True),
    ("foo bar", ["FOO"], ["startswith"], True),
    ("foo bar", ["BAR"], ["endswith"], True),
    ("one two", ["one", "two"], ["contains", "all"], True),
    ("one", ["one", "two"], ["contains", "all"], False),
    ("AbC", ["A[a-z]C"], ["re"], True),
    ("abc", ["A[a-z]C"], ["re"], False),
    ("abc", ["A[a-z]C"], ["re", "i"], True),
    ("172.20.1.1", ["172.16.0.0/12"], ["cidr"], True),
    ("172.32.1.1", ["172.16.0.0/12"], ["cidr"], False),
    ("2001:db8::1", ["10.0.0.0/8", "2001:db8::/32"], ["cidr"], True),
    ("text", ["10.0.0.0/8"], ["cidr"], False),
    ("run /ma x", [" -ma "], ["windash", "contains"], True),
    ("run –ma x", [" -ma "], ["windash", "contains"], True),
    ("run -ma x", [" /ma ", "x"], ["windash", "contains", "all"], True),
    ("a-ma x", [" -ma "], ["windash", "contains"], False),
    ("x", ["true"], ["exists"], True),
    (None, ["true"], ["exists"], False),
    (None, ["false"], ["exists"], True),
    ("SQBFAFgAIAA=", ["IEX "], ["wide", "base64", "contains"], True),
]


@pytest.mark.parametrize("value,values,modifiers,expected", CASES)
def test_truth(spark, value, values, modifiers, expected):
    assert holds(spark, value, values, modifiers) is expected


def test_placeholders(spark):
    assert holds(spark, "kim", ["%Admins%"], ["expand"], placeholders={"Admins": ["KIM"]})
    assert not holds(spark, "kim", ["%Admins%"], ["expand"], placeholders={})


def test_base64_offsets_found_at_every_shift():
    import base64

    for shift in range(6):
        text = base64.b64encode(b"y" * shift + b"needle" + b"rest").decode()
        assert any(form in text for form in base64_offset_literals(b"needle"))


def test_unknown_modifier(spark):
    with pytest.raises(ValueError):
        holds(spark, "x", ["x"], ["nosuch"])


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a and not b", True),
        ("not a or b", False),
        ("a AND (b OR c)", True),
        ("1 of fil*", False),
        ("all of fil*", False),
        ("1 of them", True),
        ("not 1 of fil*", True),
        ("a and not all of them", True),
    ],
)
def test_conditions(spark, text, expected):
    # an undecided selection counts as False, so NOT makes it True
    names = {"a": True, "b": None, "c": True, "fil_1": False, "fil_2": None}
    selections = {n: F.lit(v).cast("boolean") for n, v in names.items()}
    assert spark.range(1).select(condition(text, selections)).first()[0] is expected


def test_condition_refuses_other_code(spark):
    with pytest.raises(ValueError):
        condition("a.b()", {"a": F.lit(True)})


def test_count_suffix():
    head, count = split_count("selection | count(User) by Host >= 5")
    assert head.strip() == "selection"
    assert (count.field, count.by, count.operator, count.threshold) == ("User", "Host", ">=", 5)


def test_addresses(spark):
    rows = [("::1", "0" * 31 + "1"), ("fe80::a:b", "fe80" + "0" * 20 + "000a000b"), ("1:2", None), ("x::1::2", None), ("1.2.3.4", None)]
    frame = spark.createDataFrame(rows, "a string, h string")
    assert all(r[0] == r[1] for r in frame.select("h", ipv6_hex(F.col("a"))).collect())
    scopes = spark.createDataFrame([("10.1.1.1",), ("8.8.8.8",), ("::1",), ("2600::1",), ("nope",), ("1.2.3.400",)], "a string")
    assert [r[0] for r in scopes.select(ip_scope(F.col("a"))).collect()] == ["private", "public", "private", "public", None, None]
    assert scopes.filter(in_networks(F.col("a"), ["0.0.0.0/0"])).count() == 2


@pytest.mark.parametrize("name", ["import", "is", "class", "sel.1", "a-b"])
def test_selection_names(spark, name):
    row = spark.createDataFrame([(True,)], "x boolean")
    assert row.select(condition(f"{name} and not other", {name: F.col("x"), "other": ~F.col("x")})).first()[0]


def test_problems_are_named_and_skipped(spark):
    from emberwatch.operators.detection import problems, rule_hits
    from emberwatch.operators.rules import Rule

    selection = {"selection": {"Image": "a"}}
    rules = [
        Rule("good", "", {**selection, "condition": "selection"}),
        Rule("aggregate", "", {**selection, "condition": "selection | near other"}),
        Rule("syntax", "", {**selection, "condition": "selection and ("}),
        Rule("missing", "", {**selection, "condition": "nothing"}),
        Rule("frame", "", {**selection, "timeframe": "soon", "condition": "selection | count() > 1"}),
        Rule("source", "", {**selection, "condition": "selection"}, logsource={"product": "windows", "category": "unheard_of"}),
    ]
    assert set(problems(rules)) == {"aggregate", "syntax", "missing", "frame", "source"}
    data = F.create_map(F.lit("Image"), F.lit("a"))
    events = spark.range(3).select(
        "id", data.alias("eventData"), F.lit("").alias("rawLine"), F.lit(1).alias("eventId"), F.lit("Microsoft-Windows-Sysmon").alias("source"),
        F.lit("windows").alias("platform"), F.timestamp_seconds("id").alias("timestamp"),
    )
    assert {(r.id, r.rule_id) for r in rule_hits(events, rules, ["id"], route=True).collect()} == {(i, "good") for i in range(3)}


def test_count_tests_hold_back_matches(spark):
    from emberwatch.operators.detection import detect
    from emberwatch.operators.rules import Rule

    body = {"selection": {"Image": "a"}}
    rules = [
        Rule("many", "", {**body, "condition": "selection | count() > 100"}),
        Rule("span", "", {**body, "timeframe": "10s", "condition": "selection | count() by Host >= 3"}),
        Rule("kinds", "", {**body, "condition": "selection | count(Kind) by Host > 1"}),
    ]
    rows = [(0, 0, "x", "k"), (1, 1, "x", "k"), (2, 2, "x", "l"), (3, 11, "x", "l"), (4, 3, "y", "k"), (5, 4, "y", "k"), (6, 5, "y", None)]
    events = spark.createDataFrame(rows, "id long, at long, h string, k string").select(
        "id", F.timestamp_seconds("at").alias("timestamp"), F.lit("").alias("rawLine"),
        F.create_map(F.lit("Image"), F.lit("a"), F.lit("Host"), F.col("h"), F.lit("Kind"), F.col("k")).alias("eventData"),
    )
    events = events.withColumn("host", F.element_at("eventData", "Host")).withColumn("computer", F.lit(None).cast("string"))
    found = {(r.rule_id, r.id) for r in detect(events, rules, ["id"]).collect()}
    assert found == {("span", i) for i in range(7)} | {("kinds", i) for i in (0, 1, 2, 3)}

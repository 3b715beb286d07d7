"""Rules over events: matches, explanations, statistics and what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.bundle import bundle_rows, compile_bundle
from emberwatch.operators.counting import counted_hits
from emberwatch.operators.predicates import expand_values, one_value, predicate, two_valued
from emberwatch.operators.routes import route_test, unknown_source
from emberwatch.operators.rules import CATEGORY_EVENTS, FieldSet, Rule, _values, rule_column
from emberwatch.operators.skew import spread
from emberwatch.session import cut_lineage


def problems(rules: list[Rule]) -> dict[str, str]:
    """Rules that cannot be translated, or whose Windows log is not known, with the reason."""
    found = {}
    for rule in rules:
        try:
            rule.timeframe  # noqa: B018
            fields = FieldSet(rule.field_names(), rule.has_keywords())
            rule_column(rule, fields)
            reason = unknown_source(rule.logsource)
        except (ValueError, KeyError, TypeError) as error:
            reason = str(error)
        if reason:
            found[rule.rule_id] = reason
    return found


def logsource_table(spark: SparkSession) -> DataFrame:
    """The category map as a table (channel, eventId, category)."""
    rows = [(s, e, c) for c, pairs in CATEGORY_EVENTS.items() for s, e in pairs]
    return spark.createDataFrame(rows, "channel string, eventId long, category string")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.rule_id, r.title, r.level, list(r.tags)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, title string, level string, tags array<string>")


def _hit_arrays(
    events: DataFrame,
    rules: list[Rule],
    keep: list[str],
    route: bool,
    placeholders: dict[str, list[str]] | None,
    mapping: dict[str, str] | None,
    counting: bool = False,
) -> tuple[DataFrame, Column]:
    """The fields of all rules, and a row's hits as one array, with the count's key and value if ``counting``."""
    usable = []
    for rule in rules:
        try:
            if rule.count_test:
                rule.timeframe  # noqa: B018
            usable.append((rule, rule.field_names()))
        except ValueError:
            continue
    names = set().union(*[n for _, n in usable])
    fields = FieldSet(names, any(r.has_keywords() for r, _ in usable), mapping)
    by_source: dict[tuple, list[Column]] = {}
    for rule, _ in usable:
        try:
            test, count = rule_column(rule, fields, placeholders)
        except (ValueError, KeyError, TypeError):
            continue
        of_group = lambda name: fields.get(name).text if name else F.lit(None).cast("string")
        hit = [F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.title).alias("title")]
        if counting:
            hit += [of_group(count and count.by).alias("by"), of_group(count and count.field).alias("value")]
        source = tuple(sorted(rule.logsource.items())) if route else ()
        by_source.setdefault(source, []).append(F.when(test, F.struct(*hit)))
    extra = [c for c in ("eventId", "source", "platform") if route and c not in keep]
    frame = fields.project(events, [*keep, *extra])
    more = ",by:string,value:string" if counting else ""
    kind = f"array<struct<rule_id:string,title:string{more}>>"
    empty = F.array().cast(kind)
    hits = [empty]
    for source, tests in by_source.items():
        found = F.array_compact(F.array(*tests)).cast(kind)
        hits.append(F.coalesce(F.when(route_test(dict(source)), found) if source else found, empty))
    return frame, F.concat(*hits[1:]) if len(hits) > 2 else hits[-1]


def rule_hits(
    events: DataFrame,
    rules: list[Rule],
    keep: list[str],
    route: bool = False,
    placeholders: dict[str, list[str]] | None = None,
    mapping: dict[str, str] | None = None,
    time: str = "timestamp",
    indexed: bool = False,
) -> DataFrame:
    """One row per (event, rule) hit, in one scan.

    The fields every rule needs are projected once. Rules with the same log
    source share its test, which comes first and so spares the predicates.
    ``indexed`` is for bundles of hundreds of rules and more: an index of necessary
    literals picks each row's candidates (``bundle``), and only rules that the
    index cannot take are predicates in the plan. Nothing is shuffled, but for the hits of rules
    with a count test (``counting``): these keep the hits at which it passes. A rule that cannot be
    translated is left out (``problems`` names it).
    """
    counted = _counted(rules)
    carried = [*keep, *([time] if counted and time not in keep else [])]
    left = rules
    parts = []
    if indexed:
        bundle = compile_bundle(rules, route, placeholders, mapping)
        parts.append(bundle_rows(events, bundle, carried, bool(counted)))
        left = bundle.left_out
    if left or not indexed:
        frame, found = _hit_arrays(events, left, carried, route, placeholders, mapping, bool(counted))
        parts.append(spread(frame, carried, found, "_hit").select(*carried, "_hit.*").drop("title"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not counted:
        return rows
    plain = rows.filter(~F.col("rule_id").isin(list(counted))).select(*keep, "rule_id")
    # the hits are counted and then picked: worked out once
    hits = cut_lineage(rows.filter(F.col("rule_id").isin(list(counted))))
    return plain.unionByName(counted_hits(hits, counted, time).select(*keep, "rule_id"))


def _counted(rules: list[Rule]) -> dict[str, Rule]:
    """The rules with a count test that can be translated."""
    found = {}
    for rule in rules:
        try:
            if rule.count_test:
                rule.timeframe  # noqa: B018
                found[rule.rule_id] = rule
        except ValueError:
            continue
    return found


def detect(events: DataFrame, rules: list[Rule], keep: list[str], **options) -> DataFrame:
    """Matches with the rule's title, level and tags."""
    hits = rule_hits(events, rules, keep, **options)
    return hits.join(F.broadcast(rule_table(events.sparkSession, rules)), "rule_id")


def enabled(rules: DataFrame, disabled: DataFrame) -> DataFrame:
    """Rules are on unless their id is in the disabled table."""
    return rules.join(disabled.select("rule_id").distinct(), "rule_id", "left_anti")


def explain_matches(
    events: DataFrame, rules: list[Rule], key: str, placeholders: dict[str, list[str]] | None = None
) -> DataFrame:
    """For every match the conditions that held: selection, field, modifier, value and pattern.

    One scan: a row's reasons are built where its rule holds, and nowhere else.
    """
    names = set().union(*[r.field_names() for r in rules])
    fields = FieldSet(names, any(r.has_keywords() for r in rules))
    frame = fields.project(events, [key])
    empty = F.array().cast("array<struct<rule_id:string,selection:string,field:string,value:string,modifier:string,pattern:string>>")
    found = [empty]
    for rule in rules:
        reasons = []
        add = lambda test, *reason: reasons.append(F.when(test, _reason(rule.rule_id, *reason)))  # noqa: B023, E731
        for selection, body in rule.selections.items():
            for part in body if isinstance(body, list) else [body]:
                if not isinstance(part, dict):
                    test = two_valued(fields.raw().text.contains(str(part).lower()))
                    add(test, selection, "rawLine", fields.raw().text, "contains", str(part))
                    continue
                for name_key, value in part.items():
                    name, *modifiers = name_key.split("|")
                    field = fields.get(name)
                    shown = "|".join(modifiers) or "equals"
                    if "fieldref" in modifiers:
                        test = predicate(field, _values(value), modifiers, placeholders, fields.get)
                        add(test, selection, name, field.text, shown, str(value))
                        continue
                    groups, comparison = expand_values(_values(value), modifiers, placeholders)
                    for literal in [form for group in groups for form in group]:
                        add(one_value(field, literal, comparison), selection, name, field.text, shown, literal)
        holds, _ = rule_column(rule, fields, placeholders)
        found.append(F.when(holds, F.array_compact(F.array(*reasons))).otherwise(empty))
    return spread(frame, [key], F.concat(*found), "reason").select(key, "reason.*")


def _reason(rule_id: str, selection: str, name: str, value: Column, modifier: str, pattern: str | None) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(selection).alias("selection"),
        F.lit(name).alias("field"),
        value.alias("value"),
        F.lit(modifier).alias("modifier"),
        F.lit(pattern).cast("string").alias("pattern"),
    )


def hits_of_rows(events: DataFrame, rules: list[Rule], keep: list[str], **options) -> tuple[DataFrame, Column]:
    """Events, and a row's hits (rule_id, title) as one array; rules with a count test speak of groups and take no part."""
    settings = {"route": False, "placeholders": None, "mapping": None} | options
    own = [r for r in rules if "|" not in r.condition]
    return _hit_arrays(events, own, keep, **settings)


def titles_per_event(events: DataFrame, rules: list[Rule], keep: list[str], **options) -> DataFrame:
    """Every event with the titles of the rules that hold for it, in order, from the detecting scan itself.

    Events with the same raw line and time have the same titles.
    """
    frame, found = hits_of_rows(events, rules, keep, **options)
    titles = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda h: h["title"]))), ", ")
    return frame.select(*keep, titles.alias("titles"))


def detection_stats(events: DataFrame, matches: DataFrame, rules: int) -> DataFrame:
    """Rules, events, comparisons and matches in one row."""
    seen = events.agg(F.count(F.lit(1)).alias("events"))
    hits = matches.agg(F.count(F.lit(1)).alias("n")).scalar()
    return seen.select(
        F.lit(rules).cast("long").alias("rules"),
        "events",
        (F.col("events") * rules).alias("comparisons"),
        hits.alias("matches"),
    )


def regression(expected: DataFrame, matches: DataFrame) -> DataFrame:
    """Expected against actual match counts."""
    actual = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("actual"))
    joined = expected.join(actual, "rule_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.withColumn("passed", F.col("expected").eqNullSafe(F.col("actual")))

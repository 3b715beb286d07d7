"""Thousands of rules in one scan: an inverted index picks a row's candidates, and only these are evaluated.

A rule is data here, not a Column: tests of one field each, and clauses over them that must all hold, each of
them an alternative of conjunctions. Every rule is filed under the keys of one of its clauses, without one of
which it cannot hold: the rarest gram of each literal, or a whole value. A row's keys come out of its own
fields in one pass and meet the index in the row's partition; rules that no key can be named for are filed under
their log source. The plan's size and the driver's work grow with the index only, not with predicates.
"""

from __future__ import annotations

import ipaddress
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as re_constants
from re import _parser as re_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.net import ipv4_number, ipv6_hex
from emberwatch.operators.conditions import Node, condition_tree, split_count
from emberwatch.operators.grams import found_grams, grams, rarest
from emberwatch.operators.predicates import expand_values, wildcard_tokens
from emberwatch.operators.routes import route_test
from emberwatch.operators.rules import FieldSet, Rule, _values
from emberwatch.operators.skew import spread

#: Conjunctions that a clause is multiplied out to, at most; a rule beyond is left to the predicate form.
WIDEST = 512
#: Characters of rule data that are broadcast; larger bundles are joined as Spark decides.
BROADCAST_CHARS = 64 << 20

KINDS = ["equals", "contains", "startswith", "endswith", "like", "re", "re_i", "cidr", "encoded", "null", "present", "empty", "field"]
_KIND = {name: i for i, name in enumerate(KINDS)}


@dataclass(frozen=True)
class Test:
    """One field against values of one kind; one of them is enough."""

    field: int
    kind: str
    values: tuple[str, ...]


#: A test and whether it must hold; conjunctions of these; clauses are alternatives of conjunctions.
Literal = tuple[Test, bool]
Conjunction = tuple[Literal, ...]
Clause = tuple[Conjunction, ...]


class TooWide(ValueError):
    """A rule whose clauses would multiply out to too many conjunctions."""


# ---------------------------------------------------------------- rule -> clauses


def _network(text: str) -> str:
    network = ipaddress.ip_network(text, strict=False)
    digits = 8 if network.version == 4 else 32
    show = lambda address: f"{network.version}{int(address):0{digits}x}"
    return f"{show(network.network_address)}-{show(network.broadcast_address)}"


def _address(text: Column) -> Column:
    """An address in the form that networks are compared in."""
    v4 = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_number(text))), 8, "0"))
    return F.coalesce(v4, F.concat(F.lit("6"), ipv6_hex(text)))


def _one(field: int, value: str | None, comparison: str) -> tuple[str, str]:
    """Kind and text of one value."""
    if value is None:
        return "null", ""
    if comparison == "equals" and value == "":
        return "empty", ""
    if comparison == "exists":
        return ("present" if str(value).lower() in ("true", "yes", "1") else "null"), ""
    if comparison == "cidr":
        return "cidr", _network(value)
    if comparison in ("re", "re_i", "encoded"):
        return comparison, value
    tokens = wildcard_tokens(value)
    if not any(wild for wild, _ in tokens):
        return comparison, "".join(text for _, text in tokens).lower()
    escaped = lambda text: "".join("\\" + c if c in "%_\\" else c for c in text.lower())
    body = "".join({"*": "%", "?": "_"}[text] if wild else escaped(text) for wild, text in tokens)
    start = "%" if comparison in ("contains", "endswith") else ""
    end = "%" if comparison in ("contains", "startswith") else ""
    return "like", start + body + end


def _any_value(field: int, values: list[str | None], comparison: str) -> Node:
    by_kind: dict[str, list[str]] = {}
    for value in values:
        kind, text = _one(field, value, comparison)
        by_kind.setdefault(kind, []).append(text)
    return Node("or", tuple(Test(field, kind, tuple(dict.fromkeys(texts))) for kind, texts in by_kind.items()))


def _key_node(name_key: str, value, fields: FieldSet, placeholders: dict[str, list[str]] | None) -> Node:
    """One key of a selection."""
    name, *modifiers = name_key.split("|")
    field, values = fields.index[name], _values(value)
    fold = "and" if "all" in modifiers else "or"
    if "fieldref" in modifiers:
        return Node(fold, tuple(Test(field, "field", (str(fields.index[str(v)]),)) for v in values))
    groups, comparison = expand_values(values, modifiers, placeholders)
    if fold == "or":
        return _any_value(field, [v for group in groups for v in group], comparison)
    return Node("and" if groups else "or", tuple(_any_value(field, group, comparison) for group in groups))


def _selection_node(body, fields: FieldSet, placeholders: dict[str, list[str]] | None) -> Node:
    if isinstance(body, dict):
        return Node("and" if body else "or", tuple(_key_node(k, v, fields, placeholders) for k, v in body.items()))
    if isinstance(body, list):
        return Node("or", tuple(_selection_node(part, fields, placeholders) for part in body))
    return _any_value(len(fields.names), [str(body)], "contains")


def clauses(node: Node | Test, selections: dict[str, Node], holds: bool = True) -> list[Clause]:
    """Clauses that must all hold, each of them an alternative of conjunctions; no clause at all always holds."""
    if isinstance(node, Test):
        return [(((node, holds),),)]
    if isinstance(node, str):
        return clauses(selections[node], selections, holds)
    if node.kind == "not":
        return clauses(node.parts[0], selections, not holds)
    parts = [clauses(part, selections, holds) for part in node.parts]
    if (node.kind == "and") == holds:
        return [clause for part in parts for clause in part]
    alternatives: list[Conjunction] = []
    for part in parts:
        size = 1
        for clause in part:
            size *= len(clause)
        if len(alternatives) + size > WIDEST:
            raise TooWide("too many alternatives")
        alternatives += [tuple(x for conjunction in chosen for x in conjunction) for chosen in product(*part)]
    return [tuple(dict.fromkeys(alternatives))]


def rule_clauses(rule: Rule, fields: FieldSet, placeholders: dict[str, list[str]] | None = None) -> list[Clause]:
    selections = {name: _selection_node(body, fields, placeholders) for name, body in rule.selections.items()}
    return clauses(condition_tree(split_count(rule.condition)[0], list(selections)), selections)


# ---------------------------------------------------------------- keys


def pattern_texts(pattern: str) -> list[str]:
    """Runs of fixed characters, lower-cased, that every match of a regular expression has; none where it reads otherwise in Python."""
    if re.search(r"\\[0-9QEcpP]", pattern):
        return []
    try:
        parsed = re_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    runs, run = [], ""
    for kind, value in parsed:
        if kind is re_constants.LITERAL:
            run += chr(value).lower()
            continue
        runs.append(run)
        run = ""
    return [r for r in (*runs, run) if r]


def _pieces(test: Test) -> Iterator[str]:
    """The longest fixed text of each value, lower-cased; "" where there is none."""
    for value in test.values:
        if test.kind in ("contains", "startswith", "endswith"):
            yield value
        elif test.kind == "encoded":
            yield value.lower()
        elif test.kind == "like":
            yield max(value.replace("\\%", "%%").replace("\\_", "%%").replace("\\\\", "%%").replace("_", "%").split("%"), key=len)
        elif test.kind in ("re", "re_i"):
            yield max(pattern_texts(value), key=len, default="")
        else:
            yield ""


def _literal_keys(literal: Literal, common: Counter[str]) -> dict[str, int] | None:
    """Keys without one of which the literal cannot hold, and how many rules mention each; None where none can be named."""
    test, holds = literal
    if not holds:
        return None
    if test.kind == "equals":
        return {key: common[key] for key in (f"{test.field}={v}" for v in test.values)}
    found = [rarest(piece, common) for piece in _pieces(test)]
    return None if None in found else {f"{test.field}~{g}": common[g] for g in found}


def _mentioned(rule: list[Clause]) -> set[str]:
    """Every gram and whole value that the rule's literals have."""
    tests = {t for clause in rule for conjunction in clause for t, holds in conjunction if holds}
    whole = {f"{t.field}={v}" for t in tests if t.kind == "equals" for v in t.values}
    return whole.union(*(grams(piece) for t in tests for piece in _pieces(t)))


def _cheapest(options: list[dict[str, int] | None]) -> dict[str, int] | None:
    return min((o for o in options if o is not None), key=lambda o: (sum(o.values()), sorted(o)), default=None)


def rule_keys(rule: list[Clause], common: Counter[str]) -> list[str] | None:
    """The keys a rule is filed under: of the clause whose keys are the rarest."""
    options = []
    for clause in rule:
        of_conjunctions = [_cheapest([_literal_keys(x, common) for x in conjunction]) for conjunction in clause]
        options.append(None if None in of_conjunctions else {k: n for keys in of_conjunctions for k, n in keys.items()})
    best = _cheapest(options)
    return None if best is None else sorted(best)


# ---------------------------------------------------------------- evaluation

_INDEX = "_key string, _rule int"
_PROGRAMS = (
    "_rule int, rule_id string, _source int, _by int, _counts int, _own_keys array<string>, "
    "_tests array<struct<field:int,kind:int,values:array<string>>>, _clauses array<array<array<int>>>"
)


@dataclass
class Bundle:
    """Rules as rows, and what a row of events needs to meet them."""

    fields: FieldSet
    sources: list[dict]
    programs: list[tuple]
    index: list[tuple[str, int]]
    left_out: list[Rule]

    @property
    def chars(self) -> int:
        return sum(len(repr(p)) for p in self.programs) + sum(len(k) + 8 for k, _ in self.index)


def compile_bundle(
    rules: list[Rule], route: bool = False, placeholders: dict[str, list[str]] | None = None, mapping: dict[str, str] | None = None
) -> Bundle:
    """The rules that can be data; those that cannot, as they are too wide, are ``left_out``; untranslatable ones go."""
    usable = []
    for rule in rules:
        try:
            rule.timeframe  # noqa: B018
            usable.append((rule, rule.field_names()))
        except ValueError:
            continue
    names = set().union(*(n for _, n in usable))
    fields = FieldSet(names, any(r.has_keywords() for r, _ in usable), mapping)
    compiled, left_out = [], []
    for rule, _ in usable:
        try:
            compiled.append((rule, rule_clauses(rule, fields, placeholders)))
        except TooWide:
            left_out.append(rule)
        except (ValueError, KeyError, TypeError):
            continue
    common = Counter(key for _, own in compiled for key in _mentioned(own))
    sources: dict[tuple, int] = {}
    programs, index = [], []
    for number, (rule, own) in enumerate(compiled):
        source = sources.setdefault(tuple(sorted(rule.logsource.items())) if route else (), len(sources))
        keys = rule_keys(own, common)
        keys = [f"source{source}"] if keys is None else keys
        numbers: dict[Test, int] = {}
        number_of = lambda t: numbers.setdefault(t, len(numbers) + 1)  # noqa: B023, E731
        packed = [[[number_of(t) if holds else -number_of(t) for t, holds in conjunction] for conjunction in clause] for clause in own]
        rows = [(t.field, _KIND[t.kind], list(t.values)) for t in numbers]
        count = rule.count_test
        place = lambda name: fields.index[name] if name else None
        programs.append((number, rule.rule_id, source, place(count and count.by), place(count and count.field), keys, rows, packed))
        index += [(key, number) for key in keys]
    return Bundle(fields, [dict(s) for s in sources], programs, index, left_out)


def _fits(test: Column, lowers: Column, texts: Column, addresses: Column) -> Column:
    """One test on the row's fields."""
    field = test["field"]
    lower, text, address = F.get(lowers, field), F.get(texts, field), F.get(addresses, field)

    def one(value: Column) -> Column:
        kinds = {
            "equals": lower == value,
            "contains": lower.contains(value),
            "startswith": lower.startswith(value),
            "endswith": lower.endswith(value),
            "like": F.like(lower, value),
            "re": F.rlike(text, value),
            "re_i": F.rlike(text, F.concat(F.lit("(?i)"), value)),
            "cidr": address.between(F.substring_index(value, "-", 1), F.substring_index(value, "-", -1)),
            "encoded": text.contains(value),
            "null": text.isNull(),
            "present": text.isNotNull(),
            "empty": text == "",
            "field": lower == F.get(lowers, value.cast("int")),
        }
        chosen = F.lit(False)
        for name, holds in reversed(kinds.items()):
            chosen = F.when(test["kind"] == _KIND[name], holds).otherwise(chosen)
        return F.coalesce(chosen, F.lit(False))

    return F.exists(test["values"], one)


def _holds(tests: Column, clauses: Column, lowers: Column, texts: Column, addresses: Column) -> Column:
    """All clauses of a rule, up to the first that does not hold."""
    literal = lambda x: _fits(F.get(tests, F.abs(x) - 1), lowers, texts, addresses) == (x > 0)
    return F.forall(clauses, lambda clause: F.exists(clause, lambda c: F.forall(c, literal)))


def _keys_of_row(bundle: Bundle, lower: list[Column], sources: Column) -> Column:
    """The index keys that a row has."""
    by_field: dict[tuple[int, str], list[str]] = {}
    plain = []
    for key in sorted({k for k, _ in bundle.index}):
        cut = next((i for i, c in enumerate(key) if c in "~="), None)
        if key.startswith("source") or cut is None:
            plain.append(key)
        else:
            by_field.setdefault((int(key[:cut]), key[cut]), []).append(key[cut + 1 :])
    nothing = F.array().cast("array<string>")
    parts = [F.filter(F.transform(sources, lambda s: F.concat(F.lit("source"), s.cast("string"))), lambda k: k.isin(plain))] if plain else [nothing]
    for (field, kind), known in by_field.items():
        prefix, value = F.lit(f"{field}{kind}"), lower[field]
        if kind == "=":
            parts.append(F.when(value.isin(known), F.array(F.concat(prefix, value))).otherwise(nothing))
        else:
            parts.append(F.transform(found_grams(value, known), lambda g: F.concat(prefix, g)))  # noqa: B023
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def bundle_rows(events: DataFrame, bundle: Bundle, keep: list[str], counting: bool = False) -> DataFrame:
    """One row per (event, rule) hit of the bundle's rules; ``counting`` adds key and value of count tests, by and value.

    A row is spread over its index keys only; the index and the rules' data are broadcast up to
    ``BROADCAST_CHARS`` characters. A rule filed under several keys is evaluated at the first one the row has.
    """
    spark, fields = events.sparkSession, bundle.fields
    extra = [c for c in ("eventId", "source", "platform") if any(bundle.sources) and c not in keep]
    frame = fields.project(events, [*keep, *extra])
    count = len(fields.names)
    lower = [F.col(f"_l{i}") for i in range(count)] + [F.col("_raw")] * fields.keywords
    text = [F.col(f"_f{i}") for i in range(count)] + [F.col("_raw")] * fields.keywords
    networked = {t[0] for p in bundle.programs for t in p[6] if t[1] == _KIND["cidr"]}
    nothing = F.lit(None).cast("string")
    address = [_address(c) if i in networked else nothing for i, c in enumerate(text)]
    strings = lambda columns: F.array(*columns).cast("array<string>")
    holding = [F.when(route_test(s), F.lit(i)) if s else F.lit(i) for i, s in enumerate(bundle.sources)]
    sources = F.array_compact(F.array(*holding)).cast("array<int>")
    frame = frame.select(*keep, strings(lower).alias("_lowers"), strings(text).alias("_texts"), strings(address).alias("_addresses"), sources.alias("_sources"))
    fresh = [F.get("_lowers", F.lit(i)) for i in range(len(lower))]
    frame = frame.withColumn("_keys", _keys_of_row(bundle, fresh, F.col("_sources")))
    rows = spread(frame, [*keep, "_lowers", "_texts", "_addresses", "_sources", "_keys"], F.col("_keys"), "_key")
    sized = F.broadcast if bundle.chars <= BROADCAST_CHARS else (lambda df: df)
    index = sized(spark.createDataFrame(bundle.index, _INDEX))
    programs = sized(spark.createDataFrame(bundle.programs, _PROGRAMS))
    met = rows.join(index, "_key").join(programs, "_rule")
    first = F.col("_key") == F.element_at(F.array_intersect("_keys", "_own_keys"), 1)
    met = met.filter(first & F.array_contains("_sources", F.col("_source")))
    arrays = [F.col(c) for c in ("_tests", "_clauses", "_lowers", "_texts", "_addresses")]
    more = [F.get("_texts", F.col("_by")).alias("by"), F.get("_texts", F.col("_counts")).alias("value")] if counting else []
    return met.filter(_holds(*arrays)).select(*keep, "rule_id", *more)

"""Rule conditions: named selections combined into one boolean Column."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import Column

from emberwatch.operators.predicates import all_of, any_of, two_valued


@dataclass(frozen=True)
class CountTest:
    """``| count(field) by key > n`` at the end of a condition."""

    field: str | None
    by: str | None
    operator: str
    threshold: int

    def holds(self, count: Column) -> Column:
        return {
            ">": count > self.threshold,
            "<": count < self.threshold,
            ">=": count >= self.threshold,
            "<=": count <= self.threshold,
            "=": count == self.threshold,
            "==": count == self.threshold,
        }[self.operator]


_COUNT = re.compile(r"^\s*count\(\s*(\w*)\s*\)\s*(?:by\s+(\w+)\s*)?(>=|<=|==|=|>|<)\s*(\d+)\s*$", re.IGNORECASE)
_QUANTIFIER = re.compile(r"\b(1|any|all)\s+of\s+(them|[\w*]+)", re.IGNORECASE)


def selected(names: list[str], pattern: str) -> list[str]:
    """Selection names a quantifier speaks of; ``them`` leaves out names with a leading underscore."""
    if pattern.lower() == "them":
        return [n for n in names if not n.startswith("_")]
    return [n for n in names if fnmatchcase(n, pattern)]


def split_count(condition: str) -> tuple[str, CountTest | None]:
    """Separate the boolean part of a condition from a trailing count test."""
    head, bar, tail = condition.partition("|")
    if not bar:
        return condition, None
    match = _COUNT.match(tail)
    if not match:
        raise ValueError(f"unsupported aggregation: {tail.strip()}")
    field, by, operator, number = match.groups()
    return head, CountTest(field or None, by, operator, int(number))


_NAME = re.compile(r"[\w*.-]+")


@dataclass(frozen=True)
class Node:
    """``and``, ``or`` or ``not`` over parts, which are nodes or names of selections; ``or`` of nothing is never true."""

    kind: str
    parts: tuple[Node | str, ...]


def condition_tree(text: str, names: list[str]) -> Node | str:
    """``sel and not 1 of filter_*`` as a tree over selection names.

    Quantifiers become terms of their own, and every term a neutral name; the
    rest is the grammar of Python's boolean expressions, so Python's ``ast``
    gives precedence and brackets, whatever the selections are called.
    """
    terms: list[Node | str] = list(names)
    places = {name.lower(): i for i, name in enumerate(names)}

    def quantified(match: re.Match) -> str:
        amount, pattern = match.groups()
        chosen = tuple(selected(names, pattern))
        terms.append(Node("and" if chosen and amount.lower() == "all" else "or", chosen))
        places[f"quantified{len(terms)}"] = len(terms) - 1
        return f"quantified{len(terms)}"

    def neutral(match: re.Match) -> str:
        word = match.group().lower()
        if word in places:
            return f"term{places[word]}"
        if word in ("and", "or", "not"):
            return word
        raise ValueError(f"unknown selection {word} in condition: {text}")

    try:
        tree = ast.parse(_NAME.sub(neutral, _QUANTIFIER.sub(quantified, text)).strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"unsupported condition: {text}") from error

    def fold(node: ast.expr) -> Node | str:
        if isinstance(node, ast.BoolOp):
            return Node("and" if isinstance(node.op, ast.And) else "or", tuple(fold(value) for value in node.values))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return Node("not", (fold(node.operand),))
        if isinstance(node, ast.Name):
            return terms[int(node.id.removeprefix("term"))]
        raise ValueError(f"unsupported condition: {text}")

    return fold(tree)


def condition(text: str, selections: dict[str, Column]) -> Column:
    """The tree of a condition as one Column."""

    def fold(node: Node | str) -> Column:
        if isinstance(node, str):
            return two_valued(selections[node])
        parts = [fold(part) for part in node.parts]
        if node.kind == "not":
            return ~parts[0]
        return all_of(parts) if node.kind == "and" else any_of(parts)

    return fold(condition_tree(text, list(selections)))

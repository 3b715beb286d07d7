"""Rule predicates: each builder turns a field and its values into a boolean Column.

Text comparisons ignore case, except regular expressions and base64 forms.
Predicates are two-valued: an absent field gives False, so NOT gives True.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.net import in_networks
from emberwatch.functions.text import base64_literal, base64_offset_literals, like_pattern

#: The dashes a command-line flag may start with.
DASHES = ["-", "/", "–", "—", "―"]


@dataclass(frozen=True)
class Field:
    """A field as text and, computed once per row, in lower case."""

    text: Column
    lower: Column

    @staticmethod
    def of(column: Column) -> Field:
        return Field(column, F.lower(column))


def two_valued(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(False)


def wildcard_tokens(value: str) -> list[tuple[bool, str]]:
    """Split a value into (is_wildcard, text). A backslash keeps a wildcard or backslash literal."""
    tokens: list[tuple[bool, str]] = []
    position = 0
    while position < len(value):
        char = value[position]
        following = value[position + 1 : position + 2]
        if char == "\\" and following in ("*", "?", "\\") and following:
            tokens.append((False, following))
            position += 2
        else:
            tokens.append((char in "*?", char))
            position += 1
    return tokens


def _like(field: Field, tokens: list[tuple[bool, str]], prefix: str, suffix: str) -> Column:
    wild = {"*": "%", "?": "_"}
    pattern = "".join(wild[t] if is_wild else like_pattern(t.lower()) for is_wild, t in tokens)
    return field.lower.like(prefix + pattern + suffix)


def _text_match(field: Field, value: str, place: str) -> Column:
    tokens = wildcard_tokens(value)
    if any(is_wild for is_wild, _ in tokens):
        open_start = "%" if place in ("contains", "endswith") else ""
        open_end = "%" if place in ("contains", "startswith") else ""
        return _like(field, tokens, open_start, open_end)
    literal = "".join(text for _, text in tokens).lower()
    if place == "contains":
        return field.lower.contains(literal)
    if place == "startswith":
        return field.lower.startswith(literal)
    if place == "endswith":
        return field.lower.endswith(literal)
    return field.lower == literal


def match_equals(field: Field, value: str) -> Column:
    return _text_match(field, value, "equals")


def match_contains(field: Field, value: str) -> Column:
    return _text_match(field, value, "contains")


def match_startswith(field: Field, value: str) -> Column:
    return _text_match(field, value, "startswith")


def match_endswith(field: Field, value: str) -> Column:
    return _text_match(field, value, "endswith")


def match_regex(field: Field, value: str) -> Column:
    return field.text.rlike(value)


def match_regex_ignore_case(field: Field, value: str) -> Column:
    return field.text.rlike("(?i)" + value)


def match_network(field: Field, value: str) -> Column:
    return in_networks(field.text, [value])


def match_exact_text(field: Field, value: str) -> Column:
    """Case-sensitive substring, used for encoded forms."""
    return field.text.contains(value)


def match_exists(field: Field, value: str) -> Column:
    present = field.text.isNotNull()
    return present if str(value).lower() in ("true", "yes", "1") else ~present


def match_null(field: Field) -> Column:
    return field.text.isNull()


def match_empty(field: Field) -> Column:
    return two_valued(field.text == "")


def match_field(field: Field, other: Field) -> Column:
    return field.lower == other.lower


def dash_variants(value: str) -> list[str]:
    """Each flag dash (a dash at the start of a word) replaced by every known dash."""
    variants = [value]
    for dash in DASHES:
        text = "".join(
            dash if char in DASHES and (i == 0 or value[i - 1].isspace()) else char for i, char in enumerate(value)
        )
        if text not in variants:
            variants.append(text)
    return variants


#: Last modifier -> how one value is compared.
COMPARISONS: dict[str, Callable[[Field, str], Column]] = {
    "equals": match_equals,
    "contains": match_contains,
    "startswith": match_startswith,
    "endswith": match_endswith,
    "re": match_regex,
    "re_i": match_regex_ignore_case,
    "cidr": match_network,
    "exists": match_exists,
    "encoded": match_exact_text,
}

_WIDE = {"wide": "utf-16-le", "utf16le": "utf-16-le", "utf16be": "utf-16-be"}


def expand_values(
    values: list[str | None], modifiers: list[str], placeholders: dict[str, list[str]] | None = None
) -> tuple[list[list[str | None]], str]:
    """Apply value modifiers on the driver; return the literals and the comparison's name.

    Every value becomes a group of equivalent forms: one of them is enough,
    also under ``all``.
    """
    groups: list[list[str | None]] = [[value] for value in values]
    comparison = "equals"
    charset = "utf-8"
    for modifier in modifiers:
        if modifier == "expand":
            names = [str(value).strip("%") for group in groups for value in group]
            groups = [[replacement] for name in names for replacement in (placeholders or {}).get(name, [])]
        elif modifier == "windash":
            groups = [[form for value in group for form in dash_variants(str(value))] for group in groups]
        elif modifier in _WIDE:
            charset = _WIDE[modifier]
        elif modifier == "base64":
            groups = [[base64_literal(str(value).encode(charset)) for value in group] for group in groups]
            comparison = "encoded"
        elif modifier == "base64offset":
            groups = [
                [form for value in group for form in base64_offset_literals(str(value).encode(charset))]
                for group in groups
            ]
            comparison = "encoded"
        elif modifier == "i" and comparison == "re":
            comparison = "re_i"
        elif modifier == "contains" and comparison == "encoded":
            continue
        elif modifier in COMPARISONS:
            comparison = modifier
        elif modifier not in ("all", "fieldref"):
            raise ValueError(f"unknown modifier {modifier}")
    return groups, comparison


def predicate(
    field: Field,
    values: list[str | None],
    modifiers: list[str] | None = None,
    placeholders: dict[str, list[str]] | None = None,
    other: Callable[[str], Field] | None = None,
) -> Column:
    """One condition of a rule: field, modifiers and values to a boolean Column."""
    modifiers = modifiers or []
    combine = all_of if "all" in modifiers else any_of
    if "fieldref" in modifiers:
        return combine([two_valued(match_field(field, other(str(v)))) for v in values])
    groups, comparison = expand_values(values, modifiers, placeholders)

    def is_plain(value: str | None) -> bool:
        return bool(value) and not any(is_wild for is_wild, _ in wildcard_tokens(value))

    if comparison == "equals" and "all" not in modifiers:
        # one hash lookup instead of one comparison per value
        every = [value for group in groups for value in group]
        exact = ["".join(text for _, text in wildcard_tokens(v)).lower() for v in every if is_plain(v)]
        tests = [two_valued(field.lower.isin(exact))] if exact else []
        return any_of(tests + [one_value(field, v, comparison) for v in every if not is_plain(v)])
    if comparison == "cidr" and "all" not in modifiers:
        # the address is read once for all networks
        return two_valued(in_networks(field.text, [value for group in groups for value in group]))
    return combine([any_of([one_value(field, v, comparison) for v in group]) for group in groups])


def one_value(field: Field, value: str | None, comparison: str) -> Column:
    if value is None:
        return match_null(field)
    if comparison == "equals" and value == "":
        return match_empty(field)
    return two_valued(COMPARISONS[comparison](field, value))

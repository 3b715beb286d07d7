"""Free-text search over events: filters, hits, snippets, saved queries, hunts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import occurrences, quote_regex
from emberwatch.operators.predicates import any_of, two_valued
from emberwatch.operators.skew import spread

#: The searched fields, the snippet's width, how many saved queries are kept.
SEARCH_FIELDS = ["rawLine", "message", "source", "computer", "eventId", "user", "processName", "processCmd"]
CONTEXT = 60
SAVED_QUERIES = 40


def usable_regex(pattern: str) -> bool:
    """An invalid pattern finds nothing rather than failing the job."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def text_matches(text: Column, query: str, regex: bool = False) -> Column:
    if not query:
        return F.lit(False)
    if not regex:
        return F.lower(text).contains(query.lower())
    return text.rlike("(?i)" + query) if usable_regex(query) else F.lit(False)


def event_matches(query: str, regex: bool = False, fields: list[str] | None = None, data: bool = True) -> Column:
    """Any searched field or event data value of the event matches."""
    tests = [two_valued(text_matches(F.col(n).cast("string"), query, regex)) for n in fields or SEARCH_FIELDS]
    if data:
        tests.append(two_valued(F.exists(F.map_values("eventData"), lambda v: text_matches(v, query, regex))))
    return any_of(tests)


def searched_fields(events: DataFrame, key: str, fields: list[str] | None = None, data: bool = True) -> DataFrame:
    """Events as (key, field, text) rows."""
    fixed = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("text")) for n in fields or SEARCH_FIELDS]
    )
    if data:
        entries = F.transform(
            F.map_entries("eventData"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("text"))
        )
        fixed = F.concat(fixed, F.coalesce(entries, F.array().cast("array<struct<field:string,text:string>>")))
    return events.select(key, F.inline(fixed)).filter(F.col("text") != "")


def hits(fields: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """One row per occurrence: start, end, matched text and snippet of (.., field, text) rows."""
    if not query or (regex and not usable_regex(query)):
        return fields.limit(0).withColumns(
            {"start": F.lit(0), "end": F.lit(0), "match": F.lit(""), "context": F.lit("")}
        )
    pattern = "(?i)" + (query if regex else quote_regex(query))
    wanted = fields.filter(text_matches(F.col("text"), query, regex))
    found = spread(wanted, ["*"], occurrences(F.col("text"), pattern), "_hit").filter(F.length("_hit.text") > 0)
    start = F.col("_hit.start")
    end = start + F.length("_hit.text")
    return found.select(
        *fields.columns, start.alias("start"), end.alias("end"), F.col("_hit.text").alias("match")
    ).withColumn("context", snippet(F.col("text"), F.col("start"), F.col("end")))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """The hit with its surroundings, marked."""
    left = F.greatest(start - CONTEXT, F.lit(0))
    right = F.least(end + CONTEXT, F.length(text))
    between = lambda a, b: F.substr(text, a + 1, b - a)
    return F.concat(
        F.when(left > 0, F.lit("...")).otherwise(F.lit("")),
        between(left, start),
        F.lit("<mark>"),
        between(start, end),
        F.lit("</mark>"),
        between(end, right),
        F.when(right < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )


@dataclass(frozen=True)
class SavedQuery:
    query_id: str
    query: str
    regex: bool
    created_at: str


def kept_queries(queries: list[SavedQuery]) -> list[SavedQuery]:
    """What the store keeps when a query is added: the newest ones."""
    return sorted(queries, key=lambda q: (q.created_at, q.query_id), reverse=True)[:SAVED_QUERIES]


def run_saved(events: DataFrame, queries: list[SavedQuery], key: str, text: Column) -> DataFrame:
    """(key, query_id) for every saved query that finds the event; one scan, no join."""
    tests = [F.when(two_valued(text_matches(text, q.query, q.regex)), F.lit(q.query_id)) for q in queries]
    return spread(events, [key], F.array_compact(F.array(*tests)), "query_id")


@dataclass(frozen=True)
class Playbook:
    playbook_id: str
    keywords: tuple[str, ...]
    query: str


#: The hunts.
PLAYBOOKS = [
    Playbook("lateral-movement", ("lateral", "psexec", "wmi", "remote", "t1021"), r"psexec|wmic|winrm|\\"),
    Playbook("credential-dumping", ("credential", "lsass", "sam", "dump", "t1003"), r"lsass|sekurlsa|sam|mimikatz"),
    Playbook("persistence", ("persistence", "runkey", "scheduled", "autorun", "t1547"), r"run\\|schtasks|startup|service"),
]


def hunt_rules(rules: DataFrame, playbooks: list[Playbook] = PLAYBOOKS) -> DataFrame:
    """Rules whose tags hold a hunt's keyword: (playbook_id, rule_id)."""

    def tagged(playbook: Playbook) -> Column:
        return F.exists("tags", lambda t: any_of([F.lower(t).contains(k) for k in playbook.keywords]))

    tests = [F.when(tagged(p), F.lit(p.playbook_id)) for p in playbooks]
    return spread(rules, ["rule_id"], F.array_compact(F.array(*tests)), "playbook_id")


def hunt_events(events: DataFrame, key: str, text: Column, playbooks: list[Playbook] = PLAYBOOKS) -> DataFrame:
    """Events that a hunt's query finds: (playbook_id, key)."""
    tests = [F.when(two_valued(text.rlike("(?i)" + p.query)), F.lit(p.playbook_id)) for p in playbooks]
    return spread(events, [key], F.array_compact(F.array(*tests)), "playbook_id")


def process_search(names: DataFrame, query: str, name: str, position: str, limit: int = 25) -> DataFrame:
    """Process names holding the query, grouped without case, most frequent first."""
    lowered = F.lower(F.col(name))
    if len(query.strip()) == 0 or len(query) < 2:
        names = names.limit(0)
    grouped = (
        names.filter(lowered.contains(query.lower()))
        .groupBy(lowered.alias("lowered"))
        .agg(F.min_by(name, position).alias("name"), F.count(F.lit(1)).alias("n"))
    )
    return grouped.orderBy(F.col("n").desc(), "lowered").limit(limit).select("name", "n")

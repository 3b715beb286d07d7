"""Literal signatures over log files.

A file matches a signature when its text holds the anchor, none of the
exclusions and at least ``min_matches`` of the literals. Literals are tested
per event and only the hit numbers are grouped by file, so a file's text is
never put together, whatever its size.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.grams import found_grams, grams, rarest
from emberwatch.operators.skew import first_n, once, spread

#: Fixed value: literals and events shown per file and signature; nothing is decided on them.
SHOWN = 8

#: Literals that are searched for one by one.
FEW = 64

#: Fixed value: events without a source file belong to this one.
NO_FILE = "uploaded-data"


@dataclass(frozen=True)
class Signature:
    rule_id: str
    anchor: str
    literals: tuple[str, ...]
    min_matches: int
    exclusions: tuple[str, ...] = ()


def event_text(columns: list[Column]) -> Column:
    """The searched text of an event, lower-cased."""
    return F.lower(F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in columns]))


def log_event_text() -> Column:
    """The seven text fields of the event schema and every event data value."""
    names = ["rawLine", "message", "processName", "processCmd", "source", "host", "computer"]
    data = F.array_join(F.coalesce(F.map_values("eventData"), F.array().cast("array<string>")), "\n")
    return event_text([F.col(n) for n in names] + [data])


def _usable(signatures: list[Signature]) -> list[Signature]:
    return [s for s in signatures if s.anchor and s.literals]


def _needles(signatures: list[Signature]) -> list[str]:
    return sorted({n for s in signatures for n in (s.anchor, *s.literals, *s.exclusions)})


def _listed(values: list[str]) -> Column:
    """Texts as one constant array, whatever their number."""
    return F.split(F.lit("\0".join(values)), "\0") if values else F.array().cast("array<string>")


def hits(text: Column, needles: list[str]) -> Column:
    """Numbers of the literals found in the text.

    One pass over the text's grams finds the literals whose rarest gram it has, and only these are searched for.
    Literals shorter than a gram, or with a zero character, are searched for one by one, as are all of up to
    ``FEW``: so many searches cost less than the pass.
    """
    common = Counter(g for n in needles for g in set(grams(n)))
    filed: dict[str, list[int]] = {}
    alone = []
    for i, needle in enumerate(needles):
        gram = rarest(needle, common) if "\0" not in needle and len(needles) > FEW else None
        if gram is None:
            alone.append(i)
        else:
            filed.setdefault(gram, []).append(i)
    known = sorted(filed)
    # the needles of a gram stand together: a gram names the first of them and their number
    order = [i for g in known for i in filed[g]]
    starts = dict(zip(known, accumulate([0, *(len(filed[g]) for g in known)])))
    texts, grams_, first = _listed([needles[i] for i in order]), _listed(known), _listed([str(starts[g]) for g in known])
    number, size = _listed([str(i) for i in order]), _listed([str(len(filed[g])) for g in known])

    def of_gram(g: Column) -> Column:
        at = F.array_position(grams_, g).cast("int") - 1
        start = F.get(first, at).cast("int")
        return F.sequence(start, start + F.get(size, at).cast("int") - 1)

    places = F.filter(F.flatten(F.transform(found_grams(text, known), of_gram)), lambda p: text.contains(F.get(texts, p)))
    found = F.transform(places, lambda p: F.get(number, p).cast("int")) if known else F.array().cast("array<int>")
    if not alone:
        return found
    return F.concat(found, F.array_compact(F.array(*[F.when(text.contains(needles[i]), F.lit(i)) for i in alone])))


def _tables(events: DataFrame, signatures: list[Signature], needles: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a literal is to which rule, and the rules; both are the driver's own, and broadcast."""
    number = {n: i for i, n in enumerate(needles)}
    roles, rules = [], []
    for i, s in enumerate(signatures):
        own = {"anchor": (s.anchor,), "literal": s.literals, "exclusion": s.exclusions}
        roles += [(number[n], i, role) for role, names in own.items() for n in dict.fromkeys(names)]
        rules.append((i, s.rule_id, [number[n] for n in s.literals], list(s.literals), [number[n] for n in s.exclusions], s.min_matches))
    spark = events.sparkSession
    return (
        F.broadcast(spark.createDataFrame(roles, "needle int, rule int, role string")),
        F.broadcast(
            spark.createDataFrame(
                rules, "rule int, rule_id string, literals array<int>, texts array<string>, exclusions array<int>, min_matches int"
            )
        ),
    )


def _matched(found: str) -> Column:
    """The rule's literals among the found numbers, as texts, in the rule's order."""
    pairs = F.filter(F.arrays_zip("literals", "texts"), lambda p: F.array_contains(found, p["literals"]))
    return F.transform(pairs, lambda p: p["texts"])


def scan(events: DataFrame, signatures: list[Signature], file: str, text: Column) -> DataFrame:
    """Matched (file, rule) pairs with all literals found and the file's event count.

    The shuffles carry rows per (file, literal) and per (file, rule), never text; rules come in as rows,
    so their number does not widen the plan.
    """
    signatures = _usable(signatures)
    needles = _needles(signatures)
    roles, rules = _tables(events, signatures, needles)
    source = F.coalesce(F.nullif(F.col(file), F.lit("")), F.lit(NO_FILE)).alias("source_file")
    found = once(events.select(source, text.alias("_text")), hits(F.col("_text"), needles), "hits")
    # number -1 counts the file's events in the same pass
    exploded = spread(found, ["source_file"], F.array_append("hits", F.lit(-1)), "needle")
    counted = exploded.groupBy("source_file", "needle").agg(F.count(F.lit(1)).alias("n"))
    is_role = lambda role: F.col("role") == role
    pairs = counted.join(roles, "needle").groupBy("source_file", "rule").agg(
        F.bool_or(is_role("anchor")).alias("anchored"),
        F.bool_or(is_role("exclusion")).alias("excluded"),
        F.collect_set(F.when(is_role("literal"), F.col("needle"))).alias("found"),
    )
    pairs = pairs.filter(F.col("anchored") & ~F.col("excluded")).join(rules, "rule")
    pairs = pairs.withColumn("matched_literals", _matched("found")).filter(F.size("matched_literals") >= F.col("min_matches"))
    totals = counted.filter(F.col("needle") == -1).select("source_file", F.col("n").alias("event_count"))
    return pairs.join(totals, "source_file").select("rule_id", "source_file", "event_count", "min_matches", "matched_literals")


def enough_by_itself(
    events: DataFrame, files: DataFrame, signatures: list[Signature], file: str, text: Column, key: str
) -> DataFrame:
    """The events of matched files that hold enough literals by themselves: (rule_id, source_file, key, event_literals).

    An event meets the rules of its literals, each at the first literal that it has, so nothing is grouped.
    """
    signatures = _usable(signatures)
    needles = _needles(signatures)
    roles, rules = _tables(events, signatures, needles)
    source = F.coalesce(F.nullif(F.col(file), F.lit("")), F.lit(NO_FILE)).alias("source_file")
    found = once(events.select(key, source, text.alias("_text")), hits(F.col("_text"), needles), "hits")
    met = spread(found, [key, "source_file", "hits"], F.col("hits"), "needle")
    met = met.join(roles.filter(F.col("role") == "literal"), "needle").join(rules, "rule")
    met = met.filter(F.col("needle") == F.element_at(F.array_intersect("hits", "literals"), 1))
    met = met.withColumn("event_literals", _matched("hits"))
    passing = ~F.arrays_overlap("hits", "exclusions") & (F.size("event_literals") >= F.col("min_matches"))
    found = met.filter(passing).select("rule_id", "source_file", key, "event_literals")
    return found.join(files.select("rule_id", "source_file"), ["rule_id", "source_file"], "left_semi")


def shown_events(found: DataFrame, key: str, shown: int = SHOWN) -> DataFrame:
    """Of each file and rule the first ``shown`` events, with as many of their literals, for display."""
    first = first_n(found, ["rule_id", "source_file"], [F.col(key)], shown, F.col(key))
    return first.withColumn("event_literals", F.slice("event_literals", 1, shown))


def passing_rules(files: DataFrame, events: DataFrame, strictness: str) -> DataFrame:
    """Rules that hold up under ``permissive``, ``balanced`` or ``strict``, by number of files.

    Counts all files, all their literals and all events (``enough_by_itself``).
    """
    n_events = events.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_events"))
    literals = files.select("rule_id", F.explode("matched_literals").alias("literal"))
    distinct = literals.groupBy("rule_id").agg(F.count_distinct("literal").alias("n_literals"))
    totals = files.groupBy("rule_id", "min_matches").agg(F.count(F.lit(1)).alias("n_files"))
    frame = totals.join(distinct, "rule_id").join(n_events, "rule_id", "left")
    frame = frame.withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    tests = {
        "permissive": F.lit(True),
        "balanced": (F.col("n_events") >= 1) & (F.col("n_literals") >= F.least(F.lit(2), "min_matches")),
        "strict": (F.col("n_events") >= 2) & (F.col("n_literals") >= F.greatest(F.lit(2), "min_matches")),
    }
    return frame.filter(tests[strictness]).select("rule_id", "n_files", "n_events", "n_literals")


def ranked(passing: DataFrame) -> DataFrame:
    return passing.orderBy(F.col("n_files").desc(), "rule_id")

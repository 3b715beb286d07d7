"""URL rules by hashed host-suffix and path-prefix expressions.

A rule is a host and a path prefix. Every URL is expanded into the expressions (last labels of its
host, first characters of its path) of the shapes that the rules have: a shape is a number of
labels and a path length. The first eight hex digits of an expression's SHA-256 are the join key;
the full digest confirms, and of the rules confirmed the longest wins (host and path together,
then the host; of equal rules, block). An expression fits one digest only, so a URL has at most
as many matches as there are shapes, however many rules share its host.

URLs are judged once per distinct (host, path), so repeated ones cost one set of expressions. Rules
given as a list are a local table whose exact size Spark knows; it broadcasts them when they are
small and shuffles them when not.

Nulls and edges: a null URL, or one without ``://``, has an empty host and path, which no rule with
a host fits, and gets the default verdict. Extra columns of ``pages`` are not read; repeated rows
are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import LOWER, UPPER


class Rule(NamedTuple):
    action: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Hex digits of a digest that make the join key.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    # a host holds no "/", so the border is not in doubt; a NUL makes it plain
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def _expressions(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """Digests of the host's last labels with the path's first characters, for each shape that fits."""
    labels = F.size(F.split(host, r"\."))
    wide = F.char_length(path)
    found = [
        F.when((labels >= n) & (wide >= length) & (host != ""), _digest(F.substring_index(host, ".", -n), F.substring(path, 1, length)))
        for n, length in shapes
    ]
    return F.array_compact(F.array(*found))


def judged(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (``host/path``, or null) and verdict of each row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    table = spark.createDataFrame([tuple(r) for r in rules], "action string, rule_host string, rule_path string")
    table = table.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})

    host, path = host_and_path(F.col("url").cast("string"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    digests = pages.select("host", "path").distinct()
    digests = digests.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), shapes)).alias("found"))
    digests = digests.withColumn("prefix", F.substring("found", 1, PREFIX))
    candidates = digests.join(table.withColumn("prefix", F.substring("digest", 1, PREFIX)), "prefix")
    rank = F.struct(
        (F.char_length("rule_host") + F.char_length("rule_path")).alias("size"),
        F.char_length("rule_host").alias("host_size"),
        (F.col("action") == "block").alias("blocks"),
    )
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("verdict")), rank)
    ruled = candidates.filter("found = digest").groupBy("host", "path").agg(best.alias("best"))
    return pages.join(ruled, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


_CASES = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {i}"
    for i, r in sorted(enumerate(RULES, 1), key=lambda x: (-len(x[1].host + x[1].path), -len(x[1].host), x[1].action != "block"))
)

ORACLE = rf"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
pick AS (SELECT *, CASE {_CASES} END AS n FROM part),
rule AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r.host}{r.path}', '{r.action}')" for i, r in enumerate(RULES, 1))}) v(n, rule, verdict))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM pick LEFT JOIN rule USING (n)
"""

"""Queries for signature conditions and indicators over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.net import ip_scope as scope_of
from emberwatch.operators import docscan as S
from emberwatch.operators import indicators as I
from emberwatch.plans.binding import log_events, with_log
from emberwatch.plans.registry import query, table
from emberwatch.session import scratch_path
from emberwatch.sinks.stix import export_stix as write_stix
from emberwatch.sinks.stix import indicator_objects


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _condition(name: str, test, where: str) -> None:
    @query(name, f"SELECT doc_id FROM documents WHERE {where}")
    def run(spark, sf_dir):
        return documents(spark, sf_dir).filter(test()).select("doc_id")


_text = lambda: F.col("text")
_bytes = lambda: F.encode("text", "UTF-8")
_SET = ["icense", "@mail", "%%%", "###", "tion"]

_condition("doc_any", lambda: S.any_string(_text(), _SET[:3]),
           "contains(text, 'icense') OR contains(text, '@mail') OR contains(text, '%%%')")
_condition("doc_all", lambda: S.all_strings(_text(), ["###", "%%%"]), "contains(text, '###') AND contains(text, '%%%')")
_condition("doc_any_all_n", lambda: S.n_strings(_text(), _SET, 2),
           " + ".join(f"CAST(contains(text, '{s}') AS INT)" for s in _SET) + " >= 2")
_condition("doc_nocase", lambda: S.nocase(_text(), "LiCeNsE"), "contains(lower(text), 'license')")
_condition("doc_fullword", lambda: S.fullword(_text(), "the"),
           "regexp_matches(text, '(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)')")
_condition("doc_regex", lambda: S.regex(_text(), r"[a-z]+\.[0-9]+@mail[0-9]+"), r"regexp_matches(text, '[a-z]+\.[0-9]+@mail[0-9]+')")
_condition("doc_at", lambda: S.at(_text(), "the", 4), "substr(text, 5, 3) = 'the'")
_condition("doc_in_range", lambda: S.in_range(_text(), "tion", 10, 40), "contains(substr(text, 11, 34), 'tion')")
_condition("doc_size", lambda: S.size_of(_text()) > 4000, "octet_length(encode(text)) > 4000")
_condition("doc_magic", lambda: S.magic(_bytes(), "5468"), "starts_with(text, 'Th')")
_condition("doc_wide", lambda: S.encoded(F.encode("text", "UTF-16LE"), "icense", ["wide"]), "contains(text, 'icense')")


@query("doc_count", r"""
SELECT doc_id, len(regexp_extract_all(text, 'tion')) AS n FROM documents WHERE len(regexp_extract_all(text, 'tion')) > 5""")
def doc_count(spark, sf_dir):
    counted = documents(spark, sf_dir).select("doc_id", S.count_of(F.col("text"), "tion").cast("long").alias("n"))
    return counted.filter(F.col("n") > 5)


#: "mail" under each key that leaves it text, as the search in the plain text that SQL can do.
_XORED = ", ".join(f"({k}, {' || '.join(f'chr({ord(c) ^ k})' for c in 'mail')})" for k in range(128) if all(ord(c) ^ k for c in "mail"))


@query("doc_encoded", f"""
WITH form(k, literal) AS (VALUES {_XORED}),
hit AS (SELECT doc_id, list(DISTINCT xor(CAST(doc_id % 255 + 1 AS INTEGER), k) ORDER BY xor(CAST(doc_id % 255 + 1 AS INTEGER), k)) AS keys
  FROM documents, form WHERE contains(text, literal) AND xor(CAST(doc_id % 255 + 1 AS INTEGER), k) <> 0 GROUP BY doc_id)
SELECT doc_id, contains(text, 'icense') AS in_base64, keys IS NOT NULL AS in_xor, coalesce(array_to_string(keys, ','), '') AS xor_keys
FROM documents LEFT JOIN hit USING (doc_id)""")
def doc_encoded(spark, sf_dir):
    # texts are encoded here, each with a key of its own, then searched for encoded literals under all keys
    shift = F.repeat(F.lit("x"), (F.col("doc_id") % 3).cast("int"))
    # base64() breaks its lines, which would cut literals in two
    one_line = F.regexp_replace(F.base64(F.encode(F.concat(shift, "text"), "UTF-8")), r"\s", "")
    base64_text = F.encode(one_line, "UTF-8")
    hidden = S.xored(F.encode("text", "UTF-8"), (F.col("doc_id") % 255 + 1).cast("int"))
    found = documents(spark, sf_dir).select("doc_id", S.encoded(base64_text, "icense", ["base64"]).alias("in_base64"), S.xor_keys(hidden, "mail").alias("keys"))
    return found.select("doc_id", "in_base64", (F.size("keys") > 0).alias("in_xor"), F.array_join("keys", ",").alias("xor_keys"))


@query("doc_entropy", """
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents),
c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY doc_id, byte),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, round(-sum((n / total) * log2(n / total)), 4) AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id""")
def doc_entropy(spark, sf_dir):
    value = S.entropy(F.encode("text", "UTF-8"))
    return documents(spark, sf_dir).select("doc_id", F.round(value, 4).alias("entropy"))


@query("doc_hash_match", """
SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY text HAVING count(*) > 1)""")
def doc_hash_match(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hashes = docs.select(F.sha2("text", 256).alias("sha256")).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    return S.hash_match(docs.select("doc_id", "text"), "text", hashes.filter("n > 1")).select("doc_id")


# ---------------------------------------------------------------- indicators


def _rows(type_: str, column: str) -> str:
    gate = f"contains({column}, '{I.GATES[type_]}')" if I.GATES[type_] else "true"
    pattern = I.PATTERNS[type_].replace("'", "''")
    return f"CASE WHEN {gate} THEN regexp_extract_all({column}, '{pattern}') ELSE [] END"


def _found(source: str, key: str, column: str, types: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{t}' AS type, unnest({_rows(t, column)}) AS value FROM {source}" for t in types
    )


_DOC_TYPES = list(I.PATTERNS)
_DOC_FOUND = f"WITH found AS ({_found('documents', 'doc_id', 'text', _DOC_TYPES)})"


def doc_indicators(spark, sf_dir):
    return I.extract(documents(spark, sf_dir), "text", ["doc_id"], _DOC_TYPES)


@query("ioc_extract", _DOC_FOUND + " SELECT doc_id, type, value FROM found")
def ioc_extract(spark, sf_dir):
    return doc_indicators(spark, sf_dir)


@query("ioc_extract_pages", f"SELECT * FROM ({_found('pages', 'page_id', 'url', ['domain', 'url'])})")
def ioc_extract_pages(spark, sf_dir):
    return I.extract(table(spark, sf_dir, "pages"), "url", ["page_id"], ["domain", "url"])


@query("ioc_extract_html", f"""
SELECT type, value, count(*) AS n FROM ({_found('pages', 'page_id', 'html', list(I.PATTERNS))}) GROUP BY type, value""")
def ioc_extract_html(spark, sf_dir):
    found = I.extract(table(spark, sf_dir, "pages"), "html", ["page_id"])
    return found.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n"))


@query("ioc_extract_events", with_log(", fields AS (SELECT event_id, unnest(["
    + "{'f': 'rawLine', 't': raw}, {'f': 'message', 't': message}, {'f': 'SubjectUserName', 't': account}, {'f': 'ProcessGuid', 't': guid}, "
    + "{'f': 'DestinationPort', 't': CASE WHEN eid = 3 THEN dst_port END}, {'f': 'Protocol', 't': CASE WHEN eid = 3 THEN 'tcp' END}, "
    + "{'f': 'ip', 't': dst_ip}, {'f': 'processName', 't': image}, {'f': 'processCmd', 't': cmdline}, "
    + "{'f': 'Image', 't': image}, {'f': 'CommandLine', 't': cmdline}, {'f': 'ParentImage', 't': parent_image}, "
    + "{'f': 'DestinationIp', 't': CASE WHEN eid = 3 THEN dst_ip END}, "
    + "{'f': 'QueryName', 't': CASE WHEN eid = 22 THEN 'q' || CAST(event_id % 9 AS VARCHAR) || '.example.com' END}]) AS x FROM log), "
    + "cells AS (SELECT event_id, x.f AS field, x.t AS text FROM fields WHERE x.t <> ''), found AS ("
    + _found("cells", "event_id, field", "text", list(I.PATTERNS))
    + ") SELECT field, type, value, count(*) AS n FROM found GROUP BY field, type, value"))
def ioc_extract_events(spark, sf_dir):
    found = I.extract_events(log_events(spark, sf_dir), "event_id")
    return found.groupBy("field", "type", "value").agg(F.count(F.lit(1)).alias("n"))


@query("ioc_counts", _DOC_FOUND + """
SELECT type, value, count(*) AS n, count(DISTINCT doc_id) AS n_events FROM found GROUP BY type, value""")
def ioc_counts(spark, sf_dir):
    return I.counts(doc_indicators(spark, sf_dir), "doc_id")


@query("ioc_pivot", f"""
WITH found AS ({_found('pages', 'page_id', 'html', ['domain'])}),
best AS (SELECT value FROM found GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)
SELECT page_id, url FROM pages WHERE page_id IN (SELECT page_id FROM found WHERE value IN (SELECT value FROM best))""")
def ioc_pivot(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = I.extract(pages, "html", ["page_id"], ["domain"])
    # the most frequent indicator: one row
    best = I.counts(found, "page_id").orderBy(F.col("n").desc(), "value").first()
    return I.pivot(found, pages.select("page_id", "url"), "page_id", best["type"], best["value"])


@query("ip_scope", with_log("""
SELECT event_id, CASE WHEN starts_with(dst_ip, '10.') OR starts_with(dst_ip, '192.168.')
  OR (starts_with(dst_ip, '172.') AND CAST(split_part(dst_ip, '.', 2) AS BIGINT) BETWEEN 16 AND 31)
  THEN 'private' ELSE 'public' END AS scope FROM log"""))
def ip_scope(spark, sf_dir):
    return log_events(spark, sf_dir).select("event_id", scope_of(F.col("ip")).alias("scope"))


@query("export_stix", _DOC_FOUND + """
, counted AS (SELECT type, value, count(*) AS n FROM found GROUP BY type, value),
p AS (SELECT type, value, n, sha256(type || ':' || value) AS h, CASE type
  WHEN 'ip' THEN '[ipv4-addr:value = ''' || value || ''']'
  WHEN 'ipv6' THEN '[ipv6-addr:value = ''' || value || ''']'
  WHEN 'domain' THEN '[domain-name:value = ''' || value || ''']'
  WHEN 'url' THEN '[url:value = ''' || replace(replace(value, '\\', '\\\\'), '''', '\\''') || ''']'
  WHEN 'email' THEN '[email-addr:value = ''' || value || ''']'
  WHEN 'hash' THEN CASE length(value) WHEN 32 THEN '[file:hashes.MD5 = ''' WHEN 40 THEN '[file:hashes.''SHA-1'' = '''
    ELSE '[file:hashes.''SHA-256'' = ''' END || value || ''']' END AS pattern FROM counted)
SELECT 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
    || '-' || substr(h, 21, 12) AS id,
  upper(type) || ': ' || value AS name, pattern, 'ioc-type:' || type AS label,
  CAST(least(100, 50 + n * 5) AS BIGINT) AS confidence, '2024-02-01T00:00:00.000Z' AS created
FROM p WHERE pattern IS NOT NULL""")
def export_stix(spark, sf_dir):
    counted = I.counts(doc_indicators(spark, sf_dir), "doc_id")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return indicator_objects(counted, now, random_ids=False).select(
        "id", "name", "pattern", F.element_at("labels", 1).alias("label"), F.col("confidence").cast("long"), "created"
    )


@query("export_stix_written", _DOC_FOUND + """
SELECT 'indicator' AS type, count(DISTINCT type || value) AS n, count(DISTINCT type || value) AS ids FROM found
WHERE type IN ('ip', 'ipv6', 'domain', 'url', 'email', 'hash') UNION ALL SELECT 'identity', 1, 1""")
def export_stix_written(spark, sf_dir):
    """The whole export as JSON lines, identity object included, read back."""
    path = scratch_path(spark, "stix")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    write_stix(I.counts(doc_indicators(spark, sf_dir), "doc_id"), now, path)
    objects = spark.read.schema("type string, id string").json(path)
    return objects.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))

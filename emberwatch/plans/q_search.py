"""Queries for field access, projections, search and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.fields import extract_field as field_of
from emberwatch.operators import projections as P
from emberwatch.operators import rulecorpus as RC
from emberwatch.operators import search as S
from emberwatch.plans.binding import flat_log, log_events, with_log
from emberwatch.plans.registry import query, table
from emberwatch.schema import EVENT_COLUMNS, to_event_schema


@query("normalize_event", with_log("""
SELECT event_id, us, dst_ip AS ip, eid AS event_code, host, coalesce(cmdline, '-') AS command, 'windows' AS platform FROM log"""))
def normalize_event(spark, sf_dir):
    events = to_event_schema(log_events(spark, sf_dir), ["event_id"])
    assert events.columns == ["event_id", *EVENT_COLUMNS]
    return events.select(
        "event_id",
        F.unix_micros("timestamp").alias("us"),
        "ip",
        F.col("eventId").alias("event_code"),
        "host",
        F.coalesce("processCmd", F.lit("-")).alias("command"),
        "platform",
    )


@query("extract_field", with_log("""
SELECT event_id, image AS exact, image AS loose, coalesce(cmdline, '') AS alias, 'k' || CAST(k AS VARCHAR) AS raw,
  CASE WHEN eid = 22 THEN 'q' || CAST(event_id % 9 AS VARCHAR) || '.example.com' ELSE '' END AS optional,
  host AS hostname, '' AS missing FROM log"""))
def extract_field(spark, sf_dir):
    names = {"exact": "Image", "loose": "iMAGE", "alias": "CommandLine", "raw": "extra", "optional": "QueryName",
             "hostname": "HostName", "missing": "NoSuchField"}
    return log_events(spark, sf_dir).select("event_id", *[field_of(n).alias(a) for a, n in names.items()])


@query("field_mapping", with_log("SELECT event_id, dst_ip AS address, host AS asset FROM log"))
def field_mapping(spark, sf_dir):
    renamed = P.rename_fields(log_events(spark, sf_dir), {"ip": "address", "host": "asset"})
    return renamed.select("event_id", "address", "asset")


@query("display_projection", with_log("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, host AS computer, account AS user,
  split_part(image, chr(92), -1) AS "processName", source AS provider, '—' AS path,
  CAST(eid AS VARCHAR) AS "eventId" FROM log"""))
def display_projection(spark, sf_dir):
    names = ["timestamp", "computer", "user", "processName", "provider", "path", "eventId"]
    return P.display(log_events(spark, sf_dir), names, ["event_id"])


@query("custom_column", with_log(r"""
SELECT event_id, regexp_extract(image, '([^\\.]+)\.exe$', 1) AS stem, account AS who FROM log"""))
def custom_column(spark, sf_dir):
    return log_events(spark, sf_dir).select(
        "event_id",
        P.custom_column("eventData.Image", r"([^\\.]+)\.exe$").alias("stem"),
        P.custom_column("eventData.SubjectUserName").alias("who"),
    )


@query("file_filter", with_log("SELECT event_id FROM log WHERE source_file = 'f3'"))
def file_filter(spark, sf_dir):
    return P.in_file(log_events(spark, sf_dir), "f3").select("event_id")


@query("search_filter", with_log("""
SELECT event_id FROM log WHERE contains(lower(image), 'svch') OR contains(lower(coalesce(cmdline, '')), 'svch')
  OR contains(lower(parent_image), 'svch') OR contains(lower(message), 'svch')"""))
def search_filter(spark, sf_dir):
    return log_events(spark, sf_dir).filter(S.event_matches("SvcH")).select("event_id")


@query("search_filter_regex", with_log("""
SELECT event_id FROM log WHERE regexp_matches(message, '(?i)USER 1[0-9] ') OR regexp_matches(image, '(?i)USER 1[0-9] ')"""))
def search_filter_regex(spark, sf_dir):
    return log_events(spark, sf_dir).filter(S.event_matches("USER 1[0-9] ", regex=True)).select("event_id")


def _document_fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("text").alias("field"), "text")


_HITS = """
WITH pieces AS (SELECT doc_id, text, string_split(lower(text), 'tion') AS p FROM documents WHERE contains(lower(text), 'tion')),
n AS (SELECT doc_id, text, p, unnest(range(1, len(p))) AS i FROM pieces),
hits AS (SELECT doc_id, text, CAST(list_sum([length(x) for x in p[1:i]]) + (i - 1) * 4 AS BIGINT) AS s FROM n)
"""


@query("search_hits", _HITS + """
SELECT doc_id, 'text' AS field, s AS start, s + 4 AS "end", substr(text, s + 1, 4) AS match FROM hits""")
def search_hits(spark, sf_dir):
    found = S.hits(_document_fields(spark, sf_dir), "TION")
    return found.select("doc_id", "field", F.col("start").cast("long"), F.col("end").cast("long"), "match")


@query("search_context", _HITS.replace("tion", "@mail").replace("* 4", "* 5") + """
SELECT doc_id, s AS start, CASE WHEN s > 60 THEN '...' ELSE '' END || substr(text, greatest(s - 60, 0) + 1, s - greatest(s - 60, 0))
  || '<mark>' || substr(text, s + 1, 5) || '</mark>' || substr(text, s + 6, 60)
  || CASE WHEN s + 65 < length(text) THEN '...' ELSE '' END AS context FROM hits""")
def search_context(spark, sf_dir):
    found = S.hits(_document_fields(spark, sf_dir), "@mail")
    return found.select("doc_id", F.col("start").cast("long"), "context")


@query("search_hits_regex", """
SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+[0-9]*@[a-z]+[0-9]|(?i)licen[cs]e')) AS match FROM documents""")
def search_hits_regex(spark, sf_dir):
    found = S.hits(_document_fields(spark, sf_dir), "[A-Za-z]+[0-9]*@[a-z]+[0-9]|licen[cs]e", regex=True)
    return found.select("doc_id", "match")


SAVED = [
    S.SavedQuery("q1", "license", False, "2024-01-02"),
    S.SavedQuery("q2", "@MAIL[0-9]", True, "2024-01-03"),
    S.SavedQuery("q3", "[broken", True, "2024-01-04"),
    S.SavedQuery("q4", "%%%", False, "2024-01-05"),
]


@query("saved_query_run", """
SELECT doc_id, 'q1' AS query_id FROM documents WHERE contains(lower(text), 'license')
UNION ALL SELECT doc_id, 'q2' FROM documents WHERE regexp_matches(text, '(?i)@MAIL[0-9]')
UNION ALL SELECT doc_id, 'q4' FROM documents WHERE contains(text, '%%%')""")
def saved_query_run(spark, sf_dir):
    return S.run_saved(table(spark, sf_dir, "documents"), SAVED, "doc_id", F.col("text"))


@query("playbook_hunt", with_log(r"""
SELECT 'credential-dumping' AS playbook_id, event_id FROM log WHERE regexp_matches(cmdline, '(?i)lsass|sekurlsa|sam|mimikatz')
UNION ALL SELECT 'lateral-movement', event_id FROM log WHERE regexp_matches(cmdline, '(?i)psexec|wmic|winrm|\\')
UNION ALL SELECT 'persistence', event_id FROM log WHERE regexp_matches(cmdline, '(?i)run\\|schtasks|startup|service')"""))
def playbook_hunt(spark, sf_dir):
    return S.hunt_events(log_events(spark, sf_dir), "event_id", F.col("processCmd"))


_TAGS = "['attack.' || lower(p_type), 't' || CAST(1000 + p_size AS VARCHAR), lower(p_name)]"


def _rule_table(spark, sf_dir):
    """Parts as rules: the type gives level and tags, some fields are missing."""
    part = table(spark, sf_dir, "part")
    levels = F.array(*[F.lit(v) for v in ("low", "medium", "high", "critical", None)])
    return part.select(
        F.col("p_partkey").alias("rule_id"),
        F.col("p_name").alias("title"),
        F.get(levels, F.col("p_size") % 5).alias("level"),
        F.when(F.col("p_partkey") % 4 != 0, F.lower("p_brand")).alias("category"),
        F.array(
            F.concat(F.lit("attack."), F.lower("p_type")),
            F.concat(F.lit("t"), (F.col("p_size") + 1000).cast("string")),
            F.lower("p_name"),
        ).alias("tags"),
    )


_RULES = f"""
WITH rules AS (SELECT p_partkey AS rule_id, p_name AS title, (['low', 'medium', 'high', 'critical', NULL])[p_size % 5 + 1] AS level,
  CASE WHEN p_partkey % 4 <> 0 THEN lower(p_brand) END AS category, {_TAGS} AS tags FROM part)
"""


@query("playbook_rules", _RULES + """
SELECT 'credential-dumping' AS playbook_id, rule_id FROM rules
WHERE len([t for t in tags if contains(t, 'credential') OR contains(t, 'lsass') OR contains(t, 'sam') OR contains(t, 'dump') OR contains(t, 't1003')]) > 0
UNION ALL SELECT 'lateral-movement', rule_id FROM rules
WHERE len([t for t in tags if contains(t, 'lateral') OR contains(t, 'psexec') OR contains(t, 'wmi') OR contains(t, 'remote') OR contains(t, 't1021')]) > 0""")
def playbook_rules(spark, sf_dir):
    return S.hunt_rules(_rule_table(spark, sf_dir))


@query("rule_filter", _RULES + """
SELECT rule_id FROM rules WHERE (level IS NULL OR level IN ('high', 'critical'))
  AND (category IS NULL OR category IN ('brand#1', 'brand#2', 'brand#17'))
  AND len([t for t in tags if contains(t, 'economy') OR contains(t, 't101')]) > 0""")
def rule_filter(spark, sf_dir):
    return RC.select_rules(
        _rule_table(spark, sf_dir), ["high", "critical"], ["brand#1", "brand#2", "brand#17"], ["economy", "t101"]
    ).select("rule_id")


@query("rule_summary", _RULES + """
SELECT 'level' AS by, coalesce(level, 'medium') AS value, count(*) AS n FROM rules GROUP BY 2
UNION ALL SELECT 'category', coalesce(category, 'unknown'), count(*) FROM rules GROUP BY 2""")
def rule_summary(spark, sf_dir):
    return RC.summary(_rule_table(spark, sf_dir))


@query("process_search", """
SELECT min_by(p_name, p_partkey) AS name, count(*) AS n FROM part WHERE contains(lower(p_name), 'ri')
GROUP BY lower(p_name) ORDER BY count(*) DESC, lower(p_name) LIMIT 25""")
def process_search(spark, sf_dir):
    return S.process_search(table(spark, sf_dir, "part"), "Ri", "p_name", "p_partkey")


@query("event_compare", with_log("""
, sides AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM log GROUP BY user_id),
cells AS (SELECT event_id, unnest([{'k': 'dst_ip', 'v': dst_ip}, {'k': 'image', 'v': image}, {'k': 'cmdline', 'v': coalesce(cmdline, '')},
  {'k': 'eid', 'v': CAST(eid AS VARCHAR)}, {'k': 'attr.host', 'v': host},
  {'k': CASE WHEN eid = 3 THEN 'attr.port' END, 'v': dst_port}]) AS c FROM log),
l AS (SELECT user_id, c.k AS key, c.v AS v FROM sides JOIN cells ON event_id = a WHERE c.k IS NOT NULL),
r AS (SELECT user_id, c.k AS key, c.v AS v FROM sides JOIN cells ON event_id = b WHERE c.k IS NOT NULL)
SELECT user_id, key, coalesce(l.v, '') AS val_a, coalesce(r.v, '') AS val_b, coalesce(l.v, '') = coalesce(r.v, '') AS same
FROM l FULL JOIN r USING (user_id, key)"""))
def event_compare(spark, sf_dir):
    log = flat_log(spark, sf_dir)
    attributes = F.map_filter(
        F.create_map(F.lit("host"), F.col("host"), F.lit("port"), F.when(F.col("eid") == 3, F.col("dst_port"))),
        lambda k, v: v.isNotNull(),
    )
    events = log.select("event_id", "user_id", "dst_ip", "image", "cmdline", "eid", attributes.alias("attr"))
    ends = log.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    left = events.join(ends.select(F.col("a").alias("event_id")), "event_id", "left_semi")
    right = events.join(ends.select(F.col("b").alias("event_id")), "event_id", "left_semi")
    return P.compare(left, right, ("event_id", "user_id"), ["user_id"])

"""Queries for detection jobs: rules, prefilter, signatures, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import detection as D
from emberwatch.operators import prefilter as PF
from emberwatch.operators import signatures as S
from emberwatch.operators.lookups import with_review
from emberwatch.operators.rules import CATEGORY_EVENTS, SERVICE_SOURCES, Rule
from emberwatch.plans.binding import log_events, with_log
from emberwatch.plans.registry import query, table
from emberwatch.sinks.matches import write_matches
from emberwatch.session import scratch_path

RULES = [
    Rule("r1", "Encoded PowerShell", {
        "selection": {"Image|endswith": "\\powershell.exe", "CommandLine|contains": "-encodedcommand"},
        "condition": "selection",
    }, "high", ("attack.execution", "attack.t1059.001")),
    Rule("r2", "Dump Of LSASS", {
        "selection": {"CommandLine|windash|contains|all": [" -ma "], "CommandLine|contains": "lsass"},
        "condition": "selection",
    }, "critical", ("attack.credential-access", "attack.t1003.001")),
    Rule("r3", "Shell From Office", {
        "selection_parent": {"ParentImage|endswith": "\\winword.exe"},
        "selection_child": {"Image|endswith": ["\\cmd.exe", "\\powershell.exe"]},
        "condition": "all of selection_*",
    }, "medium", ("attack.execution", "attack.g0016")),
    Rule("r4", "Download With Certutil", {
        "selection": {"CommandLine|re": "certutil\\.exe .*http"},
        "filter_public": {"Image|contains": "\\Public\\"},
        "condition": "selection and not 1 of filter_*",
    }, "low", ("attack.command-and-control",)),
    Rule("r5", "Program In Public Folder", {
        "selection": [{"Image|contains": "\\users\\public\\"}, {"Image|contains": "\\temp\\"}],
        "filter": {"EventID": ["4624", "4625"]},
        "condition": "selection and not filter",
    }, None, ("attack.defense-evasion",)),
    Rule("r6", "Failed Logon", {"selection": {"EventID": "4625"}, "condition": "selection"}, "informational", ()),
    Rule("r7", "Connection To Documentation Network", {
        "selection": {"DestinationIp|cidr": ["203.0.113.0/24", "2001:db8::/32"]},
        "condition": "selection",
    }, "medium", ("attack.exfiltration",), {"category": "network_connection", "product": "windows"}),
    Rule("r8", "Missing Command Line", {
        "selection": {"CommandLine": None},
        "keywords": ["svch0st", "k77<"],
        "condition": "selection and keywords",
    }, "low", ("attack.defense-evasion", "attack.t1036")),
]

_RULE_SQL = {
    "r1": r"ends_with(lower(image), '\powershell.exe') AND contains(lower(cmdline), '-encodedcommand')",
    "r2": "(contains(lower(cmdline), ' -ma ') OR contains(lower(cmdline), ' /ma ')) AND contains(lower(cmdline), 'lsass')",
    "r3": r"ends_with(lower(parent_image), '\winword.exe') AND (ends_with(lower(image), '\cmd.exe') OR ends_with(lower(image), '\powershell.exe'))",
    "r4": r"regexp_matches(cmdline, 'certutil\.exe .*http') AND NOT contains(lower(image), '\public\')",
    "r5": r"(contains(lower(image), '\users\public\') OR contains(lower(image), '\temp\')) AND eid NOT IN (4624, 4625)",
    "r6": "eid = 4625",
    "r7": "eid = 3 AND (starts_with(dst_ip, '203.0.113.') OR starts_with(dst_ip, '2001:db8:'))",
    "r8": "cmdline IS NULL AND (contains(lower(image), 'svch0st') OR k = 77)",
}

_META = ", ".join(
    f"('{r.rule_id}', '{r.title}', {'NULL' if r.level is None else repr(r.level)}, "
    + (f"[{', '.join(repr(t) for t in r.tags)}]" if r.tags else "CAST([] AS VARCHAR[])")
    + ")"
    for r in RULES
)

#: Matches and rule metadata as SQL expressions that follow ``log``.
MATCHES = (
    ", meta(rule_id, title, level, tags) AS (VALUES "
    + _META
    + "), hits AS ("
    + " UNION ALL ".join(f"SELECT event_id, host, us, '{r}' AS rule_id FROM log WHERE {w}" for r, w in _RULE_SQL.items())
    + "), matches AS (SELECT * FROM hits JOIN meta USING (rule_id))"
)


def matches(spark, sf_dir):
    return D.detect(log_events(spark, sf_dir), RULES, ["event_id", "host", "us"], route=True)


@query("sigma_detect", with_log(MATCHES + " SELECT event_id, rule_id, title, level FROM matches"))
def sigma_detect(spark, sf_dir):
    return matches(spark, sf_dir).select("event_id", "rule_id", "title", "level")


@query("sigma_detect_counts", with_log(MATCHES + """
SELECT rule_id, title, level, count(*) AS n FROM matches GROUP BY rule_id, title, level"""))
def sigma_detect_counts(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("rule_id", "title", "level").agg(F.count(F.lit(1)).alias("n"))


def prefilter_rules(n: int = 700) -> list[PF.PrefilterRule]:
    """Keyword rules in rotation, every seventh a lookup rule and every hundredth without filters."""
    keywords = ["powershell", "invoke-expression", "cmd.exe", "whoami"]
    rules = []
    for i in range(n):
        keyword = (keywords[i % 4],)
        filters = (PF.QuickFilter("Image", "contains", keyword), PF.QuickFilter("CommandLine", "contains", keyword))
        if i % 7 == 6:
            filters = (PF.QuickFilter("QueryName", "endswith", ("Q3.example.com", "q5.example.com")),)
        if i % 100 == 99:
            filters = ()
        rules.append(PF.PrefilterRule(f"rule-{i:04d}", filters))
    return rules


_PREFILTER = with_log(r"""
, tests AS (SELECT
    count(*) AS n,
    count(*) FILTER (contains(lower(image), 'powershell') OR contains(lower(cmdline), 'powershell')) AS c0,
    count(*) FILTER (contains(lower(image), 'invoke-expression') OR contains(lower(cmdline), 'invoke-expression')) AS c1,
    count(*) FILTER (contains(lower(image), 'cmd.exe') OR contains(lower(cmdline), 'cmd.exe')) AS c2,
    count(*) FILTER (contains(lower(image), 'whoami') OR contains(lower(cmdline), 'whoami')) AS c3,
    count(*) FILTER (eid <> 22 OR event_id % 9 IN (3, 5)) AS cq
  FROM log),
rules AS (SELECT i, CASE WHEN i % 100 = 99 THEN n WHEN i % 7 = 6 THEN cq
    WHEN i % 4 = 0 THEN c0 WHEN i % 4 = 1 THEN c1 WHEN i % 4 = 2 THEN c2 ELSE c3 END AS candidates, n
  FROM range(700) r(i), tests)
""")


@query("sigma_prefilter", _PREFILTER + """
SELECT 'rule-' || lpad(CAST(i AS VARCHAR), 4, '0') AS rule_id, n AS comparisons, candidates, n - candidates AS rejects FROM rules""")
def sigma_prefilter(spark, sf_dir):
    return PF.prefilter_counts(log_events(spark, sf_dir), prefilter_rules())


@query("sigma_prefilter_totals", _PREFILTER + """
SELECT CAST(sum(n) AS BIGINT) AS comparisons, CAST(sum(candidates) AS BIGINT) AS candidates,
  CAST(sum(n - candidates) AS BIGINT) AS rejects FROM rules""")
def sigma_prefilter_totals(spark, sf_dir):
    return PF.prefilter_totals(PF.prefilter_counts(log_events(spark, sf_dir), prefilter_rules()))


@query("sigma_prefilter_candidates", with_log(r"""
SELECT event_id, 1 AS n_rules FROM log WHERE contains(lower(image), 'powershell') OR contains(lower(cmdline), 'powershell')"""))
def sigma_prefilter_candidates(spark, sf_dir):
    keyword = ("PowerShell",)
    rule = PF.PrefilterRule(
        "one", (PF.QuickFilter("Image", "contains", keyword), PF.QuickFilter("CommandLine", "contains", keyword))
    )
    pairs = PF.prefilter_candidates(log_events(spark, sf_dir), [rule], "event_id")
    return pairs.select("event_id", F.size("rule_ids").alias("n_rules"))


@query("logsource_route", with_log("""
SELECT event_id, CASE eid WHEN 1 THEN 'process_creation' WHEN 3 THEN 'network_connection' ELSE 'dns_query' END AS category
FROM log WHERE eid IN (1, 3, 22)"""))
def logsource_route(spark, sf_dir):
    events = log_events(spark, sf_dir).withColumn("channel", F.regexp_extract("source", r"-Windows-(\w+)", 1))
    routes = D.logsource_table(spark)
    return events.join(F.broadcast(routes), ["channel", "eventId"]).select("event_id", "category")


@query("rule_toggle", """
SELECT p_partkey AS rule_id, p_brand FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R')""")
def rule_toggle(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), "p_brand")
    lines = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return D.enabled(rules, lines.select(F.col("l_partkey").alias("rule_id")))


@query("match_explain", with_log(MATCHES + r"""
, m AS (SELECT event_id, rule_id FROM hits)
SELECT event_id, rule_id, 'selection' AS selection, 'Image' AS field, image AS value, 'endswith' AS modifier,
  '\powershell.exe' AS pattern FROM m JOIN log USING (event_id) WHERE rule_id = 'r1'
UNION ALL
SELECT event_id, rule_id, 'selection', 'CommandLine', cmdline, 'contains', '-encodedcommand'
FROM m JOIN log USING (event_id) WHERE rule_id = 'r1'
UNION ALL
SELECT event_id, rule_id, 'selection', 'Image', image, 'contains', '\users\public\'
FROM m JOIN log USING (event_id) WHERE rule_id = 'r5' AND contains(lower(image), '\users\public\')
UNION ALL
SELECT event_id, rule_id, 'selection', 'Image', image, 'contains', '\temp\'
FROM m JOIN log USING (event_id) WHERE rule_id = 'r5' AND contains(lower(image), '\temp\')
UNION ALL SELECT event_id, rule_id, 'selection', 'CommandLine', cmdline, 'windash|contains|all', p
FROM m JOIN log USING (event_id), (VALUES (' -ma '), (' /ma ')) v(p) WHERE rule_id = 'r2' AND contains(lower(cmdline), p)
UNION ALL SELECT event_id, rule_id, 'selection', 'CommandLine', cmdline, 'contains', 'lsass' FROM m JOIN log USING (event_id) WHERE rule_id = 'r2'
UNION ALL SELECT event_id, rule_id, 'selection_parent', 'ParentImage', parent_image, 'endswith', '\winword.exe'
FROM m JOIN log USING (event_id) WHERE rule_id = 'r3'
UNION ALL SELECT event_id, rule_id, 'selection_child', 'Image', image, 'endswith', p
FROM m JOIN log USING (event_id), (VALUES ('\cmd.exe'), ('\powershell.exe')) v(p) WHERE rule_id = 'r3' AND ends_with(lower(image), p)
UNION ALL SELECT event_id, rule_id, 'selection', 'CommandLine', cmdline, 're', 'certutil\.exe .*http' FROM m JOIN log USING (event_id) WHERE rule_id = 'r4'
UNION ALL SELECT event_id, rule_id, 'selection', 'EventID', CAST(eid AS VARCHAR), 'equals', '4625' FROM m JOIN log USING (event_id) WHERE rule_id = 'r6'
UNION ALL SELECT event_id, rule_id, 'selection', 'DestinationIp', dst_ip, 'cidr', CASE WHEN dst_ip LIKE '203%' THEN '203.0.113.0/24' ELSE '2001:db8::/32' END
FROM m JOIN log USING (event_id) WHERE rule_id = 'r7'
UNION ALL SELECT event_id, rule_id, 'selection', 'CommandLine', NULL, 'equals', NULL FROM m WHERE rule_id = 'r8'
UNION ALL SELECT event_id, rule_id, 'keywords', 'rawLine', lower(raw), 'contains', p
FROM m JOIN log USING (event_id), (VALUES ('svch0st'), ('k77<')) v(p) WHERE rule_id = 'r8' AND contains(lower(raw), p)"""))
def match_explain(spark, sf_dir):
    return D.explain_matches(log_events(spark, sf_dir), RULES, "event_id")


@query("matches_per_event", with_log(MATCHES + """
SELECT event_id, coalesce(titles, '') AS titles FROM log
LEFT JOIN (SELECT event_id, string_agg(title, ', ' ORDER BY title) AS titles FROM matches GROUP BY event_id) USING (event_id)"""))
def matches_per_event(spark, sf_dir):
    return D.titles_per_event(log_events(spark, sf_dir), RULES, ["event_id"], route=True)


@query("match_event_join", with_log(MATCHES + """
SELECT rule_id, eid AS event_code, count(*) AS n FROM matches JOIN log USING (event_id) GROUP BY rule_id, eid"""))
def match_event_join(spark, sf_dir):
    events = log_events(spark, sf_dir).select("event_id", F.col("eventId").alias("event_code"))
    joined = matches(spark, sf_dir).select("event_id", "rule_id").join(events, "event_id")
    return joined.groupBy("rule_id", "event_code").agg(F.count(F.lit(1)).alias("n"))


@query("detect_stats", with_log(MATCHES + """
SELECT CAST(8 AS BIGINT) AS rules, count(*) AS events, count(*) * 8 AS comparisons,
  (SELECT count(*) FROM matches) AS matches FROM log"""))
def detect_stats(spark, sf_dir):
    return D.detection_stats(log_events(spark, sf_dir), matches(spark, sf_dir), len(RULES))


@query("review_join", """
SELECT c_custkey AS rule_id, c_name AS title, coalesce(o_orderstatus, 'unreviewed') AS review_status,
  coalesce(o_orderpriority, '') AS review_note
FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (
    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderpriority DESC) AS rn FROM orders
) ON o_custkey = c_custkey AND rn = 1""")
def review_join(spark, sf_dir):
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), F.col("c_name").alias("title"))
    notes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("rule_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("note"),
    )
    return with_review(rules, notes)


_EXPECTED = [("r1", 3), ("r2", 100_000), ("r6", None), ("r9", 0)]


@query("regression_check", with_log(MATCHES + """
, expected(rule_id, expected) AS (VALUES ('r1', CAST(3 AS BIGINT)), ('r2', 100000), ('r6', NULL), ('r9', 0))
SELECT rule_id, expected, coalesce(n, 0) AS actual, expected IS NOT DISTINCT FROM coalesce(n, 0) AS passed
FROM expected LEFT JOIN (SELECT rule_id, count(*) AS n FROM matches GROUP BY rule_id) USING (rule_id)"""))
def regression_check(spark, sf_dir):
    expected = spark.createDataFrame(_EXPECTED, "rule_id string, expected long")
    return D.regression(expected, matches(spark, sf_dir))


@query("write_matches", with_log(MATCHES + """
SELECT coalesce(level, 'none') AS level, count(*) AS n FROM matches GROUP BY coalesce(level, 'none')"""))
def write_matches_query(spark, sf_dir):
    path = scratch_path(spark, "matches")
    found = matches(spark, sf_dir).withColumn("level", F.coalesce("level", F.lit("none")))
    write_matches(found.select("event_id", "rule_id", "level"), path)
    return spark.read.parquet(path).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


#: Count tests with and without a timeframe, and a selection named like a Python keyword.
COUNT_RULES = [
    Rule("c1", "Failed Logons In An Hour", {
        "selection": {"EventID": "4625"}, "timeframe": "1h", "condition": "selection | count() by Computer >= 2",
    }),
    Rule("c2", "Many Addresses In A Day", {
        "import": {"EventID": "3"}, "timeframe": "1d", "condition": "import | count(DestinationIp) by Computer > 3",
    }),
    Rule("c3", "Rare Programs", {"selection": {"Image|endswith": "\\svch0st.exe"}, "condition": "selection | count() by SubjectUserName < 8"}),
    Rule("c4", "All Together", {"selection": {"EventID": "22"}, "condition": "selection | count() > 1000000"}),
    Rule("c5", "Not Translated", {"selection": {"EventID": "22"}, "condition": "selection | near other"}),
    Rule("c6", "No Count", {"not_this": {"EventID": "4624"}, "is": {"Image|endswith": "\\cmd.exe"}, "condition": "is and not not_this"}),
]


def _ending(span: int, test: str) -> str:
    """SQL: a window of the span that ends at the row or at one up to ``span`` later passes."""
    return f"SELECT event_id, bool_or(n {test}) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN CURRENT ROW AND {span} FOLLOWING) AS hit"


@query("sigma_detect_count", with_log(rf"""
, n1 AS (SELECT *, count(*) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n
  FROM log WHERE eid = 4625),
n2 AS (SELECT *, count(DISTINCT dst_ip) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n
  FROM log WHERE eid = 3),
c1 AS ({_ending(3600000000, ">= 2")} FROM n1), c2 AS ({_ending(86400000000, "> 3")} FROM n2),
c3 AS (SELECT event_id, count(*) OVER (PARTITION BY account) AS n FROM log WHERE ends_with(lower(image), '\svch0st.exe'))
SELECT event_id, 'c1' AS rule_id FROM c1 WHERE hit UNION ALL SELECT event_id, 'c2' FROM c2 WHERE hit
UNION ALL SELECT event_id, 'c3' FROM c3 WHERE n < 8
UNION ALL SELECT event_id, 'c6' FROM log WHERE ends_with(lower(image), '\cmd.exe') AND eid <> 4624"""))
def sigma_detect_count(spark, sf_dir):
    return D.detect(log_events(spark, sf_dir), COUNT_RULES, ["event_id"]).select("event_id", "rule_id")


def bundle_rules(n: int = 2000) -> list[Rule]:
    """A bundle of the size that is in use, in eight shapes; as there, most rules hold for few events or none."""

    def rule(i: int) -> dict:
        program = ["\\cmd.exe", "\\powershell.exe", "\\winword.exe"][i % 3]
        return [
            {"selection": {"message|contains": [f"by user {i // 8} value 1", f"by user {i // 8} value 7"]}, "condition": "selection"},
            {"selection": {"Image|endswith": program, "CommandLine|contains": f"tool{i}.exe"}, "condition": "selection"},
            {"selection": {"EventID": "3"}, "keywords": [f"k{i % 97}<"], "condition": "selection and keywords"},
            {
                "selection": {"QueryName|endswith": f"q{i % 9}.example.com", "SubjectUserName": f"USER{i % 20}"},
                "filter_main": {"Image|contains": "\\Public\\"},
                "filter_other": {"ParentImage|endswith": "\\services.exe", "EventID": "22"},
                "condition": "selection and not 1 of filter_*",
            },
            {"selection": {"DestinationIp|startswith": f"203.0.113.{i % 60}", "DestinationPort": ["443", "4444"]}, "condition": "selection"},
            {"selection": {"CommandLine|contains|all": ["certutil", f"a{i}.exe"]}, "condition": "selection"},
            {
                "selection_a": {"Image|endswith": "\\cmd.exe", "SubjectUserName": f"user{i % 20}"},
                "selection_b": {"ParentImage|endswith": "\\wmiprvse.exe", "message|contains": f" user {i % 150} "},
                "condition": "1 of selection_*",
            },
            {"selection": {"CommandLine|re": f"invoke-x{i}", "Image|endswith": "\\powershell.exe"}, "condition": "selection"},
        ][i % 8]

    return [Rule(f"b{i}", f"Rule {i}", rule(i)) for i in range(n)]


@query("sigma_detect_bundle", with_log(r"""
SELECT event_id, 'b' || i AS rule_id FROM log JOIN range(2000) r(i) ON CASE i % 8
  WHEN 0 THEN contains(message, 'by user ' || (i // 8) || ' value 1') OR contains(message, 'by user ' || (i // 8) || ' value 7')
  WHEN 2 THEN eid = 3 AND k = i % 97
  WHEN 3 THEN eid = 22 AND event_id % 9 = i % 9 AND account = 'user' || (i % 20)
    AND NOT contains(lower(image), '\public\') AND NOT ends_with(lower(parent_image), '\services.exe')
  WHEN 4 THEN eid = 3 AND starts_with(dst_ip, '203.0.113.' || (i % 60)) AND dst_port IN ('443', '4444')
  WHEN 6 THEN (ends_with(lower(image), '\cmd.exe') AND account = 'user' || (i % 20))
    OR (ends_with(lower(parent_image), '\wmiprvse.exe') AND contains(message, ' user ' || (i % 150) || ' '))
  ELSE false END"""))
def sigma_detect_bundle(spark, sf_dir):
    return D.rule_hits(log_events(spark, sf_dir), bundle_rules(), ["event_id"], indexed=True)


def _routed_rules() -> list[Rule]:
    """One rule that sees every event of its source, per category and service, and two that are not known."""
    anything = {"selection": {"EventID|re": "."}, "condition": "selection"}
    sources = [{"product": "windows", "category": c} for c in CATEGORY_EVENTS] + [{"product": "windows", "service": s} for s in SERVICE_SOURCES]
    sources += [{"product": "windows", "category": "unheard_of"}, {"product": "windows", "service": "unheard-of"}, {"product": "linux"}]
    return [Rule("-".join(s.values()), "any", anything, logsource=s) for s in sources]


@query("sigma_detect_routed", with_log("""
, kinds(rule_id, eids, part) AS (VALUES """ + ", ".join(
    f"('windows-{c}', [{', '.join(str(e) for _, e in pairs)}], '{s}')" for c, all_ in CATEGORY_EVENTS.items()
    for s in dict.fromkeys(s for s, _ in all_) for pairs in [[p for p in all_ if p[0] == s]]
) + """),
services(rule_id, part) AS (VALUES """ + ", ".join(f"('windows-{n}', '{s}')" for n, s in SERVICE_SOURCES.items()) + """)
SELECT rule_id, eid, count(*) AS n FROM (
  SELECT rule_id, eid FROM log JOIN kinds ON list_contains(eids, eid) AND contains(source, part)
  UNION ALL SELECT rule_id, eid FROM log JOIN services ON contains(source, part)) GROUP BY rule_id, eid"""))
def sigma_detect_routed(spark, sf_dir):
    events = log_events(spark, sf_dir)
    hits = D.rule_hits(events, _routed_rules(), ["event_id", "eventId"], route=True)
    return hits.groupBy("rule_id", F.col("eventId").alias("eid")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- literal signatures

SIGNATURES = [
    S.Signature("s1", "license", ("license", "@mail", "%%%"), 2),
    S.Signature("s2", "the", ("tion", "###", "ouel", "zzzz"), 2, ("qqqq",)),
    S.Signature("s3", "%%%", ("%%%", "###", "&&&", "***"), 3),
    S.Signature("s4", "license", ("license",), 1, ("the",)),
    S.Signature("s5", "", ("license",), 1),
]


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def _file_sql() -> str:
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]" if values else "CAST([] AS VARCHAR[])"
    rows = ", ".join(
        f"('{s.rule_id}', '{s.anchor}', {quoted(s.literals)}, {quoted(s.exclusions)}, {s.min_matches})"
        for s in SIGNATURES
        if s.anchor
    )
    return f"""
sig(rule_id, anchor, literals, exclusions, min_matches) AS (VALUES {rows}),
corpus AS (SELECT source AS source_file, count(*) AS event_count, string_agg(lower(text), chr(10)) AS body
  FROM documents GROUP BY source),
files AS (SELECT rule_id, source_file, event_count, min_matches, list_filter(literals, lambda x: contains(body, x)) AS found
  FROM corpus, sig WHERE contains(body, anchor) AND len(list_filter(exclusions, lambda x: contains(body, x))) = 0
  AND len(list_filter(literals, lambda x: contains(body, x))) >= min_matches),
event_hits AS (SELECT rule_id, source AS source_file, doc_id, list_filter(literals, lambda x: contains(lower(text), x)) AS found,
    row_number() OVER (PARTITION BY rule_id, source ORDER BY doc_id) AS rn
  FROM documents, sig WHERE len(list_filter(exclusions, lambda x: contains(lower(text), x))) = 0
  AND len(list_filter(literals, lambda x: contains(lower(text), x))) >= min_matches),
shown AS (SELECT e.rule_id, e.source_file, doc_id, e.found FROM event_hits e JOIN files USING (rule_id, source_file) WHERE rn <= 8),
totals AS (SELECT rule_id, min_matches, count(*) AS n_files FROM files GROUP BY rule_id, min_matches),
per_rule AS (SELECT rule_id, min_matches, n_files,
    (SELECT count(*) FROM event_hits e JOIN files f USING (rule_id, source_file) WHERE e.rule_id = t.rule_id) AS n_events,
    (SELECT count(DISTINCT u.l) FROM (SELECT rule_id, unnest(found) AS l FROM files) u WHERE u.rule_id = t.rule_id) AS n_literals
  FROM totals t)"""


_FILES = "WITH " + _file_sql()
_TEXT = S.event_text


def _scan(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return S.scan(documents, SIGNATURES, "source", S.event_text([F.col("text")]))


def _events(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return S.enough_by_itself(
        documents, _scan(spark, sf_dir), SIGNATURES, "source", S.event_text([F.col("text")]), "doc_id"
    )


@query("signature_scan", _FILES + """
SELECT rule_id, source_file, event_count, array_to_string(found, '|') AS literals FROM files""")
def signature_scan(spark, sf_dir):
    files = _scan(spark, sf_dir)
    return files.select("rule_id", "source_file", "event_count", F.array_join("matched_literals", "|").alias("literals"))


@query("signature_events", _FILES + """
SELECT rule_id, source_file, doc_id, array_to_string(found[1:8], '|') AS literals FROM shown""")
def signature_events(spark, sf_dir):
    found = S.shown_events(_events(spark, sf_dir), "doc_id")
    return found.select("rule_id", "source_file", "doc_id", F.array_join("event_literals", "|").alias("literals"))


@query("signature_strictness", _FILES + """
SELECT 'permissive' AS strictness, rule_id, n_files, n_events, n_literals FROM per_rule
UNION ALL SELECT 'balanced', rule_id, n_files, n_events, n_literals FROM per_rule
  WHERE n_events >= 1 AND n_literals >= least(2, min_matches)
UNION ALL SELECT 'strict', rule_id, n_files, n_events, n_literals FROM per_rule
  WHERE n_events >= 2 AND n_literals >= greatest(2, min_matches)""")
def signature_strictness(spark, sf_dir):
    files, found = _scan(spark, sf_dir), _events(spark, sf_dir)
    frames = [
        S.passing_rules(files, found, level).select(F.lit(level).alias("strictness"), "*")
        for level in ("permissive", "balanced", "strict")
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("signature_rank", _FILES + """
SELECT rule_id, n_files FROM per_rule WHERE n_events >= 1 AND n_literals >= least(2, min_matches)
ORDER BY n_files DESC, rule_id""")
def signature_rank(spark, sf_dir):
    passing = S.passing_rules(_scan(spark, sf_dir), _events(spark, sf_dir), "balanced")
    return S.ranked(passing).select("rule_id", "n_files")


@query("signature_log_scan", with_log(r"""
, sig AS (SELECT source_file, count(*) AS event_count,
    bool_or(contains(lower(image), 'svch0st')) AS a, bool_or(contains(lower(cmdline), 'lsass')) AS b,
    bool_or(contains(message, 'signup')) AS c FROM log GROUP BY source_file)
SELECT 'log1' AS rule_id, source_file, event_count,
  concat_ws('|', CASE WHEN a THEN 'svch0st' END, CASE WHEN b THEN 'lsass' END, CASE WHEN c THEN 'signup by' END) AS literals
FROM sig WHERE a AND (CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT)) >= 2"""))
def signature_log_scan(spark, sf_dir):
    signature = S.Signature("log1", "svch0st", ("svch0st", "lsass", "signup by", "nowhere"), 2)
    files = S.scan(log_events(spark, sf_dir), [signature], "sourceFile", S.log_event_text())
    return files.select("rule_id", "source_file", "event_count", F.array_join("matched_literals", "|").alias("literals"))


def signature_bundle(n: int = 2000) -> list[S.Signature]:
    """Signatures in the number that is in use; most of their literals are in no text."""
    anchors, parts = ["license", "@mail", "%%%", "the "], ["tion", "ouel", "###", "ment"]
    return [S.Signature(f"y{i}", anchors[i % 4], (f"@mail{i % 50}", f"needle-{i}", parts[i // 4 % 4], f"w{i}x"), 2) for i in range(n)]


@query("signature_scan_bundle", """
WITH body AS (SELECT source AS source_file, count(*) AS event_count, string_agg(lower(text), chr(10)) AS body FROM documents GROUP BY source),
sig AS (SELECT i, ['license', '@mail', '%%%', 'the '][i % 4 + 1] AS anchor,
    ['@mail' || (i % 50), 'needle-' || i, ['tion', 'ouel', '###', 'ment'][(i // 4) % 4 + 1], 'w' || i || 'x'] AS literals FROM range(2000) r(i)),
needle AS (SELECT DISTINCT anchor AS n FROM sig UNION SELECT DISTINCT unnest(literals) FROM sig),
hit AS (SELECT source_file, event_count, list(n) AS found FROM body, needle WHERE contains(body, n) GROUP BY ALL)
SELECT 'y' || i AS rule_id, source_file, event_count, array_to_string(list_filter(literals, lambda x: list_contains(found, x)), '|') AS literals
FROM hit, sig WHERE list_contains(found, anchor) AND len(list_filter(literals, lambda x: list_contains(found, x))) >= 2""")
def signature_scan_bundle(spark, sf_dir):
    files = S.scan(_documents(spark, sf_dir), signature_bundle(), "source", S.event_text([F.col("text")]))
    return files.select("rule_id", "source_file", "event_count", F.array_join("matched_literals", "|").alias("literals"))

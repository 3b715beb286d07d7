"""Queries for triage, networks, breakdowns, fingerprints and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import chains as C
from emberwatch.operators import facets as FA
from emberwatch.operators import network as N
from emberwatch.operators import triage as T
from emberwatch.operators.timeline import sessions
from emberwatch.plans.binding import log_events, with_log
from emberwatch.plans.q_detection import MATCHES, RULES, matches
from emberwatch.plans.registry import query, table

# ---------------------------------------------------------------- triage

_SUSPICIOUS = " OR ".join(f"contains(lower(image), '{p}')" for p in T.SUSPICIOUS_PROGRAMS)
_FOLDERS = " OR ".join(f"contains(lower(image), '{p}')" for p in T.SUSPICIOUS_FOLDERS)
_EXTERNAL = "eid = 3 AND NOT starts_with(dst_ip, '10.') AND NOT starts_with(dst_ip, '192.168.')"


def _factors(key: str) -> str:
    """SQL of the factor rows per ``key`` (a column, or a constant for the whole data set)."""
    return f"""
, lv AS (SELECT {key} AS g, count(*) FILTER (level = 'critical') AS c, count(*) FILTER (level = 'high') AS h,
    count(*) FILTER (level = 'medium') AS m, count(*) FILTER (coalesce(level, 'low') NOT IN ('critical', 'high', 'medium')) AS l,
    count(*) AS n FROM matches GROUP BY 1),
tags AS (SELECT DISTINCT {key} AS g, replace(lower(unnest(tags)), 'attack.', '') AS tag FROM matches),
tn AS (SELECT g, count(*) AS n, array_to_string(list_sort(list(tag))[1:5], ', ') AS names FROM tags WHERE NOT starts_with(tag, 't') AND length(tag) > 2 GROUP BY g),
ev AS (SELECT {key} AS g, count(DISTINCT CASE WHEN {_SUSPICIOUS} THEN split_part(image, chr(92), -1) END) AS p,
    array_to_string(list_sort(list(DISTINCT CASE WHEN {_SUSPICIOUS} THEN split_part(image, chr(92), -1) END)
      FILTER ({_SUSPICIOUS}))[1:5], ', ') AS pn,
    count(*) FILTER ({_FOLDERS}) AS f, count(DISTINCT CASE WHEN {_EXTERNAL} THEN dst_ip END) AS x FROM log GROUP BY 1),
factors AS (
  SELECT g, 'detections' AS factor, least(40, 25 * c + 12 * h + 5 * m + 2 * l) AS points, CAST(c AS VARCHAR) || ' critical, '
    || CAST(h AS VARCHAR) || ' high, ' || CAST(m AS VARCHAR) || ' medium, ' || CAST(l AS VARCHAR) || ' low' AS detail FROM lv
  UNION ALL SELECT g, 'tactics', least(15, 3 * n), CAST(n AS VARCHAR) || ' distinct tactic(s): ' || names FROM tn
  UNION ALL SELECT g, 'processes', least(15, 3 * p), pn FROM ev WHERE p > 0
  UNION ALL SELECT g, 'folders', least(10, CAST(ceil(f / 5) AS BIGINT)), CAST(f AS VARCHAR) || ' execution(s) from unusual folders' FROM ev WHERE f > 0
  UNION ALL SELECT g, 'network', least(10, 2 * x), CAST(x AS VARCHAR) || ' unique external address(es)' FROM ev WHERE x > 0
  UNION ALL SELECT g, 'volume', least(10, 2 * (n // 50)), CAST(n AS VARCHAR) || ' total matches' FROM lv WHERE n > 50)
"""


def _factor(name: str, function, source: str, factor: str) -> None:
    @query(name, with_log(MATCHES + _factors("host") + f"SELECT g AS host, factor, points, detail FROM factors WHERE factor = '{factor}'"))
    def run(spark, sf_dir):
        by = ["host"]
        if source == "matches":
            return function(T.match_totals(matches(spark, sf_dir), by), by)
        return function(T.event_totals(log_events(spark, sf_dir), by), by)


_factor("triage_sigma_points", T.detection_points, "matches", "detections")
_factor("triage_tactic_breadth", T.tactic_breadth, "matches", "tactics")
_factor("triage_susp_process", T.suspicious_processes, "events", "processes")
_factor("triage_susp_path", T.unusual_folders, "events", "folders")
_factor("triage_external_ip", T.external_connections, "events", "network")
_factor("triage_volume", T.match_volume, "matches", "volume")

_LABEL = """CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 55 THEN 'High' WHEN score >= 30 THEN 'Medium'
  WHEN score >= 10 THEN 'Low' ELSE 'Informational' END AS label"""


@query("triage_score", with_log(MATCHES + _factors("'all'") + f"""
SELECT score, {_LABEL} FROM (SELECT CAST(least(100, coalesce(sum(points), 0)) AS BIGINT) AS score FROM factors)"""))
def triage_score(spark, sf_dir):
    return T.score(log_events(spark, sf_dir), matches(spark, sf_dir))


@query("triage_score_by_host", with_log(MATCHES + _factors("host") + f"""
SELECT g AS host, score, {_LABEL} FROM (SELECT g, CAST(least(100, sum(points)) AS BIGINT) AS score FROM factors GROUP BY g)"""))
def triage_score_by_host(spark, sf_dir):
    return T.score(log_events(spark, sf_dir), matches(spark, sf_dir), ["host"])


# ---------------------------------------------------------------- processes and networks

_NETWORK = """
, net AS (SELECT event_id, guid, image, ts, eid, CASE WHEN eid = 3 THEN dst_ip END AS ip, dst_port AS port,
    'q' || CAST(event_id % 9 AS VARCHAR) || '.example.com' AS q FROM log WHERE eid IN (3, 22)),
img AS (SELECT guid, arg_min(image, event_id) AS image FROM net GROUP BY guid)
"""


@query("process_network_map", with_log(_NETWORK + """
SELECT net.guid, any_value(img.image) AS image, count(*) FILTER (eid = 3) AS connections, count(*) FILTER (eid = 22) AS lookups
FROM net JOIN img USING (guid) GROUP BY net.guid"""))
def process_network_map(spark, sf_dir):
    return N.process_map(log_events(spark, sf_dir), "event_id")


@query("process_network_activity", with_log(_NETWORK + """
SELECT guid, event_id, CASE WHEN eid = 3 THEN 'connection' ELSE 'lookup' END AS kind,
  CASE WHEN eid = 3 THEN ip || ':' || port END AS target, CASE WHEN eid = 22 THEN q END AS query FROM net"""))
def process_network_activity(spark, sf_dir):
    rows = N.process_activity(log_events(spark, sf_dir), "event_id")
    target = F.when(F.col("kind") == "connection", F.concat_ws(":", "ip", "port"))
    return rows.select("guid", F.col("key").alias("event_id"), "kind", target.alias("target"), "query")


@query("external_destinations", with_log(_NETWORK + """
SELECT ip, string_agg(DISTINCT port, ', ' ORDER BY port) AS ports, count(DISTINCT img.image) AS processes, count(*) AS connections
FROM net JOIN img USING (guid) WHERE eid = 3 GROUP BY ip"""))
def external_destinations(spark, sf_dir):
    return N.destinations(log_events(spark, sf_dir), "event_id")


# ---------------------------------------------------------------- counts and breakdowns


@query("file_breakdown", with_log("""
SELECT source_file AS file, count(*) AS n, round(count(*) / (SELECT count(*) FROM log) * 100, 6) AS percentage
FROM log GROUP BY source_file"""))
def file_breakdown(spark, sf_dir):
    return FA.share_per_file(log_events(spark, sf_dir), "sourceFile")


@query("facet_buckets", with_log("""
SELECT 'source' AS field, source AS value, count(*) AS n FROM log GROUP BY source
UNION ALL SELECT 'host', host, count(*) FROM log GROUP BY host
UNION ALL SELECT 'eventId', CAST(eid AS VARCHAR), count(*) FROM log GROUP BY eid
UNION ALL SELECT 'user', account, count(*) FROM log WHERE event_id % 2 = 0 GROUP BY account"""))
def facet_buckets(spark, sf_dir):
    return FA.facet_counts(log_events(spark, sf_dir), ["source", "host", "eventId", "user"])


@query("distinct_fields", with_log("""
SELECT DISTINCT 'source' AS field, source AS value FROM log UNION ALL SELECT DISTINCT 'sourceFile', source_file FROM log
UNION ALL SELECT DISTINCT 'user', account FROM log WHERE event_id % 2 = 0"""))
def distinct_fields(spark, sf_dir):
    return FA.distinct_values(log_events(spark, sf_dir), ["source", "sourceFile", "user"])


@query("distinct_fields_approx", "SELECT unnest(['source', 'sourceFile', 'user', 'ip']) AS field, true AS close")
def distinct_fields_approx(spark, sf_dir):
    """Whether the sketched counts are within 5 % of the exact ones."""
    fields, log = ["source", "sourceFile", "user", "ip"], log_events(spark, sf_dir)
    sketched = FA.distinct_counts(log, fields)
    exact = FA.distinct_values(log, fields).groupBy("field").agg(F.count(F.lit(1)).alias("exact"))
    sketched = sketched.unpivot([], fields, "field", "n")
    return sketched.join(exact, "field").select("field", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query("time_histogram", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1")
def time_histogram(spark, sf_dir):
    counted = FA.histogram(log_events(spark, sf_dir), "timestamp", "hour")
    return counted.select(F.date_format("time", "yyyy-MM-dd HH").alias("hour"), "n")


@query("status_counts", with_log("SELECT eid AS code, count(*) AS n FROM log GROUP BY eid"))
def status_counts(spark, sf_dir):
    return FA.counts(log_events(spark, sf_dir), F.col("statusCode").alias("code"))


@query("ip_counts", with_log("SELECT dst_ip AS ip, count(*) AS n FROM log GROUP BY dst_ip"))
def ip_counts(spark, sf_dir):
    return FA.counts(log_events(spark, sf_dir), "ip")


@query("tactic_event_counts", with_log(MATCHES + """
, t AS (SELECT event_id, unnest(tags) AS tag FROM matches)
SELECT tag AS tactic, count(DISTINCT event_id) AS n FROM t WHERE NOT regexp_matches(tag, '^attack\\.[tg][0-9]') GROUP BY tag
ORDER BY n DESC, tactic LIMIT 10""".replace("\\\\", "\\")))
def tactic_event_counts(spark, sf_dir):
    tagged = matches(spark, sf_dir).select("event_id", F.explode("tags").alias("tactic"))
    named = tagged.filter(~F.col("tactic").rlike(r"^attack\.[tg][0-9]")).distinct()
    return FA.top_counts(named, ["tactic"], 10)


@query("top_events_by_tactic", with_log(MATCHES + """
, t AS (SELECT event_id, unnest(tags) AS tag FROM matches),
c AS (SELECT tag AS tactic, eid AS event_code, count(*) AS n FROM t JOIN log USING (event_id) GROUP BY 1, 2)
SELECT tactic, event_code, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY n DESC, event_code) AS rank FROM c)
WHERE rank <= 3"""))
def top_events_by_tactic(spark, sf_dir):
    codes = log_events(spark, sf_dir).select("event_id", F.col("eventId").alias("event_code"))
    tagged = matches(spark, sf_dir).select("event_id", F.explode("tags").alias("tactic"))
    top = FA.top_per_group(tagged.join(codes, "event_id"), "tactic", "event_code", 3)
    return top.withColumn("rank", F.col("rank").cast("long"))


@query("top_by_group", """
WITH c AS (SELECT l_returnflag AS share, l_partkey AS target, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT share, target, n, row_number() OVER (PARTITION BY share ORDER BY n DESC, target) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY share ORDER BY n DESC, target) <= 30""")
def top_by_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("share"), F.col("l_partkey").alias("target"))
    return FA.top_per_group(lines, "share", "target", 30).withColumn("rank", F.col("rank").cast("long"))


@query("flow_pairs", with_log("SELECT host, dst_ip AS ip, count(*) AS n FROM log GROUP BY host, dst_ip"))
def flow_pairs(spark, sf_dir):
    return FA.counts(log_events(spark, sf_dir), "host", "ip")


_DIGEST = "CAST(sum(CAST(('0x' || substr(sha256({0}), 1, 12)) AS BIGINT)) AS VARCHAR)"


@query("dataset_fingerprint", with_log("""
, f AS (SELECT source_file, count(*) AS n, min(us) AS a, max(us) AS b FROM log GROUP BY source_file)
SELECT sha256('windows|evtx|' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || '|' || """ + _DIGEST.format("source_file") + """
  || '|' || CAST(min(a) AS VARCHAR) || '|' || CAST(max(b) AS VARCHAR)) AS fingerprint FROM f"""))
def dataset_fingerprint(spark, sf_dir):
    return FA.dataset_fingerprint(log_events(spark, sf_dir), "sourceFile", "timestamp", "windows", "evtx")


@query("ruleset_fingerprint", """
SELECT sha256('sigma|' || CAST(count(*) AS VARCHAR) || '|' || """ + _DIGEST.format("CAST(p_partkey AS VARCHAR)") + """
  || '|strict') AS fingerprint FROM part""")
def ruleset_fingerprint(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("rule_id"))
    return FA.ruleset_fingerprint(rules, "sigma", "strict")


@query("file_info", with_log("""
SELECT source_file, count(*) AS records, min(us) AS first_us, max(us) AS last_us, min(event_id) AS first_id, max(event_id) AS last_id
FROM log GROUP BY source_file"""))
def file_info(spark, sf_dir):
    info = FA.file_info(log_events(spark, sf_dir), "sourceFile", "timestamp", "event_id")
    return info.select(
        F.col("sourceFile").alias("source_file"), "records", F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"), "first_id", "last_id",
    )


# ---------------------------------------------------------------- correlation chains

_GAP = 1_800_000_000

_CHAINS = MATCHES + f"""
, w AS (SELECT event_id, count(*) AS m, sum(CASE level WHEN 'critical' THEN 25 WHEN 'high' THEN 12 WHEN 'medium' THEN 5 ELSE 2 END) AS weight,
    max(CASE level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS rank FROM matches GROUP BY event_id),
e AS (SELECT log.event_id, host, us, image, coalesce(m, 0) AS m, coalesce(weight, 0) AS weight, coalesce(rank, 0) AS rank,
    us - lag(us) OVER (PARTITION BY host ORDER BY us) > {_GAP} AS apart FROM log LEFT JOIN w USING (event_id)),
s AS (SELECT *, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY us) AS session FROM e),
c AS (SELECT host, session, min(us) AS session_start, max(us) AS session_end, count(*) AS length, min(event_id) AS first_event,
    CAST(sum(m) AS BIGINT) AS n_matches, CAST(sum(weight) AS BIGINT) AS score, max(rank) AS r FROM s GROUP BY host, session),
kept AS (SELECT *, (['low', 'medium', 'high', 'critical'])[r] AS severity,
    CAST(length AS VARCHAR) || ' events, ' || CAST(n_matches AS VARCHAR) || ' matches' AS summary
  FROM c WHERE length >= 2 AND n_matches >= 1)
"""


def _members(spark, sf_dir):
    weighted = C.detected_events(log_events(spark, sf_dir), RULES, ["event_id", "host", "us", "processName"], route=True)
    return sessions(weighted.withColumnRenamed("processName", "image"), ["host"], "us", _GAP)


def _chains(spark, sf_dir):
    members = _members(spark, sf_dir)
    return members, C.chains(members, ["host"], "us", "event_id")


@query("correlation_chains", with_log(_CHAINS + """
SELECT host, session_start, session_end, length, first_event, n_matches, score, severity, summary FROM kept"""))
def correlation_chains(spark, sf_dir):
    return _chains(spark, sf_dir)[1]


@query("correlation_chain_events", with_log(_CHAINS + """
SELECT host, session_start, event_id FROM s JOIN kept USING (host, session)"""))
def correlation_chain_events(spark, sf_dir):
    members, kept = _chains(spark, sf_dir)
    return C.chain_members(members, kept, ["host"], "event_id")


@query("correlation_analytics", with_log(_CHAINS + """
SELECT count(*) AS total_chains, round(avg(length), 6) AS avg_length, coalesce(max(score), 0) AS max_score FROM kept"""))
def correlation_analytics(spark, sf_dir):
    return C.analytics(_chains(spark, sf_dir)[1])


@query("correlation_top_processes", with_log(_CHAINS + """
SELECT image, count(*) AS n FROM s JOIN kept USING (host, session) GROUP BY image ORDER BY n DESC, image LIMIT 5"""))
def correlation_top_processes(spark, sf_dir):
    members, kept = _chains(spark, sf_dir)
    return C.top_processes(members, kept, ["host"], "image")

"""Queries for the joins with supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import lineage as L
from emberwatch.operators import lookups as J
from emberwatch.operators import rulecorpus as RC
from emberwatch.operators import typosquat as T
from emberwatch.plans.binding import flat_log, with_log
from emberwatch.plans.q_documents import _DOC_FOUND, doc_indicators
from emberwatch.plans.registry import query, table

_KNOWN = ", ".join(f"('{n}', {i})" for i, n in enumerate(T.LEGITIMATE))


@query("typosquat", f"""
WITH known(legitimate, ord) AS (VALUES {_KNOWN}),
seen AS (SELECT DISTINCT lower(trim(n)) AS name FROM (
  SELECT split_part(p_name, ' ', 2) || '.exe' AS n FROM part
  UNION ALL SELECT substr(legitimate, 1, 1 + CAST(l_partkey % 5 AS BIGINT)) || (['0', 'q', '', '_x'])[l_suppkey % 4 + 1]
    || substr(legitimate, 3 + l_linenumber % 2) FROM lineitem JOIN known ON ord = l_orderkey % 120)),
unknown AS (SELECT name FROM seen WHERE name <> '' AND name NOT IN (SELECT legitimate FROM known)),
near AS (SELECT name, legitimate, ord, levenshtein(name, legitimate) AS d FROM unknown, known)
SELECT name, arg_min(legitimate, d * 1000 + ord) AS legitimate, min(d) AS distance FROM near
WHERE d BETWEEN 1 AND 3 GROUP BY name""")
def typosquat(spark, sf_dir):
    known = T.legitimate_names(spark)
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat(F.substring_index("p_name", " ", -1), F.lit(".exe")).alias("n"))
    line = table(spark, sf_dir, "lineitem").withColumn("ord", (F.col("l_orderkey") % 120).cast("int"))
    middle = F.get(F.array(*[F.lit(v) for v in ("0", "q", "", "_x")]), (F.col("l_suppkey") % 4).cast("int"))
    forged = line.join(F.broadcast(known), "ord").select(
        F.concat(
            F.substr("legitimate", F.lit(1), (F.col("l_partkey") % 5 + 1).cast("int")),
            middle,
            F.substr("legitimate", F.col("l_linenumber") % 2 + 3),
        ).alias("n")
    )
    return T.look_alikes(names.unionByName(forged), "n", known).withColumn("distance", F.col("distance").cast("long"))


@query("threat_actor_join", _DOC_FOUND + """
, actors AS (SELECT s_suppkey AS actor_id, s_name AS name FROM supplier),
known AS (SELECT DISTINCT doc_id % (SELECT count(*) FROM supplier) AS actor_id, type,
  CASE WHEN type = 'base64' THEN trim(value) ELSE lower(trim(value)) END AS value FROM found WHERE type IN ('email', 'hash', 'ip')),
keyed AS (SELECT doc_id, type, CASE WHEN type = 'base64' THEN trim(value) ELSE lower(trim(value)) END AS value FROM found)
SELECT doc_id, type, value, actor_id, name FROM keyed JOIN known USING (type, value) JOIN actors USING (actor_id)""")
def threat_actor_join(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    total = supplier.agg(F.count(F.lit(1))).scalar()
    found = doc_indicators(spark, sf_dir)
    # each actor claims the indicators of some documents, in another spelling
    claimed = found.filter(F.col("type").isin("email", "hash", "ip")).select(
        F.pmod("doc_id", total).alias("actor_id"),
        F.array(F.struct("type", F.concat(F.lit("  "), F.upper("value"), F.lit(" ")).alias("value"))).alias("iocs"),
    )
    repository = claimed.join(
        supplier.select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name")), "actor_id"
    )
    return J.actor_matches(found, repository)


@query("reputation_join", with_log("""
, rep AS (SELECT '203.0.113.' || CAST(s_suppkey % 60 AS VARCHAR) AS ip, max(CAST(floor(s_acctbal / 100) AS BIGINT)) AS score,
  max(s_nationkey) AS reports FROM supplier GROUP BY 1),
ips AS (SELECT DISTINCT dst_ip AS ip FROM log)
SELECT ip, coalesce(score, 0) AS score, coalesce(score, 0) > 25 AS malicious,
  CAST(coalesce(score, 0) AS VARCHAR) || '% confidence, ' || CAST(coalesce(reports, 0) AS VARCHAR) || ' reports, ?, ISP: ' ||
  CASE WHEN score IS NULL THEN '?' ELSE 'net' END AS detail
FROM ips LEFT JOIN rep USING (ip)"""))
def reputation_join(spark, sf_dir):
    address = F.concat(F.lit("203.0.113."), (F.col("s_suppkey") % 60).cast("string"))
    reputation = (
        table(spark, sf_dir, "supplier")
        .groupBy(address.alias("ip"))
        .agg(F.max(F.floor(F.col("s_acctbal") / 100)).alias("score"), F.max("s_nationkey").alias("reports"))
        .select("*", F.lit(None).cast("string").alias("country"), F.lit("net").alias("isp"))
    )
    addresses = flat_log(spark, sf_dir).select(F.col("dst_ip").alias("ip")).distinct()
    return J.with_reputation(addresses, reputation, "ip")


@query("cache_split", """
WITH cache AS (SELECT DISTINCT 'ip:' || CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus <> 'P')
SELECT c_custkey, 'ip:' || CAST(c_custkey AS VARCHAR) AS key,
  'ip:' || CAST(c_custkey AS VARCHAR) IN (SELECT key FROM cache) AS cached FROM customer""")
def cache_split(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ip:"), F.col("o_custkey").cast("string")).alias("key"), (F.col("o_orderstatus") == "P").alias("loading")
    )
    wanted = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("ip").alias("type"), F.col("c_custkey").cast("string").alias("value")
    )
    return J.cache_split(wanted, cache).select("c_custkey", "key", "cached")


_LATEST = """
WITH old AS (SELECT o_custkey AS k, o_orderdate AS d, o_orderpriority AS note FROM orders WHERE o_orderkey % 2 = 0),
changes AS (SELECT o_custkey AS k, o_orderdate AS d, o_orderpriority AS note FROM orders WHERE o_orderkey % 2 = 1),
latest AS (SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM changes)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC, note DESC) = 1),
kept AS (SELECT * FROM latest WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))
"""


def _bookmarks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("note")
    )
    old = orders.filter(F.col("o_orderkey") % 2 == 0).drop("o_orderkey")
    changes = orders.filter(F.col("o_orderkey") % 2 == 1).drop("o_orderkey")
    gone = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("k"))
    return J.remove(J.upsert(old, changes, ["k"], "d"), gone, ["k"])


@query("bookmark_upsert", _LATEST + "SELECT k, strftime(d, '%Y-%m-%d') AS d, note FROM kept")
def bookmark_upsert(spark, sf_dir):
    return _bookmarks(spark, sf_dir).select("k", F.date_format("d", "yyyy-MM-dd").alias("d"), "note")


@query("bookmark_flag", _LATEST + """
SELECT c_custkey AS k, c_custkey IN (SELECT k FROM kept) AS bookmarked FROM customer""")
def bookmark_flag(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return J.flag(rows, _bookmarks(spark, sf_dir), ["k"])


def _processes(spark, sf_dir):
    """Every event as a process; the process started by event n is that of event n // 3."""
    log = flat_log(spark, sf_dir)
    parent = F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 3))
    return log.select("event_id", parent.alias("parent_id"), "image")


_PROCESSES = ", p AS (SELECT event_id, CASE WHEN event_id > 0 THEN event_id // 3 END AS parent_id, image FROM log)"


@query("process_lineage", f"""
WITH RECURSIVE {with_log(_PROCESSES)[5:]},
down AS (SELECT c.event_id FROM p c JOIN p a ON c.parent_id = a.event_id WHERE contains(a.image, 'svch0st')
  UNION SELECT c.event_id FROM p c JOIN down d ON c.parent_id = d.event_id)
SELECT event_id, image FROM p WHERE event_id IN (SELECT event_id FROM down)""")
def process_lineage(spark, sf_dir):
    processes = _processes(spark, sf_dir)
    found = L.descendants(processes, "event_id", "parent_id", F.col("image").contains("svch0st"))
    return found.select("event_id", "image")


@query("parent_child", with_log(_PROCESSES + """
SELECT c.event_id, c.image, a.image AS parent_image FROM p c JOIN p a ON c.parent_id = a.event_id"""))
def parent_child(spark, sf_dir):
    joined = L.with_parent(_processes(spark, sf_dir), "event_id", "parent_id", ["image"])
    return joined.select("event_id", "image", "parent_image")


# ---------------------------------------------------------------- housekeeping of rules

_CORPUS = """
WITH rules AS (SELECT o_orderkey AS rule_id, 'rule ' || CAST(o_custkey AS VARCHAR) AS title, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END AS modified,
  CASE o_orderstatus WHEN 'P' THEN 'deprecated' WHEN 'F' THEN 'experimental' ELSE 'stable' END AS status,
  (['informational', 'low', 'medium', 'high', 'critical'])[o_custkey % 5 + 1] AS level FROM orders)
"""


def _corpus(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    date = F.to_date("o_orderdate")
    levels = F.array(*[F.lit(v) for v in RC.LEVEL_ORDER])
    return orders.select(
        F.col("o_orderkey").alias("rule_id"),
        F.concat(F.lit("rule "), F.col("o_custkey").cast("string")).alias("title"),
        date.alias("date"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_add(date, (F.col("o_orderkey") % 90).cast("int"))).alias("modified"),
        F.when(F.col("o_orderstatus") == "P", F.lit("deprecated"))
        .when(F.col("o_orderstatus") == "F", F.lit("experimental"))
        .otherwise(F.lit("stable"))
        .alias("status"),
        F.get(levels, (F.col("o_custkey") % 5).cast("int")).alias("level"),
    )


@query("deprecated_summary", _CORPUS + """
SELECT rule_id, title, strftime(date, '%Y-%m-%d') AS date, strftime(coalesce(modified, date), '%Y-%m-%d') AS modified
FROM rules WHERE status = 'deprecated'""")
def deprecated_summary(spark, sf_dir):
    rows = RC.deprecated_summary(_corpus(spark, sf_dir))
    return rows.select("rule_id", "title", F.col("date").cast("string").alias("date"), F.col("modified").cast("string").alias("modified"))


@query("export_rule_summary", _CORPUS + """
SELECT CAST(rule_id AS VARCHAR) AS rule_id, title, strftime(coalesce(modified, date), '%Y-%m-%d') AS modified
FROM rules WHERE status = 'deprecated'""")
def export_rule_summary(spark, sf_dir):
    from emberwatch.session import scratch_path
    from emberwatch.sinks.matches import write_report

    path = scratch_path(spark, "report")
    write_report(RC.deprecated_summary(_corpus(spark, sf_dir)), path)
    return spark.read.option("header", True).csv(path).select("rule_id", "title", "modified")


@query("promotion_candidates", _CORPUS + """
SELECT rule_id, date_diff('day', coalesce(modified, date), DATE '2001-06-01') AS age FROM rules
WHERE status = 'experimental' AND date_diff('day', coalesce(modified, date), DATE '2001-06-01') >= 300""")
def promotion_candidates(spark, sf_dir):
    as_of = F.lit("2001-06-01").cast("date")
    return RC.promotion_candidates(_corpus(spark, sf_dir), as_of).select("rule_id", F.col("age").cast("long"))


@query("new_references", """
SELECT DISTINCT url AS reference FROM pages WHERE starts_with(url, 'http')
  AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def new_references(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = pages.select(F.array(F.col("url"), F.concat(F.lit("see "), "url")).alias("references"))
    archived = pages.filter(F.col("page_id") % 3 == 0).select(F.col("url").alias("reference"))
    return RC.new_references(rules, archived)


@query("rule_package_select", _CORPUS + """
SELECT 'listed' AS package, count(*) AS n FROM rules WHERE level IN ('high', 'critical') AND status = 'stable'
UNION ALL SELECT 'lowest', count(*) FROM rules WHERE level IN ('medium', 'high', 'critical') AND status IN ('stable', 'experimental')""")
def rule_package_select(spark, sf_dir):
    rules = _corpus(spark, sf_dir)
    listed = RC.package(rules, ["high", "critical"], ["stable"])
    lowest = RC.package(rules, min_level="medium", min_status="experimental")
    tagged = listed.select(F.lit("listed").alias("package")).unionByName(lowest.select(F.lit("lowest").alias("package")))
    return tagged.groupBy("package").agg(F.count(F.lit(1)).alias("n"))

"""Queries for thresholds, proximity, sequences and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import temporal as T
from emberwatch.operators.boundsequence import BoundStage, sequence_bound
from emberwatch.operators.timeline import sessions
from emberwatch.plans.binding import flat_log, with_log
from emberwatch.plans.registry import query, table

HOUR = 3_600_000_000
DAY = 24 * HOUR

_kind = lambda name: F.col("event_type") == name
_day = lambda frame: frame.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
_SQL_DAY = "strftime(ts, '%Y-%m-%d')"


@query("threshold_count", with_log(f"""
SELECT user_id, {_SQL_DAY} AS day, count(*) AS n FROM log GROUP BY 1, 2 HAVING count(*) > 3"""))
def threshold_count(spark, sf_dir):
    return _day(T.count_over(flat_log(spark, sf_dir), ["user_id"], "ts", "1 day", 3))


@query("threshold_count_trailing", with_log(f"""
, c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS n FROM log)
SELECT event_id, user_id, n FROM c WHERE n > 2"""))
def threshold_count_trailing(spark, sf_dir):
    events = flat_log(spark, sf_dir).select("event_id", "user_id", "us")
    return T.trailing_count_over(events, ["user_id"], "us", 6 * HOUR, 2).select("event_id", "user_id", "n")


@query("threshold_global", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 2""")
def threshold_global(spark, sf_dir):
    found = T.count_over(flat_log(spark, sf_dir), [], "ts", "1 hour", 2)
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "n")


@query("threshold_distinct", with_log(f"""
SELECT user_id, {_SQL_DAY} AS day, count(DISTINCT event_type) AS n FROM log GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 2"""))
def threshold_distinct(spark, sf_dir):
    return _day(T.distinct_over(flat_log(spark, sf_dir), ["user_id"], "ts", "1 day", "event_type", 2))


@query("threshold_distinct_trailing", with_log(f"""
, d AS (SELECT a.user_id, a.us, count(DISTINCT b.event_type) AS n FROM log a
  JOIN log b ON a.user_id = b.user_id AND b.us BETWEEN a.us - {DAY} AND a.us GROUP BY a.user_id, a.us)
SELECT user_id, us, n FROM d WHERE n > 2"""))
def threshold_distinct_trailing(spark, sf_dir):
    events = flat_log(spark, sf_dir)
    return T.trailing_distinct_over(events, ["user_id"], "us", DAY, "event_type", 2)


@query("threshold_sum", with_log(f"""
SELECT user_id, {_SQL_DAY} AS day, CAST(sum(k) AS BIGINT) AS total FROM log GROUP BY 1, 2 HAVING sum(k) > 150"""))
def threshold_sum(spark, sf_dir):
    return _day(T.sum_over(flat_log(spark, sf_dir), ["user_id"], "ts", "1 day", F.col("k"), 150))


@query("rare_count", with_log(f"""
SELECT host, event_type, {_SQL_DAY} AS day, count(*) AS n FROM log GROUP BY 1, 2, 3 HAVING count(*) < 2"""))
def rare_count(spark, sf_dir):
    return _day(T.count_under(flat_log(spark, sf_dir), ["host", "event_type"], "ts", "1 day", 2))


@query("threshold_no_timeframe", with_log("""
SELECT user_id, event_type, count(*) AS n FROM log GROUP BY 1, 2 HAVING count(*) > 10"""))
def threshold_no_timeframe(spark, sf_dir):
    return T.count_total(flat_log(spark, sf_dir), ["user_id", "event_type"], 10)


def _exists(kind: str, span: int) -> str:
    return (
        f"EXISTS (SELECT 1 FROM log b WHERE b.user_id = a.user_id AND b.event_type = '{kind}' "
        f"AND b.us BETWEEN a.us - {span} AND a.us + {span})"
    )


@query("near_all", with_log(f"""
SELECT event_id, user_id FROM log a WHERE event_type = 'error' AND {_exists('view', 6 * HOUR)} AND {_exists('purchase', 6 * HOUR)}"""))
def near_all(spark, sf_dir):
    required = {"view": _kind("view"), "purchase": _kind("purchase")}
    events = flat_log(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    return T.near(events, ["user_id"], "us", 6 * HOUR, _kind("error"), required).select("event_id", "user_id")


@query("near_not", with_log(f"""
SELECT event_id, user_id FROM log a WHERE event_type = 'error' AND {_exists('view', DAY)} AND NOT {_exists('purchase', DAY)}"""))
def near_not(spark, sf_dir):
    events = flat_log(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    found = T.near(
        events, ["user_id"], "us", DAY, _kind("error"), {"view": _kind("view")}, {"purchase": _kind("purchase")}
    )
    return found.select("event_id", "user_id")


@query("near_across_rules", with_log(f"""
SELECT event_id, source_file FROM log a WHERE eid = 4624 AND starts_with(image, 'C:\\Users') AND EXISTS (
  SELECT 1 FROM log b WHERE b.source_file = a.source_file AND b.eid = 22 AND contains(b.image, 'svch0st')
  AND b.us BETWEEN a.us - {6 * HOUR} AND a.us + {6 * HOUR})"""))
def near_across_rules(spark, sf_dir):
    log = flat_log(spark, sf_dir)
    logons = log.filter((F.col("eid") == 4624) & F.col("image").startswith("C:\\Users"))
    lookups = log.filter((F.col("eid") == 22) & F.col("image").contains("svch0st"))
    both = T.tagged_union({"logon": logons, "lookup": lookups}, ["event_id", "source_file", "us"])
    found = T.near(
        both, ["source_file"], "us", 6 * HOUR, F.col("selection") == "logon", {"lookup": F.col("selection") == "lookup"}
    )
    return found.select("event_id", "source_file")


_STEP2 = """
, s2 AS (SELECT a.{k1} AS key, a.event_id AS a_id, a.us AS a_at, min(b.us) AS b_at, arg_min(b.event_id, b.us) AS b_id
  FROM log a JOIN log b ON b.{k2} = a.{k1} AND b.us > a.us WHERE a.event_type = '{a}' AND b.event_type = '{b}' GROUP BY 1, 2, 3)
"""


@query("sequence_by", with_log(_STEP2.format(k1="user_id", k2="user_id", a="signup", b="view") + f"""
SELECT key AS user_id, a_id AS signup_id, b_id AS view_id, arg_min(c.event_id, c.us) AS purchase_id
FROM s2 JOIN log c ON c.user_id = key AND c.us > b_at AND c.event_type = 'purchase'
GROUP BY key, a_id, a_at, b_id HAVING min(c.us) - a_at <= {2 * DAY}"""))
def sequence_by(spark, sf_dir):
    stages = [T.Stage(n, _kind(n), "user_id") for n in ("signup", "view", "purchase")]
    found = T.sequence(flat_log(spark, sf_dir), stages, "us", "event_id", 2 * DAY)
    return found.select(F.col("key").alias("user_id"), "signup_id", "view_id", "purchase_id")


@query("sequence_with", with_log(_STEP2.format(k1="user_id", k2="k", a="click", b="purchase") + f"""
SELECT key, a_id AS click_id, b_id AS purchase_id FROM s2 WHERE b_at - a_at <= {2 * DAY}"""))
def sequence_with(spark, sf_dir):
    stages = [T.Stage("click", _kind("click"), "user_id"), T.Stage("purchase", _kind("purchase"), "k")]
    return T.sequence(flat_log(spark, sf_dir), stages, "us", "event_id", 2 * DAY).select("key", "click_id", "purchase_id")


@query("sequence_until", with_log(_STEP2.format(k1="user_id", k2="user_id", a="view", b="purchase") + """
SELECT key AS user_id, a_id AS view_id, b_id AS purchase_id FROM s2 WHERE NOT EXISTS (
  SELECT 1 FROM log e WHERE e.user_id = key AND e.event_type = 'error' AND e.us > a_at AND e.us < b_at)"""))
def sequence_until(spark, sf_dir):
    stages = [T.Stage("view", _kind("view"), "user_id"), T.Stage("purchase", _kind("purchase"), "user_id")]
    found = T.sequence(flat_log(spark, sf_dir), stages, "us", "event_id", until=_kind("error"))
    return found.select(F.col("key").alias("user_id"), "view_id", "purchase_id")


@query("sequence_bind", with_log(f"""
SELECT a.user_id, a.image AS program, a.event_id AS first_id, arg_min(b.event_id, b.us) AS second_id
FROM log a JOIN log b ON b.user_id = a.user_id AND b.parent_image = a.image AND b.us > a.us
WHERE a.event_type = 'click' AND b.event_type <> 'click'
GROUP BY a.user_id, a.image, a.event_id, a.us HAVING min(b.us) - a.us <= {2 * DAY}"""))
def sequence_bind(spark, sf_dir):
    binding = {"program": (F.col("image"), F.col("parent_image"))}
    found = T.sequence_bind(
        flat_log(spark, sf_dir), _kind("click"), ~_kind("click"), ["user_id"], binding, "us", "event_id", 2 * DAY
    )
    return found.select("user_id", "program", "first_id", "second_id")


@query("sequence_bind_prefix", with_log(rf"""
, a AS (SELECT event_id, user_id, us, lower(regexp_extract(image, '([^\\]+)$', 1)) AS name, regexp_extract(image, '^(.*\\)', 1) AS folder
  FROM log WHERE event_type = 'click'),
b AS (SELECT a.*, arg_min(l.event_id, l.us) AS run_id, min(l.us) AS run_us FROM a JOIN log l ON l.user_id = a.user_id AND l.us > a.us
  AND l.event_type <> 'click' AND contains(lower(l.cmdline), a.name) GROUP BY ALL),
c AS (SELECT b.event_id AS first_id, b.user_id, b.us, b.run_id, arg_min(l.event_id, l.us) AS child_id, min(l.us) AS child_us
  FROM b JOIN log l ON l.user_id = b.user_id AND l.us > b.run_us AND starts_with(l.parent_image, b.folder) GROUP BY ALL)
SELECT user_id, first_id, run_id, child_id FROM c WHERE child_us - us <= {5 * DAY}"""))
def sequence_bind_prefix(spark, sf_dir):
    name, folder = F.regexp_extract("image", r"([^\\]+)$", 1), F.regexp_extract("image", r"^(.*\\)", 1)
    stages = [
        BoundStage("run", ~_kind("click"), F.col("cmdline"), name, "contains", ignore_case=True),
        BoundStage("child", F.lit(True), F.col("parent_image"), folder, "startswith"),
    ]
    found = sequence_bound(flat_log(spark, sf_dir), _kind("click"), stages, ["user_id"], "us", "event_id", 5 * DAY)
    return found.select("user_id", "first_id", "run_id", "child_id")


@query("sequence_turns", """
SELECT a.conv_id, a.turn AS system_at, min(b.turn) AS user_at, min(c.turn) AS assistant_at
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'user'
JOIN conversations c ON c.conv_id = a.conv_id AND c.turn > b.turn AND c.role = 'assistant'
WHERE a.role = 'system' GROUP BY a.conv_id, a.turn""")
def sequence_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    stages = [T.Stage(n, F.col("role") == n, "conv_id") for n in ("system", "user", "assistant")]
    found = T.sequence(turns, stages, "turn", "turn", width=1000)
    return found.select(F.col("key").alias("conv_id"), "system_at", "user_at", "assistant_at")


@query("any_category", with_log("SELECT event_id, event_type FROM log WHERE contains(lower(image), 'temp') AND k > 50"))
def any_category(spark, sf_dir):
    log = flat_log(spark, sf_dir)
    categories = {n: log.filter(_kind(n)) for n in ("click", "view", "purchase", "signup", "error")}
    every = T.tagged_union(categories, ["event_id", "event_type", "image", "k"])
    return every.filter(F.lower("image").contains("temp") & (F.col("k") > 50)).select("event_id", "event_type")


SESSIONS = f"""
, e AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {6 * HOUR} AS apart FROM log),
s AS (SELECT *, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS session FROM e),
g AS (SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, session)
"""


@query("session_events", with_log(SESSIONS + "SELECT user_id, first_us, last_us, n FROM g"))
def session_events(spark, sf_dir):
    events = flat_log(spark, sf_dir).select("user_id", "us")
    grouped = sessions(events, ["user_id"], "us", 6 * HOUR).groupBy("user_id", F.col("session_start").alias("first_us"))
    return grouped.agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))

"""Streaming queries: the events table as a stream, run to its end.

Windows are kept as they grow (update mode), so their results are whole at the
stream's end. Sessions and sequences come out when the watermark has closed
them; a last row at the end of time closes what is open when the log ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators.detection import detect, hits_of_rows, rule_hits
from emberwatch.plans.binding import as_events, flatten, with_log
from emberwatch.plans.q_detection import MATCHES, RULES
from emberwatch.plans.q_temporal import DAY, HOUR, SESSIONS
from emberwatch.plans.registry import query, table
from emberwatch.session import scratch_path
from emberwatch.streaming import jobs
from emberwatch.streaming.run import STATE_STORE, append_to_table, append_whole, latest_updates, read_parquet_stream, write_with_progress
from emberwatch.streaming.sequences import sequences, staged


def log_stream(spark, sf_dir):
    return flatten(read_parquet_stream(spark, sf_dir, "events.parquet"))


_kind = lambda name: F.col("event_type") == name


def _daily(stream, name, keys=()):
    frame = stream.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
    return latest_updates(frame, name, [*keys, "day"])


@query("stream_threshold_count", with_log(f"""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM log GROUP BY 1, 2 HAVING count(*) > 3"""))
def stream_threshold_count(spark, sf_dir):
    return _daily(jobs.count_over(log_stream(spark, sf_dir), ["user_id"], "ts", "1 day", "1 day", 3), "threshold", ["user_id"])


@query("stream_threshold_global", with_log(f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM log GROUP BY 1 HAVING count(*) > 20"""))
def stream_threshold_global(spark, sf_dir):
    return _daily(jobs.count_over(log_stream(spark, sf_dir), [], "ts", "1 day", "1 day", 20), "global")


@query("stream_threshold_distinct", with_log(f"""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT event_type) AS n FROM log
GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 2"""))
def stream_threshold_distinct(spark, sf_dir):
    stream = log_stream(spark, sf_dir)
    seen = _daily(jobs.values_seen(stream, ["user_id"], "ts", "1 day", "1 day", "event_type"), "distinct", ["user_id", "event_type"])
    return seen.groupBy("user_id", "day").agg(F.count("event_type").alias("n")).filter("n > 2")


@query("stream_threshold_sum", with_log(f"""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(k) AS BIGINT) AS total FROM log
GROUP BY 1, 2 HAVING sum(k) > 150"""))
def stream_threshold_sum(spark, sf_dir):
    stream = log_stream(spark, sf_dir)
    return _daily(jobs.sum_over(stream, ["user_id"], "ts", "1 day", "1 day", F.col("k"), 150), "sum", ["user_id"])


def _exists(kind: str, low: int, high: int) -> str:
    return (
        f"EXISTS (SELECT 1 FROM log b WHERE b.user_id = a.user_id AND b.event_type = '{kind}' "
        f"AND b.us BETWEEN a.us + {low} AND a.us + {high})"
    )


@query("stream_near_all", with_log(f"""
SELECT event_id FROM log a WHERE event_type = 'error' AND {_exists('view', -6 * HOUR, 6 * HOUR)}
AND {_exists('purchase', -6 * HOUR, 6 * HOUR)}"""))
def stream_near_all(spark, sf_dir):
    stream = log_stream(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    required = {"view": _kind("view"), "purchase": _kind("purchase")}
    found = jobs.near(stream, "user_id", "ts", "event_id", "6 HOURS", _kind("error"), required)
    return append_to_table(found.select("event_id"), "near")


@query("stream_followed_by", with_log(f"""
SELECT event_id FROM log a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM log b WHERE b.k = a.user_id
  AND b.event_type = 'purchase' AND b.us > a.us AND b.us <= a.us + {2 * DAY})"""))
def stream_followed_by(spark, sf_dir):
    stream = log_stream(spark, sf_dir).select("event_id", "user_id", "k", "ts", "event_type")
    found = jobs.followed_by(stream, _kind("click"), _kind("purchase"), "user_id", "k", "ts", "event_id", "2 DAYS")
    return append_to_table(found.select("event_id"), "followed")


@query("stream_sequence", with_log(f"""
, c AS (SELECT c.user_id, c.us, max(a.us) AS first_us FROM log c
  JOIN log b ON b.user_id = c.user_id AND b.us < c.us AND b.event_type = 'view'
  JOIN log a ON a.user_id = c.user_id AND a.us < b.us AND a.event_type = 'signup'
  WHERE c.event_type = 'purchase' AND c.us - a.us <= {2 * DAY} GROUP BY c.user_id, c.us)
SELECT user_id, first_us, us AS last_us FROM c"""))
def stream_sequence(spark, sf_dir):
    stages = [(_kind(n), "user_id") for n in ("signup", "view", "purchase")]
    log = log_stream(spark, sf_dir).select("user_id", "ts", "event_type")
    found = append_whole(log, "ts", lambda s: sequences(staged(s, stages, "ts"), 3, 2 * DAY, "1 day"), "sequence", STATE_STORE)
    return found.select(F.col("key").alias("user_id"), "first_us", "last_us")


@query("stream_session_events", with_log(SESSIONS + """
SELECT user_id, first_us, last_us, n FROM g"""))
def stream_session_events(spark, sf_dir):
    log = log_stream(spark, sf_dir).select("user_id", "ts")
    found = append_whole(log, "ts", lambda s: jobs.gap_sessions(s, ["user_id"], "ts", "6 hours", "1 day"), "sessions")
    return found.select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n"
    )


@query("stream_detect", with_log(MATCHES + " SELECT event_id, rule_id FROM hits"))
def stream_detect(spark, sf_dir):
    events = as_events(log_stream(spark, sf_dir))
    return append_to_table(rule_hits(events, RULES, ["event_id"], route=True), "detect")


#: Bytes of a row group of a batch's file: small, so that all cores share a file, which is split by row groups.
ROW_GROUP = 2 << 20


def in_files(rows, number, folder):
    """``rows`` as one file for each value of the column ``number``, four at most."""
    dealt = rows.withColumn("part", number).repartition(4, "part")
    dealt.write.option("parquet.block.size", ROW_GROUP).partitionBy("part").parquet(folder)


@query("stream_progress", with_log(MATCHES + """
SELECT 'events' AS measure, 4 AS batches, CAST(count(*) AS DOUBLE) AS total FROM log
UNION ALL SELECT 'hits', 4, CAST(count(*) AS DOUBLE) FROM hits
UNION ALL SELECT 'written', 4, CAST((SELECT count(*) FROM log) AS DOUBLE)"""))
def stream_progress(spark, sf_dir):
    """Detection over the log in four files, one a batch: what each batch saw and found adds up to the whole."""
    folder = scratch_path(spark, "parts")
    in_files(table(spark, sf_dir, "events"), F.col("event_id") % 4, folder)
    log = as_events(flatten(read_parquet_stream(spark, folder, "*.parquet", files_per_batch=1)))
    frame, found = hits_of_rows(log, RULES, ["event_id"], route=True)
    seen = frame.select("event_id", F.size(found).alias("n_hits"))
    rows, progress = write_with_progress(seen, "scan", events=F.count(F.lit(1)), hits=F.sum("n_hits"))
    totals = progress.groupBy("measure").agg(F.count_distinct("batch").cast("int").alias("batches"), F.sum("value").alias("total"))
    written = rows.agg(F.lit("written").alias("measure"), F.count_distinct("batch").cast("int").alias("batches"), F.count(F.lit(1)).cast("double").alias("total"))
    return totals.unionByName(written)


@query("stream_dedupe", "SELECT event_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    stream = log_stream(spark, sf_dir).select("event_id", "event_type", "ts")
    twice = stream.union(log_stream(spark, sf_dir).select("event_id", "event_type", "ts"))
    once = jobs.without_duplicates(twice, ["event_id"], "ts", "1 day").select("event_id", "event_type")
    return append_to_table(once, "dedupe")


@query("stream_triage", with_log(MATCHES + """
SELECT host, strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) FILTER (level = 'critical') AS critical,
  count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium,
  count(*) FILTER (coalesce(level, 'low') NOT IN ('critical', 'high', 'medium')) AS low FROM matches GROUP BY 1, 2"""))
def stream_triage(spark, sf_dir):
    events = as_events(log_stream(spark, sf_dir))
    found = detect(events, RULES, ["timestamp", "host"], route=True)
    levels = jobs.running_levels(found, ["host"], "timestamp", "1 day", "1 day")
    daily = levels.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
    return latest_updates(daily, "triage", ["host", "day"])

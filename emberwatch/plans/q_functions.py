"""Queries for the scalar functions that no other query shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions import text as X
from emberwatch.functions.net import in_networks
from emberwatch.operators.predicates import Field, match_equals
from emberwatch.plans.binding import flat_log, with_log
from emberwatch.plans.registry import query, table


@query("fn_string", with_log("""
SELECT event_id, split_part(image, chr(92), -1) AS base, substr(message, 1, 20) AS head, lower(trim(image)) AS norm,
  length(message) AS len, contains(image, 'System32') AS sys, ends_with(image, '.exe') AS exe FROM log"""))
def fn_string(spark, sf_dir):
    return flat_log(spark, sf_dir).select(
        "event_id",
        X.basename(F.col("image")).alias("base"),
        F.left("message", F.lit(20)).alias("head"),
        F.lower(F.trim("image")).alias("norm"),
        F.length("message").cast("long").alias("len"),
        F.col("image").contains("System32").alias("sys"),
        F.col("image").endswith(".exe").alias("exe"),
    )


@query("fn_wildcard", with_log("""
SELECT event_id, image LIKE 'C:\\Windows\\%.exe' ESCAPE '!' AS cased, lower(image) LIKE 'c:\\windows\\s__host%' ESCAPE '!' AS loose,
  lower(account) IN ('user1', 'user2') AS listed FROM log""".replace("\\\\", "\\")))
def fn_wildcard(spark, sf_dir):
    image = F.col("image")
    return flat_log(spark, sf_dir).select(
        "event_id",
        image.like("C:\\\\Windows\\\\%.exe").alias("cased"),
        match_equals(Field.of(image), "C:\\Windows\\s??host*").alias("loose"),
        F.lower("account").isin("user1", "user2").alias("listed"),
    )


@query("fn_regex", with_log("""
SELECT event_id, regexp_full_match(message, '[a-z]+ by user [0-9]+ value 1.*') AS whole,
  regexp_full_match(message, '(?i)VIEW.*') AS loose, array_to_string(regexp_extract_all(message, '[0-9]+'), ',') AS numbers FROM log"""))
def fn_regex(spark, sf_dir):
    message = F.col("message")
    return flat_log(spark, sf_dir).select(
        "event_id",
        X.regex_whole(message, "[a-z]+ by user [0-9]+ value 1.*").alias("whole"),
        X.regex_whole(message, "VIEW.*", ignore_case=True).alias("loose"),
        F.array_join(F.regexp_extract_all(message, F.lit("[0-9]+"), F.lit(0)), ",").alias("numbers"),
    )


@query("fn_distance", """
SELECT p_partkey, levenshtein(p_name, 'red widget') AS distance,
  CASE WHEN levenshtein(p_name, 'red widget') > 4 THEN -1 ELSE levenshtein(p_name, 'red widget') END AS bounded FROM part""")
def fn_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.levenshtein("p_name", F.lit("red widget")).cast("long").alias("distance"),
        F.levenshtein("p_name", F.lit("red widget"), 4).cast("long").alias("bounded"),
    )


@query("fn_net", with_log("""
SELECT event_id, starts_with(dst_ip, '10.') AS ten, starts_with(dst_ip, '2001:db8:') AS six,
  starts_with(dst_ip, '192.168.1.') AND CAST(split_part(dst_ip, '.', -1) AS VARCHAR) IN ('64','65','66','67','68','69','70','71','72','73','74','75','76','77','78','79') AS part FROM log"""))
def fn_net(spark, sf_dir):
    address = F.col("dst_ip")
    return flat_log(spark, sf_dir).select(
        "event_id",
        in_networks(address, ["10.0.0.0/8"]).alias("ten"),
        in_networks(address, ["2001:db8::/32"]).alias("six"),
        in_networks(address, ["192.168.1.64/28"]).alias("part"),
    )


@query("fn_date", """
SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS age,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders""")
def fn_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.datediff(F.lit("2001-01-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("age"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


@query("fn_math", """
SELECT l_orderkey, l_linenumber, least(10, ceil(l_quantity / 5)) AS up, greatest(3, floor(l_quantity / 5)) AS down,
  floor(l_quantity / 4 + 0.5) AS half_up FROM lineitem""")
def fn_math(spark, sf_dir):
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.least(F.lit(10), F.ceil(quantity / 5)).cast("double").alias("up"),
        F.greatest(F.lit(3), F.floor(quantity / 5)).cast("double").alias("down"),
        F.round(quantity / 4).alias("half_up"),
    )


@query("fn_array", """
SELECT vec_id, len([x for x in embedding if x > 0.3]) > 0 AS any_big, CAST(len(list_distinct(embedding[1:4])) AS BIGINT) AS n FROM embeddings""")
def fn_array(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.exists("embedding", lambda x: x > F.lit(0.3)).alias("any_big"),
        F.size(F.array_distinct(F.slice("embedding", 1, 4))).cast("long").alias("n"),
    )


@query("fn_map", """
SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k, 'k=' || regexp_extract(props, '([0-9]+)', 1) AS flat,
  event_type AS dup FROM events""")
def fn_map(spark, sf_dir):
    from emberwatch.sources.linux import key_values

    line = F.concat(F.lit('dup="first one" dup='), "event_type")
    props = F.from_json("props", "map<string,string>")
    pairs = F.transform(F.map_entries(props), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.element_at(props, "k").alias("k"),
        F.array_join(pairs, ",").alias("flat"),
        F.element_at(key_values(line), "dup").alias("dup"),
    )


@query("fn_json_xml", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type AS kind FROM events""")
def fn_json_xml(spark, sf_dir):
    xml = F.concat(F.lit("<e><kind>"), "event_type", F.lit("</kind></e>"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.from_json("props", "k long")["k"].alias("k"),
        F.xpath_string(xml, F.lit("e/kind")).alias("kind"),
    )


@query("fn_null", with_log("""
SELECT event_id, cmdline IS NULL AS missing, coalesce(nullif(cmdline, ''), 'none') AS filled FROM log"""))
def fn_null(spark, sf_dir):
    command = F.col("cmdline")
    return flat_log(spark, sf_dir).select(
        "event_id", command.isNull().alias("missing"), F.coalesce(X.empty_as_null(command), F.lit("none")).alias("filled")
    )


@query("fn_hash", """
SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, CASE length(md5(text)) WHEN 32 THEN 'md5' ELSE 'other' END AS kind FROM documents""")
def fn_hash(spark, sf_dir):
    md5 = F.md5("text")
    kinds = F.when(F.length(md5) == 32, F.lit("md5")).otherwise(F.lit("other"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha"), md5.alias("md5"), kinds.alias("kind")
    )

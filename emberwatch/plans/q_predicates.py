"""Queries for the rule predicates and conditions, each over the whole log."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from emberwatch.operators import conditions as C
from emberwatch.operators import predicates as P
from emberwatch.operators.detection import rule_hits
from emberwatch.operators.rules import FieldSet, Rule, selection_column
from emberwatch.plans.binding import log_events, with_log
from emberwatch.plans.registry import query, table


def _selection(name: str, body, where: str) -> None:
    """Events that a selection holds for, against the SQL condition."""

    @query(name, with_log(f"SELECT event_id, host FROM log WHERE {where}"))
    def run(spark, sf_dir):
        rule = Rule(name, name, {"selection": body, "condition": "selection"})
        fields = FieldSet(rule.field_names(), rule.has_keywords())
        frame = fields.project(log_events(spark, sf_dir), ["event_id", "host"])
        return frame.filter(selection_column(body, fields)).select("event_id", "host")


_selection("sig_equals", {"ParentImage": [r"c:\windows\EXPLORER.exe", r"C:\Windows\System32\cmd.exe"]},
           r"lower(parent_image) IN ('c:\windows\explorer.exe', 'c:\windows\system32\cmd.exe')")
_selection("sig_wildcard", {"Image": r"C:\Windows\s*h?st.exe"}, r"lower(image) SIMILAR TO 'c:\\windows\\s.*h.st\.exe'")
_selection("sig_number", {"EventID": ["4624", "22"]}, "eid IN (4624, 22)")
_selection("sig_contains", {"Image|contains": ["\\Public\\", "appdata"]},
           r"contains(lower(image), '\public\') OR contains(lower(image), 'appdata')")
_selection("sig_startswith", {"CommandLine|startswith": ["PowerShell", "reg.exe"]},
           "starts_with(lower(cmdline), 'powershell') OR starts_with(lower(cmdline), 'reg.exe')")
_selection("sig_endswith", {"Image|endswith": ["\\CMD.EXE", "\\svchost.exe"]},
           r"ends_with(lower(image), '\cmd.exe') OR ends_with(lower(image), '\svchost.exe')")
_selection("sig_all", {"CommandLine|contains|all": ["procdump", "lsass", "-MA"]},
           "contains(lower(cmdline), 'procdump') AND contains(lower(cmdline), 'lsass') AND contains(lower(cmdline), '-ma')")
_selection("sig_re", {"CommandLine|re": "-[A-Z][A-Za-z]+ [A-Z]"}, "regexp_matches(cmdline, '-[A-Z][A-Za-z]+ [A-Z]')")
_selection("sig_re_i", {"CommandLine|re|i": "WHOAMI$|report_[0-9]{4}"}, "regexp_matches(cmdline, '(?i)WHOAMI$|report_[0-9]{4}')")
_selection("sig_windash", {"CommandLine|windash|contains": " -ma "},
           "contains(lower(cmdline), ' -ma ') OR contains(lower(cmdline), ' /ma ')")
_selection("sig_fieldref", {"Image|fieldref": "ParentImage"}, "lower(image) = lower(parent_image)")
_selection("sig_exists", {"DestinationIp|exists": "true"}, "eid = 3")
_selection("sig_null", {"CommandLine": None}, "cmdline IS NULL")
_selection("sig_empty", {"CommandLine": ""}, "cmdline = ''")
_selection("sig_map_and", {"EventID": "1", "Image|endswith": "\\cmd.exe", "ParentImage|contains": "office"},
           r"eid = 1 AND ends_with(lower(image), '\cmd.exe') AND contains(lower(parent_image), 'office')")
_selection("sig_list_or", [{"Image|endswith": "\\x.exe", "EventID": "22"}, {"CommandLine|contains": "certutil"}],
           r"(ends_with(lower(image), '\x.exe') AND eid = 22) OR contains(lower(cmdline), 'certutil')")


@query("sig_cidr", with_log(r"""
SELECT event_id, dst_ip FROM log
WHERE (starts_with(dst_ip, '172.') AND CAST(split_part(dst_ip, '.', 2) AS BIGINT) BETWEEN 16 AND 31)
   OR starts_with(dst_ip, '2001:db8:1::')
   OR (starts_with(dst_ip, '203.0.113.') AND CAST(split_part(dst_ip, '.', 4) AS BIGINT) < 16)"""))
def sig_cidr(spark, sf_dir):
    networks = ["172.16.0.0/12", "2001:db8:1::/48", "203.0.113.0/28"]
    events = log_events(spark, sf_dir).select("event_id", F.col("ip").alias("dst_ip"))
    return events.filter(P.predicate(P.Field.of(F.col("dst_ip")), networks, ["cidr"]))


@query("sig_base64", with_log(f"""
SELECT event_id FROM log
WHERE contains(base64(encode(image)), '{base64.b64encode(b"C:" + chr(92).encode() + b"Users").decode().rstrip("=")[:10]}')"""))
def sig_base64(spark, sf_dir):
    # nine bytes make twelve characters without padding
    encoded = F.base64(F.encode(F.element_at("eventData", "Image"), "UTF-8"))
    events = log_events(spark, sf_dir).select("event_id", encoded.alias("text"))
    return events.filter(P.predicate(P.Field.of(F.col("text")), ["C:\\Users\\"], ["base64", "contains"])).select("event_id")


@query("sig_base64offset", with_log("SELECT event_id FROM log WHERE contains(image, 'svch0st')"))
def sig_base64offset(spark, sf_dir):
    shifted = F.concat(F.repeat(F.lit("x"), (F.col("event_id") % 3).cast("int")), F.element_at("eventData", "Image"))
    events = log_events(spark, sf_dir).select("event_id", F.base64(F.encode(shifted, "UTF-8")).alias("text"))
    test = P.predicate(P.Field.of(F.col("text")), ["svch0st"], ["base64offset", "contains"])
    return events.filter(test).select("event_id")


@query("sig_wide", with_log("SELECT event_id FROM log WHERE contains(cmdline, 'SQBFAFgAIAA=')"))
def sig_wide(spark, sf_dir):
    events = log_events(spark, sf_dir)
    return events.filter(
        P.predicate(P.Field.of(F.col("processCmd")), ["IEX "], ["wide", "base64", "contains"])
    ).select("event_id")


@query("sig_expand", with_log("SELECT event_id, account FROM log WHERE account IN ('user1', 'user7', 'user13')"))
def sig_expand(spark, sf_dir):
    account = F.element_at("eventData", "SubjectUserName")
    events = log_events(spark, sf_dir).select("event_id", account.alias("account"))
    lists = {"Admins": ["USER1", "user7", "user13"]}
    return events.filter(P.predicate(P.Field.of(F.col("account")), ["%Admins%"], ["expand"], lists))


@query("sig_keywords", """
SELECT doc_id, source FROM documents
WHERE contains(lower(text), 'license') OR contains(lower(text), '@mail') OR contains(lower(text), '%%%')""")
def sig_keywords(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumnRenamed("text", "rawLine")
    fields = FieldSet(set())
    frame = fields.project(documents, ["doc_id", "source"])
    return frame.filter(selection_column(["License", "@mail", "%%%"], fields)).select("doc_id", "source")


SELECTIONS = {
    "selection_image": {"Image|endswith": ["\\cmd.exe", "\\powershell.exe", "\\x.exe"]},
    "selection_event": {"EventID": ["1", "3"]},
    "filter_parent": {"ParentImage|endswith": "\\explorer.exe"},
    "filter_cmd": {"CommandLine|contains": "whoami"},
}

_IMAGE = r"(ends_with(lower(image), '\cmd.exe') OR ends_with(lower(image), '\powershell.exe') OR ends_with(lower(image), '\x.exe'))"
_EVENT = "(eid IN (1, 3))"
_PARENT = r"ends_with(lower(parent_image), '\explorer.exe')"
_COMMAND = "coalesce(contains(lower(cmdline), 'whoami'), false)"


def _condition(name: str, text: str, where: str) -> None:
    @query(name, with_log(f"SELECT event_id FROM log WHERE {where}"))
    def run(spark, sf_dir):
        rule = Rule(name, name, {**SELECTIONS, "condition": text})
        fields = FieldSet(rule.field_names(), False)
        frame = fields.project(log_events(spark, sf_dir), ["event_id"])
        selections = {n: selection_column(b, fields) for n, b in SELECTIONS.items()}
        return frame.filter(C.condition(text, selections)).select("event_id")


_condition("cond_and_or_not", "selection_image and (selection_event or filter_cmd) and not filter_parent",
           f"{_IMAGE} AND ({_EVENT} OR {_COMMAND}) AND NOT {_PARENT}")
_condition("cond_one_of", "1 of selection_*", f"{_IMAGE} OR {_EVENT}")
_condition("cond_all_of", "all of selection_*", f"{_IMAGE} AND {_EVENT}")
_condition("cond_not_one_of", "selection_image and not 1 of filter_*", f"{_IMAGE} AND NOT ({_PARENT} OR {_COMMAND})")


@query("cond_count", with_log(r"""
, c AS (SELECT *, count(*) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS n
  FROM log WHERE ends_with(lower(image), '\cmd.exe'))
SELECT event_id FROM (
  SELECT event_id, bool_or(n > 1) OVER (PARTITION BY host ORDER BY us RANGE BETWEEN CURRENT ROW AND 7200000000 FOLLOWING) AS hit FROM c) WHERE hit"""))
def cond_count(spark, sf_dir):
    selection = {"Image|endswith": "\\cmd.exe"}
    rule = Rule("count", "count", {"selection": selection, "timeframe": "2h", "condition": "selection | count() by host > 1"})
    return rule_hits(log_events(spark, sf_dir), [rule], ["event_id"]).select("event_id")

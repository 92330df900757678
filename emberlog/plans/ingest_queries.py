"""Parsers, ATT&CK roll-ups, exports and streams as named queries, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import attack as at
from emberlog.sources import parsers, sinks
from emberlog.plans.log_view import WITH, as_logs, log_events
from emberlog.streaming import live

_queries, _oracles = {}, {}


def _parse(name: str, parser, line: str, fields: dict[str, str]):
    """Registers a parser over lines that SQL text makes of the view; `fields` names what each field must hold."""

    def run(spark, sf):
        rows = log_events(spark, sf).select("event_id", F.expr(line).alias("value")).select("event_id", parser(F.col("value")).alias("f"))
        return rows.select("event_id", *[F.col("f")[k].alias(k) for k in fields])

    _queries[name] = run
    _oracles[name] = f"{WITH} SELECT event_id, " + ", ".join(f'{sql} AS "{k}"' for k, sql in fields.items()) + " FROM logs"


_ID, _USER, _HOST, _IP = '"EventID"', '"AcctName"', '"Computer"', """nullif("IpAddress",'-')"""
_parse("parse_json", lambda v: parsers.with_aliases(parsers.json_fields(v)), """concat('{"Event":{"System":{"EventID":', EventID, '},"EventData":{"TargetUserName":"', AcctName, '","IpAddress":"', IpAddress, '"}}}')""", {"EventID": _ID, "TargetUserName": _USER, "SourceIp": '"IpAddress"'})
_parse("parse_syslog", parsers.syslog_fields, """concat('<34>Oct 11 22:14:15 ', Computer, ' sshd[', event_id, ']: failed user=', AcctName)""", {"hostname": _HOST, "procid": "CAST(event_id AS VARCHAR)", "user": _USER, "facility": "'4'"})
_parse("parse_cef", parsers.cef_fields, """concat('CEF:0|V|P|1|', EventID, '|a logon|5|suser=', AcctName, ' msg=came from ', Computer, ' today dst=1.2.3.4')""", {"DeviceEventClassID": _ID, "suser": _USER, "msg": """'came from ' || "Computer" || ' today'"""})
_parse("parse_leef", parsers.leef_fields, """concat('LEEF:1.0|V|P|1|', EventID, '|usrName=', AcctName, chr(9), 'host=', Computer)""", {"DeviceEventID": _ID, "usrName": _USER, "host": _HOST})
_parse("parse_auditd", parsers.auditd_fields, """concat('type=LOGIN uid=1 exe="/bin/a b" uid=', AcctName, ' pid=', event_id)""", {"uid": _USER, "pid": "CAST(event_id AS VARCHAR)", "exe": "'/bin/a b'"})
_parse("parse_event_xml", parsers.event_xml_fields, """concat('<Event><System><EventID>', EventID, '</EventID><TimeCreated SystemTime="', SystemTime, '"/></System><EventData><Data Name="TargetUserName">', AcctName, '</Data></EventData></Event>')""", {"EventID": _ID, "SystemTime": '"SystemTime"', "TargetUserName": _USER})
_parse("parse_access_log", parsers.text_fields, """concat(IpAddress, ' - ', AcctName, ' [10/Oct/2023:13:55:36 +0000] "GET /', event_id, ' HTTP/1.1" 200 12')""", {"c-ip": _IP, "cs-username": _USER, "cs-uri-stem": "'/' || event_id", "sc-status": "'200'"})

#: A small technique table for the queries; callers bring a full one.
TECHNIQUES = "VALUES ('T1033','Owner discovery','discovery'), ('T1059.001','Shell','execution'), ('T1105','Tool transfer','command-and-control')"


def techniques(spark):
    return spark.sql(f"SELECT * FROM {TECHNIQUES} AS t(id, name, tactic)")


def setup(rules, hits_sql: str, apply_rules):
    """Registers what needs the catalog's rules and the SQL of their hits."""
    found = lambda spark, sf: at.tagged(apply_rules(log_events(spark, sf), rules))
    tags = f"""{hits_sql}, found AS (SELECT title, level, count(*) AS n FROM hits GROUP BY 1,2), tagged AS (SELECT f.*, technique, tactic FROM found f JOIN (VALUES
('Discovery command','T1033','discovery'), ('Encoded shell','T1059.001','execution'), ('Download with a system tool','T1105','command-and-control'), ('Failed logon',NULL,'credential-access')) t(name, technique, tactic) ON f.title = t.name)"""
    _queries["parse_tags"] = lambda spark, sf: at.parse_tags(found(spark, sf))
    _oracles["parse_tags"] = f"{tags} SELECT title, level, n, technique, NULL AS tactic FROM tagged WHERE technique IS NOT NULL UNION ALL SELECT title, level, n, NULL, tactic FROM tagged"
    _queries["tactic_coverage"] = lambda spark, sf: at.tactic_coverage(found(spark, sf), techniques(spark))
    _oracles["tactic_coverage"] = f"{tags} SELECT tactic, count(DISTINCT technique) AS n_techniques, CAST(sum(n) AS BIGINT) AS n_hits FROM tagged WHERE technique IS NOT NULL GROUP BY 1"
    _queries["kill_chain"] = lambda spark, sf: at.kill_chain(found(spark, sf), techniques(spark))
    _oracles["kill_chain"] = f"{tags} SELECT tactic, [title] AS detections, n AS n_hits, level FROM tagged"
    _queries["export_detections"] = lambda spark, sf: sinks.detections_table(found(spark, sf)).drop("tags")
    _oracles["export_detections"] = f"{tags} SELECT title AS rule_title, level AS rule_level, n AS count FROM tagged"

    def stream(spark, sf):
        # A pattern, since a stream's plain path must be a folder and the table may be one file.
        schema = spark.read.parquet(f"{sf}/events.parquet").schema
        return as_logs(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))

    _queries["live_detect"] = lambda spark, sf: live.run_available(live.live_detect(stream(spark, sf), rules).select("event_id", "title"), "live_detect")
    _oracles["live_detect"] = f"{hits_sql} SELECT event_id, title FROM hits"
    _queries["live_brute_force"] = lambda spark, sf: live.run_available(live.live_brute_force(stream(spark, sf), "AcctName", least=1), "live_brute_force")
    _oracles["live_brute_force"] = f"""{WITH}, failed AS (SELECT date_trunc('hour', CAST("SystemTime" AS TIMESTAMP)) AS h, CAST("SystemTime" AS TIMESTAMP) AS t, "AcctName" AS user, "IpAddress" AS ip FROM logs WHERE "EventID"='4625')
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS begins, user, ip, count(*) AS n FROM failed WHERE h + INTERVAL 1 HOUR <= (SELECT max(t) FROM failed) - INTERVAL 1 HOUR GROUP BY 1,2,3"""


def queries():
    return dict(_queries)


def oracles():
    return dict(_oracles)

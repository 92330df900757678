"""Readers, sinks and alerts over files that Spark makes of the view in the shared folder, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators import attack as at
from emberlog.operators import incident as inc
from emberlog.operators import rules as ru
from emberlog.plans.log_view import WITH, as_logs, log_events
from emberlog.sources import readers, sinks
from emberlog.streaming import live

_queries, _oracles = {}, {}


def _folder(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text(spark, sf: str, name: str, value: str) -> str:
    """A folder of text files with `value` (SQL) of every row of the view."""
    path = _folder(spark, name)
    log_events(spark, sf).select(F.expr(value.replace("\\", "\\\\"))).write.text(path)
    return path


def _fields(landing: DataFrame, *names: str) -> DataFrame:
    return landing.select(*[F.col("fields")[n].alias(n) for n in names])


def read_csv(spark, sf):
    """Every seventh line has a cell more than the header."""
    path = _folder(spark, "csv")
    line = F.concat_ws(",", "event_id", "EventID", "AcctName", "Computer", F.when(F.col("event_id") % 7 == 0, "more"))
    files = log_events(spark, sf).groupBy(F.expr("event_id div 500")).agg(F.concat_ws("\n", F.lit("event_id,EventID,AcctName,Computer"), F.collect_list(line)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _fields(readers.read_csv(spark, path), "event_id", "EventID", "AcctName", "Computer", "field_4")


_queries["read_csv"] = read_csv
_oracles["read_csv"] = f"""{WITH} SELECT CAST(event_id AS VARCHAR) AS event_id, "EventID", "AcctName", "Computer", CASE WHEN event_id % 7 = 0 THEN 'more' END AS field_4 FROM logs"""


def read_csv_folders(spark, sf):
    """Files with the same columns in other orders, some with a column more, in one folder."""
    path = _folder(spark, "csv-folders")
    names = {0: ("event_id", "EventID", "AcctName"), 1: ("AcctName", "event_id", "EventID"), 2: ("Computer", "AcctName", "EventID", "event_id")}
    events = log_events(spark, sf)
    for k, columns in names.items():
        part = events.filter(F.pmod(F.col("event_id"), F.lit(3)) == k)
        part.select(*[F.concat(c, F.lit(",")).alias(c) if c == "AcctName" else F.col(c) for c in columns]).write.option("header", True).csv(f"{path}/{k}")
    return _fields(readers.read_csv(spark, path, include="part-"), "event_id", "EventID", "AcctName", "Computer")


_queries["read_csv_folders"] = read_csv_folders
_oracles["read_csv_folders"] = f"""{WITH} SELECT CAST(event_id AS VARCHAR) AS event_id, "EventID", "AcctName" || ',' AS "AcctName", CASE WHEN event_id % 3 = 2 THEN "Computer" END AS "Computer" FROM logs"""


def ingest_counts(spark, sf):
    """Lines, events and lines without an event of four formats, counted by the job that saves the events."""
    every = lambda n, bad, good: f"CASE WHEN event_id % {n} = 0 THEN {bad} ELSE {good} END"
    made = {
        "json": (readers.read_jsonl, every(10, """concat('{"a": ', event_id)""", """concat('{"EventID": ', EventID, ', "id": ', event_id, '}')""")),
        "cef": (readers.read_cef, every(7, "'CEF without bars'", "concat('CEF:0|V|P|1|', EventID, '|n|5|src=10.0.0.1 id=', event_id)")),
        "leef": (readers.read_leef, every(5, "concat('LEEF-', event_id)", "concat('LEEF:1.0|V|P|1|', EventID, '|id=', event_id)")),
        "auditd": (readers.read_auditd, every(4, "'no pairs here'", "concat('type=X id=', event_id)")),
    }
    ingest, found = readers.Ingest(), None
    for name, (read, value) in made.items():
        part = read(spark, _text(spark, sf, name, value), ingest=ingest)
        found = part if found is None else found.unionByName(part)
    with ingest:
        found.write.parquet(_folder(spark, "landed"))
    return ingest.report(spark).drop("seconds")


_queries["ingest_counts"] = ingest_counts
_oracles["ingest_counts"] = f"{WITH} SELECT f AS source_format, count(*) AS lines, count(*) FILTER (event_id % n <> 0) AS events, count(*) FILTER (event_id % n = 0) AS malformed FROM logs, (VALUES ('json', 10), ('cef', 7), ('leef', 5), ('auditd', 4)) v(f, n) GROUP BY 1"


def read_json_array(spark, sf):
    """Files of at most 500 events, one array each."""
    path = _folder(spark, "arrays")
    events = log_events(spark, sf).select("event_id", "EventID", F.struct(F.col("AcctName").alias("name"), F.array(F.col("Computer"), F.lit("x")).alias("hosts")).alias("user"))
    arrays = events.groupBy(F.expr("event_id div 500")).agg(F.to_json(F.collect_list(F.struct("event_id", "EventID", "user"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _fields(readers.read_json_array(spark, path), "event_id", "EventID", "user_name", "name", "user_hosts")


_queries["read_json_array"] = read_json_array
_oracles["read_json_array"] = f"""{WITH} SELECT CAST(event_id AS VARCHAR) AS event_id, "EventID", "AcctName" AS user_name, "AcctName" AS name, concat("Computer", ', x') AS user_hosts FROM logs"""


def read_w3c(spark, sf):
    """Each event has a header of its own; every third one names other fields."""
    line = "concat(CASE WHEN event_id % 3 = 0 THEN '#Fields: date time c-ip cs(Host)' ELSE '#Fields: time date cs(Host)' END, chr(10), CASE WHEN event_id % 3 = 0 THEN concat_ws(' ', substr(SystemTime,1,10), substr(SystemTime,12,8), IpAddress, Computer) ELSE concat_ws(' ', substr(SystemTime,12,8), substr(SystemTime,1,10), Computer) END)"
    return _fields(readers.read_w3c(spark, _text(spark, sf, "w3c", line)), "timestamp", "c-ip", "cs-host")


_queries["read_w3c"] = read_w3c
_oracles["read_w3c"] = f"""{WITH} SELECT "SystemTime" AS timestamp, CASE WHEN event_id % 3 = 0 THEN nullif("IpAddress",'-') END AS "c-ip", "Computer" AS "cs-host" FROM logs"""


def read_zeek(spark, sf):
    line = "concat('#path', chr(9), 'conn', chr(10), '#fields', chr(9), 'uid', chr(9), 'id.orig_h', chr(9), 'host', chr(10), event_id, chr(9), IpAddress, chr(9), CASE WHEN event_id % 5 = 0 THEN '(empty)' ELSE Computer END)"
    return _fields(readers.read_zeek(spark, _text(spark, sf, "zeek", line)), "uid", "id_orig_h", "host", "_zeek_log_type")


_queries["read_zeek"] = read_zeek
_oracles["read_zeek"] = f"""{WITH} SELECT CAST(event_id AS VARCHAR) AS uid, nullif("IpAddress",'-') AS id_orig_h, CASE WHEN event_id % 5 <> 0 THEN "Computer" END AS host, 'conn' AS _zeek_log_type FROM logs"""


def read_macos(spark, sf):
    """Unified log lines; a field has the alias only where it is not there itself."""
    line = """CASE WHEN event_id % 4 = 0 THEN concat('{"processImagePath":"/bin/', Computer, '","Image":"own"}') ELSE concat('{"processImagePath":"/bin/', Computer, '","processID":', event_id, ',"eventMessage":"', AcctName, '"}') END"""
    return _fields(readers.read_macos(spark, _text(spark, sf, "macos", line)), "Image", "ProcessId", "message")


_queries["read_macos"] = read_macos
_oracles["read_macos"] = f"""{WITH} SELECT CASE WHEN event_id % 4 = 0 THEN 'own' ELSE '/bin/' || "Computer" END AS "Image", CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS VARCHAR) END AS "ProcessId", CASE WHEN event_id % 4 <> 0 THEN "AcctName" END AS message FROM logs"""


def discovered_files(spark, sf):
    """Folders of the files that a listing finds, of those that hold failed or special logons."""
    path = _folder(spark, "listed")
    log_events(spark, sf).select("event_id", "EventID", "Computer").repartition("EventID", "Computer").write.partitionBy("EventID", "Computer").parquet(path)
    found = readers.discover(spark, path, include=".PARQUET")
    return found.select(F.regexp_extract("path", "EventID=([0-9]+)", 1).alias("EventID"), F.regexp_extract("path", "Computer=(WS[0-9]+)", 1).alias("Computer")).distinct()


_queries["discovered_files"] = discovered_files
_oracles["discovered_files"] = f"""{WITH} SELECT DISTINCT "EventID", "Computer" FROM logs"""


def loaded_rules(spark, sf):
    """A rule file for each computer and kind of logon, read back, chosen by level and title, and applied."""
    path = _folder(spark, "rules")
    text = """concat('title: ', Computer, ' type ', LogonType, '\\nlevel: ', CASE WHEN n % 3 = 0 THEN 'low' WHEN n % 3 = 1 THEN 'high' ELSE 'critical' END, '\\ndetection:\\n  s:\\n    Computer: "', Computer, '"\\n    LogonType: ', LogonType, '\\n    EventID: 4625\\n  condition: s\\n')"""
    counted = log_events(spark, sf).groupBy("Computer", "LogonType").agg(F.count("*").alias("n"))
    counted.select(F.expr(text).alias("value"), F.concat("Computer", "LogonType").alias("part")).repartition("part").write.partitionBy("part").text(path)
    rules = ru.select_rules(ru.rules_of(spark.read.text(path, recursiveFileLookup=True, wholetext=True)), "high", exclude=("ws3 ",))
    return ru.detections(ru.apply_rules(log_events(spark, sf), rules))


_queries["loaded_rules"] = loaded_rules
_oracles["loaded_rules"] = f"""{WITH} SELECT "Computer" || ' type ' || "LogonType" AS title, CASE WHEN count(*) % 3 = 1 THEN 'high' ELSE 'critical' END AS level, count(*) FILTER ("EventID" = '4625') AS n FROM logs WHERE "Computer" <> 'WS3' GROUP BY "Computer", "LogonType" HAVING count(*) % 3 > 0 AND count(*) FILTER ("EventID" = '4625') > 0"""


def event_hashes(spark, sf):
    """Lines and different hashes of lines, by day: equal lines have equal hashes and others do not."""
    found = readers.read_text_log(spark, _text(spark, sf, "hashes", "concat(SystemTime, ' ', EventID)"))
    return found.groupBy(F.substring("raw", 1, 10).alias("day")).agg(F.count("*").alias("n"), F.count_distinct("event_hash").alias("different"))


_queries["event_hashes"] = event_hashes
_oracles["event_hashes"] = f"""{WITH} SELECT substr("SystemTime", 1, 10) AS day, count(*) AS n, count(DISTINCT "SystemTime" || ' ' || "EventID") AS different FROM logs GROUP BY 1"""


def save_events(spark, sf):
    """Events by day, read again."""
    path = _folder(spark, "events")
    sinks.save_events(log_events(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("EventID") == "4625").alias("failed"))


_queries["save_events"] = save_events
_oracles["save_events"] = f"""{WITH} SELECT substr("SystemTime",1,10) AS day, count(*) AS n, count(*) FILTER ("EventID"='4625') AS failed FROM logs GROUP BY 1"""


def _from_json(records: DataFrame, **paths: str) -> DataFrame:
    return records.select(*[F.get_json_object("value", path).alias(name) for name, path in paths.items()])


def setup(rules, hits_sql: str):
    """Registers what needs the catalog's rules and the SQL of their hits."""
    hits = lambda spark, sf: ru.apply_rules(log_events(spark, sf), rules)
    key = "CAST(event_id AS VARCHAR) AS event_id"
    image = """nullif("Image",'') AS image"""
    _queries["export_jsonl"] = lambda spark, sf: _from_json(sinks.jsonl(log_events(spark, sf)), event_id="$.event_id", image="$.Image", raw="$._raw")
    _oracles["export_jsonl"] = f"{WITH} SELECT {key}, {image}, NULL AS raw FROM logs"
    _queries["export_splunk"] = lambda spark, sf: _from_json(sinks.splunk(hits(spark, sf)), event_id="$.event_id", time="$._time", rule="$.rule_title", level="$.rule_level", image="$.Image")
    _oracles["export_splunk"] = f"""{hits_sql} SELECT {key}, "SystemTime" AS time, title AS rule, level, {image} FROM hits"""
    _queries["export_elk"] = lambda spark, sf: _from_json(sinks.elk(hits(spark, sf)), event_id="$.event_id", time="$['@timestamp']", rule="$['rule.name']", level="$['rule.severity']", tag="$.tags[0]")
    _oracles["export_elk"] = f"""{hits_sql} SELECT {key}, "SystemTime" AS time, title AS rule, level, CASE title WHEN 'Discovery command' THEN 'attack.discovery' WHEN 'Encoded shell' THEN 'attack.execution' WHEN 'Download with a system tool' THEN 'attack.command_and_control' ELSE 'attack.credential_access' END AS tag FROM hits"""
    _queries["export_timesketch"] = lambda spark, sf: _from_json(sinks.timesketch(hits(spark, sf).select("title", "level", "tags", "event_id", "SystemTime", "Image", "IpAddress")), time="$.datetime", message="$.message", rule="$.rule_title")
    _oracles["export_timesketch"] = f"""{hits_sql} SELECT "SystemTime" AS time, concat_ws(' ', 'event_id=' || event_id, 'SystemTime=' || "SystemTime", 'Image=' || nullif("Image",''), 'IpAddress=' || nullif("IpAddress",'')) AS message, title AS rule FROM hits"""

    def sarif(spark, sf):
        results = F.from_json(F.get_json_object("value", "$.runs[0].results"), "array<struct<ruleId:string,level:string,message:struct<text:string>>>")
        return sinks.sarif(at.tagged(hits(spark, sf))).select(F.explode(results).alias("r")).select("r.ruleId", "r.level", F.col("r.message.text").alias("text"))

    _queries["export_sarif"] = sarif
    _oracles["export_sarif"] = f"""{hits_sql} SELECT title AS "ruleId", CASE WHEN level IN ('critical','high') THEN 'error' WHEN level = 'medium' THEN 'warning' ELSE 'note' END AS level, concat(title, ': ', count(*), ' events') AS text FROM hits GROUP BY title, hits.level"""

    def navigator(spark, sf):
        found = F.from_json(F.get_json_object("value", "$.techniques"), "array<struct<techniqueID:string,score:bigint,color:string>>")
        return at.navigator_layer(at.tagged(hits(spark, sf))).select(F.explode(found).alias("t")).select("t.techniqueID", "t.score", "t.color")

    _queries["export_navigator"] = navigator
    _oracles["export_navigator"] = f"""{hits_sql} SELECT CASE title WHEN 'Discovery command' THEN 'T1033' WHEN 'Encoded shell' THEN 'T1059.001' ELSE 'T1105' END AS "techniqueID", count(*) AS score, CASE title WHEN 'Discovery command' THEN '{at.COLORS["medium"]}' WHEN 'Encoded shell' THEN '{at.COLORS["high"]}' ELSE '{at.COLORS["critical"]}' END AS color FROM hits WHERE title <> 'Failed logon' GROUP BY title"""

    def report(spark, sf):
        """The run report's lines: one summary, one line for each file and each rule that could not run."""
        found = at.tagged(hits(spark, sf))
        broken = [*rules, {"title": "broken", "detection": {"s": {"a|expand": 1}, "condition": "s"}}]
        files = readers.evidence_manifest(spark, _text(spark, sf, "report", "concat('line ', event_id)")).agg(F.lit("all").alias("path"), F.sum("size").alias("size"), F.lit("").alias("sha256"))
        lines = inc.run_report(found.agg(F.sum("n").alias("hits")), found, files=files, problems=ru.rule_problems(log_events(spark, sf), broken))
        return _from_json(lines, kind="$.kind", hits="$.summary.hits", size="$.size", title="$.title")

    _queries["run_report"] = report
    _oracles["run_report"] = f"""{hits_sql} SELECT 'summary' AS kind, CAST(count(*) AS VARCHAR) AS hits, NULL AS size, NULL AS title FROM hits UNION ALL
SELECT 'file', NULL, CAST(sum(length(concat('line ', event_id)) + 1) AS VARCHAR), NULL FROM logs UNION ALL SELECT 'problem', NULL, NULL, 'broken'"""

    def alerts(spark, sf):
        schema = spark.read.parquet(f"{sf}/events.parquet").schema
        stream = as_logs(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))
        path = _folder(spark, "alerts")
        live.start_alerts(stream, rules, f"{path}/alerts", f"{path}/state", available_now=True).awaitTermination()
        return spark.read.parquet(f"{path}/alerts").groupBy("title", "level").agg(F.sum("n").alias("n"))

    _queries["live_alerts"] = alerts
    _oracles["live_alerts"] = f"{hits_sql} SELECT title, level, count(*) AS n FROM hits GROUP BY 1,2"


def queries():
    return dict(_queries)


def oracles():
    return dict(_oracles)

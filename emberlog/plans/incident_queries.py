"""Formats, rule checks, indicators by field and the incident summary as named queries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import analytics as an
from emberlog.operators import attack as at
from emberlog.operators import field_indicators as fi
from emberlog.operators import incident as inc
from emberlog.operators import indicators as ind
from emberlog.operators.rule_checks import validate_rules
from emberlog.plans.ingest_queries import techniques
from emberlog.plans.log_view import WITH, log_events
from emberlog.sources.formats import format_of

_queries, _oracles = {}, {}

#: Heads of files made of the view's rows, and their formats, by event_id % 8.
_HEADS = {
    "json": """concat('{"EventID":', EventID, '}')""",
    "csv": "concat(EventID, ',', Computer, ',', AcctName)",
    "syslog": "concat('<34>Oct 11 22:14:15 ', Computer, ' su: x')",
    "cef": "concat('x CEF:0|V|P|1|', EventID, '|a|5|')",
    "w3c": "concat('#Fields: date ', Computer)",
    "auditd": "concat('type=LOGIN pid=', event_id)",
    "xml": "concat('<a>', EventID, '</a>')",
    "text": "concat(Computer, ' said ', EventID)",
}


def classify_formats(spark, sf):
    head = F.expr("CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(_HEADS.values())) + " END")
    name = F.expr("concat('f', event_id, CASE WHEN event_id % 16 = 7 THEN '.TSV' ELSE '.log' END)")
    return log_events(spark, sf).select("event_id", format_of(name, head).alias("format"))


_queries["classify_formats"] = classify_formats
_oracles["classify_formats"] = "SELECT event_id, CASE WHEN event_id % 16 = 7 THEN 'tsv' ELSE CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_HEADS)) + " END END AS format FROM events"


def check_rules(spark, sf):
    """Rules made of parts: some lack a status, some have a bad id or level, some share an id."""
    text = "concat(substr(m,1,8),'-',substr(m,9,4),'-',substr(m,13,4),'-',substr(m,17,4),'-',substr(m,21,12))"
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), F.expr("md5(cast(p_partkey - p_partkey % 2 as string))").alias("m"), F.col("p_name").alias("title"))
    columns = {
        "path": "lpad(cast(k as string), 12, '0')",
        "id": f"CASE WHEN k % 5 = 0 THEN 'x' ELSE {text} END",
        "status": "CASE WHEN k % 7 = 0 THEN NULL ELSE 'test' END",
        "description": "'d'",
        "logsource": "'l'",
        "detection": "'condition: s'",
        "level": "CASE WHEN k % 11 = 0 THEN 'severe' ELSE 'high' END",
    }
    return validate_rules(rows.select("title", *[F.expr(sql).alias(c) for c, sql in columns.items()]))


_queries["validate_rules"] = check_rules
_oracles["validate_rules"] = """WITH r AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS path, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE md5(CAST(p_partkey - p_partkey % 2 AS VARCHAR)) END AS id FROM part)
SELECT path, 'missing: status' AS problem FROM r WHERE k % 7 = 0 UNION ALL
SELECT path, 'invalid id' FROM r WHERE k % 7 <> 0 AND k % 5 = 0 UNION ALL
SELECT path, 'invalid level' FROM r WHERE k % 7 <> 0 AND k % 11 = 0 UNION ALL
SELECT path, 'duplicate id' FROM (SELECT path, min(path) OVER (PARTITION BY id) AS f FROM r) WHERE path > f"""


def field_iocs(spark, sf):
    ev = log_events(spark, sf).select("event_id", "IpAddress", "Image", "ParentImage", "QueryName", "CommandLine")
    return fi.field_iocs(ev, "event_id")


_PUBLIC = """regexp_matches("IpAddress", '^203')"""
_PATH = r"""lower("{0}") NOT IN ('', 'c:\windows\explorer.exe', 'c:\windows\system32\svchost.exe')"""
_FIELD_IOCS = f"""SELECT event_id, 'ipv4' AS type, "IpAddress" AS value, 'IpAddress' AS field FROM logs WHERE {_PUBLIC} UNION ALL
SELECT event_id, 'file_path', "Image", 'Image' FROM logs WHERE {_PATH.format("Image")} UNION ALL
SELECT event_id, 'file_path', "ParentImage", 'ParentImage' FROM logs WHERE {_PATH.format("ParentImage")} UNION ALL
SELECT event_id, 'domain', regexp_extract("QueryName", '[a-z0-9]+\\.[a-z]+'), 'QueryName' FROM logs WHERE "QueryName" <> ''"""
_queries["field_iocs"] = field_iocs
_oracles["field_iocs"] = f"{WITH} {_FIELD_IOCS}"
_queries["iocs_table"] = lambda spark, sf: fi.iocs_table(field_iocs(spark, sf), "event_id")
_oracles["iocs_table"] = f"""{WITH} SELECT type AS "Type", value AS "Value", count(*) AS "Count", min(event_id) AS "First Seen", max(event_id) AS "Last Seen", string_agg(DISTINCT field, '; ' ORDER BY field) AS "Source Fields" FROM ({_FIELD_IOCS}) GROUP BY 1, 2"""
_queries["iocs_all_text"] = lambda spark, sf: fi.extract_iocs_all_text(log_events(spark, sf), "event_id")
_oracles["iocs_all_text"] = f"""{WITH} SELECT event_id, 'ipv4' AS type, "IpAddress" AS value FROM logs WHERE {_PUBLIC} UNION ALL
SELECT event_id, 'url', 'http://files.example.net/a' FROM logs WHERE contains("CommandLine", 'certutil -urlcache')"""
_queries["deobfuscate"] = lambda spark, sf: ind.deobfuscate(log_events(spark, sf)).filter("deobfuscation is not null").select("event_id", "deobfuscated_CommandLine", "deobfuscation")
_oracles["deobfuscate"] = f"""{WITH} SELECT event_id, 'powershell' AS "deobfuscated_CommandLine", 'CARET' AS deobfuscation FROM logs WHERE "CommandLine" = 'p^o^w^e^r^s^h^e^l^l'"""


def setup(rules, hits_sql: str, apply_rules):
    """Registers what needs the catalog's rules and the SQL of their hits."""
    tactics = f"""{hits_sql}, found AS (SELECT title, level, count(*) AS n FROM hits GROUP BY 1,2), tactic AS (SELECT pos, slug, shown FROM found JOIN (VALUES
(4,'execution','Execution','Encoded shell'), (8,'credential-access','Credential Access','Failed logon'), (9,'discovery','Discovery','Discovery command'), (12,'command-and-control','Command and Control','Download with a system tool')) t(pos, slug, shown, name) ON title = name)"""

    def incident_summary(spark, sf):
        hits = apply_rules(log_events(spark, sf), rules)
        window = hits.agg(F.min("SystemTime").alias("first"), F.max("SystemTime").alias("last"))
        scores = an.threat_scores(hits, users=("AcctName",))
        return inc.incident_summary(at.tagged(hits), techniques(spark), scores, window)

    advice = """list_filter([CASE WHEN 'credential-access' IN (SELECT slug FROM tactic) THEN 'Immediately reset all credentials on affected hosts' END, CASE WHEN 'command-and-control' IN (SELECT slug FROM tactic) THEN 'Block identified C2 IPs/domains at firewall' END, 'Conduct full forensic investigation of affected hosts'], lambda x: x IS NOT NULL)"""
    _queries["incident_summary"] = incident_summary
    _oracles["incident_summary"] = f"""{tactics},
s AS (SELECT count(*) FILTER (level='critical') AS critical, count(*) FILTER (level='high') AS high, count(*) FILTER (level='medium') AS medium, count(*) FILTER (level='low') AS low FROM found),
scored AS (SELECT entity, least(sum(w), 100.0) AS score FROM (SELECT CAST(CASE level WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END AS DOUBLE) AS w, unnest(["Computer", "AcctName"]) AS entity FROM hits) GROUP BY 1),
e AS (SELECT list(concat(entity, ' (score: ', CAST(round_even(score, 0) AS INT), '/100)') ORDER BY score DESC, entity) AS entities, max(score) AS highest FROM (SELECT * FROM scored ORDER BY score DESC, entity LIMIT 10)),
w AS (SELECT min("SystemTime") AS a, max("SystemTime") AS b FROM hits),
t AS (SELECT list(slug ORDER BY pos) AS tactics, string_agg(shown, ', ' ORDER BY pos) AS shown FROM tactic)
SELECT 'likely' AS verdict, round(least((10 * critical + 5 * high + 2 * medium + low) * 0.6 + highest * 0.4, 100), 6) AS risk, critical, high, medium, low, tactics, entities, {advice} AS advice,
'Evidence indicates likely compromise.' AS meaning, a AS first, b AS last FROM s, e, w, t"""
    _queries["recommendations"] = lambda spark, sf: inc.recommendations(at.tagged(apply_rules(log_events(spark, sf), rules)), techniques(spark))
    _oracles["recommendations"] = f"""{tactics} SELECT unnest(range(len(a)))::INT AS place, unnest(a) AS advice FROM (SELECT {advice} AS a)"""

    def confidence(spark, sf):
        # Of the services, the first rule's events are all in its channel, the second's in another one.
        named = [r | {"logsource": (r.get("logsource") or {}) | {"service": s}} for r, s in zip(rules, ("sysmon", "Sysmon", "security", ""), strict=True)]
        channel = F.expr("CASE WHEN contains(CommandLine, 'whoami') THEN 'microsoft-windows-sysmon/operational' WHEN contains(CommandLine, '-enc') THEN 'Other' ELSE '' END")
        return inc.confidence(apply_rules(log_events(spark, sf).withColumn("Channel", channel), named), named)

    _queries["confidence"] = confidence
    _oracles["confidence"] = f"{hits_sql} SELECT title, CASE title WHEN 'Encoded shell' THEN 'low' ELSE 'high' END AS confidence FROM hits GROUP BY 1"


def queries():
    return dict(_queries)


def oracles():
    return dict(_oracles)

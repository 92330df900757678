"""Sets of rules as named queries over the whole view, with SQL: log sources, and a thousand rules at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import rules as ru
from emberlog.plans.log_view import WITH, log_events

#: A format and a provider for the view, which has none, as the same SQL text in both engines.
_FORMAT = "CASE event_id % 9 WHEN 0 THEN 'zeek' WHEN 1 THEN 'Syslog' WHEN 2 THEN 'json' WHEN 3 THEN 'cef' WHEN 4 THEN 'w3c' WHEN 5 THEN 'auditd' WHEN 6 THEN 'macos' WHEN 7 THEN 'ZeekTsv' ELSE NULL END"
_PROVIDER = "CASE event_id % 2 WHEN 0 THEN 'Microsoft-Windows-Sysmon' ELSE 'Other' END"
_NOT_MACHINE = {"s": {"AcctName|endswith": "$"}, "condition": "not s"}

_BY_FORMAT = {  # title: log source, formats
    "zeek": ({"product": "zeek", "service": "conn"}, ("zeek", "ZeekTsv")),
    "linux": ({"product": "linux", "category": "process_creation"}, ("Syslog",)),
    "audit": ({"product": "linux", "service": "auditd"}, ("Syslog", "auditd")),
    "mac": ({"product": "macos", "category": "process_creation"}, ("Syslog", "macos")),
    "router": ({"product": "cisco"}, ("cef", "Syslog")),
    "cloud": ({"product": "aws", "service": "cloudtrail"}, ("json",)),
    "web": ({"product": "apache"}, ("w3c",)),
    "nothing": ({"product": "okta", "category": "x"}, ("json",)),
    "windows": ({"product": "windows", "service": "security"}, None),
}
_BY_CATEGORY = {  # title: log source, SQL
    "process": ({"category": "process_creation"}, f"\"EventID\" = '4688' OR \"EventID\" = '1' AND {_PROVIDER} <> 'Other'"),
    "names": ({"product": "windows", "category": "dns_query"}, "\"EventID\" = '22'"),
    "accounts": ({"product": "windows", "category": "user_accounts"}, "\"EventID\" IN ('4624', '4625')"),
    "registry": ({"product": "windows", "category": "registry_set"}, "FALSE"),
    "other": ({"product": "windows", "category": "create_stream_hash"}, "TRUE"),
    "elsewhere": ({"product": "linux", "category": "process_creation"}, "FALSE"),
    "jvm": ({"product": "jvm", "category": "process_creation"}, "TRUE"),
}
SET_SIZE = 1000


def _rule(title: str, logsource: dict, detection: dict) -> dict:
    return {"title": title, "level": "low", "logsource": logsource, "detection": detection}


def rules_by_format(spark, sf):
    """Hits of a rule of each product on events of all formats."""
    ev = log_events(spark, sf).withColumn("_source_format", F.expr(_FORMAT))
    return ru.apply_rules(ev, [_rule(t, source, _NOT_MACHINE) for t, (source, _) in _BY_FORMAT.items()]).groupBy("title").agg(F.count("*").alias("n"))


def rules_by_category(spark, sf):
    """Hits of a rule of each category; event ids count for Windows alone."""
    ev = log_events(spark, sf).withColumn("Provider_Name", F.expr(_PROVIDER))
    return ru.apply_rules(ev, [_rule(t, source, _NOT_MACHINE) for t, (source, _) in _BY_CATEGORY.items()]).groupBy("title").agg(F.count("*").alias("n"))


def many_rules(n: int = SET_SIZE) -> list[dict]:
    """Rules by number: words of commands, accounts, networks, names with a filter."""
    kinds = (
        lambda i: {"s": {"CommandLine|contains": f"TASK_{i}"}, "condition": "s"},
        lambda i: {"s": {"AcctName": [f"user{i}", f"host{i - 1}$"]}, "condition": "s"},
        lambda i: {"s": {"IpAddress|cidr": f"10.0.{i // 4 % 4}.0/28"}, "t": {"LogonType": i % 3}, "condition": "s and not t"},
        lambda i: {"s": {"QueryName|startswith": f"q{i // 4}"}, "f": {"Computer|endswith": str(i % 7)}, "condition": "s and not f"},
    )
    return [_rule(f"rule {i}", {}, kinds[i % 4](i)) for i in range(n)]


def rule_set(spark, sf):
    """A thousand rules over all events in one scan."""
    return ru.apply_rules(log_events(spark, sf), many_rules()).groupBy("title").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def rule_routes(spark, sf):
    """Events that can belong to each log source, by its dimension row."""
    from emberlog.operators import log_sources as ls

    ev = log_events(spark, sf).withColumn("format", ls.format_name(F.expr(_FORMAT)))
    table = F.broadcast(ls.log_source_table(spark))  # some hundred fixed rows
    by_format = ev.filter("format IS NOT NULL").join(table.filter("format IS NOT NULL").withColumnRenamed("format", "of"), F.col("format") == F.col("of"))
    by_event = ev.join(table.filter("event_id IS NOT NULL").withColumnRenamed("event_id", "of"), F.col("EventID") == F.col("of"))
    name = F.concat_ws("/", "product", "category", "service").alias("source")
    return by_format.select(name).unionByName(by_event.select(name)).groupBy("source").agg(F.count("*").alias("n"))


_FORMAT_NAMES = "('zeek', ['zeek']), ('linux', ['syslog']), ('linux/auditd', ['auditd']), ('macos', ['syslog', 'macos']), ('apache', ['w3c'])" + "".join(f", ('{p}', ['cef', 'syslog'])" for p in ("cisco", "juniper", "fortinet", "paloalto")) + "".join(f", ('{p}', ['json'])" for p in ("aws", "azure", "gcp", "google_workspace", "m365", "okta", "github", "onelogin", "qualys"))
_LOWER = f"replace(lower({_FORMAT}), 'zeektsv', 'zeek')"
_MANY = f"""SELECT 'rule ' || i AS title, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (
SELECT i, event_id FROM logs JOIN range(0, {SET_SIZE}, 4) r(i) ON contains("CommandLine", 'task_' || i) UNION ALL
SELECT i, event_id FROM logs JOIN range(1, {SET_SIZE}, 4) r(i) ON "AcctName" IN ('user' || i, 'host' || (i - 1) || '$') UNION ALL
SELECT i, event_id FROM logs JOIN range(2, {SET_SIZE}, 4) r(i) ON starts_with("IpAddress", '10.0.' || (i // 4 % 4) || '.') AND TRY_CAST(split_part("IpAddress", '.', 4) AS INTEGER) < 16 AND "LogonType" <> CAST(i % 3 AS VARCHAR) UNION ALL
SELECT i, event_id FROM logs JOIN range(3, {SET_SIZE}, 4) r(i) ON starts_with("QueryName", 'q' || (i // 4)) AND NOT ends_with("Computer", CAST(i % 7 AS VARCHAR))) GROUP BY i"""


def queries():
    return {f.__name__: f for f in (rules_by_format, rules_by_category, rule_set, rule_routes)}


def oracles():
    person = "NOT ends_with(\"AcctName\",'$')"
    by_format = " UNION ALL ".join(f"""SELECT '{t}' AS title, count(*) AS n FROM logs WHERE {person}""" + ("" if formats is None else f" AND coalesce({_FORMAT}, '') IN ({', '.join(repr(x) for x in formats)})") for t, (_, formats) in _BY_FORMAT.items())
    by_category = " UNION ALL ".join(f"SELECT '{t}' AS title, count(*) AS n FROM logs WHERE {person} AND ({where})" for t, (_, where) in _BY_CATEGORY.items())
    routes = f"SELECT s AS source, count(*) AS n FROM logs JOIN (VALUES {_FORMAT_NAMES}) v(s, f) ON list_contains(f, {_LOWER}) GROUP BY 1"
    events = "('process_creation', ['1', '4688']), ('dns_query', ['22']), ('dns', ['22']), ('account_login', ['4624', '4625']), ('user_accounts', ['4624', '4625'])"
    routes += f""" UNION ALL SELECT 'windows/' || s, count(*) FROM logs JOIN (VALUES {events}) v(s, e) ON list_contains(e, "EventID") GROUP BY 1"""
    return {
        "rules_by_format": f"{WITH} SELECT * FROM ({by_format}) WHERE n > 0",
        "rules_by_category": f"{WITH} SELECT * FROM ({by_category}) WHERE n > 0",
        "rule_set": f"{WITH} {_MANY}",
        "rule_routes": f"{WITH} {routes}",
    }

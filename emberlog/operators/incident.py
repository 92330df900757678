"""One row about a set of detections: what to do, what happened, and how sure each rule is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.columns import field, present
from emberlog.operators import attack as at
from emberlog.operators.analytics import verdict

#: Advice by tactic, and advice that always stands (fixed values).
ADVICE = {
    "credential-access": "Immediately reset all credentials on affected hosts",
    "lateral-movement": "Isolate affected hosts from network",
    "persistence": "Audit startup items, services, and scheduled tasks",
    "command-and-control": "Block identified C2 IPs/domains at firewall",
}
BASELINE = "Conduct full forensic investigation of affected hosts"
#: What a verdict means (fixed values).
MEANING = {
    "clean": "No significant threats detected.",
    "suspicious": "Suspicious activity detected that warrants investigation.",
    "likely": "Evidence indicates likely compromise.",
    "breach": "Strong evidence of confirmed breach.",
}
#: Channel in which the events of a service are expected (fixed values).
CHANNELS = {
    "sysmon": "Microsoft-Windows-Sysmon/Operational",
    "security": "Security",
    "system": "System",
    "application": "Application",
    "windefend": "Microsoft-Windows-Windows Defender/Operational",
    "powershell": "Microsoft-Windows-PowerShell/Operational",
    "powershell-classic": "Windows PowerShell",
    "codeintegrity-operational": "Microsoft-Windows-CodeIntegrity/Operational",
    "taskscheduler": "Microsoft-Windows-TaskScheduler/Operational",
    "wmi": "Microsoft-Windows-WMI-Activity/Operational",
    "dns-server": "DNS Server",
    "bits-client": "Microsoft-Windows-Bits-Client/Operational",
    "firewall-as": "Microsoft-Windows-Windows Firewall With Advanced Security/Firewall",
    "ntlm": "Microsoft-Windows-NTLM/Operational",
    "openssh": "OpenSSH/Operational",
    "ldap_debug": "Microsoft-Windows-LDAP-Client/Debug",
    "msexchange-management": "MSExchange Management",
    "terminalservices-localsessionmanager": "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational",
}
def confidence(hits: DataFrame, rules: list[dict]) -> DataFrame:
    """(title, confidence): low where a hit's channel is not the one that the rule's service writes to."""
    expected = [(r["title"], CHANNELS.get(str((r.get("logsource") or {}).get("service") or "").lower())) for r in rules]
    table = hits.sparkSession.createDataFrame(expected, "title string, expected string")
    rows = hits.select("title", field(hits, "Channel").alias("channel")).join(F.broadcast(table), "title", "left")  # one row per rule
    other = present(F.col("channel")) & (F.lower("channel") != F.lower("expected"))
    return rows.groupBy("title").agg(F.when(F.coalesce(F.bool_or(other), F.lit(False)), "low").otherwise("high").alias("confidence"))


def _tactics(found: DataFrame, techniques: DataFrame) -> DataFrame:
    """One row: the tactics of all detections, in the order of an attack."""
    ranked = at.kill_chain(found, techniques).select(F.struct(at.tactic_rank(F.col("tactic")).alias("at"), "tactic").alias("t"))
    return ranked.agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tactic"]).alias("tactics"))


def _advice(tactics: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.array_contains(tactics, t), text) for t, text in ADVICE.items()], F.lit(BASELINE)))


def recommendations(found: DataFrame, techniques: DataFrame) -> DataFrame:
    """One row per advice, in order."""
    return _tactics(found, techniques).select(F.posexplode(_advice(F.col("tactics"))).alias("place", "advice"))


def incident_summary(found: DataFrame, techniques: DataFrame, scores: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """One row: verdict and what it means, risk, the ten highest entities, advice, and the time window.

    found(title, level, n, tags), scores(entity, score); window holds one row
    (first, last) or is left out.  Risk is 60 % by detections and 40 % by the highest
    entity, where there is one.
    """
    top = scores.select("entity", "score").orderBy(F.col("score").desc(), "entity").limit(10)
    named = lambda e: F.concat(e["entity"], F.lit(" (score: "), F.bround(-e["down"]).cast("int").cast("string"), F.lit("/100)"))
    entities = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "entity"))), named).alias("entities"), F.coalesce(F.max("score"), F.lit(0.0)).alias("highest"))
    span = window.select("first", "last") if window is not None else found.agg(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"))
    stats = verdict(found).drop("verdict", "risk")
    row = stats.withColumn("one", F.lit(1))
    for part in (_tactics(found, techniques), entities, span):  # one row each
        row = row.join(part.withColumn("one", F.lit(1)), "one")
    c, h, m, low, highest = (F.col(x) for x in ("critical", "high", "medium", "low", "highest"))
    by_rules = 10.0 * c + 5 * h + 2 * m + low
    risk = F.least(F.when(highest > 0, by_rules * 0.6 + highest * 0.4).otherwise(by_rules), F.lit(100.0))
    word = F.when((c >= 3) | ((c >= 1) & (h >= 5)), "breach").when((c >= 1) | (h >= 3) | (F.size("tactics") >= 3), "likely").when((h > 0) | (m > 2), "suspicious").otherwise("clean")
    meaning = F.create_map(*[F.lit(x) for pair in MEANING.items() for x in pair])
    out = row.withColumn("verdict", word).withColumn("risk", F.round(risk, 6)).withColumn("advice", _advice(F.col("tactics")))
    return out.select("verdict", "risk", "critical", "high", "medium", "low", "tactics", "entities", "advice", meaning[F.col("verdict")].alias("meaning"), "first", "last")


def run_report(summary: DataFrame, found: DataFrame, sure: DataFrame | None = None, files: DataFrame | None = None, problems: DataFrame | None = None, ingest: DataFrame | None = None) -> DataFrame:
    """JSON lines: the summary with all rules with hits (rules, not hits, so it stays small), then one line a file, a problem and a format.

    files(path, size, sha256) as evidence_manifest makes them, problems(title, problem) as rule_problems does,
    ingest(source_format, lines, events, malformed, seconds) as Ingest.report does.
    """
    rules = found.join(sure, "title", "left") if sure is not None else found.withColumn("confidence", F.lit("high"))
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("title", "level", F.col("n").alias("count"), "tags", "confidence"))).alias("detections")).withColumn("one", F.lit(1))
    joined = summary.select(F.struct(*summary.columns).alias("summary"), F.lit(1).alias("one")).join(listed, "one")
    out = joined.select(F.to_json(F.struct(F.lit("summary").alias("kind"), "summary", "detections")).alias("value"))
    for kind, rows, columns in (("file", files, ("path", "size", "sha256")), ("problem", problems, ("title", "problem")), ("ingest", ingest, ("source_format", "lines", "events", "malformed", "seconds"))):
        if rows is not None:
            out = out.unionByName(rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)).alias("value")))
    return out

"""Named queries over the driver tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.columns import entropy, is_public_ip
from emberlog.operators import analytics as an
from emberlog.operators import attack as at
from emberlog.operators import field_indicators as fi
from emberlog.operators import hunts as hu
from emberlog.operators import indicators as ind
from emberlog.operators import rules as ru
from emberlog.operators import run_all
from emberlog.operators import search as se
from emberlog.operators import transforms as tr
from emberlog.plans import cookbook, detection_queries, file_queries, hunt_queries, incident_queries, ingest_queries
from emberlog.plans.log_view import WITH, log_events

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, logs: bool = True):
    """Registers a function of (events or spark, sf_dir) under its name, with its SQL."""

    def register(f):
        _queries[f.__name__] = (lambda spark, sf: f(log_events(spark, sf))) if logs else f
        if sql:
            _oracles[f.__name__] = f"{WITH} {sql}" if logs else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search -----------------------------------------------------------------------------------
@query("SELECT event_id FROM logs WHERE contains(lower(_raw), 'click')")
def search_keyword(ev):
    return se.search_keyword(ev, "CLICK").select("event_id")


@query(r"SELECT event_id FROM logs WHERE Image ILIKE '%\\power%.exe' ESCAPE '$'".replace("\\\\", "\\"))
def search_field(ev):
    return se.search_field(ev, "Image", r"%\power%.exe").select("event_id")


@query("SELECT event_id FROM logs WHERE regexp_matches(CommandLine, 'powershell.*-enc')")
def search_regex(ev):
    return se.search_regex(ev, "CommandLine", "powershell.*-enc").select("event_id")


@query("""SELECT "EventID", count(*) AS n FROM logs GROUP BY "EventID" HAVING count(*) > 1""")
def sql_group(ev):
    return se.sql(ev, "SELECT EventID, count(*) AS n FROM events GROUP BY EventID HAVING count(*) > 1")


@query("""SELECT event_id FROM logs WHERE "SystemTime" >= '2024-01-05T00:00:00' AND "SystemTime" <= '2024-01-20T12:00:00'""")
def time_range(ev):
    return se.time_range(ev, "2024-01-05T00:00:00", "2024-01-20T12:00:00").select("event_id")


@query("""SELECT DISTINCT "Image" AS value FROM logs WHERE "Image" <> ''""")
def distinct_values(ev):
    return se.distinct_values(ev, "Image")


@query("SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS field, count(*) FILTER ("{c}" IS NOT NULL AND CAST("{c}" AS VARCHAR) <> '') AS n FROM logs""" for c in ("EventID", "SystemTime", "AcctName", "Computer", "IpAddress", "LogonType", "QueryName", "Image", "ParentImage", "CommandLine")) + ")")
def field_stats(ev):
    return se.field_stats(ev.drop("event_id", "_raw"))


@query("""SELECT "Image" AS value, count(*) AS n FROM logs WHERE "Image" <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 3""")
def top_values(ev):
    return se.top_values(ev, "Image", 3)


@query("""SELECT substr("SystemTime",1,13) AS hour, count(*) AS n FROM logs GROUP BY 1""")
def hourly_histogram(ev):
    return se.hourly_histogram(ev)


@query("""SELECT event_id, "AcctName" AS "TargetUserName" FROM logs""")
def rename_fields(ev):
    return se.rename_fields(ev, {"AcctName": "TargetUserName"}).select("event_id", "TargetUserName")


@query("""SELECT label, count(*) AS n FROM (SELECT 'a' AS label FROM logs WHERE "EventID"='4625' UNION ALL SELECT 'b' FROM logs WHERE "EventID"='1') GROUP BY 1""")
def run_queries(ev):
    return se.run_queries(ev, se.parse_queries("# two\na ||| SELECT * FROM events WHERE EventID='4625'\nb ||| SELECT * FROM events WHERE EventID='1'")).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count("Image") AS images FROM (SELECT nullif("Image",'') AS "Image" FROM logs)""")
def normalize_empty(ev):
    return se.normalize_empty(ev).agg(F.count("*").alias("n"), F.count("Image").alias("images"))


@query("""SELECT count(*) AS n, count(a) AS a, count(b) AS b FROM (SELECT "Image" AS a, NULL AS b FROM logs WHERE "EventID"='1' UNION ALL SELECT NULL, "IpAddress" FROM logs WHERE "EventID"='4625')""")
def union_events(ev):
    return se.union_events(ev.filter("EventID='1'").select(F.col("Image").alias("a")), ev.filter("EventID='4625'").select(F.col("IpAddress").alias("b"))).agg(F.count("*").alias("n"), F.count("a").alias("a"), F.count("b").alias("b"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""", logs=False)
def top_k_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


# --- the cookbook -----------------------------------------------------------------------------
def _filters(**conditions: tuple[Callable[[DataFrame], DataFrame], str]):
    for name, (f, where) in conditions.items():
        _queries[name] = lambda spark, sf, f=f: f(log_events(spark, sf)).select("event_id")
        _oracles[name] = f"{WITH} SELECT event_id FROM logs WHERE {where}"


_filters(
    remote_logons=(lambda e: e.filter((F.col("EventID") == "4624") & F.col("LogonType").isin("3", "10")), """"EventID"='4624' AND "LogonType" IN ('3','10')"""),
    rdp_sessions=(lambda e: e.filter((F.col("EventID") == "4624") & (F.col("LogonType") == "10")), """"EventID"='4624' AND "LogonType"='10'"""),
    lolbin_downloads=(lambda e: e.filter(F.contains("CommandLine", F.lit("http")) & F.col("Image").rlike("(?i)(certutil|powershell|mshta|bitsadmin)")), """contains("CommandLine",'http') AND regexp_matches("Image",'(?i)(certutil|powershell|mshta|bitsadmin)')"""),
    office_children=(lambda e: e.filter(F.col("ParentImage").rlike("(?i)(winword|excel|powerpnt|outlook)")), """regexp_matches("ParentImage",'(?i)(winword|excel|powerpnt|outlook)')"""),
    recon_commands=(lambda e: e.filter(F.col("CommandLine").rlike("(?i)(whoami|net user|net group|ipconfig|systeminfo)")), """regexp_matches("CommandLine",'(?i)(whoami|net user|net group|ipconfig|systeminfo)')"""),
    encoded_powershell=(lambda e: e.filter(F.col("CommandLine").ilike("%powershell%-enc%")), """"CommandLine" ILIKE '%powershell%-enc%'"""),
    temp_exec=(lambda e: e.filter(F.col("Image").rlike(r"(?i)\\(temp|public|downloads)\\")), r""""Image" <> '' AND regexp_matches("Image",'(?i)\\(temp|public|downloads)\\')"""),
    dns_long=(lambda e: e.filter(F.length("QueryName") > 15), """length("QueryName") > 15"""),
    suspicious_tlds=(lambda e: e.filter(F.col("QueryName").rlike(r"\.(xyz|top|net)$")), r"""regexp_matches("QueryName",'\.(xyz|top|net)$')"""),
    privileged_logons=(lambda e: e.filter((F.col("EventID") == "4672") & ~F.endswith("AcctName", F.lit("$"))), """"EventID"='4672' AND NOT ends_with("AcctName",'$')"""),
    public_sources=(lambda e: e.filter(is_public_ip(F.col("IpAddress"))), """starts_with("IpAddress",'203.0.113.')"""),
)


@query("""SELECT "AcctName" AS user, "IpAddress" AS ip, count(*) AS n FROM logs WHERE "EventID"='4625' GROUP BY 1,2""")
def failed_logons(ev):
    return ev.filter("EventID='4625'").groupBy(F.col("AcctName").alias("user"), F.col("IpAddress").alias("ip")).agg(F.count("*").alias("n"))


@query("""SELECT "QueryName", count(*) AS n FROM logs WHERE "QueryName" <> '' GROUP BY 1 HAVING count(*) > 5""")
def dns_beaconing(ev):
    return ev.filter("QueryName <> ''").groupBy("QueryName").agg(F.count("*").alias("n")).filter("n > 5")


@query("""SELECT "Image", count(DISTINCT "IpAddress") AS n FROM logs WHERE "Image" <> '' GROUP BY 1 ORDER BY n DESC, "Image" LIMIT 20""")
def fanout_by_process(ev):
    return ev.filter("Image <> ''").groupBy("Image").agg(F.count_distinct("IpAddress").alias("n")).orderBy(F.col("n").desc(), "Image").limit(20)


@query("""SELECT DISTINCT "IpAddress" AS ip FROM logs WHERE starts_with("IpAddress",'203.')""")
def external_ips(ev):
    return ev.select(F.col("IpAddress").alias("ip")).filter(is_public_ip(F.col("ip"))).distinct()


# --- detection rules: one query per value modifier, then conditions and evaluation ---------------
def _rule_query(name: str, detection: dict, where: str):
    _queries[name] = lambda spark, sf: (lambda ev: ev.filter(ru.rule_predicate(ev, {"detection": detection})).select("event_id"))(log_events(spark, sf))
    _oracles[name] = f"{WITH} SELECT event_id FROM logs WHERE {where}"


_rule_query("rule_eq", {"s": {"EventID": 4625}, "condition": "s"}, """"EventID"='4625'""")
_rule_query("rule_wildcard", {"s": {"Image": r"*\cmd.ex?"}, "condition": "s"}, r"""regexp_matches("Image",'(?i)^.*\\cmd\.ex.$')""")
_rule_query("rule_contains", {"s": {"CommandLine|contains": "WHOAMI"}, "condition": "s"}, """contains("CommandLine",'whoami')""")
_rule_query("rule_startswith", {"s": {"Image|startswith": r"c:\users"}, "condition": "s"}, r"""starts_with(lower("Image"),'c:\users')""")
_rule_query("rule_endswith", {"s": {"Image|endswith": r"\certutil.exe"}, "condition": "s"}, r"""ends_with(lower("Image"),'\certutil.exe')""")
_rule_query("rule_re", {"s": {"CommandLine|re": "task_[0-9]*7$"}, "condition": "s"}, """regexp_matches("CommandLine",'task_[0-9]*7$')""")
_rule_query("rule_cidr", {"s": {"IpAddress|cidr": "10.0.0.0/15"}, "condition": "s"}, """starts_with("IpAddress",'10.0.') OR starts_with("IpAddress",'10.1.')""")
_rule_query("rule_gt", {"s": {"EventID|gt": 1000}, "condition": "s"}, """CAST("EventID" AS DOUBLE) > 1000""")
_rule_query("rule_lte", {"s": {"LogonType|lte": 3}, "condition": "s"}, """CAST("LogonType" AS DOUBLE) <= 3""")
_rule_query("rule_base64", {"s": {"CommandLine|base64|contains": "e\0c\0h\0o\0"}, "condition": "s"}, """contains(lower("CommandLine"),'zqbjaggabwa=')""")
_rule_query("rule_base64offset", {"s": {"CommandLine|base64offset|contains": "\0c\0h\0"}, "condition": "s"}, """contains(lower("CommandLine"),'zqbjagga')""")
_rule_query("rule_windash", {"s": {"CommandLine|windash|contains": " -c"}, "condition": "s"}, """contains("CommandLine",' -c') OR contains("CommandLine",' /c')""")
_rule_query("rule_all", {"s": {"CommandLine|contains|all": ["net", "domain"]}, "condition": "s"}, """contains("CommandLine",'net') AND contains("CommandLine",'domain')""")
_rule_query("rule_null", {"s": {"QueryName": None}, "condition": "s"}, """"QueryName"=''""")
_rule_query("rule_list", {"s": {"EventID": [1, 22, "4672"]}, "condition": "s"}, """"EventID" IN ('1','22','4672')""")
_rule_query("rule_map", {"s": {"EventID": 4624, "LogonType": "10"}, "condition": "s"}, """"EventID"='4624' AND "LogonType"='10'""")
_rule_query("rule_selection_list", {"s": [{"EventID": 4672}, {"LogonType": 2}], "condition": "s"}, """"EventID"='4672' OR "LogonType"='2'""")
_rule_query("rule_keywords", {"keywords": ["click", "signup"], "condition": "keywords"}, """contains(_raw,'click') OR contains(_raw,'signup')""")
_rule_query("rule_condition", {"a": {"EventID": 1}, "b": {"LogonType": 3}, "c": {"Computer": "WS1"}, "condition": "a and not (b or c)"}, """"EventID"='1' AND NOT ("LogonType"='3' OR "Computer"='WS1')""")
_rule_query("rule_one_of", {"sel_a": {"EventID": 22}, "sel_b": {"Computer": "WS2"}, "other": {"EventID": 1}, "condition": "1 of sel_*"}, """"EventID"='22' OR "Computer"='WS2'""")
_rule_query("rule_all_of", {"sel_a": {"EventID": 22}, "sel_b": {"Computer": "WS2"}, "condition": "all of them"}, """"EventID"='22' AND "Computer"='WS2'""")
_rule_query("rule_n_of", {"sel_a": {"EventID": 22}, "sel_b": {"Computer": "WS2"}, "sel_c": {"LogonType": 3}, "condition": "2 of sel_*"}, """(CAST("EventID"='22' AS INT) + CAST("Computer"='WS2' AS INT) + CAST("LogonType"='3' AS INT)) >= 2""")

RULES = [
    {"title": "Discovery command", "level": "medium", "tags": ["attack.discovery", "attack.t1033"], "logsource": {"category": "process_creation"}, "detection": {"s": {"CommandLine|contains": "whoami"}, "condition": "s"}},
    {"title": "Encoded shell", "level": "high", "tags": ["attack.execution", "attack.t1059.001"], "logsource": {"category": "process_creation"}, "detection": {"s": {"Image|endswith": r"\powershell.exe", "CommandLine|contains": "-enc"}, "condition": "s"}},
    {"title": "Download with a system tool", "level": "critical", "tags": ["attack.command_and_control", "attack.t1105"], "logsource": {"category": "process_creation"}, "detection": {"s": {"CommandLine|contains|all": ["certutil", "http"]}, "condition": "s"}},
    {"title": "Failed logon", "level": "low", "tags": ["attack.credential_access"], "logsource": {}, "detection": {"s": {"EventID": 4625}, "machine": {"AcctName|endswith": "$"}, "condition": "s and not machine"}},
]
_HITS = f"""{WITH}, hits AS (
SELECT *, 'Discovery command' AS title, 'medium' AS level FROM logs WHERE "EventID" IN ('1','4688') AND contains("CommandLine",'whoami') UNION ALL
SELECT *, 'Encoded shell', 'high' FROM logs WHERE "EventID" IN ('1','4688') AND ends_with("Image",'\\powershell.exe') AND contains("CommandLine",'-enc') UNION ALL
SELECT *, 'Download with a system tool', 'critical' FROM logs WHERE "EventID" IN ('1','4688') AND contains("CommandLine",'certutil') AND contains("CommandLine",'http') UNION ALL
SELECT *, 'Failed logon', 'low' FROM logs WHERE "EventID"='4625' AND NOT ends_with("AcctName",'$'))"""


def hit_query(sql: str | None):
    def register(f):
        _queries[f.__name__] = lambda spark, sf: f(ru.apply_rules(log_events(spark, sf), RULES))
        if sql:
            _oracles[f.__name__] = f"{_HITS} {sql}"
        return f

    return register


@hit_query("SELECT title, level, count(*) AS n FROM hits GROUP BY 1,2")
def detections(hits):
    return ru.detections(hits)


@hit_query("SELECT event_id, title FROM hits")
def rule_hits(hits):
    return hits.select("event_id", "title")


@hit_query("""SELECT count(DISTINCT title) AS rules_matched, CAST(4 AS BIGINT) AS rules_loaded, count(DISTINCT event_id) AS events_matched, """ + ", ".join(f"count(DISTINCT title) FILTER (level='{x}') AS {x}" for x in ru.LEVELS) + """,
(SELECT list(concat(title, ': ', n) ORDER BY n DESC, title) FROM (SELECT title, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, title LIMIT 5)) AS top_rules FROM hits""")
def rule_coverage(hits):
    return ru.rule_coverage(hits, len(RULES))


@query(None)
def rule_profile(ev):
    return ru.rule_profile(ru.apply_rules(ev, RULES), ev.count())


_oracles["rule_profile"] = f"{_HITS} SELECT title, level, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM logs) AS selectivity FROM hits GROUP BY 1,2"


@query("""SELECT event_id FROM logs WHERE "EventID" IN ('1','4688','4625')""")
def prefilter_events(ev):
    return ru.prefilter_events(ev, RULES).select("event_id")


@hit_query("SELECT event_id, title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY event_id) AS p FROM hits) WHERE p <= 20")
def sample_hits(hits):
    return ru.sample_hits(hits, ["event_id"], 20).select("event_id", "title")


@hit_query("""SELECT title, level, min("SystemTime") AS first_seen, count(*) AS n, CASE title WHEN 'Discovery command' THEN ['T1033'] WHEN 'Encoded shell' THEN ['T1059.001'] WHEN 'Download with a system tool' THEN ['T1105'] ELSE CAST([] AS VARCHAR[]) END AS techniques FROM hits GROUP BY 1,2""")
def timeline(hits):
    return an.timeline(hits)


@hit_query("""SELECT "Computer" AS entity, count(*) AS n, count(DISTINCT title) AS n_rules, list_sort(list(DISTINCT title)) AS rules, list_sort(list(DISTINCT CASE title WHEN 'Discovery command' THEN 'discovery' WHEN 'Encoded shell' THEN 'execution' WHEN 'Download with a system tool' THEN 'command-and-control' ELSE 'credential-access' END)) AS tactics, CAST(date_diff('second', min(CAST("SystemTime" AS TIMESTAMP)), max(CAST("SystemTime" AS TIMESTAMP))) AS DOUBLE) AS duration_sec FROM hits GROUP BY 1 HAVING count(DISTINCT title) >= 2""")
def attack_chains(hits):
    return an.attack_chains(hits)


@hit_query("""SELECT entity, place, SystemTime AS t, title, level, image FROM (SELECT "Computer" AS entity, "SystemTime", title, level, nullif("Image",'') AS image, row_number() OVER (PARTITION BY "Computer" ORDER BY "SystemTime", title, keys) AS place, count(*) OVER (PARTITION BY "Computer") AS n, titles FROM (
SELECT *, concat('{', array_to_string(list_filter(['"Image":"' || replace("Image",'\\','\\\\') || '"', '"CommandLine":"' || replace("CommandLine",'\\','\\\\') || '"', '"EventID":"' || "EventID" || '"'], lambda x: NOT contains(x, ':""')), ','), '}') AS keys FROM hits JOIN (SELECT "Computer" AS c, count(DISTINCT title) AS titles FROM hits GROUP BY 1) ON c = "Computer")) WHERE titles >= 2""")
def chain_events(hits):
    return an.chain_events(hits).select("entity", "place", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "title", "level", F.col("key_fields")["Image"].alias("image"))


@hit_query("""SELECT entity, kind, least(sum(w), 100.0) AS score, count(*) AS n, CAST(count(DISTINCT title) AS INTEGER) AS n_rules, list_sort(list(DISTINCT title)) AS rules FROM (
SELECT title, CAST(CASE level WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END AS DOUBLE) AS w, unnest(["Computer", "AcctName"]) AS entity, unnest(['host','user']) AS kind FROM hits) GROUP BY 1,2""")
def threat_scores(hits):
    return an.threat_scores(hits, users=("AcctName",))


@hit_query("""SELECT CAST(count(*) FILTER (level='informational') AS BIGINT) AS informational, count(*) FILTER (level='low') AS low, count(*) FILTER (level='medium') AS medium, count(*) FILTER (level='high') AS high, count(*) FILTER (level='critical') AS critical, CAST(sum(n) AS BIGINT) AS total_hits FROM (SELECT title, level, count(*) AS n FROM hits GROUP BY 1,2)""")
def severity_stats(hits):
    return an.severity_stats(ru.detections(hits))


@hit_query("""SELECT CASE WHEN c >= 3 OR (c >= 1 AND h >= 5) THEN 'breach' WHEN c >= 1 OR h >= 3 THEN 'likely' WHEN h > 0 OR m > 2 THEN 'suspicious' ELSE 'clean' END AS verdict, least(10*c+5*h+2*m+l, 100) AS risk FROM (
SELECT count(*) FILTER (level='low') AS l, count(*) FILTER (level='medium') AS m, count(*) FILTER (level='high') AS h, count(*) FILTER (level='critical') AS c FROM (SELECT DISTINCT title, level FROM hits))""")
def verdict(hits):
    return an.verdict(ru.detections(hits)).select("verdict", "risk")


@hit_query("""SELECT title, level, count(*) AS n, [CASE title WHEN 'Discovery command' THEN 'Discovery' WHEN 'Encoded shell' THEN 'Execution' WHEN 'Download with a system tool' THEN 'Command and Control' ELSE 'Credential Access' END] AS tactics FROM hits GROUP BY 1,2 ORDER BY CASE level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC LIMIT 2""")
def key_findings(hits):
    return an.key_findings(at.tagged(hits), 2)


@hit_query("""SELECT coalesce(a.title, b.title) AS title, CASE WHEN b.title IS NULL THEN 'resolved' WHEN a.title IS NULL THEN 'new' ELSE 'both' END AS state, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after
FROM (SELECT title, count(*) AS n FROM hits WHERE "Computer"='WS1' AND level <> 'low' GROUP BY 1) a FULL JOIN (SELECT title, count(*) AS n FROM hits WHERE "Computer"='WS2' AND level <> 'high' GROUP BY 1) b ON a.title = b.title""")
def evidence_diff(hits):
    return an.evidence_diff(hits.filter("Computer='WS1' and level <> 'low'"), hits.filter("Computer='WS2' and level <> 'high'"))


# --- anomalies and logins -----------------------------------------------------------------------
_HOUR = """CAST(substr("SystemTime",12,2) AS INT)"""
_USER = """"AcctName" <> '' AND "AcctName" <> '-' AND NOT ends_with("AcctName",'$')"""


@query("""SELECT "CommandLine" AS "Image", count(*) AS n FROM logs WHERE "CommandLine" <> '' GROUP BY 1 HAVING count(*) <= 2""")
def rare_process(ev):
    return an.rare_process(ev.select(F.col("CommandLine").alias("Image")))


@query("""SELECT "ParentImage", "CommandLine" AS "Image", count(*) AS n FROM logs WHERE "ParentImage" <> '' AND "CommandLine" <> '' GROUP BY 1,2 HAVING count(*) = 1""")
def rare_parent_child(ev):
    return an.rare_parent_child(ev.select("ParentImage", F.col("CommandLine").alias("Image")))


@query(f"""SELECT event_id FROM logs WHERE "EventID"='4624' AND NOT ({_HOUR} BETWEEN 8 AND 18)""")
def off_hours_logon(ev):
    return an.off_hours_logon(ev).select("event_id")


@query("""SELECT "AcctName" AS user, "IpAddress" AS ip, count(*) AS n, CAST(least(2*count(*),10) AS DOUBLE) AS score FROM logs WHERE "EventID"='4625' GROUP BY 1,2 HAVING count(*) >= 5""")
def brute_force(ev):
    return an.brute_force(ev, "AcctName")


_ANOMALIES = {  # category: severity, score, findings as text t
    "rare_process": ("medium", "least(count(*),10)", """SELECT concat("Image", ' (', count(*), ')') AS t FROM logs WHERE "Image" <> '' GROUP BY "Image" HAVING count(*) <= 2"""),
    "off_hours_logon": ("low", "least(0.5*count(*),10)", f"""SELECT concat("SystemTime", ' ', "AcctName") AS t FROM logs WHERE "EventID"='4624' AND NOT ({_HOUR} BETWEEN 8 AND 18)"""),
    "rare_parent_child": ("medium", "least(0.5*count(*),10)", """SELECT concat("ParentImage", ' > ', "Image", ' (1)') AS t FROM logs WHERE "ParentImage" <> '' AND "Image" <> '' GROUP BY "ParentImage", "Image" HAVING count(*) = 1"""),
    "brute_force": ("high", "least(2*count(*),10)", """SELECT concat("AcctName", ' > ', "IpAddress", ' (', count(*), ')') AS t FROM logs WHERE "EventID"='4625' GROUP BY "AcctName", "IpAddress" HAVING count(*) >= 5"""),
}


@query("SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{k}' AS category, '{severity}' AS severity, count(*) AS n, CAST({score} AS DOUBLE) AS score, list_sort(list(t))[1:5] AS evidence FROM ({found})""" for k, (severity, score, found) in _ANOMALIES.items()) + ") WHERE n > 0")
def anomaly_report(ev):
    return an.anomaly_report(ev, "AcctName")


def _login_sql(name: str, where: str) -> str:
    return f"""SELECT "{name}", count(*) FILTER ("EventID"='4624') AS success, count(*) FILTER ("EventID"='4625') AS failure, round(100 * count(*) FILTER ("EventID"='4625') / CAST(count(*) AS DOUBLE), 2) AS failure_pct FROM logs WHERE "EventID" IN ('4624','4625') AND {where} GROUP BY 1"""


@query(_login_sql("AcctName", _USER))
def logins_by_user(ev):
    return an.logins_by_user(ev, "AcctName")


@query(_login_sql("IpAddress", """"IpAddress" NOT IN ('','-')"""))
def logins_by_ip(ev):
    return an.logins_by_ip(ev)


@query(f"""SELECT "AcctName" AS user, coalesce(nullif("IpAddress",''),'N/A') AS ip, count(*) AS n FROM logs WHERE "EventID"='4625' AND {_USER} GROUP BY 1,2 HAVING count(*) >= 5""")
def login_brute_force(ev):
    return an.login_brute_force(ev, "AcctName")


@query(f"""SELECT "AcctName" AS user, 'N/A' AS ip, count(*) AS n FROM logs WHERE "EventID"='4625' AND {_USER} GROUP BY 1 HAVING count(*) >= 5""")
def login_brute_force_without_addresses(ev):
    return an.login_brute_force(ev.drop("IpAddress"), "AcctName")


@query(f"""SELECT event_id FROM logs WHERE "EventID"='4624' AND ({_HOUR} < 6 OR {_HOUR} >= 20)""")
def unusual_hours(ev):
    return an.unusual_hours(ev).select("event_id")


@query("""SELECT DISTINCT "AcctName" AS user, "IpAddress" AS ip, "LogonType" AS logon_type FROM logs WHERE "EventID"='4624' AND "LogonType" IN ('3','10') AND "IpAddress" NOT IN ('','-')""")
def lateral_logons(ev):
    return an.lateral_logons(ev, "AcctName")


@query(f"""SELECT "AcctName" AS user, count(*) AS n FROM logs WHERE "EventID"='4672' AND {_USER} GROUP BY 1""")
def privilege_use(ev):
    return an.privilege_use(ev, "AcctName")


# --- indicators and enrichment --------------------------------------------------------------------
@query("""SELECT c AS name, round(-sum(p*log2(p)), 2) AS entropy FROM (SELECT c, n/sum(n) OVER (PARTITION BY c) AS p FROM (
SELECT c, ch, count(*) AS n FROM (SELECT c, unnest(string_split(c,'')) AS ch FROM (SELECT DISTINCT c_name AS c FROM customer)) WHERE ch <> '' GROUP BY 1,2)) GROUP BY 1""", logs=False)
def entropy_of_names(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("name")).distinct().withColumn("entropy", F.round(entropy(F.col("name")), 2))


# --- indicators of all types in all texts ------------------------------------------------------------
_PUBLIC_IP = r"""(regexp_full_match(value, '(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}') AND list_max(o) <= 255 AND NOT (o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168)
OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) OR (o[3] = 0 AND o[4] = 0) OR o[4] = 255))"""
_ALL_TEXTS = {"documents.text": ("documents", "doc_id", "text"), "pages.url": ("pages", "page_id", "url"), "pages.html": ("pages", "page_id", "html")}
_ALL_IOC = "SELECT source, id, type, value FROM (SELECT *, CASE WHEN type = 'ipv4' THEN list_transform(string_split(value, '.'), lambda x: CAST(x AS INTEGER)) END AS o FROM (" + " UNION ALL ".join(
    f"""SELECT '{source}' AS source, {key} AS id, '{kind}' AS type, unnest(list_distinct(regexp_extract_all(coalesce({column},''), '{pattern.replace("'", "''")}'))) AS value FROM {name}"""
    for source, (name, key, column) in _ALL_TEXTS.items()
    for kind, pattern in ind.PATTERNS.items()
) + f")) WHERE type <> 'ipv4' OR {_PUBLIC_IP}"


@query(_ALL_IOC, logs=False)
def extract_iocs(spark, sf):
    parts = [ind.extract_iocs(table(spark, sf, name).select(F.lit(source).alias("source"), F.col(key).alias("id"), column), column) for source, (name, key, column) in _ALL_TEXTS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT type, value, count(*) AS n, min(id) AS first_key, max(id) AS last_key FROM ({_ALL_IOC}) GROUP BY 1,2", logs=False)
def ioc_rollup(spark, sf):
    return ind.ioc_rollup(extract_iocs(spark, sf), "id")


@query("SELECT DISTINCT page_id, 'url' AS type, unnest(list_concat(" + ", ".join(f"""regexp_extract_all(coalesce({c},''), '{ind.PATTERNS["url"].replace("'", "''")}')""" for c in ("url", "html")) + ")) AS value FROM pages", logs=False)
def page_urls(spark, sf):
    pages = table(spark, sf, "pages")
    return ind.extract_iocs(pages.select("page_id", F.concat_ws("\n", "url", "html").alias("text")), "text", ("url",))


# --- commands over the whole view ------------------------------------------------------------------
#: Entropy over the bytes of each command line.
_ENTROPY = """, ent AS (SELECT c, -sum(p*log2(p)) AS e FROM (SELECT c, n/sum(n) OVER (PARTITION BY c) AS p FROM (SELECT c, b, count(*) AS n FROM (
SELECT c, unnest(regexp_extract_all(hex(encode(c)), '..')) AS b FROM (SELECT DISTINCT "CommandLine" AS c FROM logs WHERE "CommandLine" <> '')) GROUP BY 1,2)) GROUP BY 1)"""


@query(f"""{_ENTROPY} SELECT event_id, round(e, 2) AS entropy FROM logs JOIN ent ON c = "CommandLine" WHERE length(c) > 20 AND e > 3.5""")
def high_entropy_command(ev):
    return an.high_entropy_command(ev, 20, 3.5).select("event_id", F.round("_entropy", 2).alias("entropy"))


@query(f"""{_ENTROPY} SELECT event_id, CAST(3 * (length(c) - length(replace(c,'^','')) >= 3)::INT + 3 * (contains(c,'"+"') OR contains(c,'''+'''))::INT + 2 * (length(c) - length(replace(c,'`','')) >= 2)::INT
+ 2 * (length(c) - length(replace(c,'%','')) >= 4)::INT + (strlen(c) > 1000)::INT + 2 * (e > 4.5)::INT AS INTEGER) AS obfuscation_score
FROM (SELECT event_id, "CommandLine" AS c, coalesce(e, 0) AS e FROM logs LEFT JOIN ent ON c = "CommandLine")""")
def obfuscation_score(ev):
    return ind.obfuscation_score(ev).select("event_id", "obfuscation_score")


#: The first printable text of each command line's base64 runs, as UTF-8 or else UTF-16LE (no surrogates).
_DECODED = r""", runs AS (SELECT c, i, unnest([TRY(decode(b)), CASE WHEN regexp_matches(hex(b), '^(?:..(?:[0-9A-CEF].|D[0-7]))+$') THEN
list_reduce(list_transform(regexp_extract_all(hex(b), '....'), lambda h: chr(CAST('0x' || h[3:4] || h[1:2] AS INTEGER))), lambda x, y: x || y) END]) AS t, unnest([0, 1]) AS k FROM (
SELECT c, i, from_base64(r) AS b FROM (SELECT c, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT c, regexp_extract_all(c, '[A-Za-z0-9+/]{8,}={0,2}') AS rs FROM (SELECT DISTINCT "CommandLine" AS c FROM logs))) WHERE length(r) % 4 = 0)),
texts AS (SELECT c, arg_min(t, 2 * i + k) AS decoded FROM runs WHERE t <> '' AND NOT regexp_matches(regexp_replace(t, '[\r\n\t]', '', 'g'), '\p{Cc}') GROUP BY 1)"""


@query(f"""{_DECODED} SELECT event_id, decoded FROM logs LEFT JOIN texts ON "CommandLine" = c""")
def decode_base64(ev):
    return ind.decode_utf16_base64(ev).select("event_id", F.col("decoded_CommandLine").alias("decoded"))


ingest_queries.setup(RULES, _HITS, ru.apply_rules)
incident_queries.setup(RULES, _HITS, ru.apply_rules)
file_queries.setup(RULES, _HITS)


# --- enrichment of events and of indicators ---------------------------------------------------------
@query("""SELECT event_id, CASE WHEN regexp_matches("Image",'(?i)cmd\\.exe|powershell|certutil') THEN TRUE END AS is_lolbin, CASE WHEN "Image" ILIKE '%certutil%' THEN 'certutil' WHEN "Image" ILIKE '%cmd.exe%' THEN 'cmd.exe' WHEN "Image" ILIKE '%powershell%' THEN 'powershell' END AS lolbin_name FROM logs""")
def lolbin(ev):
    return ind.lolbin(ev).select("event_id", "is_lolbin", "lolbin_name")


_TEXT = "concat_ws(' ', IpAddress, CommandLine, QueryName, IpAddress)"


@query(f"""SELECT event_id, CASE WHEN "IpAddress" <> '-' AND NOT starts_with("IpAddress",'10.') THEN "IpAddress" END AS ioc_ips, CASE WHEN contains("CommandLine",'http') THEN 'http://files.example.net/a' END AS ioc_urls,
CASE WHEN contains("CommandLine",'http') OR "QueryName" <> '' THEN 'example.net' END AS ioc_domains FROM logs""")
def inline_iocs(ev):
    return ind.inline_iocs(ev.withColumn("_raw", F.expr(_TEXT))).select("event_id", "ioc_ips", "ioc_urls", "ioc_domains")


@query(f"""{_DECODED} SELECT event_id, texts.decoded AS decoded_CommandLine, CASE event_id % 3 WHEN 0 THEN 'echo' END AS decoded_Payload FROM logs LEFT JOIN texts ON "CommandLine" = c""")
def decode_base64_fields(ev):
    payload = ev.withColumn("Payload", F.expr("CASE event_id % 3 WHEN 0 THEN 'x ZQBjAGgAbwA= y' WHEN 1 THEN '' ELSE NULL END"))
    return ind.decode_base64(payload).select("event_id", "decoded_CommandLine", "decoded_Payload")


_ZONES = """VALUES ('ipv4','203.0.113.1','Grey'), ('ipv4','203.0.113.1','Red'), ('ipv4','203.0.113.2','Green'), ('domain','files.example.net','Orange')"""


@query(f"""SELECT type, value, coalesce(zone, 'Grey') AS zone FROM (SELECT DISTINCT 'ipv4' AS type, "IpAddress" AS value FROM logs WHERE starts_with("IpAddress",'203.') UNION ALL SELECT DISTINCT 'url', 'http://files.example.net/a' FROM logs WHERE contains("CommandLine",'http')
UNION ALL SELECT DISTINCT 'domain', 'files.example.net' FROM logs WHERE contains("CommandLine",'http')) LEFT JOIN (SELECT t, v, arg_min(z, array_position(['Red','Orange','Yellow','Grey','Green'], z)) AS zone FROM ({_ZONES}) r(t, v, z) GROUP BY 1,2) ON t = type AND v = value""")
def enrich_iocs(ev):
    found = ind.extract_iocs(ev.select("event_id", F.expr("concat_ws(' ', IpAddress, CommandLine)").alias("text")), "text", (*ind.PATTERNS, "domain"))
    return ind.enrich_iocs(found, ev.sparkSession.sql(f"SELECT * FROM {_ZONES} AS r(type, value, zone)"))


_SUFFIXES = "VALUES ('net'), ('example.net'), ('uk'), ('co.uk'), ('*.ck'), ('!www.ck'), ('io'), ('github.io')"
_HOST = "concat(Computer, '.', AcctName, CASE event_id % 9 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.uk' WHEN 2 THEN '.foo.ck' WHEN 3 THEN '.www.ck' WHEN 4 THEN '.github.io' WHEN 5 THEN '.IO' WHEN 6 THEN '.example.net' WHEN 7 THEN '.local' ELSE '.other.net.' END)"


@query(f"""SELECT public_suffix, registered_domain, count(*) AS n FROM (SELECT s AS public_suffix, lower(a || '.' || s) AS registered_domain FROM (SELECT "AcctName" AS a, "Computer" AS c, CASE event_id % 9 WHEN 0 THEN 'co.uk' WHEN 1 THEN 'uk' WHEN 2 THEN 'foo.ck' WHEN 4 THEN 'github.io' WHEN 5 THEN 'io' WHEN 6 THEN 'example.net' END AS s, event_id % 9 AS k FROM logs) WHERE k NOT IN (3, 7, 8)
UNION ALL SELECT CASE event_id % 9 WHEN 3 THEN 'ck' WHEN 8 THEN 'net' END, CASE event_id % 9 WHEN 3 THEN 'www.ck' WHEN 8 THEN 'other.net' END FROM logs WHERE event_id % 9 IN (3, 7, 8)) GROUP BY 1, 2""")
def registered_domains(ev):
    hosts = ev.select(F.expr(_HOST).alias("value"))
    return fi.with_public_suffix(hosts, ev.sparkSession.sql(f"SELECT * FROM {_SUFFIXES} AS s(suffix)")).groupBy("public_suffix", "registered_domain").agg(F.count("*").alias("n"))


# --- transforms, hunts and indicators by one call ---------------------------------------------------
_NAME_ENTROPY = """, name AS (SELECT c, -sum(p*log2(p)) AS e FROM (SELECT c, n/sum(n) OVER (PARTITION BY c) AS p FROM (SELECT c, b, count(*) AS n FROM (
SELECT c, unnest(regexp_extract_all(hex(encode(c)), '..')) AS b FROM (SELECT DISTINCT "QueryName" AS c FROM logs WHERE "QueryName" <> '')) GROUP BY 1,2)) GROUP BY 1)"""


@query(f"""{_NAME_ENTROPY} SELECT level, count(*) AS n, round(sum(e), 2) AS total FROM (SELECT round(coalesce(e, 0), 2) AS e, CASE WHEN round(coalesce(e, 0), 2) > 4.5 THEN 'very_high' WHEN round(coalesce(e, 0), 2) > 3.5 THEN 'high' WHEN round(coalesce(e, 0), 2) > 2.5 THEN 'medium' ELSE 'low' END AS level FROM logs LEFT JOIN name ON c = "QueryName") GROUP BY 1""")
def dns_entropy(ev):
    return ind.entropy_level(ev).groupBy(F.col("QueryName_entropy_level").alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("QueryName_entropy"), 2).alias("total"))


def _weekday(df: DataFrame) -> DataFrame:
    return df.withColumn("weekday", F.when(F.col("EventID") == "4625", F.date_format("SystemTime", "E")))


@query(r"""SELECT part, name, count(*) AS n FROM (
SELECT 'transform' AS part, unnest(['is_lolbin', 'lolbin_name']) AS name FROM logs WHERE regexp_matches("Image", '(?i)cmd\.exe|powershell|certutil') UNION ALL
SELECT 'transform', 'weekday' FROM logs WHERE "EventID" = '4625' UNION ALL
SELECT 'hunt', 'ProcessTyposquatting' FROM logs WHERE ends_with("Image", 'svch0st.exe') UNION ALL
SELECT 'hunt', 'ProcessPathAnomaly' FROM logs WHERE contains("Image", '\Public') UNION ALL
SELECT 'ioc', 'ipv4' FROM logs WHERE starts_with("IpAddress", '203.') UNION ALL
SELECT 'ioc', 'domain' FROM logs WHERE "QueryName" <> '' UNION ALL
SELECT 'ioc', 'file_path' FROM (SELECT unnest(["Image", "ParentImage"]) AS f FROM logs) WHERE f <> '' AND NOT regexp_matches(f, '(svchost|explorer)\.exe$')) GROUP BY 1, 2""")
def enrich_all(ev):
    """A transform of one's own, two that are there, two hunts and the indicators of all fields, in one scan."""
    if "weekday" not in tr.transforms():
        tr.register_transform("weekday", _weekday)
    enriched = run_all.enrich_all(ev, ("lolbin", "weekday"), ("typosquat", "path_anomaly"))
    return run_all.enrich_summary(enriched, ("is_lolbin", "lolbin_name", "weekday"))


# --- all analyses by one call -------------------------------------------------------------------
def _analyse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = run_all.analyse(log_events(spark, sf_dir), RULES, ingest_queries.techniques(spark), user="AcctName", hunts=tuple(hu.HUNTS))
    return run_all.digests(parts)


#: Hunts that find something in the view as it is.
_FOUND_HUNTS = ("typosquat", "path_anomaly", "download_cradle", "parent_anomaly")
_HUNT_ROWS = "SELECT name, severity, description, count(*) AS n FROM (" + " UNION ALL ".join([f"SELECT '{h}' AS name, severity, description FROM ({hunt_queries.oracles()[f'hunt_{h}']})" for h in _FOUND_HUNTS] + [f"""SELECT 'recon_command', 'low', CASE WHEN contains("CommandLine",'whoami') THEN 'a' ELSE 'b' END FROM ({WITH} SELECT * FROM logs) WHERE contains("CommandLine",'whoami') OR contains("CommandLine",'net user')"""]) + ") GROUP BY 1,2,3"
_known = _oracles | ingest_queries.oracles() | incident_queries.oracles() | {"hits": _oracles["rule_hits"], "hunts": _HUNT_ROWS, "confidence": f"{_HITS} SELECT title, 'high' AS confidence FROM hits GROUP BY 1"}
_queries["analyse_all"] = _analyse_all
_oracles["analyse_all"] = " UNION ALL ".join(f"SELECT '{name}' AS part, count(*) AS n, round(CAST(sum({total}) AS DOUBLE), 6) AS total FROM ({_known[name]})" for name, total in run_all.TOTALS.items())
_more = cookbook.queries() | detection_queries.queries() | file_queries.queries(), cookbook.oracles() | detection_queries.oracles() | file_queries.oracles()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["detections"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return _queries | hunt_queries.queries() | _more[0] | ingest_queries.queries() | incident_queries.queries()


def oracles() -> dict[str, str]:
    return _oracles | hunt_queries.oracles() | _more[1] | ingest_queries.oracles() | incident_queries.oracles()

"""Rule sets against each rule alone and against Python; log sources from files to hits."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import log_sources as ls
from emberlog.operators import rules as ru
from emberlog.operators.rule_checks import validate_rule_files
from emberlog.sources import readers as rd

WORDS = ["who", "whoami", "net user", "${jndi}", "a$b", "/C", "-enc", "İx", "Σς", "\\cmd.exe", "*", "10.1.2.3", "10.9.0.1", "fc00::1", "7", "7.5", " 8 ", "nan", "1e3", "0x1", "", "tail"]
COLUMNS = ["EventID", "CommandLine", "Image", "Ip", "Channel", "Provider_Name", "source_format"]


def value(rng, kind):
    if kind in ("gt", "lte"):
        return rng.choice([0, 7, 7.5, 1000])
    if kind == "cidr":
        return rng.choice(["10.0.0.0/8", "10.1.2.0/24", "10.1.2.3/32", "0.0.0.0/0", "fc00::/7", "10.8.0.0/13"])
    if kind == "re":
        return rng.choice(["^who", "user$", r"[0-9]+\.", "(?i)NET", r"\$\{"])
    if kind == "fieldref":
        return rng.choice(COLUMNS)
    out = rng.choice([*WORDS, "WHO*", "?et*er", "*", "${::-j}${::-n}", "$", "{", None, True, 7])
    return out


def test_values(rng):
    kind = rng.choice(["", "", "contains", "contains", "startswith", "endswith", "contains|all", "contains|windash", "cased", "contains|cased", "re", "cidr", "gt", "lte", "fieldref", "fieldref|contains", "exists", "base64offset|contains", "wide|base64"])
    name = rng.choice(["CommandLine", "Image", "Ip", "EventID", "Missing"])
    first = kind.split("|")[0]
    if first == "exists":
        return f"{name}|exists", rng.random() < 0.5
    made = [value(rng, first) for _ in range(rng.choice([1, 1, 2, 4]))]
    return (f"{name}|{kind}" if kind else name), made[0] if len(made) == 1 else made


test_values.__test__ = False


def random_rule(rng, i):
    bodies = {}
    for name in ("sel_a", "sel_b", "flt"):
        body = dict(test_values(rng) for _ in range(rng.randint(1, 2)))
        bodies[name] = rng.choice([body, [body, dict([test_values(rng)])], ["who", rng.choice(WORDS[:6])]])
    text = rng.choice(["sel_a", "sel_a and sel_b", "sel_a or sel_b", "sel_a and not flt", "not flt", "1 of sel_*", "all of them", "2 of them", "sel_b and not (sel_a or flt)"])
    source = rng.choice([{}, {}, {"category": "process_creation"}, {"product": "windows", "category": "dns_query"}, {"product": "linux", "category": "process_creation"}, {"product": "zeek"}, {"category": "antivirus"}, {"product": "linux", "service": "auditd"}])
    return {"title": f"r{i}", "logsource": source, "detection": bodies | {"condition": text}}


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    join = lambda: rng.choice(["", " ", "x"]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 3)))
    rows = []
    for i in range(400):
        rows.append((i, rng.choice(["1", "22", "4688", "", None]), rng.choice([None, join()]), join(), rng.choice(WORDS), rng.choice([None, "Windows Defender/x", "Security"]), rng.choice([None, "Microsoft-Windows-Sysmon", "Other"]), rng.choice(["zeek", "Zeek", "ZeekTsv", "syslog", "Syslog", "auditd", "json", None]), join()))
    return spark.createDataFrame(rows, "event_id long, " + ", ".join(f"{c} string" for c in COLUMNS) + ", _raw string").repartition(3).cache()


def test_a_set_hits_what_each_rule_hits(spark, events):
    rng = random.Random(12)
    rules = [random_rule(rng, i) for i in range(120)]
    want = set()
    for at in range(0, len(rules), 40):  # one scan for some rules
        some = rules[at : at + 40]
        flags = events.select("event_id", *[ru.rule_predicate(events, r).alias(r["title"]) for r in some]).collect()
        want |= {(row.event_id, r["title"]) for row in flags for r in some if row[r["title"]]}
    got = {(r.event_id, r.title) for r in ru.apply_rules(events, rules).select("event_id", "title").collect()}
    assert got == want and len(want) > 1000
    assert ru.rule_problems(events, [{"title": "x", "detection": {"s": {"Image": 1}, "condition": "s"}}]).count() == 0


def test_text_with_dollars_stays_text(spark):
    spark.conf.set("spark.emberlog.secret", "s3cret")
    lines = ["say ${jndi} x", "say ", "a${jndi}", "${::-l}${::-d}${::-a}${::-p}", "s3cret", "${spark.emberlog.secret}", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "event_id long, CommandLine string")
    for words in ("${jndi}", "a${jndi}", "${::-l}${::-d}${::-a}${::-p}", "${spark.emberlog.secret}", "${env:PATH}"):
        rule = {"title": "t", "detection": {"s": {"CommandLine|contains": words}, "condition": "s"}}
        want = [i for i, t in enumerate(lines) if words in t]
        assert sorted(r.event_id for r in df.filter(ru.rule_predicate(df, rule)).collect()) == want
        assert sorted(r.event_id for r in ru.apply_rules(df, [rule]).collect()) == want
    odd = df.withColumnRenamed("CommandLine", "a${x}`b")
    assert odd.filter(ru.rule_predicate(odd, {"title": "t", "detection": {"s": {"a${x}`b|contains": "jndi"}, "condition": "s"}})).count() == 2


FILES = {
    "zeek": ("#separator \\x09\n#path\tdns\n#fields\tts\tquery\n1\tevil.example\n", {"product": "zeek", "service": "dns"}, {"query|endswith": ".example"}, ["query"]),
    "syslog": ("<34>Oct 11 22:14:15 host su[234]: failed for root\n", {"product": "linux", "category": "process_creation"}, {"message|contains": "root"}, ["message"]),
    "cef": ("CEF:0|v|p|1|100|name|5|src=10.0.0.1 act=deny\n", {"product": "cisco"}, {"act": "deny"}, ["act"]),
    "leef": ("LEEF:1.0|v|p|1|e|src=10.0.0.1\tact=deny\n", {"product": "paloalto"}, {"act": "deny"}, ["act"]),
    "json": ('{"eventName": "ConsoleLogin"}\n', {"product": "aws", "service": "cloudtrail"}, {"eventName": "consolelogin"}, ["eventName"]),
    "w3c": ("#Fields: date time cs-method\n2024-01-01 00:00:00 TRACE\n", {"product": "apache"}, {"cs-method": "TRACE"}, ["cs-method"]),
    "text": ('10.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "TRACE /x HTTP/1.0" 200 5 "-" "-"\n', {"product": "apache"}, {"cs-method": "trace"}, ["cs-method"]),
    "auditd": ('type=EXECVE msg=audit(1:2): argc=1 a0="nc"\n', {"product": "linux", "service": "auditd"}, {"a0": "nc"}, ["a0"]),
    "macos": ('{"processImagePath": "/bin/sh", "eventMessage": "x"}\n', {"product": "macos"}, {"Image|endswith": "/sh"}, ["Image"]),
    "event_xml": ("<Event><System><EventID>4688</EventID></System><EventData><Data Name='CommandLine'>whoami</Data></EventData></Event>\n", {"product": "windows", "category": "process_creation"}, {"CommandLine": "whoami"}, ["EventID", "CommandLine"]),
}


@pytest.mark.parametrize("name", sorted(FILES))
def test_rules_fire_on_what_the_readers_read(spark, tmp_path, name):
    text, source, body, names = FILES[name]
    (tmp_path / "a.log").write_text(text)
    df = rd.wide(rd.READERS[name](spark, str(tmp_path)), names)
    rule = {"title": "t", "logsource": source, "detection": {"s": body, "condition": "s"}}
    other = rule | {"title": "o", "logsource": {"product": "zeek" if name != "zeek" else "okta"}}
    assert [r.title for r in ru.apply_rules(df, [rule, other]).collect()] == ["t"]
    assert df.filter(ru.rule_predicate(df, rule)).count() == 1 and df.filter(ru.rule_predicate(df, other)).count() == 0


def test_rules_that_have_nothing_to_say_are_reported(spark):
    df = spark.createDataFrame([(1, "1", "a")], "event_id long, EventID string, Image string")
    rules = [
        {"title": "format", "logsource": {"product": "zeek"}, "detection": {"s": {"Image": "b"}, "condition": "not s"}},
        {"title": "fields", "detection": {"s": {"c-useragent": ""}, "condition": "s"}},
        {"title": "fine", "detection": {"s": {"Image": "b"}, "condition": "not s"}},
    ]
    assert [r.title for r in ru.apply_rules(df, rules).collect()] == ["fine"]
    assert [df.filter(ru.rule_predicate(df, r)).count() for r in rules] == [0, 0, 1]
    assert {r.title: r.problem.split(":")[0] for r in ru.rule_problems(df, rules).collect()} == {"format": "its log source is told by the format, and the events name none", "fields": "none of its fields is a column of the events"}


def test_events_are_told_apart_by_channel_too(spark):
    df = spark.createDataFrame([(1, "1", None), (2, "7", "Security"), (3, "7", "SYSTEM"), (4, None, "x")], "event_id long, EventID string, Channel string")
    by_id = {"title": "a", "detection": {"s": {"EventID": 1}, "condition": "s"}}
    by_channel = {"title": "b", "detection": {"s": {"Channel": ["system", "x"]}, "condition": "s"}}
    kept = lambda *rules: sorted(r.event_id for r in ru.prefilter_events(df, list(rules)).collect())
    assert [kept(by_id), kept(by_channel), kept(by_id, by_channel), kept(by_id, {"title": "c", "detection": {"s": {"Channel|contains": "x"}, "condition": "s"}})] == [[1], [3, 4], [1, 3, 4], [1, 2, 3, 4]]


def test_the_function_runs_once_and_reads_only_the_fields_of_the_rules(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([(1, "1", "a.exe", "x")], "event_id long, EventID string, Image string, other string").write.parquet(path)
    df = spark.read.parquet(path)
    rule = {"title": "t", "detection": {"s": {"Image|endswith": ".exe"}, "condition": "s"}}
    plan = ru.detections(ru.apply_rules(df, [rule]))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 1 and "other" not in plan


def test_log_source_table(spark):
    table = ls.log_source_table(spark)
    assert table.filter("product = 'linux' AND service = 'auditd'").first().format == "auditd"
    assert {r.event_id for r in table.filter("category = 'registry_set'").collect()} == {"12", "13", "14"}
    assert table.filter(F.col("format").isNotNull() & F.col("event_id").isNotNull()).count() == 0


def test_rule_files_are_checked(spark, tmp_path):
    good = "title: a\nid: {id}\nstatus: test\ndescription: d\nlogsource: {{product: x}}\nlevel: low\ndetection:\n  s: {{a: 1}}\n  condition: s\n"
    ids = [f"0000000{i}-0000-0000-0000-000000000000" for i in range(3)]
    (tmp_path / "a.yml").write_text(good.format(id=ids[0]))
    (tmp_path / "b.yaml").write_text(good.format(id=ids[0]))
    (tmp_path / "c.yml").write_text(good.format(id="x").replace("low", "loud").replace("  condition: s\n", ""))
    (tmp_path / "d.yml").write_text(good.format(id=ids[1]).replace("status: test\n", ""))
    (tmp_path / "e.yml").write_text("a: [")
    (tmp_path / "f.yml").write_text("- x\n")
    (tmp_path / "g.txt").write_text("a: [")
    got = {(r.path.rsplit("/", 1)[1], r.problem) for r in validate_rule_files(spark, str(tmp_path)).collect()}
    assert got == {("b.yaml", "duplicate id"), ("c.yml", "no condition"), ("c.yml", "invalid id"), ("c.yml", "invalid level"), ("d.yml", "missing: status"), ("e.yml", "no YAML"), ("f.yml", "no mapping")}

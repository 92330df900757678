import json

from pyspark.sql import functions as F

from emberlog.operators import attack, incident, log_sources
from emberlog.operators import field_indicators as fi
from emberlog.operators import indicators as ind
from emberlog.sources.formats import classify_files


def test_files_by_name_and_head(spark, tmp_path):
    heads = {
        "a.evtx": "x", "b.log": "#separator \\x09\n", "c.log": "LEEF:2.0|a|b", "d.log": '[{"a":1}]', "e.log": '{"subsystem":"x"}',
        "f.log": "<Event><EventData></EventData></Event>", "g.log": "Oct 11 22:14:15 host su: x", "h": "a\tb\tc", "i": " ", "j.log": '<?xml version="1.0"?>',
    }
    for name, head in heads.items():
        (tmp_path / name).write_text(head)
    got = {r.path.rsplit("/", 1)[1]: r.format for r in classify_files(spark, str(tmp_path)).collect()}
    want = ["evtx", "zeek", "leef", "json_array", "macos", "event_xml", "syslog", "tsv", "text", "xml"]
    assert got == dict(zip(heads, want, strict=True))


def test_noise(spark):
    keep = [
        ("file_path", "C:\\Users\\a\\x.exe"), ("registry_key", "HKLM\\Run\\x"), ("domain", "evil.example"), ("url", "http://evil.example/a"),
        ("email", "a.person@evil.example"), ("md5", "0123456789abcdef0123456789abcdef"), ("pipe_name", "\\evil"), ("ipv4", "8.8.8.8"),
    ]
    drop = [
        ("file_path", "c:/windows/WinSxS/a.dll"), ("file_path", "C:\\Windows\\System32\\wbem\\WmiPrvSE.exe"), ("file_path", "C:"),
        ("registry_key", "HKLM\\Tracing\\x"), ("domain", "login.microsoft.com"), ("domain", "run.exe"), ("domain", "trojan.generic"), ("url", "http://10.0.0.1/a"),
        ("email", "noreply@evil.example"), ("email", "postman12@evil.example"), ("md5", "0" * 31 + "a"), ("md5", "1" * 32), ("pipe_name", "\\"),
        ("service_name", "-"), ("ipv4", "10.0.0.1"), ("task_name", None),
    ]
    rows = fi.without_noise(spark.createDataFrame(keep + drop, "type string, value string")).collect()
    assert sorted((r.type, r.value) for r in rows) == sorted(keep)


def test_kinds_of_fields():
    assert fi.kinds_of("SourceIp") == ["ipv4"] and fi.kinds_of("EmailAddress") == [] and fi.kinds_of("ScriptBlockText") == []
    assert fi.kinds_of("DestinationHostname") == ["domain"] and fi.kinds_of("PipeName") == ["pipe_name"]


def test_no_fields_that_hold_indicators(spark):
    assert fi.field_iocs(spark.createDataFrame([(1, "x")], "id long, Note string"), "id").count() == 0


def test_deobfuscate(spark):
    lines = ["p^o^w^ershell", "po`wer`shell -x", "'po'+'wer' %COMSPEC:~0,1% a^b^c^d", "plain command", None]
    rows = ind.deobfuscate(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, CommandLine string")).orderBy("i").collect()
    assert [(r.deobfuscated_CommandLine, r.deobfuscation) for r in rows] == [
        ("powershell", "CARET"), ("powershell -x", "BACKTICK"), ("'po'+'wer' %COMSPEC:~0,1% abcd", "CARET,CONCAT,ENV_SUBSTR"), (None, None), (None, None),
    ]


def test_logsource_formats(spark):
    df = spark.createDataFrame([("Syslog", ""), ("JSON", "Windows Defender"), (None, None)], "source_format string, Channel string")
    count = lambda **logsource: df.filter(log_sources.routed(df, logsource)).count()
    assert [count(product="linux"), count(product="okta"), count(category="antivirus"), count(product="windows"), count()] == [1, 1, 1, 3, 3]


def test_summary_without_detections(spark):
    found = spark.createDataFrame([], "title string, level string, n long, tags array<string>")
    techniques = spark.createDataFrame([], "id string, name string, tactic string")
    scores = spark.createDataFrame([], "entity string, score double")
    summary = incident.incident_summary(found, techniques, scores)
    (row,) = summary.collect()
    assert (row.verdict, row.risk, row.tactics, row.entities, row.advice, row.meaning) == ("clean", 0.0, [], [], [incident.BASELINE], "No significant threats detected.")
    (report,) = incident.run_report(summary, found).collect()
    assert json.loads(report.value)["detections"] == []


def test_report_lists_rules(spark):
    hits = spark.createDataFrame([("R", "high", ["attack.persistence"], "Other"), ("R", "high", ["attack.persistence"], None)], "title string, level string, tags array<string>, Channel string")
    found = attack.tagged(hits)
    techniques = spark.createDataFrame([], "id string, name string, tactic string")
    scores = hits.groupBy(F.lit("h").alias("entity")).agg(F.lit(50.0).alias("score"))
    sure = incident.confidence(hits, [{"title": "R", "logsource": {"service": "security"}}])
    (row,) = incident.run_report(incident.incident_summary(found, techniques, scores), found, sure).collect()
    report = json.loads(row.value)
    read = spark.createDataFrame([("json", 9, 7, 2, 1.5)], "source_format string, lines long, events long, malformed long, seconds double")
    lines = incident.run_report(incident.incident_summary(found, techniques, scores), found, sure, ingest=read).collect()
    assert json.loads(lines[1].value) == {"kind": "ingest", "source_format": "json", "lines": 9, "events": 7, "malformed": 2, "seconds": 1.5}
    assert report["detections"] == [{"title": "R", "level": "high", "count": 2, "tags": ["attack.persistence"], "confidence": "low"}]
    assert report["summary"]["risk"] == 23.0 and report["summary"]["entities"] == ["h (score: 50/100)"]


def test_public_suffixes(spark):
    names = ["a.co.uk", "co.uk", "x.y.CO.UK.", "b.github.io", "github.io", "c.foo.ck", "foo.ck", "d.www.ck", "www.ck", "e.invalid", "uk", "", None]
    df = spark.createDataFrame([(n,) for n in names], "value string")
    suffixes = spark.createDataFrame([(s,) for s in ("uk", "co.uk", "io", "github.io", "*.ck", "!www.ck", "", None)], "suffix string")
    got = {r.value: (r.public_suffix, r.registered_domain) for r in fi.with_public_suffix(df, suffixes).collect()}
    assert got == {
        "a.co.uk": ("co.uk", "a.co.uk"), "co.uk": ("co.uk", None), "x.y.CO.UK.": ("co.uk", "y.co.uk"), "b.github.io": ("github.io", "b.github.io"), "github.io": ("github.io", None), "c.foo.ck": ("foo.ck", "c.foo.ck"),
        "foo.ck": ("foo.ck", None), "d.www.ck": ("ck", "www.ck"), "www.ck": ("ck", "www.ck"), "e.invalid": (None, None), "uk": ("uk", None), "": (None, None), None: (None, None),
    }
    events = spark.createDataFrame([(1, "evil.co.uk"), (2, "co.uk"), (3, "some.thing")], "id long, QueryName string")
    assert [r.value for r in fi.field_iocs(events, "id", suffixes).collect()] == ["evil.co.uk"]

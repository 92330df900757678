import json

from pyspark.sql import functions as F

from emberlog.sources import parsers, readers


def fields(spark, parser, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return [r.f for r in df.select("i", parser(F.col("value")).alias("f")).orderBy("i").collect()]


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


def rows(df):
    return [r.fields for r in df.collect()]


def test_json_is_flattened(spark):
    text = '{"a":{"b":{"c":"x"}},"l":["p","q"],"n":3,"e":"","Event":{"System":{"EventID":1},"EventData":{"Data":[{"@Name":"Image","#text":"cmd.exe"}]}}}'
    got = fields(spark, parsers.json_fields, text, "no json", None)
    want = {"a_b_c": "x", "c": "x", "l": "p, q", "n": "3", "Event_System_EventID": "1", "EventID": "1", "Image": "cmd.exe"}
    assert got[0] == want and not got[1] and not got[2]


def test_syslog(spark):
    old, new, plain = fields(spark, parsers.syslog_fields, "<34>Oct 11 22:14:15 host su[234]: failed user=\"root x\" a=b", "<165>1 2023-01-01T00:00:00Z h app 12 ID47 hello there", "just text")
    assert old == {"priority": "34", "facility": "4", "severity": "2", "timestamp": "Oct 11 22:14:15", "hostname": "host", "app_name": "su", "procid": "234", "message": 'failed user="root x" a=b', "user": "root x", "a": "b"}
    assert new["version"] == "1" and new["msgid"] == "ID47" and new["message"] == "hello there" and new["facility"] == "20"
    assert plain == {"message": "just text"}


def test_cef_and_leef(spark):
    (cef, none) = fields(spark, parsers.cef_fields, r"CEF:0|V|P|1|100|Name of it|5|src=1.2.3.4 msg=a b\=c dst=5.6.7.8", "x")
    assert none is None and cef["msg"] == "a b=c" and cef["dst"] == "5.6.7.8" and cef["Name"] == "Name of it"
    one, two = fields(spark, parsers.leef_fields, "LEEF:1.0|V|P|1|e|src=1\tdst=2", "LEEF:2.0|V|P|1|e|^src=1^dst=a=b")
    assert one["src"] == "1" and one["dst"] == "2" and two["src"] == "1" and two["dst"] == "a=b"


def test_auditd_last_wins(spark):
    assert fields(spark, parsers.auditd_fields, 'type=SYSCALL a=1 exe="/bin/x y" a=2') == [{"type": "SYSCALL", "a": "2", "exe": "/bin/x y"}]


def test_access_log_and_text(spark):
    web, text = fields(spark, parsers.text_fields, '1.2.3.4 - bob [10/Oct/2023:13:55:36 +0000] "GET /a HTTP/1.1" 200 12', "2023-01-02T03:04:05Z error: x")
    assert web["c-ip"] == "1.2.3.4" and web["cs-username"] == "bob" and web["sc-status"] == "200"
    assert text["timestamp"] == "2023-01-02T03:04:05Z" and text["level"] == "ERROR"


def test_event_xml(spark, tmp_path):
    xml = "<Events>" + "".join(f"<Event><System><Provider Name='P'/><EventID>{i}</EventID><TimeCreated SystemTime='t{i}'/></System><EventData><Data Name='CommandLine'>a &amp; b</Data></EventData></Event>\n" for i in (1, 3)) + "</Events>"
    got = sorted(rows(readers.read_event_xml(spark, put(tmp_path, "e.xml", xml))), key=lambda f: f["EventID"])
    assert [f["EventID"] for f in got] == ["1", "3"] and got[1]["CommandLine"] == "a & b" and got[1]["SystemTime"] == "t3" and got[0]["Provider_Name"] == "P"


def test_w3c_header_may_change(spark, tmp_path):
    path = put(tmp_path, "w.log", "#Fields: date time s-ip cs(User-Agent)\n2023-10-01 12:00:00 1.1.1.1 -\n#Fields: date time sc-status\n2023-10-02 13:00:00 404\n")
    got = sorted(rows(readers.read_w3c(spark, path)), key=lambda f: f["date"])
    assert got[0] == {"date": "2023-10-01", "time": "12:00:00", "s-ip": "1.1.1.1", "timestamp": "2023-10-01T12:00:00"}
    assert got[1]["sc-status"] == "404" and "s-ip" not in got[1]


def test_zeek(spark, tmp_path):
    got = rows(readers.read_zeek(spark, put(tmp_path, "dns.log", "#separator \\x09\n#path\tdns\n#fields\tts\tid.orig_h\tquery\n1.0\t1.2.3.4\t-\n")))
    assert got == [{"ts": "1.0", "id_orig_h": "1.2.3.4", "_zeek_log_type": "dns"}]


def test_csv_json_array_and_report(spark, tmp_path):
    csv = readers.read_csv(spark, put(tmp_path, "a.csv", "EventID,Image,CommandLine\n1,cmd.exe,whoami\n3,x.exe,\n"))
    assert sorted(map(len, rows(csv))) == [2, 3]
    array = readers.read_json_array(spark, put(tmp_path, "a.json", '[{"EventID":1,"NewProcessName":"x"},{"EventID":3}]'))
    assert {f["EventID"]: f.get("Image") for f in rows(array)} == {"1": "x", "3": None}
    assert {r.source_format: r.n for r in readers.ingest_report(csv.unionByName(array)).collect()} == {"csv": 2, "json": 2}
    assert readers.evidence_manifest(spark, f"file://{tmp_path}").count() == 2


def test_later_alias_counts(spark):
    got = fields(spark, lambda v: parsers.with_aliases(parsers.json_fields(v)), '{"SubjectUserName":"s","TargetUserName":"t","EventXML_Q":"q"}')[0]
    assert got["User"] == "t" and got["Q"] == "q"


def test_json_of_any_depth(spark):
    deep = "x"
    for i in reversed(range(30)):
        deep = {f"k{i}": deep}
    lines = [json.dumps({"a": deep, "n": 1.50}).replace("1.5", "1.50"), '{"a":{"b":1,"c":true,"d":null,"e":""},"b":"top"}', '{"l":["x",1,null,{"y":[1.0,"z"]}],"Data":[{"@Name":"N","#text":"t"},{"@Name":"M","#text":null}]}', "[1]", "no", None, ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = {r.i: r.f for r in rows.select("i", parsers.json_fields(F.col("value")).alias("f")).collect()}
    assert got[0] == {"a_" + "_".join(f"k{i}" for i in range(30)): "x", "k29": "x", "n": "1.50"}
    assert got[1] == {"a_b": "1", "a_c": "true", "b": "top", "c": "true"}
    assert got[2] == {"l": 'x, 1, {"y":[1.0,"z"]}', "N": "t"}
    assert got[3] is got[4] is got[5] is got[6] is None


def test_csv_cells_beyond_the_header(spark, tmp_path):
    put(tmp_path, "a.csv", 'A,B\n1,2\n3,"x,y",4,5\n6\n')
    rows = {tuple(sorted(r.fields.items())) for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {(("A", "1"), ("B", "2")), (("A", "3"), ("B", "x,y"), ("field_2", "4"), ("field_3", "5")), (("A", "6"),)}
    put(tmp_path, "b.csv", "A,B\n7,8\n")
    assert [r.fields["A"] for r in readers.read_csv(spark, str(tmp_path), include="B.CSV").collect()] == ["7"]


def test_zeek_directives(spark, tmp_path):
    put(tmp_path, "x.log", "#separator |\n#set_separator|,\n#empty_field|EMPTY\n#unset_field|NONE\n#path|conn\n#fields|id.orig_h|a|b|c\n1.2.3.4|EMPTY|NONE|-\n")
    put(tmp_path, "y.log", "#separator \\x09\n#path\tdns\n#fields\tq\tr\nname\t(empty)\n")
    got = {frozenset(r.fields.items()) for r in readers.read_zeek(spark, str(tmp_path)).collect()}
    assert got == {frozenset({("id_orig_h", "1.2.3.4"), ("c", "-"), ("_zeek_log_type", "conn")}), frozenset({("q", "name"), ("_zeek_log_type", "dns")})}


def test_files_are_listed_and_hashed(spark, tmp_path):
    import hashlib

    put(tmp_path, "a b%.json", '{"x":1}')
    put(tmp_path, "b.log", "x")
    assert {(r.name, r["size"]) for r in readers.discover(spark, str(tmp_path)).collect()} == {("a b%.json", 7), ("b.log", 1)}
    assert [r.name for r in readers.discover(spark, str(tmp_path), exclude="JSON").collect()] == ["b.log"]
    assert {r["size"]: r.sha256 for r in readers.evidence_manifest(spark, str(tmp_path)).collect()} == {7: hashlib.sha256(b'{"x":1}').hexdigest(), 1: hashlib.sha256(b"x").hexdigest()}


def test_each_line_is_parsed_once(spark, tmp_path):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    array = readers.read_json_array(spark, put(tmp_path, "a.json", '[{"a":{"b":1}},{},3,null,{"c":""}]'))
    assert plan(array.select("fields")).count("ArrowEvalPython") == 1 and rows(array) == [{"a_b": "1", "b": "1"}]
    syslog = readers.read_syslog(spark, put(tmp_path, "s.log", "plain\n\n"))
    assert plan(syslog.select("fields")).count("map_from_entries") == 1 and rows(syslog) == [{"message": "plain"}]


def test_aliases_where_there_are_some(spark):
    lines = ['{"a":"1"}', '{"NewProcessName":"x","Image":"own"}', '{"IpPort":"5"}', '{"EventXML_":"e"}', '{"EventXML_Image":"y","NewProcessName":"x"}', "no", None]
    want = [{"a": "1"}, {"NewProcessName": "x", "Image": "own"}, {"IpPort": "5", "SourcePort": "5"}, {"EventXML_": "e", "": "e"}, {"EventXML_Image": "y", "NewProcessName": "x", "Image": "x"}, None, None]
    assert fields(spark, lambda v: parsers.with_aliases(parsers.json_fields(v)), *lines) == want
    maps = spark.sql("SELECT map('a', '', 'b', NULL, 'c', 'x') AS m, 1 AS n UNION ALL SELECT map('IpPort', '', 'b', 'y'), 2")
    assert [r.m for r in maps.select("n", parsers.with_aliases(F.col("m")).alias("m")).orderBy("n").collect()] == [{"c": "x"}, {"b": "y"}]
    mac = fields(spark, lambda v: parsers.with_aliases(parsers.json_fields(v), parsers.MACOS), '{"processID":7,"NewProcessName":"x"}')
    assert mac == [{"processID": "7", "NewProcessName": "x", "ProcessId": "7"}]


def test_names_of_inner_json_leaves(spark):
    line = '{"a":{"":{"b":1},"c":"top c"},"":{"d":"2"},"c":"own","Data":[{"@Name":"a_c","#text":"late"},{"@Name":"l","#text":["p",2]},{"@Name":"o","#text":{}}]}'
    assert fields(spark, parsers.json_fields, line) == [{"a__b": "1", "a_c": "top c", "d": "2", "c": "own", "l": "p, 2", "b": "1"}]

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.operators import rules as ru
from emberlog.operators.search import search_field


def hits(spark, values, key, value):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "event_id long, C string")
    return [r.event_id for r in df.filter(ru.rule_predicate(df, {"detection": {"s": {key: value}, "condition": "s"}})).orderBy("event_id").collect()]


def test_missing_counts_as_empty(spark):
    assert hits(spark, [None, "", "a"], "C", None) == [0, 1]
    df = spark.createDataFrame([(0, None), (1, "x")], "event_id long, C string")
    rule = {"detection": {"s": {"C|contains": "x"}, "condition": "not s"}}
    assert [r.event_id for r in df.filter(ru.rule_predicate(df, rule)).collect()] == [0]


def test_unknown_modifier_raises(spark):
    with pytest.raises(ValueError):
        hits(spark, ["a"], "C|expand", "x")


def test_cidr(spark):
    values = ["10.1.2.3", "10.1.3.255", "10.1.4.0", "010.1.2.3", "x", None]
    assert hits(spark, values, "C|cidr", "10.1.2.0/23") == [0, 1]


def test_like_escapes(spark):
    df = spark.createDataFrame([(0, r"C:\tools\a_b"), (1, r"C:\tools\axb")], "event_id long, C string")
    assert search_field(df, "C", r"%\tools\a\_b").count() == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("aAb*?\\.", max_size=6), min_size=1, max_size=6), st.text("ab*?", min_size=1, max_size=4))
def test_wildcards_match_like_a_regex(spark, values, pattern):
    reg = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), re.I | re.S)
    assert hits(spark, values, "C", pattern) == [i for i, v in enumerate(values) if reg.fullmatch(v)]


def test_cidr_of_version_six(spark):
    values = ["fc00::1", "FD12:3456::", "ff02::1", "foo", "::1", "::1234", "1:2:3:4:5:6:7:8", "1::2::3", "", None]
    assert hits(spark, values, "C|cidr", "fc00::/7") == [0, 1]
    assert hits(spark, values, "C|cidr", "::1/128") == [4]
    assert hits(spark, values, "C|cidr", "1:2:3:4::/63") == [6]


@given(st.lists(st.integers(0, 2**128 - 1), min_size=1, max_size=5), st.integers(0, 128))
@settings(max_examples=12, deadline=None)
def test_cidr_of_version_six_like_the_standard_library(spark, numbers, length):
    import ipaddress

    addresses = [ipaddress.IPv6Address(n) for n in numbers] + [ipaddress.IPv6Address(numbers[0] ^ 1)]
    network = ipaddress.ip_network((numbers[0], length), strict=False)
    assert hits(spark, [str(a) for a in addresses], "C|cidr", str(network)) == [i for i, a in enumerate(addresses) if a in network]


def test_more_modifiers(spark):
    import base64

    wide = base64.b64encode("ab".encode("utf-16-le")).decode()
    assert hits(spark, [f"x {wide} y", "ab"], "C|wide|base64|contains", "ab") == [0]
    assert hits(spark, ["Ab", "ab"], "C|cased", "ab") == [1]
    assert hits(spark, ["A", "", None], "C|exists", True) == [0] and hits(spark, ["A", "", None], "C|exists", False) == [1, 2]
    assert hits(spark, ["A.b", "a"], "C|re|i", "a\\.B") == [0]
    df = spark.createDataFrame([(0, "x", "X"), (1, "x", "y"), (2, "", "")], "event_id long, a string, b string")
    rule = {"detection": {"s": {"a|fieldref": "b"}, "condition": "s"}}
    assert [r.event_id for r in df.filter(ru.rule_predicate(df, rule)).collect()] == [0]


RULES = [
    {"title": "one", "level": "high", "tags": ["attack.execution"], "logsource": {"category": "process_creation"}, "detection": {"s": {"Image|endswith": ".EXE"}, "condition": "s"}},
    {"title": "two", "logsource": {"product": "zeek"}, "detection": {"s": {"Image|contains": "a"}, "condition": "s"}},
    {"title": "three", "detection": {"s": {"EventID": [22, "7"]}, "f": {"Image": "c"}, "condition": "s and not f"}},
    {"title": "bad", "detection": {"s": {"Image|expand": "x"}, "condition": "s"}},
    {"title": "worse", "level": "loud", "detection": {"s": {"Image": "x"}, "condition": "s"}},
    {"title": "nothing", "detection": {"condition": "s ("}},
]


def test_one_scan_skips_reports_and_keeps_clashing_columns(spark, tmp_path):
    rows = [(1, "1", "a.exe", "mine", "x"), (2, "22", "b", None, "x"), (3, "22", "C", "l", "x"), (4, None, "a", "l", "zeek"), (5, "4688", "za.exe", "l", "Zeek")]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id long, EventID string, Image string, level string, source_format string").write.parquet(path)
    df = spark.read.parquet(path)
    found = ru.apply_rules(df, RULES, skip=True)
    assert {(r.event_id, r.title, r.level, r.event_level) for r in found.collect()} == {(1, "one", "high", "mine"), (2, "three", "medium", None), (4, "two", "medium", "l"), (5, "one", "high", "l"), (5, "two", "medium", "l")}
    assert {r.title for r in ru.rule_problems(df, RULES).collect()} == {"bad", "worse", "nothing"}
    with pytest.raises(ValueError):
        ru.apply_rules(df, RULES[:4])
    plan = ru.apply_rules(df, RULES, skip=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    some = ru.apply_rules(df, [RULES[0], RULES[2]])._jdf.queryExecution().executedPlan().toString()
    assert some.count("FileScan") == 1 and "In(EventID, [1,22,4688,7])" in some


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yml").write_text("title: a\ndetection:\n  s:\n    Image: x\n  condition: s\n")
    (tmp_path / "deep" / "b.yaml").write_text("title: b\nlevel: low\ndetection:\n  s:\n    - Image: y\n    - z\n  condition: s\n")
    (tmp_path / "no.yml").write_text("title: [")
    (tmp_path / "other.yml").write_text("just: text\n")
    assert sorted(r["title"] for r in ru.load_rules(spark, str(tmp_path))) == ["a", "b"]
    assert [r["title"] for r in ru.select_rules(ru.load_rules(spark, str(tmp_path)), "medium")] == ["a"]

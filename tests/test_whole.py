"""Operators over whole inputs against brute force."""

import base64
import math
import re
from collections import Counter

from emberlog.operators import analytics as an
from emberlog.operators import indicators as ind
from emberlog.plans import catalog

SF = "/root/testdata/sf0.001"


def bits(text):
    b = text.encode()
    return -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values())


def test_obfuscation_score_has_all_parts(spark):
    odd = "".join(map(chr, range(33, 127)))
    commands = ["", "dir", "p^o^w^x", "'a'+'b'", "p`o`w", "%A%%B%", "a" * 1001, "é" * 501, odd.replace("^", "").replace("%", "").replace("`", "")]
    rows = spark.createDataFrame([(c,) for c in commands], "CommandLine string")
    got = {r.CommandLine: r.obfuscation_score for r in ind.obfuscation_score(rows).collect()}
    assert [got[c] for c in commands] == [0, 0, 3, 3, 2, 2, 1, 1, 2]


def test_decoding_of_any_command(spark):
    wide = lambda t: base64.b64encode(t.encode("utf-16-le")).decode()
    plain = base64.b64encode("héllo, wörld".encode()).decode()
    bad = base64.b64encode(b"\x00\xd8a\x00ab").decode()  # a single surrogate
    want = {"": None, "x -enc " + wide("echo"): "echo", "y " + plain: "héllo, wörld", "z " + wide("привет"): "привет", "w " + bad: None, bad + " " + plain: "héllo, wörld", "v " + wide("a😀b"): "a😀b"}
    rows = spark.createDataFrame([(c,) for c in want], "CommandLine string")
    assert {r.CommandLine: r.decoded_CommandLine for r in ind.decode_utf16_base64(rows).collect()} == want


def test_high_entropy_over_all_commands(spark):
    logs = catalog.log_events(spark, SF).select("event_id", "CommandLine").collect()
    want = {r.event_id for r in logs if len(r.CommandLine) > 20 and bits(r.CommandLine) > 3.5}
    assert {r.event_id for r in catalog.queries()["high_entropy_command"](spark, SF).collect()} == want
    assert any(re.search("-enc", r.CommandLine) for r in logs if r.event_id in want)


def test_report_holds_long_commands_of_high_entropy(spark):
    odd = "".join(map(chr, range(33, 127))) * 3
    rows = spark.createDataFrame([(odd,), (odd,), ("a" * 300,)], "CommandLine string")
    got = {r.category: (r.severity, r.n, r.score) for r in an.anomaly_report(rows).collect()}
    assert got == {"high_entropy_command": ("medium", 2, 2.0)}


def test_tools_and_indicators_of_each_event(spark):
    rows = spark.createDataFrame([("C:\\x\\CertUtil.exe", "8.8.8.8 10.0.0.1 8.8.8.8 http://a.evil.com/x b.org"), ("x.exe", "192.168.0.1"), (None, None)], "Image string, _raw string")
    a, b, c = ind.inline_iocs(ind.lolbin(rows)).collect()
    assert (a.is_lolbin, a.lolbin_name, a.ioc_ips, a.ioc_urls, a.ioc_domains) == (True, "certutil", "8.8.8.8", "http://a.evil.com/x", "evil.com, b.org")
    assert tuple(b)[2:] == tuple(c)[2:] == (None,) * 5

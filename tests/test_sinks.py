import json

import pytest

from emberlog.operators import attack
from emberlog.operators.hunts import hunt
from emberlog.sources import sinks


@pytest.fixture(scope="module")
def hits(spark):
    rows = [("1", "", "2024-01-01T00:00:00", "R", "high", ["attack.execution", "attack.t1059.001"]), ("3", "x", None, "R", "high", ["attack.execution", "attack.t1059.001"])]
    return spark.createDataFrame(rows, "EventID string, Image string, SystemTime string, title string, level string, tags array<string>")


def values(df):
    return [json.loads(r.value) for r in df.collect()]


def test_records(hits):
    assert values(sinks.jsonl(hits.select("EventID", "Image"))) == [{"EventID": "1"}, {"EventID": "3", "Image": "x"}]
    assert [v.get("_time") for v in values(sinks.splunk(hits))] == ["2024-01-01T00:00:00", None]
    assert values(sinks.elk(hits))[0]["rule.name"] == "R"
    assert values(sinks.timesketch(hits))[1]["message"] == "EventID=3 Image=x"


def test_logs_of_rules(hits, tmp_path):
    found = attack.tagged(hits)
    (log,) = values(sinks.sarif(found))
    assert log["runs"][0]["results"] == [{"ruleId": "R", "level": "error", "message": {"text": "R: 2 events"}}]
    (layer,) = values(attack.navigator_layer(found))
    assert layer["techniques"] == [{"techniqueID": "T1059.001", "score": 2, "color": "#ff6666"}]
    sinks.write(sinks.detections_table(found), str(tmp_path / "d"))
    sinks.save_events(hits, str(tmp_path / "e"))
    assert hits.sparkSession.read.parquet(str(tmp_path / "e")).count() == 2


def test_missing_fields_have_no_findings(spark):
    df = spark.createDataFrame([(None, ""), ("", None)], "CommandLine string, QueryName string")
    assert [r.hunt_findings for r in hunt(df, ("recon_command", "dns_subdomain", "masquerade", "sensitive_file")).collect()] == [[], []]

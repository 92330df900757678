"""Headers that change, files that split, and lines that hold no event."""

import random

import pytest

from emberlog.sources import readers as rd


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "10b"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return ordered(r.fields for r in df.collect())


def ordered(maps):
    return sorted((dict(sorted(m.items())) for m in maps), key=repr)


def test_every_csv_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "b.csv").write_text("\ufeffb,c,a\r\n20,30,10\r\n,,7,8\r\n")
    (tmp_path / "c.csv").write_text('x,"a b"\n"p,q","say ""hi"""\n\n"open,1\n')
    (tmp_path / "d.csv").write_text("only\n")
    got = rows(rd.read_csv(spark, str(tmp_path)))
    want = [{"a": "1", "b": "2", "c": "3"}, {"a": "10", "b": "20", "c": "30"}, {"a": "7", "field_3": "8"}, {"x": "p,q", "a b": 'say "hi"'}, {"x": '"open', "a b": "1"}]
    assert got == ordered(want)
    assert "p,q,say \"hi\"" in [r.raw for r in rd.read_csv(spark, str(tmp_path), include="c.c").collect()]
    wide = "h\n" + "," * 5000 + "z\n"
    (tmp_path / "e.tsv").write_text("a\tb\n1\t2\t3\n")
    (tmp_path / "w.csv").write_text(wide)
    assert rows(rd.read_csv(spark, str(tmp_path), sep="\t", include=".tsv")) == [{"a": "1", "b": "2", "field_2": "3"}]
    assert rows(rd.read_csv(spark, str(tmp_path), include="w.csv")) == [{"field_5000": "z"}]


def test_csv_files_that_split(spark, tmp_path, small_splits):
    want = []
    for f in range(3):
        names = random.Random(f).sample(["a", "b", "c", "d"], 4)
        lines = [",".join(names)]
        for i in range(80):
            values = {n: f"{n}{f}-{i}" for n in names}
            lines.append(",".join(values[n] for n in names))
            want.append(values)
        (tmp_path / f"{f}.csv").write_text("\n".join(lines) + "\n")
    df = rd.read_csv(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 3
    assert rows(df) == ordered(want)


@pytest.mark.parametrize("every", [1, 7, 1000])
def test_w3c_and_zeek_files_that_split(spark, tmp_path, small_splits, every):
    rng = random.Random(every)
    w3c, zeek, want_w3c, want_zeek = ["before any header"], [], [], []
    for i in range(150):
        if i % every == 0:
            names = rng.sample(["x", "y", "z"], 3)
            w3c += ["#Software: s", "#Fields: " + " ".join(names)]
            zeek += ["#separator " + "\\x09", f"#path\tp{i}", "#unset_field\t" + rng.choice("-~"), "#fields\t" + "\t".join(names)]
            kind, unset = f"p{i}", zeek[-2][-1]
        values = {n: f"{n}{i}" for n in names}
        w3c.append(" ".join(values[n] for n in names))
        zeek.append("\t".join(values[n] if n != "y" else "-" for n in names))
        want_w3c.append(values)
        want_zeek.append({k: v for k, v in values.items() if k != "y"} | ({} if unset == "-" else {"y": "-"}) | {"_zeek_log_type": kind})
    (tmp_path / "w").mkdir()
    (tmp_path / "z").mkdir()
    (tmp_path / "w" / "a.log").write_text("\n".join(w3c))
    (tmp_path / "z" / "a.log").write_text("\n".join(zeek))
    assert rows(rd.read_w3c(spark, str(tmp_path / "w"))) == ordered(want_w3c)
    assert rows(rd.read_zeek(spark, str(tmp_path / "z"))) == ordered(want_zeek)


def test_lines_are_not_joined_with_their_headers(spark, tmp_path):
    (tmp_path / "a.log").write_text("#Fields: a b\n" + "1 2\n" * 50)
    plan = rd.read_w3c(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_lines_without_events_are_counted_while_they_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{broken\n[1]\n\n{"b": 2}\n')
    (tmp_path / "b.cef").write_text("CEF:0|v|p|1|100|name|5|src=1\nnot cef\n")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n,\n")
    ingest = rd.Ingest()
    both = rd.read_jsonl(spark, str(tmp_path), include=".json", ingest=ingest).unionByName(rd.read_cef(spark, str(tmp_path), include=".cef", ingest=ingest)).unionByName(rd.read_csv(spark, str(tmp_path), include=".csv", ingest=ingest))
    with ingest:
        both.write.format("noop").mode("overwrite").save()
    found = {r.source_format: (r.lines, r.events, r.malformed) for r in ingest.report(spark).collect()}
    assert found == {"json": (4, 2, 2), "cef": (2, 1, 1), "csv": (2, 1, 1)}
    assert ingest.report(spark).first().seconds > 0

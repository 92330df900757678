"""Look-alike names, odd DNS names and pattern tables against plain forms."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from emberlog.functions.tables import spread
from emberlog.operators import hunts as hu


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain_lookalike(name):
    if not name or name in {x.lower() for x in hu.SYSTEM_PROCESSES + hu.LOOKALIKES_ALLOWED}:
        return None
    for target in hu.SYSTEM_PROCESSES:
        low = target.lower()
        distance = levenshtein(name, low)
        if 0 < distance <= (1 if len(low) <= 7 else 2):
            return f"{name} is Levenshtein distance {distance} from {target}"
        if name.replace("0", "o").replace("1", "l").replace("rn", "m").replace("vv", "w") == low:
            return f"{name} is homoglyph of {target}"
    return None


def names():
    rng = random.Random(4)
    out = ["", "svch0st.exe", "dvvm.exe", "lsas.exe", "smss.exe", "x", "SVCHOST.EXE.exe"]
    for _ in range(1500):
        w = list(rng.choice(hu.SYSTEM_PROCESSES + hu.LOOKALIKES_ALLOWED).lower())
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "o", "0", "é"])
        out.append("".join(w))
    return out


def test_deletions_find_what_distances_find(spark):
    some = names()
    assert [hu.lookalike(n) for n in some] == [plain_lookalike(n) for n in some]
    assert sum(plain_lookalike(n) is not None for n in some) > 400
    rows = [(i, None if i % 50 == 49 else f"C:\\x\\{n.upper()}") for i, n in enumerate(some[:300])]
    df = spark.createDataFrame(rows, "i int, Image string")
    got = {r.i: r.f.description for r in hu.hunt(df, ("typosquat",)).select("i", F.explode("hunt_findings").alias("f")).collect()}
    assert got == {i: p for i, v in rows if v and (p := plain_lookalike(v.rsplit("\\", 1)[1].lower()))}
    known = spark.createDataFrame([(n, t.lower()) for n in some[:200] for t in hu.SYSTEM_PROCESSES], "n string, t string")
    assert all(r.d == levenshtein(r.n, r.t) for r in known.select("n", "t", F.levenshtein("n", "t").alias("d")).collect())


def test_dns_names():
    def plain(name):
        if len(name) <= 5:
            return []
        labels = name.rstrip(".").split(".")
        entropy = lambda x: -sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values())
        odd = set()
        for x in labels[:-2]:
            odd |= {k for k, t in {"LONG_SUBDOMAIN": len(x) > 30, "HEX_SUBDOMAIN": bool(re.match("(?i)^[0-9a-f]{16,}$", x)), "BASE64_SUBDOMAIN": bool(re.match("^[A-Za-z0-9+/=]{20,}$", x)), "NUMERIC_SUBDOMAIN": len(x) >= 8 and sum(c in "0123456789" for c in x) * 2 > len(x), "HIGH_ENTROPY_LABEL": len(x) >= 8 and entropy(x.encode()) > 3.5}.items() if t}
        return sorted(odd | ({"VERY_LONG_QUERY"} if len(name) > 100 else set()) | ({"DEEP_NESTING"} if len(labels) > 4 else set()))

    rng = random.Random(7)
    for _ in range(600):
        name = ".".join("".join(rng.choice(rng.choice(["0123456789", "abcdef0", "abcdefghijklmnopqrstuvwxyzé+="])) for _ in range(rng.choice([1, 3, 9, 17, 33, 60]))) for _ in range(rng.randint(1, 6))) + rng.choice(["", "."])
        assert hu.dns_anomalies(name) == plain(name)


def test_tables_are_searched_as_one_by_one(spark):
    rng = random.Random(9)
    texts = [row[0] for table in hu._TABLES.values() for row in table]
    rows = [(i, *[rng.choice([None, "", " ".join(rng.choice(["x", t.upper(), t]) for t in rng.sample(texts, 3))]) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in hu._SEARCHED))
    got = {(r.i, r.f.transform, r.f.severity, r.f.description) for r in hu.hunt(df, ("lateral_command", "sensitive_file", "recon_command", "shellcode")).select("i", F.explode("hunt_findings").alias("f")).collect()}
    want = set()
    for i, command, script, target, other, _, _ in rows:
        low = (command or "").lower()
        if len(low) > 5 and (label := next((x for p, x in hu.LATERAL if p in low), None)):
            want.add((i, "LateralMovement", "high", f"Lateral movement: {label}"))
        for text in (target, other, command):
            if row := next((r for r in hu.SENSITIVE_FILES if r[0] in (text or "").lower()), None):
                want.add((i, "SensitiveFileAccess", row[2], f"Access to sensitive file: {row[1]}"))
                break
        if len(low) > 3 and (found := [p for p in hu.RECON if p in low]):
            want.add((i, "ReconIndicator", "medium" if len(found) >= 3 else "low", f"Reconnaissance: {', '.join(found)}"))
        for text in (command, script):
            held = [p for p in hu.SHELLCODE if p in (text or "").lower()] if len(text or "") > 20 else []
            if len(held) >= 2:
                want.add((i, "ShellcodeIndicator", "critical", f"Shellcode indicators ({len(held)}): {', '.join(held[:3])}"))
                break
    assert got == want and len(want) > 100


def test_searches_by_their_first_field(spark):
    rows = [
        (0, "x\\CurrentVersion\\Run\\a", "\\appinit_dlls", "C:\\Downloads\\Temp\\a", "rar a", None),
        (1, "plain", "\\appinit_dlls", "/tmp/\n", "RAR A", "a" * 10 + "GetType(  Invoke("),
        (2, "", "\\AppInit_DLLs", "", "SC CREATE x", "gettype(x invoke("),
        (3, None, None, None, "iex(", "downloadfile"),
        (4, None, None, None, "iex((", "downloadfile"),
        (5, "\\GlobalFlag", None, None, "iex(\U0001f600", "gettype(" * 3),
    ]
    df = spark.createDataFrame(rows, "i int, TargetObject string, ObjectName string, Image string, CommandLine string, ScriptBlockText string")
    names = ("registry_path", "path_anomaly", "data_staging", "persistence_command", "download_cradle", "ps_reflection")
    got = {(r.i, *r.f) for r in hu.findings(hu.hunt(df, names), "i").collect()}
    assert got == {
        (0, "SuspiciousRegistryPath", "medium", "Suspicious registry path: RUN_KEY"),
        (0, "ProcessPathAnomaly", "medium", "Executable in suspicious directory: DOWNLOADS"),
        (1, "ProcessPathAnomaly", "medium", "Executable in suspicious directory: LINUX_TMP"),
        (1, "PowerShellReflection", "high", ".NET reflection abuse: gettype(, invoke("),
        (2, "SuspiciousRegistryPath", "high", "Suspicious registry path: APPINIT_DLLS"),
        (2, "PersistenceClassifier", "medium", "Persistence mechanism: service_creation"),
        (3, "DownloadCradle", "high", "Download cradle: Net.WebClient.DownloadFile"),
        (4, "DownloadCradle", "high", "Download cradle: Net.WebClient.DownloadFile"),
        (5, "SuspiciousRegistryPath", "high", "Suspicious registry path: GLOBAL_FLAG"),
    }


def test_each_event_is_hunted_once(spark):
    df = spark.createDataFrame([("C:\\Temp\\svchost.exe",)], "Image string")
    summary = hu.hunt_summary(hu.hunt(df))
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("ProcessMasquerade, severity") == 1
    assert {(r.transform, r.n) for r in summary.collect()} == {("ProcessMasquerade", 1), ("ProcessPathAnomaly", 1)}


def test_tasks_grow_with_the_files(spark, tmp_path):
    spark.range(40_000).repartition(2).write.parquet(f"file://{tmp_path}/t")
    table = spark.read.parquet(f"file://{tmp_path}/t")
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert spread(table, size // 9).rdd.getNumPartitions() >= 9 and spread(table, size).rdd.getNumPartitions() == spread(table).rdd.getNumPartitions()
    assert spread(table, size // 9).count() == 40_000

"""Whole-dataset analytics: anomalies, logins, timelines, chains, scores, verdicts, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.columns import entropy, event_time, field, first_of, present
from emberlog.operators.rules import LEVELS, level_rank

WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0, "informational": 0.5}


def _hour(df: DataFrame) -> Column:
    return F.hour(event_time(df))


def rare_process(df: DataFrame, most: int = 2) -> DataFrame:
    named = df.select(field(df, "Image").alias("Image")).filter(present(F.col("Image")))
    return named.groupBy("Image").agg(F.count("*").alias("n")).filter(F.col("n") <= most)


def rare_parent_child(df: DataFrame) -> DataFrame:
    pairs = df.select(field(df, "ParentImage").alias("ParentImage"), field(df, "Image").alias("Image"))
    return pairs.filter(present(F.col("ParentImage")) & present(F.col("Image"))).groupBy("ParentImage", "Image").agg(F.count("*").alias("n")).filter("n = 1")


def off_hours_logon(df: DataFrame) -> DataFrame:
    return df.filter((field(df, "EventID") == "4624") & ~_hour(df).between(8, 18))


def brute_force(df: DataFrame, user: str = "TargetUserName", ip: str = "IpAddress", least: int = 5) -> DataFrame:
    failed = df.filter(field(df, "EventID") == "4625").select(field(df, user).alias("user"), field(df, ip).alias("ip"))
    return failed.groupBy("user", "ip").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("score", F.least(F.col("n") * 2, F.lit(10)).cast("double"))


def high_entropy_command(df: DataFrame, length: int = 200, least: float = 4.5) -> DataFrame:
    command = field(df, "CommandLine")
    return df.filter(F.length(command) > length).withColumn("_entropy", entropy(field(df, "CommandLine"))).filter(F.col("_entropy") > least)


#: Kind of anomaly -> severity, points a finding, highest score.
ANOMALIES = {"rare_process": ("medium", 1.0), "off_hours_logon": ("low", 0.5), "rare_parent_child": ("medium", 0.5), "brute_force": ("high", 2.0), "high_entropy_command": ("medium", 1.0)}
HIGHEST, SALTS = 10.0, 64


def anomaly_report(df: DataFrame, user: str = "TargetUserName", ip: str = "IpAddress", evidence: int = 5) -> DataFrame:
    """category, severity, count, score and evidence (the first `evidence` findings in order, as text) of the anomaly kinds that occur.

    One scan: each event adds to the groups of all kinds at once, and the findings of a kind
    come together as counts and as the first few of each of SALTS parts.
    """
    image, parent, number, command = (field(df, n) for n in ("Image", "ParentImage", "EventID", "CommandLine"))
    group = lambda kind, a, b=F.lit(""): F.struct(F.lit(kind).alias("category"), a.alias("a"), b.alias("b"))
    tests = [
        F.when(present(image), group("rare_process", image)),
        F.when(present(parent) & present(image), group("rare_parent_child", parent, image)),
        F.when((number == "4624") & ~_hour(df).between(8, 18), group("off_hours_logon", F.concat_ws(" ", field(df, "SystemTime"), field(df, user)))),
        F.when(number == "4625", group("brute_force", field(df, user), field(df, ip))),
        F.when((F.length(command) > 200) & F.when(F.length(command) > 200, entropy(command) > 4.5), group("high_entropy_command", F.left(command, F.lit(200)))),
    ]
    counted = df.select(F.explode(F.array_compact(F.array(*tests))).alias("g")).groupBy("g.category", "g.a", "g.b").agg(F.count("*").alias("n"))
    kind, n = F.col("category"), F.col("n")
    each = kind.isin("off_hours_logon", "high_entropy_command")  # every event is a finding
    found = counted.filter(each | ((kind == "rare_process") & (n <= 2)) | ((kind == "rare_parent_child") & (n == 1)) | ((kind == "brute_force") & (n >= 5)))
    named = F.concat(F.concat_ws(" > ", "a", F.when(kind != "rare_process", F.col("b"))), F.lit(" ("), n.cast("string"), F.lit(")"))
    found = found.select("category", F.when(each, F.col("a")).otherwise(named).alias("text"), F.when(each, n).otherwise(1).alias("times")).withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    part = Window.partitionBy("category", "salt")
    first = found.withColumn("place", F.row_number().over(part.orderBy("text"))).withColumn("all", F.sum("times").over(part)).filter(F.col("place") <= evidence)
    repeated = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("text", "times"))), lambda x: F.array_repeat(x["text"], F.least(x["times"], F.lit(evidence)).cast("int"))))
    rows = first.groupBy("category").agg(F.sum(F.when(F.col("place") == 1, F.col("all"))).alias("n"), F.slice(repeated, 1, evidence).alias("evidence"))
    lookup = lambda i: F.create_map(*[F.lit(x) for k, v in ANOMALIES.items() for x in (k, v[i])])[kind]
    return rows.select("category", lookup(0).alias("severity"), "n", F.least(n * lookup(1), F.lit(HIGHEST)).alias("score"), "evidence")


def _person(column: Column) -> Column:
    return present(column) & (column != "-") & ~F.endswith(column, F.lit("$"))


def _logins(df: DataFrame, name: str, keep) -> DataFrame:
    rows = df.select(field(df, name).alias(name), field(df, "EventID").alias("e")).filter(F.col("e").isin("4624", "4625") & keep(F.col(name)))
    counted = rows.groupBy(name).agg(F.count_if(F.col("e") == "4624").alias("success"), F.count_if(F.col("e") == "4625").alias("failure"))
    return counted.withColumn("failure_pct", F.round(100 * F.col("failure") / (F.col("success") + F.col("failure")), 2))


def logins_by_user(df: DataFrame, user: str = "TargetUserName") -> DataFrame:
    return _logins(df, user, _person)


def logins_by_ip(df: DataFrame, ip: str = "IpAddress") -> DataFrame:
    return _logins(df, ip, lambda c: present(c) & (c != "-"))


def login_brute_force(df: DataFrame, user: str = "TargetUserName", ip: str = "IpAddress", least: int = 5) -> DataFrame:
    """Failed logons of people by (user, address) with `least` or more; by user alone where events have no address field."""
    address = F.coalesce(F.nullif(field(df, ip), F.lit("")), F.lit("N/A"))
    failed = df.filter((field(df, "EventID") == "4625") & _person(field(df, user))).select(field(df, user).alias("user"), address.alias("ip"))
    return failed.groupBy("user", "ip").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "user", "ip")


def unusual_hours(df: DataFrame) -> DataFrame:
    return df.filter((field(df, "EventID") == "4624") & ((_hour(df) < 6) | (_hour(df) >= 20)))


def lateral_logons(df: DataFrame, user: str = "TargetUserName", ip: str = "IpAddress") -> DataFrame:
    rows = df.filter((field(df, "EventID") == "4624") & field(df, "LogonType").isin("3", "10") & ~field(df, ip).isin("", "-", "127.0.0.1", "::1"))
    return rows.select(field(df, user).alias("user"), field(df, ip).alias("ip"), field(df, "LogonType").alias("logon_type")).distinct()


def privilege_use(df: DataFrame, user: str = "SubjectUserName") -> DataFrame:
    return df.filter((field(df, "EventID") == "4672") & _person(field(df, user))).groupBy(field(df, user).alias("user")).agg(F.count("*").alias("n"))


def timeline(hits: DataFrame) -> DataFrame:
    """First time, hits and technique ids of each rule."""
    timed = hits.withColumn("t", first_of(hits, ("SystemTime", "UtcTime", "timestamp", "@timestamp")))
    techniques = F.array_sort(F.transform(F.filter(F.first("tags"), lambda x: x.rlike(r"^attack\.t[0-9]{4}(\.[0-9]{3})?$")), lambda x: F.upper(F.substring(x, 8, 20))))
    return timed.groupBy("title", "level").agg(F.min("t").alias("first_seen"), F.count("*").alias("n"), techniques.alias("techniques")).orderBy(F.col("first_seen").asc_nulls_first(), "title")


ENTITIES = ("User", "Computer", "hostname", "LogonId", "ProcessId")
KEY_FIELDS = ("Image", "CommandLine", "EventID", "SourceIp", "DestinationIp")


def _entities(hits: DataFrame, entities) -> DataFrame:
    return hits.withColumn("entity", first_of(hits, entities)).withColumn("t", event_time(hits)).filter("entity is not null")


def attack_chains(hits: DataFrame, entities=ENTITIES, least: int = 2) -> DataFrame:
    """Entities with hits of two rules or more: hits, rules, tactics, seconds between first and last; longest chains first.

    Aggregates only, whatever the number of hits; ``chain_events`` lists the hits in order.
    """
    rows = _entities(hits, entities)
    tactics = F.transform(F.filter(F.coalesce("tags", F.array()), lambda x: F.lower(x).rlike(r"^attack\.[a-z]+([_-][a-z]+)*$")), lambda x: F.replace(F.substring(F.lower(x), 8, 40), F.lit("_"), F.lit("-")))
    chains = rows.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("title").alias("n_rules"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.array_sort(F.collect_set("title")).alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(tactics)))).alias("tactics"))
    kept = chains.filter((F.col("n") >= least) & (F.col("n_rules") >= 2)).withColumn("duration_sec", (F.unix_timestamp("t1") - F.unix_timestamp("t0")).cast("double"))
    return kept.drop("t0", "t1").orderBy(F.col("n").desc(), "entity")


def chain_events(hits: DataFrame, entities=ENTITIES, least: int = 2) -> DataFrame:
    """The hits of every chain, numbered by time: entity, place, time, title, level and the key fields that are not empty.

    One row a hit, ranked by a window, so that no chain is gathered into one value.
    """
    rows = _entities(hits, entities)
    keys = [F.struct(F.lit(k).alias("key"), F.nullif(field(hits, k), F.lit("")).alias("value")) for k in KEY_FIELDS]
    known = F.map_from_entries(F.filter(F.array(*keys), lambda e: e["value"].isNotNull()))
    chains = attack_chains(hits, entities, least).select(F.col("entity").alias("e"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("t").asc_nulls_first(), "title", F.to_json("key_fields")))
    named = rows.select("entity", "t", "title", "level", known.alias("key_fields"))
    return named.join(chains, F.col("entity") == F.col("e")).drop("e").withColumn("place", place)


def threat_scores(hits: DataFrame, hosts=("Computer", "hostname"), users=("User",), ips=("SourceIp", "src_ip")) -> DataFrame:
    """Score per (entity, kind): sum of severity weights, at most 100, each hit once; with the rules that add to it, highest first."""
    fields = [F.struct(field(hits, n).alias("entity"), F.lit(k).alias("kind")) for k, names in (("host", hosts), ("user", users), ("ip", ips)) for n in names]
    weight = F.coalesce(*[F.when(F.col("level") == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(0.5))
    rows = hits.withColumn("w", weight).withColumn("e", F.explode(F.array_distinct(F.array(*fields)))).filter("e.entity not in ('', '-')")
    scored = rows.groupBy("e.entity", "e.kind").agg(F.sum("w").alias("s"), F.array_sort(F.collect_set("title")).alias("rules"), F.count("*").alias("n"))
    return scored.select("entity", "kind", F.least("s", F.lit(100.0)).alias("score"), "n", F.size("rules").alias("n_rules"), "rules").orderBy(F.col("score").desc(), "entity", "kind")


def severity_stats(found: DataFrame) -> DataFrame:
    """Rules per level and total hits, one row."""
    return found.agg(*[F.count_if(F.col("level") == x).alias(x) for x in LEVELS], F.coalesce(F.sum("n"), F.lit(0)).alias("total_hits"))


def verdict(found: DataFrame, n_tactics: int = 0) -> DataFrame:
    """One row: the verdict and the risk score of a set of detections."""
    s = severity_stats(found)
    c, h, m, low = (F.col(x) for x in ("critical", "high", "medium", "low"))
    word = F.when((c >= 3) | ((c >= 1) & (h >= 5)), "breach").when((c >= 1) | (h >= 3) | F.lit(n_tactics >= 3), "likely").when((h > 0) | (m > 2), "suspicious").otherwise("clean")
    return s.withColumn("verdict", word).withColumn("risk", F.least(F.greatest(10 * c + 5 * h + 2 * m + low, F.lit(0)), F.lit(100)))


def key_findings(found: DataFrame, n: int = 5) -> DataFrame:
    """The n most severe detections, with the names of the tactics in their tags where `found` has tags."""
    best = found.orderBy(level_rank(F.col("level")).desc(), F.col("n").desc(), "title").limit(n)
    if "tags" not in found.columns:
        return best
    slugs = F.filter(F.coalesce("tags", F.array()), lambda x: F.lower(x).rlike(r"^attack\.[a-z]+([_-][a-z]+)*$"))
    named = F.transform(slugs, lambda x: F.replace(F.initcap(F.translate(F.substring(F.lower(x), 8, 40), "_-", "  ")), F.lit(" And "), F.lit(" and ")))
    return best.withColumn("tactics", F.array_sort(F.array_distinct(named))).drop("tags")


def evidence_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rule titles of two sets of hits, resolved, new or in both, with their hits before and after."""
    a = before.groupBy(F.col("title").alias("ta")).agg(F.count("*").alias("n_before"))
    b = after.groupBy(F.col("title").alias("tb")).agg(F.count("*").alias("n_after"))
    state = F.when(F.col("tb").isNull(), "resolved").when(F.col("ta").isNull(), "new").otherwise("both")
    return a.join(b, F.col("ta") == F.col("tb"), "full").select(F.coalesce("ta", "tb").alias("title"), state.alias("state"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))

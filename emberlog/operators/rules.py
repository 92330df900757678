"""Detection rules: predicates of single rules, rule sets over events in one scan, and what hits add up to.

`rule_predicate` is one rule as a Column.  `apply_rules` is a set of any size: its texts become
one multi-pattern automaton for each field (rule_set.py).  Rules are taken apart in
rule_parts.py, and log_sources.py tells which events a rule is about.  Missing fields count as ''.
"""

from __future__ import annotations

import ipaddress
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.columns import all_of, any_of, column, field
from emberlog.operators import rule_parts as rp
from emberlog.operators import rule_set
from emberlog.operators.log_sources import format_column, route, routed

LEVELS = ("informational", "low", "medium", "high", "critical")
#: Columns of a hit that name its rule; columns of the events with these names become event_<name>.
RULE_COLUMNS = ("rule", "title", "level", "tags")

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_GROUPS = "(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"


def cidr(text: Column, network: str) -> Column:
    """Whether an address lies in a network; text that is no address of its version does not."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 6:
        # 32 hex digits, whose order is that of the addresses
        low = F.lower(text)
        halves = F.split(low, "::", -1)
        side = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":", -1), lambda g: g != "")
        missing = F.lit(8) - F.size(side(0)) - F.size(side(1))
        shape = low.rlike(f"^{_GROUPS}(?:::{_GROUPS})?\\z") & F.when(F.contains(low, F.lit("::")), missing >= 1).otherwise(missing == 0)
        digits = F.array_join(F.transform(F.concat(side(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), side(1)), lambda g: F.lpad(g, 4, "0")), "")
        return F.when(shape, digits.between(*(f"{int(a):032x}" for a in (net.network_address, net.broadcast_address)))).otherwise(False)
    first = int(net.network_address)
    number = F.aggregate(F.transform(F.split(text, "[.]"), lambda o: o.cast("bigint")), F.lit(0).cast("bigint"), lambda a, o: a * 256 + o)
    return F.when(text.rlike(f"^{_OCTET}([.]{_OCTET}){{3}}\\z"), number.between(first, first + net.num_addresses - 1)).otherwise(False)


def _java(pattern: str) -> str:
    """The pattern, if the engine that will run it takes it."""
    SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    return pattern


_MATCH = {"": lambda a, b: a == b, "contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}
_ORDER = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def node_column(df: DataFrame, node: tuple) -> Column:
    """A node of rule_parts as a Column."""
    kind = node[0]
    if kind == "const":
        return F.lit(node[1])
    if kind == "not":
        return ~node_column(df, node[1])
    if kind == "least":
        return reduce(lambda a, b: a + b, [F.when(node_column(df, x), 1).otherwise(0) for x in node[2]]) >= node[1]
    if kind == "and":
        return all_of([node_column(df, x) for x in node[1]])
    if kind == "or":
        equal: dict[str, list[str]] = {}
        for x in node[1]:
            if x[0] == "text" and x[2] == "" and not x[4]:
                equal.setdefault(x[1], []).append(x[3])
        lists = [F.lower(field(df, name)).isin(texts) for name, texts in equal.items()]
        return any_of(lists + [node_column(df, x) for x in node[1] if not (x[0] == "text" and x[2] == "" and not x[4])])
    text = field(df, node[1])
    if kind == "text":
        return _MATCH[node[2]](text if node[4] else F.lower(text), F.lit(node[3]))
    if kind == "like":
        return (text if node[5] else F.lower(text)).rlike("(?s)" + ("^" if node[2] in ("", "startswith") else "") + node[3] + ("\\z" if node[2] in ("", "endswith") else ""))
    if kind == "re":
        return text.rlike(_java(node[2]))
    if kind == "cidr":
        return cidr(text, node[2])
    if kind == "number":
        return F.coalesce(_ORDER[node[2]](text.try_cast("double"), F.lit(node[3])), F.lit(False))
    if kind == "empty":
        return text == ""
    a, b = F.lower(text), F.lower(field(df, node[2]))
    return (b != "") & _MATCH[node[3]](a, b)


def rule_predicate(df: DataFrame, rule: dict) -> Column:
    """Whether an event is of the rule's log source and its condition holds; a rule none of whose fields is a column never does."""
    node = rp.rule_node(rule)
    return F.lit(False) if _silent(df, rule, node) else routed(df, rule.get("logsource")) & node_column(df, node)


def rule_events(rule: dict) -> frozenset | None:
    """The event ids outside of which the rule cannot hit, None if there are none."""
    return rp.meet(rp.asked(rule, "eventid"), route(rule.get("logsource")).event_ids)


def prefilter_events(df: DataFrame, rules: list[dict]) -> DataFrame:
    """The events that any rule can hit by its event id or, where it asks for none, by its channel; all where a rule names neither.

    Event ids are a bare column test, so that sources filter by it.
    """
    known = {c.lower(): c for c in df.columns}
    ids, channels = [], []
    for rule in rules:
        events = rule_events(rule) if "eventid" in known else None
        names = rp.asked(rule, "channel") if events is None and "channel" in known else None
        if events is None and names is None:
            return df
        ids, channels = ids + sorted(events or ()), channels + sorted(names or ())
    if not rules:
        return df
    tests = []
    if ids:
        number = column(known["eventid"])
        plain = number if dict(df.dtypes)[known["eventid"]] == "string" else number.cast("string")
        tests.append(plain.isin(sorted(set(ids))))
    if channels:
        tests.append(F.lower(field(df, "channel")).isin(sorted(set(channels))))
    return df.filter(any_of(tests))


def select_rules(rules: list[dict], min_level: str = "informational", exclude=()) -> list[dict]:
    rank = LEVELS.index(min_level)
    return [r for r in rules if LEVELS.index(r.get("level", "medium")) >= rank and not any(p.lower() in r["title"].lower() for p in exclude)]


def _taken_apart(rule: dict) -> tuple[tuple | None, str | None]:
    """The rule's node, or why it cannot be evaluated."""
    try:
        if not isinstance(rule.get("title"), str) or rule.get("level", "medium") not in LEVELS:
            return None, "no title or no known level"
        rule_events(rule)
        node = rp.rule_node(rule)
        rule_set.check(node)
    except Exception as e:  # noqa: BLE001 - rules come from outside, and whatever is wrong with one is reported
        return None, f"{type(e).__name__}: {e}"
    return node, None


def _silent(df: DataFrame, rule: dict, node: tuple) -> str | None:
    """Why a rule has nothing to say about these events, or None."""
    if route(rule.get("logsource")).formats is not None and format_column(df) is None:
        return "its log source is told by the format, and the events name none: no hits"
    names = rp.fields_of(node)
    if names and not names & {c.lower() for c in df.columns}:
        return "none of its fields is a column of the events: no hits"
    return None


def rule_problems(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule number, title, problem) of the rules that apply_rules(..., skip=True) leaves out, and of those that cannot hit these events."""
    found = []
    for i, rule in enumerate(rules):
        node, problem = _taken_apart(rule)
        if problem := problem or _silent(df, rule, node):
            found.append((i, str(rule.get("title")), problem))
    return df.sparkSession.createDataFrame(found, "rule int, title string, problem string")


def apply_rules(df: DataFrame, rules: list[dict], skip: bool = False) -> DataFrame:
    """(rule number, title, level, tags and the event's columns) of every hit, in one scan of the events.

    With `skip`, rules that cannot be evaluated are left out (see rule_problems); else they raise.
    """
    nodes = {i: _taken_apart(r)[0] if skip else rp.rule_node(r) for i, r in enumerate(rules)}
    usable = [i for i, node in nodes.items() if node is not None and not _silent(df, rules[i], node)]
    taken = {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower() in RULE_COLUMNS:
            free = f"event_{c}"
            while free.lower() in taken:
                free += "_"
            df, taken = df.withColumnRenamed(c, free), taken | {free.lower()}
    columns = df.columns
    chosen = [rules[i] for i in usable]
    kept = prefilter_events(df, chosen)
    numbers = rule_set.matches(kept, [(i, nodes[i], route(r.get("logsource"))) for i, r in zip(usable, chosen, strict=True)])
    found = kept.withColumn("rule", F.explode(numbers)).select(*map(column, columns), "rule")
    info = [(i, r["title"], r.get("level", "medium"), [str(t) for t in r.get("tags") or []]) for i, r in zip(usable, chosen, strict=True)]
    table = df.sparkSession.createDataFrame(info, "rule int, title string, level string, tags array<string>")
    return found.join(F.broadcast(table), "rule")  # one row per rule


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def detections(hits: DataFrame) -> DataFrame:
    """One row per rule with hits, most severe first."""
    return hits.groupBy("title", "level").agg(F.count("*").alias("n")).orderBy(level_rank(F.col("level")).desc(), F.col("n").desc(), "title")


def rule_coverage(hits: DataFrame, n_rules: int, key: str = "event_id", top: int = 5) -> DataFrame:
    """One row: rules with hits and loaded, events hit, rules with hits of each level, and the `top` rules by hits."""
    by_rule = hits.groupBy("rule").agg(F.first("title").alias("title"), F.first("level").alias("level"), F.count("*").alias("n"))
    levels = [F.count_if(F.col("level") == x).alias(x) for x in LEVELS]
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("down"), "title"))), 1, top)
    rules = by_rule.agg(F.count("*").alias("rules_matched"), *levels, F.transform(best, lambda x: F.concat(x["title"], F.lit(": "), (-x["down"]).cast("string"))).alias("top_rules"))
    events = hits.agg(F.count_distinct(key).alias("events_matched"))
    return rules.crossJoin(events).withColumn("rules_loaded", F.lit(n_rules).cast("long"))  # one row each


def rule_profile(hits: DataFrame, n_events: int) -> DataFrame:
    """Hits of each rule and their share of all events, most hits first."""
    counted = hits.groupBy("rule", "title", "level").agg(F.count("*").alias("n"))
    share = F.lit(None).cast("double") if not n_events else F.col("n") / F.lit(n_events)
    return counted.select("title", "level", "n", share.alias("selectivity")).orderBy(F.col("n").desc(), "title")


def sample_hits(hits: DataFrame, order: list, n: int = 200) -> DataFrame:
    """At most n hits of each rule, for reports; values cut at 1000 characters."""
    from pyspark.sql import Window

    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy(*order))).filter(F.col("place") <= n).drop("place")
    return ranked.select(*[F.left(column(c), F.lit(1000)).alias(c) if t == "string" else column(c) for c, t in ranked.dtypes])


def load_rules(spark, path: str) -> list[dict]:
    """All *.yml and *.yaml rules under a path, read in tasks; what is not a rule is skipped.

    Rules come to the driver, where plans are made; they are few and small.
    """
    return rules_of(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yml,yaml}"))


def rules_of(files: DataFrame) -> list[dict]:
    """Rules of whole YAML texts (value)."""

    def parsed(batches):
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            out = []
            for text in batch["value"]:
                try:
                    rule = yaml.load(text, loader)
                    if isinstance(rule, dict) and {"title", "detection"} <= rule.keys():
                        out.append(json.dumps(rule, default=str))
                except yaml.YAMLError:
                    continue
            yield pd.DataFrame({"value": out}, dtype="object")

    return [json.loads(r.value) for r in files.mapInPandas(parsed, "value string").collect()]

"""All analyses of a set of events by one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators import analytics as an
from emberlog.operators import attack as at
from emberlog.operators import incident as inc
from emberlog.operators import rules as ru
from emberlog.operators import field_indicators as fi
from emberlog.operators.hunts import HUNTS, hunt, hunt_summary
from emberlog.operators.transforms import apply_transforms


def analyse(df: DataFrame, rules: list[dict], techniques: DataFrame, user: str = "TargetUserName", ip: str = "IpAddress", time: str = "SystemTime", hunts: tuple | None = None) -> dict[str, DataFrame]:
    """Name -> result of each analysis; lazy, over one persisted table of hits (``hits``, to be unpersisted by the caller).

    Hunts run only where `hunts` names them.
    """
    hits = ru.apply_rules(df, rules).persist()
    found = at.tagged(hits)
    scores = an.threat_scores(hits, users=(user,))
    window = hits.agg(F.min(time).alias("first"), F.max(time).alias("last"))
    out = {
        "hits": hits,
        "detections": ru.detections(hits),
        "rule_coverage": ru.rule_coverage(hits, len(rules)),
        "timeline": an.timeline(hits),
        "attack_chains": an.attack_chains(hits),
        "threat_scores": scores,
        "kill_chain": at.kill_chain(found, techniques),
        "tactic_coverage": at.tactic_coverage(found, techniques),
        "recommendations": inc.recommendations(found, techniques),
        "incident_summary": inc.incident_summary(found, techniques, scores, window),
        "anomaly_report": an.anomaly_report(df, user, ip),
        "logins_by_user": an.logins_by_user(df, user),
        "logins_by_ip": an.logins_by_ip(df, ip),
        "confidence": inc.confidence(hits, rules),
        "rule_profile": ru.rule_profile(hits, df.count()),
    }
    if hunts:
        out["hunts"] = hunt_summary(hunt(df, hunts))
    return out


def enrich_all(df: DataFrame, transforms=None, hunts=tuple(HUNTS), fast: bool = False) -> DataFrame:
    """The events with all transforms applied, their hunt_findings, and iocs: an array of (type, value, field) without noise."""
    hunted = hunt(apply_transforms(df, transforms), hunts, fast)
    found = fi.indicators_of(df)
    empty = F.array().cast("array<struct<type:string,value:string,field:string>>")
    return hunted.withColumn("iocs", empty if found is None else F.filter(found, lambda i: ~fi.is_noise(i["type"], i["value"])))


def enrich_summary(enriched: DataFrame, columns) -> DataFrame:
    """(part, name, n) of what `enrich_all` found, in one pass over the events: filled columns of transforms, kinds of findings and of indicators."""
    pair = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"))
    filled = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "", pair("transform", F.lit(c))) for c in columns]))
    found = F.concat(filled, F.transform("hunt_findings", lambda f: pair("hunt", f["transform"])), F.transform("iocs", lambda i: pair("ioc", i["type"])))
    return enriched.select(F.explode(found).alias("x")).groupBy("x.part", "x.name").agg(F.count("*").alias("n"))


#: What is summed of each result in digests.
TOTALS = {
    "hits": "1", "detections": "n", "rule_coverage": "events_matched", "timeline": "n", "attack_chains": "n", "threat_scores": "score", "kill_chain": "n_hits", "tactic_coverage": "n_hits", "recommendations": "length(advice)",
    "incident_summary": "risk", "anomaly_report": "n + score", "logins_by_user": "success + 3 * failure", "logins_by_ip": "success + 3 * failure", "confidence": "length(confidence)", "rule_profile": "n", "hunts": "n",
}


def digests(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n, total): the number of rows of each result, and the sum of what TOTALS names."""
    out = None
    for name, part in parts.items():
        row = part.agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum(F.expr(TOTALS[name]).cast("double")), 6), F.lit(0.0)).alias("total")).select(F.lit(name).alias("part"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out

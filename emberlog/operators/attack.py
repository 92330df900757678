"""ATT&CK tags of detections: tactics, techniques, coverage, kill chain and navigator layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.rules import level_rank

#: Tactics in the order of an attack (fixed values).
TACTICS = ("reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact")


def tactic_rank(column):
    return F.array_position(F.array(*[F.lit(t) for t in TACTICS]), column)


def tagged(hits: DataFrame) -> DataFrame:
    """Title, level, tags and number of hits of each rule with hits."""
    return hits.groupBy("title", "level").agg(F.count("*").alias("n"), F.first("tags").alias("tags"))


def parse_tags(found: DataFrame) -> DataFrame:
    """One row per tag of a detection: a technique id in upper case, or a tactic."""
    tag = F.lower("tag")
    technique = F.when(tag.rlike(r"^attack\.t[0-9]{4}(\.[0-9]{3})?$"), F.upper(F.substring(tag, 8, 20)))
    tactic = F.when(tag.rlike(r"^attack\.[a-z]+([_-][a-z]+)*$"), F.replace(F.substring(tag, 8, 40), F.lit("_"), F.lit("-")))
    rows = found.withColumn("tag", F.explode("tags")).select("title", "level", "n", technique.alias("technique"), tactic.alias("tactic"))
    return rows.filter("technique is not null or tactic is not null")


def resolve_techniques(found: DataFrame, techniques: DataFrame) -> DataFrame:
    """Joins names and tactics of a technique table (id, name, tactic) to the technique tags."""
    names = techniques.select(F.upper("id").alias("technique"), "name", F.col("tactic").alias("of"))
    return parse_tags(found).filter("technique is not null").drop("tactic").join(names, "technique", "left").withColumnRenamed("of", "tactic")


def _placed(found: DataFrame, techniques: DataFrame) -> DataFrame:
    """(title, level, n, tactic) by tags and by techniques, each once."""
    direct = parse_tags(found).filter("tactic is not null").select("title", "level", "n", "tactic")
    through = resolve_techniques(found, techniques).filter("tactic is not null").select("title", "level", "n", "tactic")
    return direct.unionByName(through).distinct().filter(tactic_rank(F.col("tactic")) > 0)


def tactic_coverage(found: DataFrame, techniques: DataFrame) -> DataFrame:
    """Techniques and hits of each tactic, in the order of an attack."""
    rows = resolve_techniques(found, techniques).filter("tactic is not null")
    return rows.groupBy("tactic").agg(F.count_distinct("technique").alias("n_techniques"), F.sum("n").alias("n_hits")).orderBy(tactic_rank(F.col("tactic")))


def kill_chain(found: DataFrame, techniques: DataFrame) -> DataFrame:
    """Detections of each tactic and their highest level, in the order of an attack."""
    rows = _placed(found, techniques)
    grouped = rows.groupBy("tactic").agg(F.array_sort(F.collect_set("title")).alias("detections"), F.sum("n").alias("n_hits"), F.max_by("level", level_rank(F.col("level"))).alias("level"))
    return grouped.orderBy(tactic_rank(F.col("tactic")))


#: Colour of a technique by the level of its most severe detection, and of the scale (fixed values).
COLORS = {"critical": "#ff0000", "high": "#ff6666", "medium": "#ffcc00", "low": "#66ccff", "informational": "#99ccff"}
GRADIENT = ("#66ccff", "#ffcc00", "#ff0000")


def navigator_layer(found: DataFrame, name: str = "detections") -> DataFrame:
    """One row: the layer as JSON, with the hits of each technique as its score and the colour of its most severe detection."""
    tags = parse_tags(found).filter("technique is not null")
    scores = tags.groupBy("technique").agg(F.sum("n").alias("score"), F.max_by("level", level_rank(F.col("level"))).alias("level"))
    color = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in COLORS.items()])
    techniques = F.array_sort(F.collect_list(F.struct(F.col("technique").alias("techniqueID"), "score", color.alias("color"))))
    layer = scores.agg(techniques.alias("techniques"), F.coalesce(F.max("score"), F.lit(1)).alias("top"))
    gradient = F.struct(F.array(*map(F.lit, GRADIENT)).alias("colors"), F.lit(0).alias("minValue"), F.col("top").alias("maxValue"))
    return layer.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit("enterprise-attack").alias("domain"), "techniques", gradient.alias("gradient"))).alias("value"))

"""Results as files: events, hits and detections in exchange formats.

Each format has a function that makes the records, and `write` puts any of them below a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.columns import event_time, first_of
from emberlog.operators.search import normalize_empty

TIMES = ("SystemTime", "UtcTime", "timestamp", "@timestamp")


def _fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_") and c not in ("title", "level", "tags", "rule_id")]


def save_events(df: DataFrame, path: str) -> None:
    """Parquet by day; read again with spark.read.parquet."""
    df.withColumn("event_date", F.to_date(event_time(df))).write.partitionBy("event_date").mode("overwrite").parquet(path)


def jsonl(df: DataFrame) -> DataFrame:
    """Events without empty fields and metadata, one JSON object each."""
    full = normalize_empty(df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")]))
    return full.select(F.to_json(F.struct("*")).alias("value"))


def splunk(hits: DataFrame) -> DataFrame:
    full = normalize_empty(hits)
    return full.select(F.to_json(F.struct(first_of(full, TIMES).alias("_time"), F.lit("emberlog").alias("source"), F.lit("_json").alias("sourcetype"), F.col("title").alias("rule_title"), F.col("level").alias("rule_level"), *_fields(full))).alias("value"))


def elk(hits: DataFrame) -> DataFrame:
    full = normalize_empty(hits)
    return full.select(F.to_json(F.struct(first_of(full, TIMES).alias("@timestamp"), F.lit("emberlog").alias("_index"), F.col("title").alias("rule.name"), F.col("level").alias("rule.severity"), "tags", *_fields(full))).alias("value"))


def timesketch(hits: DataFrame) -> DataFrame:
    """The message holds the first five fields that are not empty, in column order."""
    full = normalize_empty(hits)
    parts = F.slice(F.array_compact(F.array(*[F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in _fields(full)])), 1, 5)
    return full.select(F.to_json(F.struct(first_of(full, TIMES).alias("datetime"), F.lit("Event Logged").alias("timestamp_desc"), F.array_join(parts, " ").alias("message"), F.col("tags").alias("tag"), F.col("title").alias("rule_title"), F.col("level").alias("rule_level"))).alias("value"))


def detections_table(found: DataFrame) -> DataFrame:
    return found.select(F.col("title").alias("rule_title"), F.col("level").alias("rule_level"), F.col("n").alias("count"), F.array_join("tags", ";").alias("tags"))


def sarif(found: DataFrame) -> DataFrame:
    """One row: a SARIF 2.1.0 log with one result per rule (rules, not hits, so it stays small)."""
    kind = F.when(F.col("level").isin("critical", "high"), "error").when(F.col("level") == "medium", "warning").otherwise("note")
    result = F.struct(F.col("title").alias("ruleId"), kind.alias("level"), F.struct(F.concat_ws("", F.col("title"), F.lit(": "), F.col("n").cast("string"), F.lit(" events")).alias("text")).alias("message"))
    driver = F.struct(F.struct(F.lit("emberlog").alias("name")).alias("driver"))
    runs = F.array(F.struct(driver.alias("tool"), F.col("results")))
    return found.agg(F.array_sort(F.collect_list(result)).alias("results")).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), runs.alias("runs"))).alias("value"))


def write(records: DataFrame, path: str, sep: str = ",") -> None:
    """Records of one `value` column as text, others as CSV with a header."""
    if records.columns == ["value"]:
        records.write.mode("overwrite").text(path)
    else:
        records.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)

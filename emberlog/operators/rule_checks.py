"""Checks of a table of detection rules, or of the files that hold them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.rules import LEVELS

#: Required keys and valid states of a rule (fixed values).
REQUIRED = ("title", "id", "status", "description", "logsource", "detection", "level")
STATUSES = ("stable", "test", "experimental", "deprecated", "unsupported")
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def validate_rules(rules: DataFrame) -> DataFrame:
    """(path, problem) of rules(path, title, id, status, description, logsource, detection, level), text columns.

    A null key is missing, and a rule with missing keys has no other problem but a
    repeated id: of several rules with one id all but that of the first path repeat it.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) for c in REQUIRED]))
    wrong = F.array_compact(
        F.array(
            F.when(~F.contains("detection", F.lit("condition")), "no condition"),
            F.when(~F.col("id").rlike(UUID), "invalid id"),
            F.when(~F.col("level").isin(*LEVELS), "invalid level"),
            F.when(~F.col("status").isin(*STATUSES), "invalid status"),
        )
    )
    own = rules.select("path", F.explode(F.when(F.size(missing) > 0, missing).otherwise(wrong)).alias("problem"))
    first = rules.filter("id is not null").groupBy("id").agg(F.min("path").alias("first"))
    again = rules.join(first, "id").filter("path > first").select("path", F.lit("duplicate id").alias("problem"))
    return own.unionByName(again)


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, error and the required keys as text) of all *.yml and *.yaml files below a path, read in tasks; mappings and lists are JSON."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yml,yaml}").text(path, wholetext=True).select("_metadata.file_path", "value")
    names = ("path", "error", *REQUIRED)

    def text(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value, default=str)

    def parsed(batches):
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            rows = []
            for source in batch.column(1).to_pylist():
                try:
                    rule = yaml.load(source, loader)
                    error = None if isinstance(rule, dict) else "no mapping"
                except yaml.YAMLError:
                    rule, error = None, "no YAML"
                rows.append((error, *[text(rule.get(k)) if error is None else None for k in REQUIRED]))
            columns = zip(*rows, strict=True) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], list(names))

    return files.mapInArrow(parsed, ", ".join(f"{n} string" for n in names))


def validate_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of the rule files below a path; what is no YAML mapping has that problem alone."""
    table = rule_table(spark, path)
    return validate_rules(table.filter("error IS NULL")).unionByName(table.filter("error IS NOT NULL").select("path", F.col("error").alias("problem")))

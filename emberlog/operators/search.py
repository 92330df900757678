"""Keyword, field, regex, time and SQL search over events, and field statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.columns import event_time, field, present


def search_keyword(df: DataFrame, keyword: str) -> DataFrame:
    return df.filter(F.contains(F.lower(field(df, "_raw")), F.lit(keyword.lower())))


def search_field(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """SQL LIKE, without case; `\\` before any other character than %, _ or itself stands for itself."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and (i + 1 == len(pattern) or pattern[i + 1] not in "%_\\"):
            out += "\\\\"
        elif c == "\\":
            out += pattern[i : i + 2]
            i += 1
        else:
            out += c
        i += 1
    return df.filter(field(df, name).ilike(out))


def search_regex(df: DataFrame, name: str, pattern: str) -> DataFrame:
    return df.filter(field(df, name).rlike(pattern))


def sql(df: DataFrame, text: str, view: str = "events") -> DataFrame:
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(text)


def run_queries(df: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """(label, row as JSON) of every row of every query."""
    found = [sql(df, text).select(F.lit(label).alias("label"), F.to_json(F.struct("*")).alias("row")) for label, text in queries]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def parse_queries(text: str) -> list[tuple[str, str]]:
    """Lines `label|||sql`; blank lines and lines that begin with # are skipped."""
    lines = [x.strip() for x in text.splitlines()]
    return [tuple(p.strip() for p in x.split("|||", 1)) for x in lines if x and not x.startswith("#") and "|||" in x]


def time_range(df: DataFrame, after: str | None = None, before: str | None = None, names=None) -> DataFrame:
    """Events from `after` to `before`, both included; events without a time stay out when a start is given."""
    t = event_time(df, names) if names else event_time(df)
    if after:
        df = df.filter(t >= F.lit(after).cast("timestamp"))
    if before:
        df = df.filter(t.isNull() | (t <= F.lit(before).cast("timestamp")))
    return df


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(field(df, name).alias("value")).filter(present(F.col("value"))).distinct().orderBy("value")


def field_stats(df: DataFrame) -> DataFrame:
    """Non-empty values per column, in one pass."""
    names = df.columns
    counts = df.agg(*[F.count_if(present(F.col(f"`{c}`").cast("string"))).alias(c) for c in names])
    return counts.unpivot([], names, "field", "n").orderBy(F.col("n").desc(), "field")


def rename_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renames columns; where the new name exists its non-empty values win."""
    for old, new in mapping.items():
        if old not in df.columns:
            continue
        value = F.coalesce(F.nullif(field(df, new), F.lit("")), F.col(f"`{old}`")) if new in df.columns else F.col(f"`{old}`")
        df = df.withColumn(new, value).drop(old)
    return df


def normalize_empty(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def union_events(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def top_values(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    return df.select(field(df, name).alias("value")).filter(present(F.col("value"))).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(n)


def hourly_histogram(df: DataFrame) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", event_time(df)), "yyyy-MM-dd'T'HH")
    return df.select(hour.alias("hour")).filter("hour is not null").groupBy("hour").agg(F.count("*").alias("n"))

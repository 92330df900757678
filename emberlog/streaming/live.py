"""Rules and failed logons over streams; the same expressions as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.columns import event_time, field
from emberlog.operators.rules import apply_rules, detections


def live_detect(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Hits of a stream of events; stateless."""
    return apply_rules(events, rules)


def start_alerts(events: DataFrame, rules: list[dict], path: str, checkpoint: str, every: str = "10 seconds", available_now: bool = False):
    """A running job that appends (batch, title, level, n) of each micro-batch's rules with hits to Parquet at `path`.

    The checkpoint holds the source's cursor: a job started again with it goes on where the
    last one stopped, and a batch that runs twice writes to the same folder.  Returns the
    streaming query.
    """

    def alert(batch: DataFrame, number: int) -> None:
        found = detections(apply_rules(batch, rules)).withColumn("batch", F.lit(number).cast("long"))
        found.select("batch", "title", "level", "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/part={number}")

    writer = events.writeStream.foreachBatch(alert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def live_brute_force(events: DataFrame, user: str = "TargetUserName", ip: str = "IpAddress", least: int = 5, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Failed logons of (user, ip) per window; a window comes out once events are `late` past its end."""
    failed = events.filter(field(events, "EventID") == "4625").select(event_time(events).alias("t"), field(events, user).alias("user"), field(events, ip).alias("ip")).withWatermark("t", late)
    counted = failed.groupBy(F.window("t", window).alias("w"), "user", "ip").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begins"), "user", "ip", "n")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source holds now, into Parquet in the shared folder, and reads that back."""
    spark: SparkSession = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

"""Mixing sources to target weights by weighted fair queueing.

Every source has a target number of words.  Its documents queue in a shuffled order,
one pass (epoch) after the other while the target is not reached; a document's
virtual finish time is the words of its source so far divided by the target.  The
mix is all documents in the order of their finish times, cut where the words reach
the total budget.

Running sums are built from bucket totals, so a source with a third of all rows is
spread over as many tasks as its rows need.  Only the table of sources (one row
each) is handled in one piece.

Defined results: null text has size 0 and is taken 0 times; long texts count whole; a
null source is a source of its own, last in order; repeated rows queue one by one, and
of rows that share id, source and size those with the smaller text hashes come first;
null ids shuffle like any other value; an empty table gives no rows; extra columns pass
through ``mixed``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm import _text as tx

MOST_EPOCHS, BUCKET_ROWS = 3, 4000


def sized(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source and number of words of each row."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in tx.chunks(batch.column(2)):
                _, _, first = tx.word_spans(data, offsets)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(first))], ["doc_id", "source", "size"])

    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: size, rows, weight and target; weights repeat in code point order, null last.

    The total of all sizes is shared by weight; a target ends at MOST_EPOCHS times its
    source's size, and the excess goes to the others (water-filling: the smallest
    level at which no open source is above its limit).
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("place", F.row_number().over(order)).withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * MOST_EPOCHS)
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("fits", F.col("level") <= F.col("most") / F.col("weight"))
        .withColumn("step", F.row_number().over(by_limit))
    )
    first = F.min(F.when(F.col("fits"), F.struct("step", "level"))).over(everything)
    target = F.when(F.col("step") < F.col("cut.step"), F.col("most").cast("double")).otherwise(F.least(F.col("cut.level") * F.col("weight"), F.col("most").cast("double")))
    return filled.withColumn("cut", first).select("source", "place", "source_size", "n_rows", "weight", "total", F.coalesce(target, F.lit(0.0)).alias("target"))


def queue(sizes: DataFrame, seed: str = "mix") -> DataFrame:
    """Each row of the mix: doc_id, copy, epoch, size, finish (virtual time), and the source's columns.

    `copy` tells repeated rows apart.
    """
    sizes = sizes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")))
    targets = tx.written(source_targets(sizes), "targets")
    rows = sizes.join(targets.withColumnRenamed("source", "s"), sizes.source.eqNullSafe(F.col("s"))).drop("s")
    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1)))).filter(F.col("epoch") * F.col("source_size") < F.col("target"))
    name = F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    shuffled = epochs.withColumn("u", F.md5(name)).withColumn("bucket", F.floor(F.conv(F.substring("u", 1, 8), 16, 10).cast("double") / 2.0**32 * F.ceil(F.col("n_rows") / BUCKET_ROWS)).cast("long"))
    group = ["place", "epoch", "bucket"]
    totals = shuffled.groupBy(*group).agg(F.sum("size").alias("words"))
    offset = F.coalesce(F.sum("words").over(Window.partitionBy("place", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy(*group).orderBy("u", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    summed = shuffled.withColumn("inside", F.sum("size").over(inside)).join(totals.withColumn("offset", offset).drop("words"), group)
    end = F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("inside")
    placed = summed.withColumn("end", end).filter((F.col("end") - F.col("size") < F.col("target")) & (F.col("size") > 0)).withColumn("finish", F.col("end") / F.col("target"))
    # Everything that finishes by time 1 fits the budget; of each source at most one more
    # document has begun, and those follow in order until the budget is reached.
    done = placed.filter("end <= target")
    used = done.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used"))
    late = placed.filter("end > target").withColumn("run", F.sum("size").over(Window.orderBy("finish", "place").rowsBetween(Window.unboundedPreceding, 0)))
    late = late.crossJoin(used).filter("used + run <= total").drop("used", "run")  # one row against one per source
    columns = ["doc_id", "copy", "place", "epoch", "size", "finish"]
    return done.select(columns).unionByName(late.select(columns))


def mix_digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of each document."""
    sizes = tx.written(sized(documents, id_col, text_col, source_col), "sizes")
    targets = source_targets(sizes)
    taken = queue(sizes).groupBy("doc_id", "copy", "place", "size").agg(F.sum("size").alias("taken"), F.count("*").alias("times"))
    rows = sizes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")))
    rows = rows.join(targets.select(F.col("source").alias("s"), "place", "source_size", "target"), rows.source.eqNullSafe(F.col("s"))).drop("s")
    same = rows.doc_id.eqNullSafe(taken.doc_id) & (rows.copy == taken.copy) & (rows.place == taken.place) & (rows["size"] == taken["size"])
    return rows.join(taken, same, "left").select(rows.doc_id, rows["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, all columns of `documents`, in the order of their finish times.

    Rows are dealt out by range of finish time; a document taken twice appears twice.
    The words of a row are those that ``mix_digest`` says it is taken for.
    """
    names = documents.columns
    documents = tx.numbered(documents)  # no name of a caller meets one of the plan
    id_col, text_col, source_col = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    sizes = tx.written(sized(documents, id_col, text_col, source_col), "sizes")
    plan = queue(sizes)
    sources = source_targets(sizes).select(F.col("source").alias("__source"), F.col("place").alias("__place"))
    plan = plan.join(F.broadcast(sources), F.col("place") == F.col("__place")) if sources.count() < MOST_BROADCAST else plan.join(sources, F.col("place") == F.col("__place"))
    key = lambda doc_id, source, size: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("")))
    # One row for each (id, source, size), so that the join leaves its rows in one partition, where copies are told apart.
    takes = plan.groupBy(key(F.col("doc_id"), F.col("__source"), F.col("size")).alias("__key")).agg(F.collect_list(F.struct("copy", "finish", "place")).alias("__takes"))
    rows = _with_sizes(documents, text_col).withColumn("__own", key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string"), F.col(SIZE)))
    joined = rows.join(takes.hint("merge"), F.col("__own") == F.col("__key"))
    text = F.col(f"`{text_col}`").cast("string")
    copy = F.row_number().over(Window.partitionBy("__own").orderBy(F.xxhash64(text), text))
    taken = joined.withColumn("__copy", copy).withColumn("__take", F.explode(F.filter("__takes", lambda t: t["copy"] == F.col("__copy"))))
    return taken.orderBy("__take.finish", "__take.place", "__own", "__copy").select(*documents.columns).toDF(*names)


SIZE = "__emberlog_size"
MOST_BROADCAST = 1 << 20  # sources of the mix


def _with_sizes(documents: DataFrame, text_col: str) -> DataFrame:
    """`documents` with the number of words of each row."""
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            sizes = [np.diff(tx.word_spans(data, offsets)[2]) for _, data, offsets in tx.chunks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(sizes or [np.zeros(0, np.int64)]))], [*batch.schema.names, SIZE])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(SIZE, T.LongType())]))


ORACLE = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM src),
weighted AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM ranked),
lev AS (SELECT *, row_number() OVER w AS step,
  (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
   / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
  sum(source_size) OVER () AS total
 FROM weighted WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, place)),
cut AS (SELECT arg_min(level, step) AS level, min(step) AS step FROM lev WHERE level <= CAST(most AS DOUBLE) / weight),
tgt AS (SELECT lev.*, coalesce(CASE WHEN lev.step < cut.step THEN CAST(most AS DOUBLE) ELSE least(cut.level * weight, CAST(most AS DOUBLE)) END, 0.0) AS target FROM lev, cut),
rows AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, s.source, s.size ORDER BY s.doc_id) AS copy, t.place, t.source_size, t.target, t.total
 FROM sizes s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
ep AS (SELECT rows.*, e.epoch FROM rows, (SELECT unnest([0, 1, 2]) AS epoch) e WHERE e.epoch * source_size < target),
summed AS (SELECT *, epoch * source_size + sum(size) OVER (PARTITION BY place, epoch ORDER BY md5(concat('mix:', epoch, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'))), doc_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM ep),
placed AS (SELECT *, CAST(stop AS DOUBLE) / target AS finish FROM summed WHERE size > 0 AND stop - size < target),
late AS (SELECT *, sum(size) OVER (ORDER BY finish, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM placed WHERE stop > target),
kept AS (SELECT doc_id, copy, place, size FROM placed WHERE stop <= target UNION ALL
 SELECT doc_id, copy, place, size FROM late WHERE run + (SELECT coalesce(sum(size), 0) FROM placed WHERE stop <= target) <= total),
taken AS (SELECT doc_id, copy, place, size, sum(size) AS taken FROM kept GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM rows r LEFT JOIN taken t ON r.doc_id IS NOT DISTINCT FROM t.doc_id AND r.copy = t.copy AND r.place = t.place AND r.size = t.size
"""

"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments; with a segment's mean m and deviation s, the inner
product of two segments of length L is at most L * (m1 * m2 + s1 * s2), which is the
lower bound of their distance in other words.  Bounds go from few long segments to
many short ones; pairs that can still reach a query's k-th best score get their
exact score.  Queries and candidates meet in cells of one query block and one
candidate block, so no task holds all of either.  Each query's first cell gives the
score that its other cells start from; the best k of every cell are merged by a
window per query.

Components are floor(64 * x) as whole numbers, whatever their size: doubles serve
where every product in a cell stays below 2**53, Python's integers elsewhere.

Defined results: vectors that are null, empty, or hold null or non-finite components
take no part, nor do null ids; only vectors of equal length are compared; rows that
share an id are all candidates, but never of a query with that id, and all queries of
one id are one query; ties go to the smaller id; scores beyond a long's range are
ordered as they are (up to 38 digits) and shown as the nearest long; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import _text as tx

SCALE = 64
QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 4096, 8192, 1024
EXACT = 2.0**53  # doubles hold all whole numbers below
LEVELS = (16, 4, 2)  # segment lengths, coarse to fine
LONG, MOST = (1 << 63) - 1, 10**38 - 1


def _statistics(x: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a dot product is the bound."""
    n, d = x.shape
    pad = (-d) % length
    segments = np.pad(x, ((0, 0), (0, pad))).reshape(n, -1, length)
    mean = segments.mean(axis=2)
    deviation = np.sqrt(np.maximum(((segments - mean[:, :, None]) ** 2).mean(axis=2), 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(length)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles where all are below 2**53, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not x.size or np.abs(scaled).max() < EXACT:
        return scaled
    exact = [int(v * SCALE // 1) if abs(v) < EXACT else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to their largest component as doubles, and these components."""
    top = np.abs(x).max(axis=1)
    top = np.where(top > 0, top, 1)
    return (x / top[:, None]).astype(float), top


def best_of_cell(qid, q, cid, c, k: int, floor: np.ndarray | None = None):
    """(query id, vec id, score) of each query's best k candidates of one cell; `floor` is a score that each query has k candidates at or above."""
    plain = q.dtype != object and c.dtype != object and q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < EXACT
    if not plain:
        return _best_of_large(qid, q, cid, c, k)
    never = -EXACT
    best_score = np.full((len(q), 0), never)
    best_id = np.full((len(q), 0), 0, np.int64)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    levels = [length for length in LEVELS if length < q.shape[1]]
    q_stats = [_statistics(q, length) for length in levels]
    c_stats = [_statistics(c, length) for length in levels]
    for lo in range(0, len(c), STRIP):
        part, ids = c[lo : lo + STRIP], cid[lo : lo + STRIP]
        if best_score.shape[1] == k:
            floor = np.maximum(floor, best_score[:, -1])
        live = qid[:, None] != ids
        for qs, cs in zip(q_stats, c_stats, strict=True):
            if not live.any() or not np.isfinite(floor).any():
                break
            if live.mean() > 0.05:
                live &= qs @ cs[lo : lo + STRIP].T * (1 + 1e-9) + 1e-3 >= floor[:, None]
            else:
                i, j = np.nonzero(live)
                fine = np.einsum("ij,ij->i", qs[i], cs[lo + j]) * (1 + 1e-9) + 1e-3 >= floor[i]
                live[i[~fine], j[~fine]] = False
        if not live.any():
            continue
        if live.mean() > 0.05:
            score = np.where(live, q @ part.T, never)
        else:
            i, j = np.nonzero(live)
            score = np.full(live.shape, never)
            score[i, j] = np.einsum("ij,ij->i", q[i], part[j])
        score = np.concatenate([best_score, score], axis=1)
        ids = np.concatenate([best_id, np.broadcast_to(ids, (len(q), len(ids)))], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        best_score, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    i, j = np.nonzero(best_score > never)
    return qid[i], best_id[i, j], best_score[i, j].astype(np.int64).astype(object)


def _best_of_large(qid, q, cid, c, k: int):
    """The same for components of any size: doubles leave few candidates, whose exact scores are integers."""
    (q_small, _), (c_small, c_top) = _directions(q), _directions(c)
    weight = (c_top / c_top.max()).astype(float)
    out = []
    for i in range(len(q)):
        about = (c_small @ q_small[i]) * weight  # in proportion to the scores of this query
        about[cid == qid[i]] = -np.inf
        others = int(np.isfinite(about).sum())
        if not others:
            continue
        least = np.partition(about, -min(k, others))[-min(k, others)] - 1e-9 * q.shape[1]
        near = np.flatnonzero((about >= least) & np.isfinite(about)).tolist()
        scores = {j: sum(int(x) * int(y) for x, y in zip(q[i], c[j], strict=True)) for j in near}
        out += [(qid[i], cid[j], scores[j]) for j in sorted(near, key=lambda j: (-scores[j], cid[j]))[:k]]
    return np.array([r[0] for r in out], np.int64), np.array([r[1] for r in out], np.int64), np.array([r[2] for r in out] + [None], object)[:-1]


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim and components of the vectors that take part."""
    fine = ~F.exists("x", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine).select("vec_id", F.size("x").alias("dim"), "x")


def top_k(embeddings: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; is_query is a Column on vec_id."""
    vectors = tx.written(usable(embeddings, id_col, vector_col), "vectors")
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    blocks_q, blocks_c = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("vec_id", "x"), F.lit(m)).cast("int")
    own = vectors.filter(is_query).withColumn("bq", F.pmod(F.xxhash64("vec_id"), F.lit(blocks_q)).cast("int"))
    dealt = vectors.withColumn("bc", block(blocks_c))

    def cell(table: pa.Table) -> pa.Table:
        ids, dim = tx.ids(table.column("vec_id")), int(table.column("dim")[0].as_py())
        query = np.asarray(table.column("query").to_numpy())
        if query.all() or not query.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.decimal128(38, 0))})
        flat = whole_numbers(table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        low = table.column("low").to_numpy(zero_copy_only=False)[query]
        order = np.argsort(ids[~query], kind="stable")
        a, b, s = best_of_cell(ids[query], flat[query], ids[~query][order], flat[~query][order], k, np.where(np.isnan(low), -np.inf, low))
        return pa.table({"query_id": a, "vec_id": b, "score": pa.array([min(max(x, -MOST), MOST) for x in s.tolist()], pa.decimal128(38, 0))})

    def cells(queries: DataFrame, first: bool) -> DataFrame:
        """The best candidates of each query in its first block of candidates, or in all others."""
        home = F.pmod(F.col("bq"), F.lit(blocks_c))
        to = F.array(home) if first else F.filter(F.sequence(F.lit(0), F.lit(blocks_c - 1)), lambda b: b != home)
        left = queries.select("vec_id", "dim", "x", "low", F.lit(True).alias("query"), "bq", F.explode(to).alias("bc"))
        meets = (lambda b: F.pmod(b, F.lit(blocks_c)) == F.col("bc")) if first else (lambda b: F.pmod(b, F.lit(blocks_c)) != F.col("bc"))
        right = dealt.select("vec_id", "dim", "x", F.lit(None).cast("double").alias("low"), F.lit(False).alias("query"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks_q - 1)), meets)).alias("bq"), "bc")
        return left.unionByName(right.select(left.columns)).groupBy("dim", "bq", "bc").applyInArrow(cell, "query_id long, vec_id long, score decimal(38,0)")

    found = cells(own.withColumn("low", F.lit(None).cast("double")), True)
    if blocks_c > 1:
        found = tx.written(found, "found")
        place = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        low = found.withColumn("place", F.row_number().over(place)).filter(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("low"))
        found = found.unionByName(cells(own.join(low, "vec_id", "left"), False))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.least(F.greatest("score", F.lit(-LONG - 1).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""

"""Top-k search against brute force with integers."""

import math
import random

from pyspark.sql import functions as F

from emberlog.llm import topk_search


def brute(rows, k=20):
    """rows(vec_id, vector) -> {(query, rank): (vec_id, score)}."""
    fine = [(i, [math.floor(int(x) * 64 if abs(x) >= 2**53 else x * 64) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in fine if i % 20 == 0}:
        found = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for p, v in fine if p == q for i, w in fine if i != q and len(v) == len(w)]
        for rank, (score, i) in enumerate(sorted(found)[:k], 1):
            out[q, rank] = (i, max(min(-score, 2**63 - 1), -(2**63)))
    return out


def check(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("score", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, k).collect()}
    assert got == brute(rows, k)
    return got


def test_ties_nulls_mixed_lengths_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5]) for _ in range(rng.choice([3, 8, 40]))]) for i in range(300)]
    rows += [(20, [0.5, 0.25, 0.0]), (7, [0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0]), (400, None), (420, []), (440, [1.0, None, 1.0]), (460, [math.nan, 1.0, 1.0]), (480, [math.inf, 1.0, 1.0])]
    check(spark, rows)


def test_a_length_without_queries(spark):
    assert check(spark, [(1, [1.0, 2.0]), (21, [1.0, 2.0]), (20, [2.0, 2.0, 3.0])]) == {}


def test_components_of_any_size(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.choice([-3, 0, 6, 15]) for _ in range(6)]) for i in range(100)]
    check(spark, rows + [(500, [3e5, 1.0]), (501, [1.0, 3e5]), (502, [1e15, -1e15]), (520, [1e17, 1.0]), (521, [1e16, -1e17])])
    huge = [(20, [1.7e308, 1.0]), (21, [1.7e308, 2.0]), (22, [-1.7e308, 0.0])]  # more than 38 digits: no order, but no crash
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(21, 2**63 - 1), (22, -(2**63))]


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 30)
    rng = random.Random(5)
    check(spark, [(i, [rng.gauss(0, 1) for _ in range(33)]) for i in range(400)], 5)

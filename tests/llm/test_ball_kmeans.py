"""Ball k-means codes against plain k-means with Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import ball_kmeans as bk

LONG = 2**63 - 1


def whole(x):
    return math.floor(x * 4096) if abs(x) < 2**53 else int(x) * 4096


def brute(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, label, code, error, label_error, sha)], by full searches."""
    fine = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in order if v and len(v) % parts == 0), None)
    if dim is None:
        return [(i, label, None, None, None, None) for i, _, label in fine]
    width = dim // parts
    cut = [(i, [[whole(x) for x in v[p * width : (p + 1) * width]] for p in range(parts)], label) for i, v, label in order if len(v) == dim]
    books = [[x[p] for _, x, _ in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c, strict=True)), k) for k, c in enumerate(books[p])) for p in range(parts)] for _, x, _ in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for (_, x, _), c in zip(cut, codes, strict=True) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(y) // len(own) for y in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    by = defaultdict(int)
    out = []
    for (i, _, label), c in zip(cut, assign(), strict=True):
        error = min(sum(d for d, _ in c), LONG)
        by[label] += error
        out.append((i, label, "".join(f"{k:02x}" for _, k in c), error))
    rest = [(i, label, None, None, None, None) for i, v, label in fine if len(v) != dim]
    return [(*r, min(by[r[1]], LONG), sha) for r in out] + rest


def check(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3).withColumns({"code": F.lit("x"), "by": F.lit(1), "a.b": F.lit(2)})
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]  # as floats hold them
    got = [(r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in bk.vector_codes(df, **options).collect()]
    want = brute(rows, **options)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def vectors(n, dim, rng):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [[x + rng.gauss(0, rng.choice([0, 0.05, 0.7])) for x in rng.choice(centres)] for _ in range(n)]


def test_equals_plain_kmeans(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 3 % 701, v, rng.choice([1, 1, 1, 2, 3, None])) for i, v in enumerate(vectors(500, 32, rng))]
    rows += [(5000 + i, rows[7][1], 9) for i in range(300)]  # copies
    rows += [(3, rows[1][1], 4), (3, rows[2][1], 4), (None, rows[3][1], 4), (9000, None, 1), (9001, [], 1), (9002, [1.0, None], 1), (9003, [math.nan] * 32, 1), (9004, [math.inf] * 32, 1), (9005, [1.0, 2.0], 1)]
    want = check(spark, rows)
    assert any(r[2] is None for r in want)
    monkeypatch.setattr(bk, "BLOCK_BYTES", 2000)  # many blocks
    monkeypatch.setattr(bk, "HOT_SHARE", 4)  # labels on both sides of the join
    check(spark, rows)
    check(spark, rows, parts=4, entries=5, rounds=2)


def test_ties_and_few_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(16)], i % 2) for i in range(200)]
    check(spark, rows)
    check(spark, rows[:3])
    check(spark, [(1, [1.0, 2.0, 3.0], 1), (2, [1.0] * 7, None)])


def test_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.choice([-3, 0, 3, 6, 12]) for _ in range(8)], i % 3) for i in range(120)]
    check(spark, rows, "double")
    check(spark, rows + [(130 + i, [1.7e308, -1.7e308] + [float(i)] * 6, 1) for i in range(5)], "double")


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert bk.vector_codes(df).collect() == []


def test_rings_and_cores_skip_work(monkeypatch):
    """Far balls at rest compute nothing, and rings ask few neighbours; the result stays that of a full search."""
    rng = np.random.default_rng(2)
    centres = np.round(rng.normal(0, 1000, (16, 8)))
    x = np.round(np.repeat(centres, 50, axis=0) + rng.normal(0, 20, (800, 8)))
    full = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    codes = full.argmin(axis=1).astype(np.uint8)
    far = [int(full[codes == i, i].max(initial=-1)) for i in range(16)]
    asked = []
    real = bk._squared
    monkeypatch.setattr(bk, "_squared", lambda a, b: asked.append(len(a)) or real(a, b))
    moving = bk.Balls(centres, [4 * f for f in far], [True] * 16)
    asked.clear()
    new, distance = moving.assign(x, codes)
    assert (new == codes).all() and (distance == full.min(axis=1)).all() and sum(asked) < 2 * len(x)
    resting = bk.Balls(centres, [4 * f for f in far], [False] * 16)
    asked.clear()
    assert (resting.assign(x, codes)[0] == codes).all() and not asked

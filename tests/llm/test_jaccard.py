"""The Jaccard join on hot groups, repeated ids and texts that a weak hash cannot tell apart, against all pairs."""

import random
import re

import numpy as np

from emberlog.llm import jaccard_join


def brute(rows):
    """rows(doc_id, text) -> {doc_id: component}, by the incidence of shingles."""
    number, cells, sizes = {}, [], []
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        grams = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        cells += [(i, number.setdefault(g, len(number))) for g in grams]
        sizes.append(len(grams))
    m = np.zeros((len(rows), len(number)), np.float32)
    m[tuple(np.array(cells).T)] = 1
    both, sizes = (m @ m.T).astype(np.int64), np.array(sizes)
    link = (100 * both >= 75 * (sizes[:, None] + sizes - both)) & (sizes > 0) & (sizes > 0)[:, None]
    ids = np.array([d for d, _ in rows])
    link |= ids[:, None] == ids
    component = ids.copy()
    while True:
        least = np.where(link, component, np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(least, component)
        if (least == component).all():
            return dict(zip(ids.tolist(), component.tolist(), strict=True))
        component = least


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(parts)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == set(brute(rows).items())


def test_a_hot_key_in_several_components(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(2600):
        w = list(base)
        for _ in range(rng.randint(1, 4) if d % 3 else 9):
            w[rng.randrange(60)] = f"x{rng.randrange(10**9)}"
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    check(spark, rows, 1)


def test_ids_with_several_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(f"t{i}w{j}" for j in range(40 + 8 * (i % 3))) for i in range(30)]
    rows = [(rng.randrange(25), rng.choice(texts) + (" end" if rng.random() < 0.5 else "")) for _ in range(60)]
    check(spark, rows)


def morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_texts_of_a_structure_that_polynomials_cannot_tell_apart(spark):
    x = morse(11)
    y = x.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, x), (2, y), (3, x * 2), (4, y * 2), (5, " ".join([x] * 9)), (6, " ".join([y] * 9))])

"""Ranked lexical search against brute force, and the plan of shared term sets."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from emberlog.llm import lexical_search as ls

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    """(item, rank, doc_id, score) rows."""
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_texts, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_texts // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def texts():
    rng = random.Random(4)
    word = [rng.choice(["", "É", "日"]) + "".join(rng.choice("abcXY9") for _ in range(rng.randint(1, 3))) for _ in range(80)]
    some = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(word) for _ in range(n))
    docs = [(i * 2, some(rng.randint(1, 60))) for i in range(150)]
    docs += [(None, some(20)), (None, docs[3][1]), (7, docs[3][1]), (7, docs[3][1]), (1, None), (3, ""), (5, " ,.- "), (9, some(9000)), (11, "Ab" * 300)]
    shared = some(12)
    items = [(i, shared + " " + some(rng.randint(1, 12)) if i % 3 else some(rng.randint(1, 30))) for i in range(25)]
    items += [(3, "another Part of 3 " + some(3)), (None, some(5)), (90, None), (91, ""), (92, "zzzz unknownword"), (93, shared)]
    return docs, items


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("term", F.lit("x")).withColumn("score", F.lit(1)).withColumn("item.id", F.lit(2))
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2).withColumn("item", F.lit("x")).withColumn("rank", F.lit(1))
    return d, i


def test_equals_brute_force(spark, monkeypatch):
    docs, items = texts()
    want = sorted(brute(docs, items), key=repr)
    assert rows(ls.ranked_search(*frames(spark, docs, items))) == want
    monkeypatch.setattr(ls, "BLOCK_TERMS", 100)  # several blocks of items
    monkeypatch.setattr(ls, "SLICE_CELLS", 4000)  # several slices of a batch
    assert rows(ls.ranked_search(*frames(spark, docs, items))) == want


def test_empty_tables(spark):
    docs, items = texts()
    d, i = frames(spark, docs, items)
    assert ls.ranked_search(d.limit(0), i).collect() == []
    assert ls.ranked_search(d, i.limit(0)).collect() == []


def test_items_named_by_text(spark):
    d, i = frames(spark, [(1, "a b"), (2, "b c c"), (3, "x y")], [(1, "C"), (2, "b a")])
    out = ls.ranked_search(d, i.select(F.concat(F.lit("q"), "item_id").alias("a.id"), F.col("text").alias("said")), item_col="a.id", item_text_col="said")
    assert sorted((r["a.id"], r["rank"], r.doc_id) for r in out.collect()) == [("q1", 1, 2), ("q2", 1, 1), ("q2", 2, 2)]


def test_plan_sums_every_term_once():
    rng = random.Random(9)
    common = [list(range(i * 5, i * 5 + 5)) for i in range(6)]
    held = [sorted({t for part in rng.sample(common, 3) for t in part} | {rng.randrange(100) for _ in range(5)}) for _ in range(40)]
    set_of, pairs, own = ls.sharing_plan(held)
    n_sets = int(set_of.max()) + 1
    members = [{t for t in range(len(set_of)) if set_of[t] == s and any(t in h for h in held)} for s in range(n_sets)]
    for a, b in pairs:
        assert not members[a] & members[b]
        members.append(members[a] | members[b])
    for terms_of_item, nodes in zip(held, own, strict=True):
        parts = [t for x in nodes for t in members[x]]
        assert sorted(parts) == terms_of_item
    assert sum(map(len, own)) + len(pairs) < sum(len({int(set_of[t]) for t in h}) for h in held)  # fewer sums than without sharing

"""Every stage of the pipeline on the rows of the one before, against brute force."""

import base64
import hashlib
from collections import Counter

import pytest

from emberlog.llm import mixing, queries

from .test_jaccard import brute
from .test_operators import repetition, windows_removed, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        out.append((name, docs, rows))
        docs = spark.createDataFrame(rows, docs.schema)
    return {name: (df, rows, out[i - 1][2] if i else None) for i, (name, df, rows) in enumerate(out)}


def test_names_and_columns(stages):
    assert list(stages) == ["documents", "quality_rules", "near_duplicates", "suffix_dedup", "mix_sources", "byte_bpe"]
    columns = stages["documents"][0].columns
    assert all(stages[n][0].columns == columns for n in list(stages)[:-1])


def test_quality_rules(stages):
    _, rows, before = stages["quality_rules"]
    assert Counter(rows) == Counter(r for r in before if repetition(r.text)[6]) and 0 < len(rows) < len(before)


def test_near_duplicates(stages):
    _, rows, before = stages["near_duplicates"]
    component = brute([(r.doc_id, r.text) for r in before])
    assert Counter(rows) == Counter(r for r in before if component[r.doc_id] == r.doc_id) and 0 < len(rows) < len(before)


def test_suffix_dedup(stages):
    _, rows, before = stages["suffix_dedup"]
    units = {r.doc_id: (r.text or "").encode() for r in before}
    gone = windows_removed(units, 50)
    left = {d: bytes(b for i, b in enumerate(u) if i not in gone[d]).decode(errors="ignore") for d, u in units.items()}
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows} == {(r.doc_id, left[r.doc_id], r.lang, r.source, len(left[r.doc_id])) for r in before}
    assert any(gone.values())


def test_mix_sources(spark, stages):
    _, rows, before = stages["mix_sources"]
    docs = spark.createDataFrame(before, stages["suffix_dedup"][0].schema)
    said = {r.doc_id: r.taken for r in mixing.mix_digest(docs).collect()}
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += len(words(r.text))
    assert {d: n for d, n in said.items() if n} == {d: n for d, n in taken.items() if n}
    assert set(rows) <= set(before)


def test_byte_bpe(stages):
    import tiktoken

    _, rows, before = stages["byte_bpe"]
    path, pattern = queries.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tool = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((r.doc_id, len(ids := tool.encode_ordinary(r.text)), digest(",".join(map(str, ids))), digest(r.text)) for r in before)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_rows_without_ids_or_texts_and_other_columns(spark):
    import corpus_pipeline

    plain = " ".join(f"word{i}" for i in range(40))
    rows = [(None, plain, "s", 1), (1, plain, "s", 2), (2, plain, None, 3), (3, None, "s", 4), (4, "", None, 5), (1, plain, "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int")
    for f in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_substrings, corpus_pipeline.mix_sources):
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), docs.schema)
    assert Counter((r.doc_id, r["__size"]) for r in docs.collect()).keys() <= {(None, 1), (1, 2), (1, 6)}
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0

"""Packing: ids against the tokenizer's own, sequences without gaps, and how few there are."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(8)
    alphabet = ["a", "Be", "don't ", "'S", "9", "é", "é", "́", "Σ", "İ", "日本", "👍🏽", " ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "　", "-", "<|endoftext|>", "ﬁ", "\x00", "K"]
    out = [None, "", " \n", "hello world", "x" * 5000, "word " * 9000, "<|startoftext|> a", "a <|endoftext|>"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 900))) for _ in range(120)]


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_whole_texts(tool, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_RUNS", 200)
    mine = packing.RunEncoder(PATH)
    some = [t or "" for t in texts()]
    for lo in range(0, len(some), 9):
        ids, counts = mine.encode([t.encode() for t in some[lo : lo + 9]])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [tool.encode(t, add_special_tokens=False).ids for t in some[lo : lo + 9]]


def valid(rows, size):
    """Sequences have no gaps and no overlaps; returns how many there are."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_documents(spark, tool):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (5, "word " * 100), (5, "word " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("offset", F.lit("x")).withColumn("length", F.lit("y")).withColumn("a.b", F.lit(1))
    want = []
    for d, t in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((d, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.packed_pieces(docs, PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert valid(got, 4096) == -(-sum(w[3] for w in want) // 4096)
    whole = packing.packed_sequences(docs, PATH, size=300).collect()
    by_doc = defaultdict(list)
    for r in whole:
        assert len(r.ids) <= 300 and r.starts[0] == 0
        for d, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)], strict=True):
            by_doc[d].append(r.ids[a:b])
    for d, t in rows:
        if d not in (5, None):
            ids = tool.encode(t or "", add_special_tokens=False).ids + [1]
            assert sorted(by_doc[d]) == sorted(ids[i : i + 300] for i in range(0, len(ids), 300))


def fewest(lengths, size):
    """The optimum, by search."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in sorted({b for b in bins if b + lengths[i] <= size}):
            rest = list(bins)
            rest[rest.index(b)] += lengths[i]
            go(i + 1, rest)
        go(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_few_sequences(spark):
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        sequence, _ = packing.place(np.array(lengths), 20, 1, True)
        assert sequence.max() + 1 <= fewest(lengths, 20) + 1
    # three pieces in ten are equal, as copies are
    lengths = [rng.choice([777, 777, 777, *(int(rng.lognormvariate(6, 1)) % 4096 + 1 for _ in range(7))]) for _ in range(9000)] + [4096] * 50
    rows = spark.createDataFrame([(x,) for x in lengths], "length long").repartition(5)
    for group in (1 << 16, 1500):  # one group, and several rounds of groups
        got = packing.pack(rows, group=group).collect()
        assert sorted(r.length for r in got) == sorted(lengths)
        assert valid(got, 4096) <= 1.005 * sum(lengths) / 4096 + 1


def test_pieces_that_never_fill_a_sequence(spark):
    rows = spark.range(3000).select(F.lit(1400).alias("length"), F.col("id").alias("note"))
    got = packing.pack(rows, group=400).collect()
    assert valid(got, 4096) == 1500 and len({r.note for r in got}) == 3000
    rows = spark.range(600).select((2100 + F.col("id") % 7).alias("length")).unionByName(spark.createDataFrame([(5,)], "length long"))
    assert valid(packing.pack(rows, group=100).collect(), 4096) == 600


def test_empty_and_wrong(spark):
    assert packing.packed_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    for bad in (None, 0, 4097):
        with pytest.raises(ValueError, match="1 lengths"):
            packing.pack(spark.createDataFrame([(bad,), (3,)], "length long"))
    with pytest.raises(ValueError, match="offset"):
        packing.pack(spark.createDataFrame([(3, 1)], "length long, Offset long"))

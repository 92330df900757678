"""Columns of callers that are named like helpers, dotted ids, masks read from the output, and ties."""

import pytest
from pyspark.sql import functions as F

from emberlog.llm import bpe, chat, jaccard_join, mixing, quality, queries, suffix_dedup, warc

TEXT = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, TEXT, "a"), (2, TEXT + " more", "b"), (3, "other words " * 3 + " ".join(f"x{i}" for i in range(40)), "a"), (None, None, None)]


def docs(spark, id_col="doc_id"):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    helpers = ("__emberlog_size", "__gone", "__key", "__takes", "__own", "__copy", "__take", "__place", "__source", "c0", "copy", "place", "bucket", "a.b")
    return df.withColumns({n: F.lit(n) for n in helpers}).withColumnRenamed("doc_id", id_col)


@pytest.mark.parametrize("id_col", ["doc_id", "doc.id"])
def test_names_of_helpers_and_dotted_ids(spark, id_col):
    df = docs(spark, id_col)
    mixed = mixing.mixed(df, id_col)
    assert mixed.columns == df.columns and {r[id_col] for r in mixed.collect()} <= {1, 2, 3}
    assert all(r["__emberlog_size"] == "__emberlog_size" and r["c0"] == "c0" for r in mixed.collect())
    kept = jaccard_join.keep_first_of_group(df, id_col)
    assert kept.columns == df.columns and sorted(r[id_col] or 0 for r in kept.collect()) == [0, 1, 3]
    assert quality.keep_quality(df).columns == df.columns and quality.keep_quality(df).count() == 3
    assert quality.repetition_quality(df, id_col).count() == 4
    assert bpe.token_digests(df, *queries.vocabulary(), id_col).count() == 4
    cut = suffix_dedup.remove_substrings(df, id_col)
    assert cut.columns == df.columns and {r[id_col]: r["text"] for r in cut.collect()}[2] == " more"


def test_decoded_takes_the_place_of_a_column_of_its_name(spark):
    encoded = bpe.encode_text(docs(spark).withColumn("decoded", F.lit("x")), *queries.vocabulary())
    back = bpe.decode_ids(encoded, *queries.vocabulary())
    assert back.columns.count("decoded") == 1 and {bytes(r.decoded).decode() for r in back.collect()} == {r[1] or "" for r in ROWS}


def test_bytes_are_no_text(spark):
    with pytest.raises(ValueError, match="no text"):
        suffix_dedup.remove_substrings(docs(spark).withColumn("text", F.encode("text", "UTF-8")))


def test_loss_is_read_from_the_output(spark):
    rows = [(1, 0, "user", "q </s> [INST]"), (1, 1, "assistant", "a<|assistant|>\\b"), (1, 1, "assistant", "a<|assistant|>\\b"), (1, 2, None, None), (2, None, "assistant", ""), (2, 0, "assistant", "z" * 5000)]
    made = chat.formatted(chat.conversations_of(chat.chained(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    read = chat.read_back(made.drop("pieces", "turns"))
    masks = made.select("conv", F.concat_ws("", F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: chat.unescape(p["text"]))).alias("m"))
    assert {r.conv: r.read_loss for r in read.collect()} == {r.conv: r.m for r in masks.collect()} == {1: "a<|assistant|>\\b" * 2, 2: "z" * 5000}


def test_warc_of_outlying_ids_and_small_payloads(spark):
    rows = [(i, f"http://h/{i}", f"page {i % 5}") for i in range(60)] + [(2**62, "http://h/far", "page 1"), (-5, "u", "ab"), (7000, "u", "ab")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages, min_bytes=3).collect()}
    largest = {}
    for i, _, html in rows:
        largest[html] = max(i, largest.get(html, i))
    assert got == {i: ("response", None) if len(html) < 3 or largest[html] == i else ("revisit", largest[html]) for i, _, html in rows}

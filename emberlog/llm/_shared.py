"""Finds strings of `length` units that documents share, without shipping every window.

A unit is a byte or a word.  In each window of `length` units the smallest k-gram
hash picks an anchor, so equal windows pick equal anchors at equal offsets; the
windows that pick one anchor form a segment.  Two exchanges follow:

1. anchors: the k-gram hash of every segment; only those found in two or more
   documents go on, whatever their number;
2. segments: what an operator ships of each remaining segment (its bytes, or its
   window hashes) meets under the same k-gram, where the operator compares them.

Copies inside a task collapse first: of equal segments (equal as the operator judges,
see Matcher) only those of the smallest doc_id travel, the others are covered at once,
so that a passage that a third of all documents hold reaches a task no more than once
from each task before it.  A hot k-gram, one with more segments than a quarter of an
average bucket, may stand in different surroundings in as many documents; its segments
travel as single windows, keyed by the whole window, so that only equal windows meet,
and those collapse too.  Hot k-grams are about four for each bucket at most, on
average.  Rows travel packed, one row per bucket; the number of buckets follows the
shuffle partitions and the size of the input.  Rows without doc_id take no part in the
exchanges and are finished where they are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import _text as tx

U64 = tx.U64
FLUSH = 1 << 19
KEY_BYTES = 5  # with the bucket enough to tell keys of one bucket apart; a chance match only costs a comparison
SHORT = U64((1 << 8 * KEY_BYTES) - 1)


@dataclass
class Units:
    """How a chunk of texts becomes units: their codes and the bounds of each text in them, and hashes of k-grams of codes."""

    of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray, int], np.ndarray]
    length: int
    k: int


def byte_units(data, offsets):
    return data, offsets


def word_units(data, offsets):
    starts, ends, first = tx.word_spans(data, offsets)
    return tx.word_hashes(data, starts, ends), first


class Matcher(Protocol):
    """What an operator ships of a segment (its body), and how it compares segments."""

    def payload(self, data, codes, low, high) -> tuple[np.ndarray, np.ndarray]:
        """The size in bytes of each segment's body, and all bodies."""

    def body_size(self, windows: np.ndarray) -> np.ndarray:
        """The size in bytes of a body of so many windows."""

    def windows(self, body, at) -> np.ndarray:
        """The hashes of the windows whose bodies begin at `at`."""

    def classes(self, key, body, begins, windows) -> np.ndarray:
        """A number for each segment, equal for equal keys and equal contents."""

    def spans(self, doc, start, body, begins, windows) -> dict[str, np.ndarray]:
        """For segments that differ: runs of windows that a segment of a smaller document holds too.

        number (of the segment), offset, count (windows), ref (number of the other segment), ref_offset.
        """


@dataclass
class Segments:
    """Runs of windows with one anchor: windows start at low..high."""

    key: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray


def segments(codes: np.ndarray, bounds: np.ndarray, units: Units) -> Segments:
    """The segments of all texts; positions count in the chunk."""
    grams = units.grams(codes, units.k)
    least = tx.sliding_min_positions(grams, units.length - units.k + 1)
    counts = np.maximum(np.diff(bounds) - units.length + 1, 0)
    start = tx.ranges(bounds[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    anchor = least[start]
    first = tx.run_starts(text, anchor)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return Segments(tx.mix(grams[anchor[first]]), text[first], start[first], start[last])


def _short(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a key, and the part of it that travels."""
    return ((key >> U64(20)) % U64(n)).astype(np.int32), key & SHORT


def _to_bytes(short: np.ndarray) -> np.ndarray:
    return short.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(U64).ravel()


def _told(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What tells a (document, key) from others; of the key its low 32 bits are used."""
    return tx.mix(doc.astype(U64)) ^ key.astype(np.uint32)


def _shared_keys(key: np.ndarray, doc: np.ndarray):
    """The order by key, the entries in it, and which keys are in two or more documents; each key's smallest document is first."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = tx.run_starts(key)
    ends = np.append(first[1:], len(key))
    many = doc[first] != doc[ends - 1] if len(first) else np.zeros(0, bool)
    return order, key, doc, first, ends, many


#: Of each entry its key, smallest document and number of segments; of each row how many segments its flush had in all.
ANCHORS = ("key", "doc", "count", "total")
HOT = 4  # a key is hot with more than 1/HOT of an average bucket


def _anchor_batch(bucket: np.ndarray, n: int, kind: int, key: np.ndarray, doc: np.ndarray, count: np.ndarray | None = None):
    """Packed anchors; without counts the columns count and total are empty."""
    counts = np.zeros((len(key), 0), np.uint8) if count is None else count.astype(np.uint32)
    batch = tx.pack(bucket, n, kind, {"key": key, "doc": doc, "count": counts})
    total = b"" if count is None else np.int64(count.sum()).tobytes()
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([total] * batch.num_rows, pa.binary())], [*batch.schema.names, "total"])


def _anchor_rows(units: Units, n: int):
    """(doc_id, text) batches -> packed anchors: kind 0 to compare, kind 1 known to be shared."""

    def flush(keys, docs):
        _, key, doc, first, ends, many = _shared_keys(np.concatenate(keys), np.concatenate(docs))
        known = np.repeat(many, ends - first)
        bucket, short = _short(key, n)
        keep = tx.run_starts(key[known], doc[known])
        yield _anchor_batch(tx.doc_bucket(doc[known][keep], n), n, 1, key[known][keep].astype(np.uint32), doc[known][keep])
        order = np.argsort(doc[first], kind="stable")  # ids in order compress
        by_doc = first[order]
        yield _anchor_batch(bucket[by_doc], n, 0, _to_bytes(short[by_doc]), doc[by_doc], (ends - first)[order])

    def run(batches):
        keys, docs, size = [], [], 0
        for batch in batches:
            doc = tx.ids(batch.column(0))
            for row, data, offsets in tx.chunks(batch.column(1)):
                found = segments(*units.of(data, offsets), units)
                own = doc[row + found.text]
                known = own != tx.NO_ID
                keys.append(found.key[known])
                docs.append(own[known])
                size += len(keys[-1])
                if size >= FLUSH:
                    yield from flush(keys, docs)
                    keys, docs, size = [], [], 0
        if keys:
            yield from flush(keys, docs)

    return run


def _find_shared(n: int):
    """A bucket of anchors -> by document: kind 1, those in two or more documents; kind 2, to every bucket, the hot keys."""

    def run(table: pa.Table) -> pa.Table:
        nothing = np.zeros(0, U64)
        out = [_anchor_batch(np.zeros(0, np.int32), n, 1, nothing, nothing)]
        known = tx.filtered(table, 1)
        if known.num_rows:
            out.append(known.cast(out[0].schema).combine_chunks().to_batches()[0])
        rows = tx.filtered(table, 0)
        if rows.num_rows:
            key = _from_bytes(b"".join(x.as_py() for x in rows.column("key")))
            count, total = tx.unpack(rows, "count", np.uint32).astype(np.int64), tx.unpack(rows, "total", np.int64).sum()
            order, key, doc, first, ends, many = _shared_keys(key, tx.unpack(rows, "doc", np.int64))
            hot = key[first][np.add.reduceat(count[order], first) * HOT * n > total].astype(np.uint32)
            to = np.repeat(np.arange(n), len(hot))
            out.append(_anchor_batch(to, n, 2, np.tile(hot, n), np.zeros(len(to), np.int64)))
            keep = np.repeat(many, ends - first)
            key, doc = key[keep], doc[keep]
            order = np.argsort(doc, kind="stable")
            key, doc = key[order], doc[order]
            out.append(_anchor_batch(tx.doc_bucket(doc, n), n, 1, key.astype(np.uint32), doc))
        return pa.Table.from_batches(out)

    return run


def _tags(doc: np.ndarray, texts: pa.ChunkedArray) -> np.ndarray:
    """Tells rows of one doc_id with different texts apart: the rank of the text's digest among theirs, mostly 0."""
    tags = np.zeros(len(doc), np.uint32)
    order = np.argsort(doc, kind="stable")
    first = tx.run_starts(doc[order])
    sizes = np.diff(np.append(first, len(doc)))
    for begin, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        rows = order[begin : begin + size]
        marks = [hashlib.sha256((texts[int(i)].as_py() or "").encode()).digest() for i in rows]
        rank = {m: j for j, m in enumerate(sorted(set(marks)))}
        tags[rows] = [rank[m] for m in marks]
    return tags


#: A covered span: units [start, end) of a document also stand in document ref, from unit ref_start on.
SPANS = {"doc": np.int64, "tag": np.uint32, "start": np.int32, "end": np.int32, "ref": np.int64, "ref_start": np.int32}


def _span_rows(n: int, kind: int, spans: dict[str, np.ndarray]):
    order = np.lexsort((spans["start"], spans["doc"]))
    columns = {c: spans[c][order].astype(t) for c, t in SPANS.items()}
    return tx.pack(tx.doc_bucket(columns["doc"], n), n, kind, columns)


def collapse(label, doc, low):
    """Of segments with equal labels: those of the smallest document stay; spans for the others.

    Returns the order, the class of each entry in it, whether it stays, and the
    position of the entry that stands for its class.
    """
    order = np.lexsort((low, doc, label))
    label, doc = label[order], doc[order]
    first = tx.run_starts(label)
    number = np.zeros(len(order), np.int64)
    number[first] = 1
    number = np.cumsum(number) - 1
    return order, number, doc == doc[first][number] if len(first) else np.zeros(0, bool), first


SEGMENT = {"doc": np.int64, "tag": np.uint32, "start": np.int32, "size": np.uint8}


def _split_windows(have, begins, body, length: int, matcher: Matcher):
    """Segments as single windows keyed by their content: (windows, begins of their bodies, spans of those a smaller document of this task holds)."""
    one, two = matcher.body_size(np.array([1, 2])).tolist()
    windows = have["size"].astype(np.int64)
    number = np.repeat(np.arange(len(windows)), windows)
    offset = tx.ranges(np.zeros(len(windows), np.int64), windows)
    begins = begins[number] + offset * (two - one)
    key = tx.mix(matcher.windows(body, begins))
    out = {"key": key, "doc": have["doc"][number], "tag": have["tag"][number], "start": (have["start"][number] + offset).astype(np.int32), "size": np.ones(len(number), np.uint8)}
    order, label, stays, first = collapse(matcher.classes(key, body, begins, out["size"].astype(np.int64)), out["doc"], out["start"])
    out, begins = {c: v[order] for c, v in out.items()}, begins[order]
    lead = first[label]
    doc, tag, start, ref, ref_start = (v[~stays] for v in (out["doc"], out["tag"], out["start"], out["doc"][lead], out["start"][lead]))
    order = np.lexsort((start, ref_start - start, ref, tag, doc))
    doc, tag, start, ref, ref_start = (v[order] for v in (doc, tag, start, ref, ref_start))
    run = tx.run_starts(doc, tag, ref, ref_start - start, start - np.arange(len(start)))
    count = np.diff(np.append(run, len(start)))
    spans = {"doc": doc[run], "tag": tag[run], "start": start[run], "end": start[run] + count + length - 1, "ref": ref[run], "ref_start": ref_start[run]}
    return {c: v[stays] for c, v in out.items()}, begins[stays], spans


def _segment_rows(units: Units, n: int, matcher: Matcher, text: str):
    """Documents and their shared anchors -> packed segments (kind 0) and spans known already (kind 1)."""
    names = [*dict.fromkeys(["key", *SEGMENT, *SPANS])]

    def full(batch):
        present = dict(zip(batch.schema.names, batch.columns, strict=True))
        empty = pa.array([b""] * batch.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([present.get(c, empty) for c in ("bucket", "kind", *names, "body")], ["bucket", "kind", *names, "body"])

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        out = [full(tx.pack(np.zeros(0, np.int32), n, 0, {c: np.zeros(0, U64) for c in names}))]
        if docs.num_rows and shared.num_rows:
            hot_keys = np.unique(tx.unpack(tx.filtered(shared, 2), "key", np.uint32))
            shared = tx.filtered(shared, 1)
            wanted = np.unique(_told(tx.unpack(shared, "doc", np.int64), tx.unpack(shared, "key", np.uint32)))
            doc = tx.ids(docs.column(ID))
            tags = _tags(doc, docs.column(text))
            parts: list[dict[str, np.ndarray]] = []
            bodies, sizes = [], []
            for row, data, offsets in tx.chunks(docs.column(text), tx.CHUNK_BYTES // 2):
                codes, bounds = units.of(data, offsets)
                s = segments(codes, bounds, units)
                own = doc[row + s.text]
                at = np.flatnonzero(np.isin(_told(own, s.key), wanted))
                low, high, of = s.low[at], s.high[at], s.text[at]
                size, body = matcher.payload(data, codes, low, high)
                parts.append({"key": s.key[at], "doc": own[at], "tag": tags[row + of], "start": (low - bounds[of]).astype(np.int32), "size": (high - low + 1).astype(np.uint8)})
                sizes.append(size)
                bodies.append(body)
            have = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
            sizes, body = np.concatenate(sizes), np.concatenate(bodies)
            begins = np.cumsum(sizes) - sizes
            label = matcher.classes(have["key"], body, begins, have["size"].astype(np.int64))
            order, label, stays, first = collapse(label, have["doc"], have["start"])
            have = {c: v[order] for c, v in have.items()}
            sizes, begins = sizes[order], begins[order]
            gone, lead = ~stays, first[label] if len(first) else label
            out.append(full(_span_rows(n, 1, {"doc": have["doc"][gone], "tag": have["tag"][gone], "start": have["start"][gone], "end": have["start"][gone] + have["size"][gone].astype(np.int32) + units.length - 1, "ref": have["doc"][lead][gone], "ref_start": have["start"][lead][gone]})))
            have = {c: v[stays] for c, v in have.items()}
            sizes, begins = sizes[stays], begins[stays]
            hot = np.isin(have["key"].astype(np.uint32), hot_keys)
            if hot.any():
                split, at, spans = _split_windows({c: v[hot] for c, v in have.items()}, begins[hot], body, units.length, matcher)
                out.append(full(_span_rows(n, 1, spans)))
                have = {c: np.concatenate([v[~hot], split[c]]) for c, v in have.items()}
                begins = np.concatenate([begins[~hot], at])
                sizes = matcher.body_size(have["size"].astype(np.int64))
            by_doc = np.lexsort((have["start"], have["doc"]))  # ids in order compress
            have = {c: v[by_doc] for c, v in have.items()}
            sizes, begins = sizes[by_doc], begins[by_doc]
            bucket, short = _short(have["key"], n)
            order, bounds = tx.by_bucket(bucket, n)
            rows = full(tx.pack(bucket, n, 0, {"key": _to_bytes(short), **{c: have[c] for c in SEGMENT}}))
            sizes, begins = sizes[order], begins[order]
            pairs = [(bounds[b], bounds[b + 1]) for b in np.flatnonzero(np.diff(bounds))]
            packed = [zlib.compress(body[tx.ranges(begins[a:b], sizes[a:b])].tobytes(), 1) for a, b in pairs]
            out.append(rows.set_column(rows.schema.names.index("body"), "body", pa.array(packed, pa.binary())))
        return pa.Table.from_batches(out)

    return run, tx.packed_schema([*names, "body"])


def _slices(classes: np.ndarray, key: np.ndarray, windows: np.ndarray, limit: int = 400_000):
    """Slices of the classes of about `limit` windows; a key is never cut."""
    heads = np.append(tx.run_starts(key[classes]), len(classes))
    total = np.concatenate([[0], np.cumsum(windows[classes])])[heads]
    at = 0
    while at < len(heads) - 1:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield classes[heads[at] : heads[to]]
        at = to


def _class_spans(have, sizes, body, begins, classes, members, member_class, units: Units, matcher: Matcher) -> dict[str, np.ndarray]:
    """Spans that the matcher finds between `classes`, for all members of each."""
    found = matcher.spans(have["doc"][classes], have["start"][classes], body, begins[classes], sizes[classes])
    number, other = found["number"], classes[found["ref"]]
    bounds = np.searchsorted(member_class, np.arange(len(classes) + 1))
    times = np.diff(bounds)[number]
    pick = members[tx.ranges(bounds[:-1][number], times)]
    at = np.repeat(np.arange(len(number)), times)
    start = have["start"][pick] + found["offset"][at]
    return {"doc": have["doc"][pick], "tag": have["tag"][pick], "start": start, "end": start + found["count"][at] + units.length - 1, "ref": have["doc"][other][at], "ref_start": (have["start"][other] + found["ref_offset"])[at]}


def _compare(n: int, units: Units, matcher: Matcher):
    """A bucket of segments -> spans."""

    def run(table: pa.Table) -> pa.Table:
        out = [tx.pack(np.zeros(0, np.int32), n, 0, {c: np.zeros(0, t) for c, t in SPANS.items()})]
        known = tx.filtered(table, 1)
        if known.num_rows:
            out += known.select(["bucket", "kind", *SPANS]).cast(out[0].schema).to_batches()
        rows = tx.filtered(table, 0)
        if rows.num_rows:
            have = {c: tx.unpack(rows, c, t) for c, t in SEGMENT.items()}
            body = np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in rows.column("body")), np.uint8)
            sizes = have["size"].astype(np.int64)
            body_sizes = matcher.body_size(sizes)
            begins = np.cumsum(body_sizes) - body_sizes
            have["key"] = _from_bytes(b"".join(x.as_py() for x in rows.column("key")))
            order, label, stays, first = collapse(matcher.classes(have["key"], body, begins, sizes), have["doc"], have["start"])
            have = {c: v[order] for c, v in have.items()}
            begins, sizes = begins[order], sizes[order]
            lead = first[label]
            gone = np.flatnonzero(~stays)
            spans = [{"doc": have["doc"][gone], "tag": have["tag"][gone], "start": have["start"][gone], "end": have["start"][gone] + sizes[gone] + units.length - 1, "ref": have["doc"][lead][gone], "ref_start": have["start"][lead][gone]}]
            # A key with several different segments: these are compared.
            by_key = first[np.argsort(have["key"][first], kind="stable")]
            key_first = tx.run_starts(have["key"][by_key])
            kinds = np.diff(np.append(key_first, len(first)))
            several = np.repeat(kinds > 1, kinds)
            class_of = np.full(len(have["key"]), -1)
            for classes in _slices(by_key[several], have["key"], sizes):
                class_of[:] = -1
                class_of[classes] = np.arange(len(classes))
                members = np.flatnonzero(stays & (class_of[lead] >= 0))  # all entries of a class in its smallest document
                members = members[np.argsort(class_of[lead[members]], kind="stable")]
                spans.append(_class_spans(have, sizes, body, begins, classes, members, class_of[lead[members]], units, matcher))
            out.append(_span_rows(n, 1, {c: np.concatenate([s[c] for s in spans]) for c in SPANS}))
        return pa.Table.from_batches(out)

    return run


ID, BUCKET = "__emberlog_id", "__emberlog_bucket"


def shared_spans(documents: DataFrame, units: Units, matcher: Matcher, finish, schema, id_col: str, text_col: str) -> DataFrame:
    """finish(documents, spans_of) for every document; spans_of(row) are the spans of a row found in smaller ids.

    The tables that finish gets have the columns of `documents`; text_col is a string column.
    """
    n = tx.buckets(documents)
    rows = documents.withColumn(ID, F.col(f"`{id_col}`").cast("long"))
    known = rows.filter(F.col(ID).isNotNull())
    anchors = known.select(ID, f"`{text_col}`").mapInArrow(_anchor_rows(units, n), tx.packed_schema(ANCHORS))
    shared = anchors.groupBy("bucket").applyInArrow(_find_shared(n), tx.packed_schema(ANCHORS))
    dealt = known.withColumn(BUCKET, tx.doc_bucket_column(F.col(ID), n))
    cut, cut_schema = _segment_rows(units, n, matcher, text_col)
    found = dealt.groupBy(BUCKET).cogroup(shared.groupBy("bucket")).applyInArrow(cut, cut_schema)
    spans = found.groupBy("bucket").applyInArrow(_compare(n, units, matcher), tx.packed_schema(SPANS))

    def final(docs: pa.Table, spans: pa.Table) -> pa.Table:
        have = {c: tx.unpack(spans, c, t) for c, t in SPANS.items()}
        order = np.lexsort((have["start"], have["doc"]))
        have = {c: v[order] for c, v in have.items()}
        doc = tx.ids(docs.column(ID))
        low, high = np.searchsorted(have["doc"], doc), np.searchsorted(have["doc"], doc, "right")
        tags = _tags(doc, docs.column(text_col))

        def spans_of(row: int) -> dict[str, np.ndarray]:
            part = {c: v[low[row] : high[row]] for c, v in have.items()}
            keep = part["tag"] == tags[row]
            return part if keep.all() else {c: v[keep] for c, v in part.items()}

        return finish(docs.drop_columns([ID, BUCKET]), spans_of)

    def alone(batches):
        nothing = {c: np.zeros(0, t) for c, t in SPANS.items()}
        for batch in batches:
            yield from finish(pa.Table.from_batches([batch]), lambda row: nothing).to_batches()

    unknown = documents.filter(F.col(f"`{id_col}`").cast("long").isNull()).mapInArrow(alone, schema)
    return dealt.groupBy(BUCKET).cogroup(spans.groupBy("bucket")).applyInArrow(final, schema).unionByName(unknown)

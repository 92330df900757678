"""Substring dedup by relative Lempel-Ziv parsing on words.

The segments that meet under one anchor (see ``_shared``), ordered by document, are a
reference block.  Its index is a suffix array over windows of `length` words, with for
every place the nearest places of smaller documents on either side: the longest match
with a smaller document begins at one of the two.  Each segment is parsed from left to
right: the longest copy that begins at the current word is a factor if it has `length`
words or more, and the next one is looked for from its end; windows that cross the
boundary are looked up one by one, and where one is found, a factor begins before the
boundary.  A segment that equals one of a smaller document is one factor as it stands.
Factors of neighbouring segments that copy from one place of one document join.

Words, windows and segments are equal if their 64-bit hashes are.

Defined results: null text has no words; texts with fewer than `length` words stay
whole, long texts are parsed whole; rows without doc_id take no part; repeated rows
(equal doc_id) do not remove each other; an empty table gives no rows; extra columns
pass through ``remove_passages``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import _shared as sh
from emberlog.llm import _text as tx

LENGTH, GRAM = 50, 20
UNITS = sh.Units(sh.word_units, tx.gram_hashes, LENGTH, GRAM)


class BlockIndex:
    """Suffix array over the windows of segments, each window one symbol."""

    LEVELS = 5  # segments have at most LENGTH - GRAM + 1 = 31 windows, so runs of 32 tell all suffixes apart

    def __init__(self, windows: np.ndarray, sizes: np.ndarray):
        """windows: hashes of all segments' windows, one segment after the other; sizes: windows of each segment."""
        n = len(windows)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # windows to the end of the segment
        self.ranks = [np.unique(windows, return_inverse=True)[1]]
        for level in range(self.LEVELS):  # runs of 2, 4, 8, ... windows by pairs of shorter ones
            step = 1 << level
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.left > step)
            after[inside] = self.ranks[-1][inside + step] + 1
            self.ranks.append(np.unique(self.ranks[-1] * (n + 1) + after, return_inverse=True)[1])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of windows from a and from b on that are equal (b below 0: none)."""
        out = np.zeros(len(a), np.int64)
        most = np.where(b < 0, 0, np.minimum(self.left[a], self.left[b]))
        for level in reversed(range(self.LEVELS + 1)):
            at = np.flatnonzero(out < most)
            rank = self.ranks[level]
            same = rank[a[at] + out[at]] == rank[b[at] + out[at]]
            out[at[same]] += 1 << level
        return np.minimum(out, most)

    def longest(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place the longest match that begins at a place of a smaller document: its windows, and that place."""
        n = len(doc)
        order = np.argsort(self.ranks[-1], kind="stable")
        size, source = np.zeros(n, np.int64), np.full(n, -1)
        for step in (-1, 1):
            near = nearest_smaller(doc[order], step)
            other = np.empty(n, np.int64)
            other[order] = np.where(near < 0, -1, order[near])
            common = self.common(np.arange(n), other)
            better = common > size
            size[better], source[better] = common[better], other[better]
        return size, source


def nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For every place the nearest one before it (step -1) or after it (1) with a smaller value, or -1."""
    if step > 0:
        found = nearest_smaller(values[::-1], -1)[::-1]
        return np.where(found < 0, -1, len(values) - 1 - found)
    near = np.arange(len(values)) - 1
    todo = np.arange(len(values))
    while len(todo):  # what lies between a place and its candidate is not smaller, so candidates can be followed together
        todo = todo[near[todo] >= 0]
        todo = todo[values[near[todo]] >= values[todo]]
        near[todo] = near[near[todo]]
    return near


class _Matcher:
    def payload(self, data, codes, low, high):
        """The hash of every window of the segments: what the index of a reference block holds."""
        return (high - low + 1) * 8, tx.gram_hashes(codes, LENGTH)[tx.ranges(low, high - low + 1)].view(np.uint8)

    def body_size(self, windows: np.ndarray) -> np.ndarray:
        return windows * 8

    def windows(self, body, at):
        return body.view(np.uint64)[at // 8]

    def classes(self, key, body, begins, windows):
        """The first and the last window cover a segment, so their hashes and the number of windows tell its content."""
        hashes, first = body.view(np.uint64), begins // 8
        return tx.join(key, tx.join(tx.join(hashes[first], hashes[first + windows - 1]), windows.astype(np.uint64)))

    def spans(self, doc, start, body, begins, windows):
        """The factors of a greedy parse of every segment against the block that they all form."""
        base = np.cumsum(windows) - windows
        number = np.repeat(np.arange(len(windows)), windows)
        index = BlockIndex(body.view(np.uint64)[tx.ranges(begins // 8, windows)], windows)
        size, source = index.longest(doc[number])
        at, live = np.zeros(len(windows), np.int64), np.arange(len(windows))
        found = [np.zeros(0, np.int64)]
        while len(live):
            place = base[live] + at[live]
            copies = size[place]
            found.append(place[copies > 0])
            at[live] += np.maximum(copies, 1)  # after a factor: the first window across its boundary
            live = live[at[live] < windows[live]]
        place = np.concatenate(found)
        other = source[place]
        return {"number": number[place], "offset": place - base[number[place]], "count": size[place], "ref": number[other], "ref_offset": other - base[number[other]]}


def joined(spans: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The factors of one document: those of neighbouring segments that copy on from one place join; what others cover whole goes."""
    start, end, ref, ref_start = (spans[c].astype(np.int64) for c in ("start", "end", "ref", "ref_start"))
    shift = ref_start - start
    order = np.lexsort((start, shift, ref))
    start, end, ref, shift = start[order], end[order], ref[order], shift[order]
    out: list[list[int]] = []
    for s, e, r, d in zip(start.tolist(), end.tolist(), ref.tolist(), shift.tolist(), strict=True):
        if out and out[-1][2] == r and out[-1][3] == d and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, r, d])
    taken: list[list[int]] = []
    for f in sorted(out, key=lambda f: (f[0], -f[1])):
        if not taken or f[1] > taken[-1][1]:
            taken.append(f)
    columns = np.array(taken, np.int64).reshape(-1, 4)
    return {"start": columns[:, 0], "end": columns[:, 1], "ref": columns[:, 2], "ref_start": columns[:, 0] + columns[:, 3]}


def _rows(docs: pa.Table, text_col: str, spans_of):
    """(text bytes, word starts, word ends, factors) of every text."""
    for row, data, offsets in tx.chunks(docs.column(text_col)):
        starts, ends, first = tx.word_spans(data, offsets)
        for i in range(len(offsets) - 1):
            base = offsets[i]
            yield data[base : offsets[i + 1]], starts[first[i] : first[i + 1]] - base, ends[first[i] : first[i + 1]] - base, joined(spans_of(row + i))


def _kept_words(text, starts, ends, keep) -> bytes:
    """The kept words joined by one space."""
    lengths = (ends - starts)[keep]
    if not len(lengths):
        return b""
    out = np.full(int(lengths.sum()) + len(lengths) - 1, 32, np.uint8)
    to = np.cumsum(lengths + 1) - lengths - 1
    out[tx.ranges(to, lengths)] = text[tx.ranges(starts[keep], lengths)]
    return out.tobytes()


def passage_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, the digest of the kept words and n_factors of each document."""

    def finish(docs: pa.Table, spans_of) -> pa.Table:
        out = []
        for text, starts, ends, found in _rows(docs, "text", spans_of):
            keep = ~tx.union_mask(len(starts), found["start"], found["end"])
            out.append((len(starts), int((~keep).sum()), hashlib.sha256(_kept_words(text, starts, ends, keep)).hexdigest(), len(found["start"])))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "kept_sha256": pa.array(columns[2], pa.string()), "n_factors": pa.array(columns[3], pa.int64())})

    narrow = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return sh.shared_spans(narrow, UNITS, _Matcher(), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long", "doc_id", "text")


def remove_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`documents`, all columns, with the duplicate words cut; texts that lose words become words joined by one space."""
    names = documents.columns
    at = names.index(text_col)

    def finish(docs: pa.Table, spans_of) -> pa.Table:
        texts = []
        for text, starts, ends, found in _rows(docs, text_col, spans_of):
            keep = ~tx.union_mask(len(starts), found["start"], found["end"])
            texts.append((text.tobytes() if keep.all() else _kept_words(text, starts, ends, keep)).decode())
        return docs.set_column(at, text_col, pa.array(texts, pa.string()))

    return sh.shared_spans(documents, UNITS, _Matcher(), finish, documents.schema, id_col, text_col)

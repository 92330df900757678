"""Suffix-array dedup: removes byte strings that a document with a smaller id also holds.

Candidate segments (see ``_shared``) meet by their anchor.  They are ordered by
deep-shallow sorting: multikey quicksort on 8-byte digits down to a shallow depth,
then blind tries for the groups that still share that prefix.  Whole segments are
sorted first (equal ones form a class), then the suffixes of at least `length` bytes
of the classes that differ; suffixes that agree on `length` bytes form a group, and
all of its members but those of the smallest doc_id are removed.  The bytes decide
what is equal; hashes only bring segments together.

Defined results: null text is empty; texts shorter than `length` stay whole, long
texts are taken whole; rows without doc_id take no part and stay whole; repeated rows
(equal doc_id) do not remove each other; an empty table gives no rows; extra columns
pass through ``remove_substrings``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import _shared as sh
from emberlog.llm import _text as tx

LENGTH, GRAM, SHALLOW, DIGIT = 50, 20, 24, 8
U64 = tx.U64


def padded(data: np.ndarray) -> np.ndarray:
    """Bytes that digits can be read from at every place."""
    return np.concatenate([data, np.zeros(DIGIT, np.uint8)])


def multikey_quicksort(data: np.ndarray, at: np.ndarray, part: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes (in parts: ascending numbers) by their first `depth` bytes; each has `depth` bytes or more.

    Ternary partition on 8-byte digits; all parts of one round are split together.
    Returns the order, and the number of the part (equal prefixes) of each place.
    """
    digits = tx.eights(padded(data))
    n = len(at)
    order = np.arange(n)
    level = np.zeros(n, np.int16)  # bytes that the members of a part share
    while True:
        first = tx.run_starts(part)
        sizes = np.diff(np.append(first, n))
        where = np.flatnonzero(np.repeat(sizes > 1, sizes) & (level < depth))
        if not len(where):
            return order, np.repeat(np.arange(len(first)), sizes)
        digit = digits[at[order[where]] + level[where]].byteswap()
        begin = tx.run_starts(part[where])
        length = np.diff(np.append(begin, len(where)))
        a, b, c = digit[begin], digit[begin + length // 2], digit[begin + length - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), length)
        side = (digit >= pivot).astype(np.int64) + (digit > pivot)
        label = np.repeat(np.arange(len(begin)) * 3, length) + side
        if (label[1:] < label[:-1]).any():
            moved = np.argsort(label, kind="stable")
            order[where], label = order[where[moved]], label[moved]
        level[where] += np.where(label % 3 == 1, DIGIT, 0).astype(np.int16)
        fresh = np.zeros(n, bool)
        fresh[first] = True
        fresh[where[tx.run_starts(label)]] = True
        part = np.cumsum(fresh)


def blind_tries(data: np.ndarray, at: np.ndarray, order: np.ndarray, part: np.ndarray, depth: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the parts left by the shallow sort by bytes depth..length (one length in a part); numbers of equal strings.

    A blind trie keeps of each inner node the position where its strings branch and
    the bytes there, nothing of what they share.  The tries of all parts grow together,
    one level a round, in arrays: a node's position is the least one at which a string
    differs from the first of its node, its children are the strings with one byte there,
    and a node whose strings do not differ is a leaf.
    """
    data = padded(data)
    digits = tx.eights(data)
    n = len(part)
    order, node = order.copy(), part
    level = np.full(n, depth)
    grown = np.zeros(n, bool)
    while True:
        first = tx.run_starts(node)
        sizes = np.diff(np.append(first, n))
        where = np.flatnonzero(np.repeat(sizes > 1, sizes) & ~grown)
        if not len(where):
            return order, np.repeat(np.arange(len(first)), sizes)
        begin = tx.run_starts(node[where])
        count = np.diff(np.append(begin, len(where)))
        own, lead, end = at[order[where]], np.repeat(at[order[where[begin]]], count), length[order[where]]
        branch = level[where]
        todo = np.arange(len(where))
        while len(todo):  # where each string first differs from the first one of its node
            differ = digits[own[todo] + branch[todo]] ^ digits[lead[todo] + branch[todo]]
            same = differ == 0
            step = np.bitwise_count((differ & (~differ + U64(1))) - U64(1)).astype(np.int64) >> 3
            branch[todo] += np.where(same, DIGIT, step)
            todo = todo[same]
            todo = todo[branch[todo] < end[todo]]
        branch = np.minimum(branch, end)
        position = np.repeat(np.minimum.reduceat(branch, begin), count)
        leaf = position == end
        grown[where[leaf]] = True
        inner = np.flatnonzero(~leaf)
        child = (np.repeat(np.arange(len(begin)), count)[inner] << 8) | data[own[inner] + position[inner]]
        moved = np.argsort(child, kind="stable")
        places = where[inner]
        order[places] = order[places[moved]]
        level[places] = position[inner] + 1
        fresh = np.zeros(n, bool)
        fresh[first] = True
        fresh[places[tx.run_starts(child[moved])]] = True
        node = np.cumsum(fresh)


def deep_shallow_sort(data: np.ndarray, at: np.ndarray, part: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the strings data[at:at+length] of each part (one length in a part); the order, and numbers of equal strings."""
    order, part = multikey_quicksort(data, at, part, SHALLOW)
    return blind_tries(data, at, order, part, SHALLOW, length)


class _Matcher:
    def payload(self, data, codes, low, high):
        sizes = high - low + LENGTH
        return sizes, data[tx.ranges(low, sizes)]

    def body_size(self, windows: np.ndarray) -> np.ndarray:
        return windows + LENGTH - 1

    def windows(self, body, at):
        return tx.byte_gram_hashes(body, LENGTH, at)

    def classes(self, key, body, begins, windows):
        """Whole segments in order; those of one key and one length are compared."""
        group = np.lexsort((windows, key))
        fresh = np.zeros(len(group), np.int64)
        fresh[tx.run_starts(key[group], windows[group])] = 1
        order, number = deep_shallow_sort(body, begins[group], np.cumsum(fresh), windows[group] + LENGTH - 1)
        label = np.empty(len(group), np.int64)
        label[group[order]] = number
        return label

    def spans(self, doc, start, body, begins, windows):
        """Runs of suffixes whose first LENGTH bytes a suffix of a smaller document has too."""
        at = tx.ranges(begins, windows)
        number = np.repeat(np.arange(len(begins)), windows)
        offset = tx.ranges(np.zeros(len(begins), np.int64), windows)
        order, group = deep_shallow_sort(body, at, np.zeros(len(at), np.int64), np.full(len(at), LENGTH))
        number, offset = number[order], offset[order]
        order = np.lexsort((offset, doc[number], group))
        number, offset, group = number[order], offset[order], group[order]
        head = tx.run_starts(group)
        head = np.repeat(head, np.diff(np.append(head, len(group))))
        hit = np.flatnonzero(doc[number] > doc[number[head]])
        ref, ref_offset, number, offset = number[head[hit]], offset[head[hit]], number[hit], offset[hit]
        order = np.lexsort((offset, number))
        number, offset, ref, ref_offset = number[order], offset[order], ref[order], ref_offset[order]
        begin = tx.run_starts(number, ref, offset - np.arange(len(offset)), ref_offset - offset)
        return {"number": number[begin], "offset": offset[begin], "count": np.diff(np.append(begin, len(number))), "ref": ref[begin], "ref_offset": ref_offset[begin]}


UNITS = sh.Units(sh.byte_units, tx.byte_gram_hashes, LENGTH, GRAM)


def _rows(docs: pa.Table, text_col: str, spans_of):
    """(bytes, keep mask) of every text; mask None if nothing goes."""
    for row, data, offsets in tx.chunks(docs.column(text_col)):
        for i in range(len(offsets) - 1):
            spans, text = spans_of(row + i), data[offsets[i] : offsets[i + 1]]
            yield text, ~tx.union_mask(len(text), spans["start"], spans["end"]) if len(spans["start"]) else None


def substring_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left of each document."""

    def finish(docs: pa.Table, spans_of) -> pa.Table:
        out = []
        for text, keep in _rows(docs, "text", spans_of):
            if keep is None:
                out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
            else:
                gone = ~keep
                out.append((len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & keep[:-1]).sum()), hashlib.sha256(text[keep].tobytes()).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})

    narrow = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return sh.shared_spans(narrow, UNITS, _Matcher(), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id", "text")


def remove_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`documents`, all columns, with the repeated bytes cut out of the text.

    Cuts fall between bytes; what is left of a split character is dropped.  A text column
    that is not text raises.
    """
    at = documents.columns.index(text_col)
    if documents.schema[at].dataType.typeName() != "string":
        raise ValueError(f"column {text_col} holds no text")
    names = documents.columns
    documents = tx.numbered(documents)  # no name of a caller meets one of the plan
    id_col, text_col = f"c{names.index(id_col)}", f"c{at}"

    def finish(docs: pa.Table, spans_of) -> pa.Table:
        texts = [text.tobytes().decode() if keep is None else text[keep].tobytes().decode(errors="ignore") for text, keep in _rows(docs, text_col, spans_of)]
        return docs.set_column(at, text_col, pa.array(texts, pa.string()))

    return sh.shared_spans(documents, UNITS, _Matcher(), finish, documents.schema, id_col, text_col).toDF(*names)

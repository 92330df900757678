"""Best-fit packing of tokenized documents into sequences of at most `size` tokens, by sums of squares.

`document_pieces` makes each document's ids, ends them with one end id, and cuts longer ones
into pieces.  `pack` gives every piece a sequence and an offset there: pieces are dealt evenly
to groups of about GROUP, and in a group each piece, in a seeded order, goes to the open
sequence (or a new one) that makes the sum of the squared counts of open sequences per
residual gap smallest.  Sequences without room for any piece are closed; the pieces of open
ones come together in fewer groups and are placed anew, until one group is left or half of a
round's pieces stay open.  A last group places what it left open again, longest first: by sums
of squares and, where that takes more sequences than the sum of lengths needs, by best fit;
the fewest sequences count.  What a task holds is one group of narrow rows.

White space never joins two tokens, so a text is encoded by its runs between ASCII spaces,
each through the tokenizer once and from a bounded memo afterwards; the tests hold the ids
against the tokenizer's own for whole texts.

Defined results: null and empty texts are the end id alone; special tokens written out in a
text are what the tokenizer makes of them; texts of any length are taken whole; repeated rows
are packed one by one; a null doc_id is kept; an empty table gives no rows; extra columns are
ignored by `packed_pieces` and `packed_sequences` and kept by `pack`, which raises on lengths
that are null or outside 1 to `size`, and on a column with a name that it adds.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm import _text as tx

SIZE, END = 4096, 1
GROUP = 1 << 16  # pieces that one task places
MARKS = frozenset(b",.;:!?")
MEMO_RUNS, MEMO_BYTES = 3 << 19, 64  # runs kept in a worker's memo, and the longest of them


class RunEncoder:
    """Ids of texts by a tokenizers file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.batch = getattr(self.tool, "encode_batch_fast", self.tool.encode_batch)
        vocabulary = self.tool.get_vocab()
        suffix = getattr(self.tool.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, runs: list[bytes]) -> None:
        """Ids of new runs; one that ends in a mark behind an ASCII letter has those of its two parts."""
        number = self.number
        marked = [r for r in runs if r[-1] in MARKS and r[-2:-1].isalpha()]
        whole = [r for r in runs if not (r[-1] in MARKS and r[-2:-1].isalpha())]
        parts = {p for r in marked for p in (r[:-1], r[-1:])}
        whole += [p for p in parts.difference(whole) if p not in number]
        self._encode(whole)
        if marked:
            both = np.fromiter((number[p] for r in marked for p in (r[:-1], r[-1:])), np.int64, 2 * len(marked))
            sizes = self.sizes[both]
            self._add(marked, sizes[::2] + sizes[1::2], self.flat[tx.ranges(self.starts[both], sizes)])

    def _encode(self, runs: list[bytes]) -> None:
        """Runs of letters go as one text, if as many tokens in it end a word as there are runs; others one by one."""
        texts = [r.decode() for r in runs]
        plain = [(r, t) for r, t in zip(runs, texts, strict=True) if t.isalpha()]
        step = 4096
        for lo in range(0, len(plain), step):
            some = plain[lo : lo + step]
            ids = np.array(self.batch([" ".join([t for _, t in some])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and len(ids) == ends[-1] + 1:
                self._add([r for r, _ in some], np.diff(ends, prepend=-1), ids)
            else:
                self._one_by_one([r for r, _ in some], [t for _, t in some])
        rest = [(r, t) for r, t in zip(runs, texts, strict=True) if not t.isalpha()]
        self._one_by_one([r for r, _ in rest], [t for _, t in rest])

    def _one_by_one(self, runs: list[bytes], texts: list[str]) -> None:
        found = [e.ids for e in self.batch(texts, add_special_tokens=False)]
        self._add(runs, np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32))

    def _add(self, runs: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(runs, range(len(self.sizes), len(self.sizes) + len(runs)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids."""
        if len(self.number) > MEMO_RUNS or len(self.flat) > 8 * MEMO_RUNS:
            self._reset()
        # the tokenizer lowers letters itself, but looks for special tokens before
        found = [(t if b"<|" in t else t.lower()).split() for t in texts]
        number = self.number
        runs = list(chain.from_iterable(found))
        at = np.array(list(map(number.get, runs)), float)  # nan: not known yet
        new = np.flatnonzero(np.isnan(at)).tolist()
        fresh = list({runs[i] for i in new})
        if fresh:
            self._learn(fresh)
            at[new] = [number[runs[i]] for i in new]
        at = at.astype(np.int64)
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        sizes = self.sizes[at]
        ids = self.flat[tx.ranges(self.starts[at], sizes)]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        for r in fresh:
            if len(r) > MEMO_BYTES:
                del number[r]
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(per_text)])])


_encoders: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def document_pieces(documents: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its ids if asked for.  `path` must be readable on every executor."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for row, data, offsets in tx.chunks(batch.column(1)):
                data = data.tobytes()
                ids, counts = encoder(path).encode([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                whole = np.full(len(ids) + len(counts), end, "<u4")
                is_end = np.zeros(len(whole), bool)
                is_end[np.cumsum(counts + 1) - 1] = True
                whole[~is_end] = ids
                counts = counts + 1
                pieces = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(size, counts[doc] - start)
                bounds = np.concatenate([[0], np.cumsum(length)])
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row + doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(whole.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each length, placed in the given order, and what each sequence holds."""
    count = np.zeros(size + 1, np.int64)  # open sequences of each gap; 0 for gaps 0 and size
    places: dict[int, list[int]] = {}
    sequence, held = np.zeros(len(lengths), np.int64), []
    for i, x in enumerate(lengths.tolist()):
        if x == size:
            at = len(held)
            held.append(x)
        else:
            change = 2 * (count[: size - x + 1] - count[x:]) + 2  # for gaps x to size before, 0 to size - x behind
            change[0] -= 1  # full sequences are not counted
            change[count[x:] == 0] = 1 << 60
            change[-1] = 2 * count[size - x] + 1
            gap = int(change.argmin()) + x
            if gap == size:
                at = len(held)
                held.append(x)
            else:
                count[gap] -= 1
                at = places[gap].pop()
                held[at] += x
            if gap > x:
                count[gap - x] += 1
                places.setdefault(gap - x, []).append(at)
        sequence[i] = at
    return sequence, np.array(held, np.int64)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by the smallest gap that is large enough."""
    count = np.zeros(size + 1, bool)
    places: dict[int, list[int]] = {}
    sequence, held = np.zeros(len(lengths), np.int64), []
    for i, x in enumerate(lengths.tolist()):
        gap = x + int(count[x:].argmax())
        if count[gap]:
            at = places[gap].pop()
            count[gap] = bool(places[gap])
        else:
            gap, at = size, len(held)
            held.append(0)
        held[at] += x
        if gap > x:
            count[gap - x] = True
            places.setdefault(gap - x, []).append(at)
        sequence[i] = at
    return sequence, np.array(held, np.int64)


def place(lengths: np.ndarray, size: int, seed: int, last: bool, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each length in a group, and whether each sequence is closed; all are where the group is `last`."""
    order = np.random.default_rng(seed).permutation(len(lengths))
    sequence = np.zeros(len(lengths), np.int64)
    sequence[order], held = sum_of_squares(lengths[order], size)
    closed = size - held < least
    if not last or closed.all():
        return sequence, closed | last
    again = np.flatnonzero(~closed[sequence])
    again = again[np.argsort(-lengths[again], kind="stable")]
    few, need = np.unique(sequence[again], return_inverse=True)[1], -(-int(lengths[again].sum()) // size)
    for method in (sum_of_squares, best_fit):
        if few.max() + 1 > need:
            other = method(lengths[again], size)[0]
            few = min(few, other, key=np.max)
    number = np.cumsum(closed) - 1
    out = np.where(closed[sequence], number[sequence], 0)
    out[again] = closed.sum() + few
    return out, np.ones(int(out.max()) + 1, bool)


def _offsets(sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each length begins in its sequence, in row order."""
    order = np.argsort(sequence, kind="stable")
    ends = np.cumsum(lengths[order])
    begins = ends - lengths[order]
    first = np.searchsorted(sequence[order], sequence[order])
    out = np.zeros(len(lengths), np.int64)
    out[order] = begins - begins[first]
    return out


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP, length_col: str = "length") -> DataFrame:
    """`pieces` with sequence_id and offset; keep the rows narrow, as a task holds a group of them."""
    at = pieces.columns.index(length_col)
    if taken := {"sequence_id", "offset", "__closed"} & {c.lower() for c in pieces.columns}:
        raise ValueError(f"pack adds columns that are there: {sorted(taken)}")
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__closed", T.BooleanType())]
    schema = T.StructType([*pieces.schema.fields, *added])

    def placed(rows: DataFrame, level: int, groups: int, last: bool, least: int) -> DataFrame:
        def run(batches):
            part = TaskContext.get().partitionId()
            table = pa.Table.from_batches(batches) if (batches := list(batches)) else None  # a group: bounded
            if table is None or not table.num_rows:
                return
            lengths = np.asarray(table.column(at).cast(pa.int64()).to_numpy())
            sequence, closed = place(lengths, size, level << 32 | part, last, least)
            columns = [*table.columns, pa.array((level << 56 | part << 32) + sequence), pa.array(_offsets(sequence, lengths)), pa.array(closed[sequence])]
            yield from pa.Table.from_arrays(columns, schema.names).to_batches(1 << 14)

        return rows.repartition(groups).mapInArrow(run, schema)

    length = F.col(f"`{length_col}`")
    wrong = length.isNull() | (length < 1) | (length > size)
    n, bad, least = pieces.agg(F.count("*"), F.count_if(wrong), F.min(length)).first()
    if bad:
        raise ValueError(f"{bad} lengths are null or not from 1 to {size}")
    out, rows, level, last = None, pieces, 0, False
    while True:
        groups, level = max(1, -(-n // group)), level + 1
        last |= groups == 1
        done = tx.written(placed(rows, level, groups, last, int(least or 1)), f"packed-{level}")
        part = done.filter("__closed").drop("__closed")
        out = part if out is None else out.unionByName(part)
        left = 0 if last else done.filter("NOT __closed").count()
        if not left:
            return out
        rows, n, last = done.filter("NOT __closed").select(*[f"`{c}`" for c in pieces.columns]), left, 2 * left > n


def packed_pieces(documents: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(tx.written(document_pieces(documents, path, size, end, False, id_col, text_col), "pieces"), size)


def packed_sequences(documents: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, ids (array of at most `size`), doc_ids and starts (arrays: the pieces in it and their offsets) of every sequence."""
    pieces = document_pieces(documents, path, size, end, True, id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    pieces = tx.written(pieces, "pieces")
    where = pack(pieces.select("place", "length"), size)
    part = F.struct("offset", "ids", "doc_id")
    whole = pieces.select("place", "ids", "doc_id").join(where, "place").groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # `size` ids at most
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))

"""Byte-level BPE encoding and decoding in padded numpy matrices.

Pre-tokens (matches of a pattern) become rows of token ids, padded to a few
lengths.  Each round, every row finds its smallest merge rank, merges the leftmost
pair of that rank and closes the gap, until no row has a pair.  Ranks are looked
up in an open-addressing hash table of (left id, right id).  Distinct pre-tokens
are encoded once per worker (a bounded memo); the vocabulary file has a fixed size.

Defined results: null and empty texts have no tokens and decode to nothing; long
pre-tokens are merged whole by the same rule with per-block minima; any id and any
extra columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm import _text as tx

NONE = np.int32(2**31 - 1)
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
MEMO_WORDS = 800_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


class Ranks:
    """A vocabulary of byte strings with merge ranks (rank = id)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(tokens.values()) + 1
        by_id = [b""] * size
        for t, i in tokens.items():
            by_id[i] = t
        self.bytes_table = _Pieces(by_id)
        self.decimal_table = _Pieces([b"%d," % i for i in range(size)])
        self.single = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        pairs = [(tokens[t[:i]], tokens[t[i:]], r) for t, r in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens]
        self._build(np.array(pairs, np.int64).reshape(-1, 3))

    def _build(self, pairs: np.ndarray) -> None:
        self.bits = max(8, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, ranks = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2].astype(np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several, the last one stays
            done = self.keys[slot] == keys
            self.ranks[slot[done]] = ranks[done]
            keys, ranks, slot = keys[~done], ranks[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(tx.U64) * tx._M) >> tx.U64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NONE where there is no merge."""
        keys = left.astype(np.int64) << 32 | right
        out = np.full(len(keys), NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_rows(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merge the rows of a padded matrix in place; returns the new lengths."""
        n, width = ids.shape
        lengths = lengths.copy()
        if width < 2 or not n:
            return lengths
        inside = np.arange(1, width) < lengths[:, None]
        ranks = np.full((n, width - 1), NONE, np.int32)
        ranks[inside] = self.lookup(ids[:, :-1][inside], ids[:, 1:][inside])
        live = np.arange(n)
        work, left = ids.copy(), lengths.copy()
        while len(live):
            at = ranks.argmin(axis=1)  # the leftmost smallest rank of each row
            row = np.arange(len(live))
            best = ranks[row, at]
            go = best != NONE
            if not go.all():
                done = ~go
                ids[live[done]], lengths[live[done]] = work[done], left[done]
                live, work, ranks, left, at, best = live[go], work[go], ranks[go], left[go], at[go], best[go]
                if not len(live):
                    break
                row = np.arange(len(live))
            cols = np.arange(width - 1)
            work[row, at] = best
            shift = cols > at[:, None]  # close the gap right of the merged pair
            work[:, :-1] = np.where(shift, work[:, 1:], work[:, :-1])
            if width > 2:
                ranks[:, :-1] = np.where(cols[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            left -= 1
            for offset in (-1, 0):
                p = at + offset
                ok = (p >= 0) & (p + 1 < left)
                ranks[row[ok], p[ok]] = self.lookup(work[row[ok], p[ok]], work[row[ok], p[ok] + 1])
        return lengths

    def encode_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row by the same rule: minima of blocks of pairs find the leftmost smallest rank."""
        n, block = len(ids), 1024
        ids = ids.copy()
        pad = (-n) % block
        ranks = np.concatenate([self.lookup(ids[:-1], ids[1:]), np.full(1 + pad, NONE, np.int32)])
        least = ranks.reshape(-1, block).min(axis=1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        while True:
            b = int(least.argmin())
            best = least[b]
            if best == NONE:
                break
            i = b * block + int(ranks[b * block : (b + 1) * block].argmin())
            j = int(after[i])
            k = int(after[j])
            ids[i], after[i], ranks[j], ids[j] = best, k, NONE, -1
            if k < n:
                before[k] = i
            ranks[i] = self.lookup(ids[i : i + 1], ids[k : k + 1])[0] if k < n else NONE
            h = int(before[i])
            if h >= 0:
                ranks[h] = self.lookup(ids[h : h + 1], ids[i : i + 1])[0]
            for q in {i // block, j // block, max(h, 0) // block}:
                least[q] = ranks[q * block : (q + 1) * block].min()
        return ids[ids >= 0]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each pre-token, in length buckets."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        bucket = np.searchsorted(WIDTHS, lengths)
        for b, width in enumerate(WIDTHS):
            at = np.flatnonzero(bucket == b)
            step = max(1, (4 << 20) // width // 8)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                data = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
                ids = np.zeros((len(part), width), np.int32)
                ids[np.arange(width) < lengths[part][:, None]] = self.single[data]
                size = self.encode_rows(ids, lengths[part])
                for i, row, m in zip(part.tolist(), ids, size.tolist(), strict=True):
                    out[i] = row[:m].copy()
        for i in np.flatnonzero(bucket == len(WIDTHS)).tolist():
            out[i] = self.encode_long(self.single[np.frombuffer(words[i], np.uint8)])
        return out


class _Pieces:
    """Byte strings by number, gathered into one buffer."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in order, and the end of each."""
        sizes = self.sizes[ids]
        return self.data[tx.ranges(self.starts[ids], sizes)], np.cumsum(sizes)


class Encoder:
    """Encodes texts with a memo of pre-tokens of bounded size."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = Ranks(path), regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes = [np.zeros(0, np.int32)], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids."""
        if len(self.number) > MEMO_WORDS:
            self._reset()
        found = [self.find(t) for t in texts]
        number = self.number
        fresh = list({w for words in found for w in words if w not in number})
        if fresh:
            ids = self.ranks.encode_words([w.encode() for w in fresh])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            base = int(self.sizes.sum())
            number.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, base + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = [np.concatenate([*self.flat, *ids])]
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter((number[w] for words in found for w in words), np.int64, int(per_text.sum()))
        sizes = self.sizes[at]
        ids = self.flat[0][tx.ranges(self.starts[at], sizes)]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return ids, np.diff(sums[bounds])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _texts(column, limit: int = tx.CHUNK_BYTES):
    """(first row, texts) in slices of about `limit` bytes."""
    array = tx.strings(column)
    row = 0
    for row, _, offsets in tx.chunks(array, limit):
        yield row, array.slice(row, len(offsets) - 1).to_pylist()


def encode_text(documents: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """`documents` with an array column of token ids.  `path` must be readable on every executor."""
    at = documents.columns.index(text_col)
    names = [c for c in documents.columns if c != ids_col]
    keep = [documents.columns.index(c) for c in names]

    def run(batches):
        for batch in batches:
            for row, texts in _texts(batch.column(at)):
                ids, counts = encoder(path, pattern).encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                part = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*names, ids_col])

    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return tx.numbered(documents).mapInArrow(run, schema)


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an array column, and each row's bounds."""
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _pieces(table: _Pieces, ids: np.ndarray, bounds: np.ndarray, limit: int = 1 << 19):
    """The gathered bytes of each row of ids, whole rows of about `limit` ids at a time."""
    row = 0
    while row < len(bounds) - 1:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        data, ends = table.gather(ids[bounds[row] : bounds[to]])
        cuts = np.concatenate([[0], ends])[bounds[row : to + 1] - bounds[row]]
        data = data.tobytes()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield memoryview(data)[a:b]
        row = to


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with a binary column of the bytes that its token ids stand for, in place of one of that name."""
    at = encoded.columns.index(ids_col)
    keep = [i for i, c in enumerate(encoded.columns) if c != out_col]
    names = [*(encoded.columns[i] for i in keep), out_col]

    def run(batches):
        for batch in batches:
            table = encoder(path, pattern).ranks.bytes_table
            decoded = [bytes(x) for x in _pieces(table, *_ids(batch.column(at)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(decoded, pa.binary())], names)

    return tx.numbered(encoded).mapInArrow(run, T.StructType([*(encoded.schema.fields[i] for i in keep), T.StructField(out_col, T.BinaryType())]))


def token_digests(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of tokens and digests of its ids and of the decoded bytes.

    Encoding and decoding run in one task, batch by batch, so neither ids nor
    decoded bytes are written anywhere.
    """

    def run(batches):
        for batch in batches:
            tool = encoder(path, pattern)
            for row, texts in _texts(batch.column(1)):
                ids, counts = tool.encode(texts)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                decimals = [hashlib.sha256(x[:-1]).hexdigest() for x in _pieces(tool.ranks.decimal_table, ids, bounds)]
                decoded = [(hashlib.sha256(x).hexdigest(), len(x)) for x in _pieces(tool.ranks.bytes_table, ids, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(counts), pa.array(decimals), pa.array([d for d, _ in decoded]), pa.array([n for _, n in decoded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, SCHEMA)

"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

``repetition_quality(documents)`` adds no shuffle: every text is judged alone, in
Arrow batches, with rolling hashes of several n-gram lengths in numpy.

Defined results: null and empty texts have no words and fail; a text is judged whole,
whatever its length; a null doc_id is kept as null; repeated rows are judged one by
one; an empty table gives no rows; extra columns are ignored by ``repetition_quality``
and kept by ``keep_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import _text as tx

SYMBOLS = b"#*$%&|<>"
#: n-gram length in words -> largest share of word characters inside n-grams found twice or more.
NGRAM_LIMITS = {4: 0.35, 6: 0.32, 10: 0.28}
#: largest share of word characters inside lines equal to an earlier line.
LINE_CHAR_LIMIT = 0.30
MIN_WORDS, BASE_NGRAM, BASE_PERCENT = 20, 8, 30
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)
)


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more."""
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(hashes, np.unique(again)) if len(again) else np.zeros(len(hashes), bool)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The repetition measures of the texts in one byte buffer."""
    n_texts = len(offsets) - 1
    starts, ends, first = tx.word_spans(data, offsets)
    n_words = np.diff(first)
    text_of_word = np.repeat(np.arange(n_texts), n_words)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    salt = tx.mix(np.arange(1, n_texts + 1, dtype=tx.U64) * tx._M)
    hashes = tx.word_hashes(data, starts, ends)
    out = {"n_words": n_words, "word_chars": _per_text(chars, first), "n_symbols": _per_text(symbol[data], offsets)}

    def covered(n: int) -> np.ndarray:
        grams = tx.gram_hashes(hashes, n)
        at = np.flatnonzero(text_of_word[: len(grams)] == text_of_word[n - 1 : n - 1 + len(grams)])
        again = at[_repeated(grams[at] ^ salt[text_of_word[at]])]
        return tx.union_mask(len(hashes), again, again + n)

    out["n_repeat_words"] = _per_text(covered(BASE_NGRAM), first)
    for n in NGRAM_LIMITS:
        out[f"dup_chars_{n}"] = _per_text(chars * covered(n), first)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]
    line_ends = np.minimum(next_break, offsets[np.searchsorted(offsets, line_starts, "right")])
    words_before = np.searchsorted(starts, line_starts)
    words_after = np.searchsorted(starts, line_ends)
    keep = words_after > words_before
    line_starts, line_ends, words_before, words_after = line_starts[keep], line_ends[keep], words_before[keep], words_after[keep]
    text_of_line = np.searchsorted(offsets, line_starts, "right") - 1
    line_hash = tx.span_hashes(data, line_starts, line_ends) ^ salt[text_of_line]
    order = np.argsort(line_hash, kind="stable")
    again = np.zeros(len(order), bool)
    again[order[1:]] = line_hash[order[1:]] == line_hash[order[:-1]]
    sums = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=sums[1:])
    line_chars = sums[words_after] - sums[words_before]
    out["n_dup_lines"] = np.bincount(text_of_line[again], minlength=n_texts)
    out["dup_line_chars"] = np.bincount(text_of_line[again], line_chars[again], minlength=n_texts).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) for measures."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    ok = m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["word_chars"]
    for n, limit in NGRAM_LIMITS.items():
        ok &= m[f"dup_chars_{n}"] <= limit * m["word_chars"]
    return failed, ~failed & ok


def _measured(column):
    for row, data, offsets in tx.chunks(column):
        m = measure(data, offsets)
        m["base_failed"], m["kept"] = verdict(m)
        yield row, len(offsets) - 1, m


def repetition_quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the measures, base_failed and kept."""
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def run(batches):
        for batch in batches:
            for row, n, m in _measured(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), *(pa.array(m[c]) for c in names)], ["doc_id", *names])

    return documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, SCHEMA)


def keep_quality(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, whose text passes the rules."""
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept = np.concatenate([m["kept"] for _, _, m in _measured(batch.column(at))] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(kept))

    safe = tx.numbered(documents)
    return safe.mapInArrow(run, safe.schema).toDF(*documents.columns)

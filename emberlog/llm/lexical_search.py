"""Ranked lexical search of many items at once: shared term sets are summed once for each document.

A term is a maximal run of ASCII letters, digits and non-ASCII characters, with A-Z in lower
case.  A term's weight is w = floor(1000 * ln((2N + 2) / (2 df + 1))), a document's length
norm m = 10 + (90 n N) div L, and a document's score for an item is the sum over the item's
distinct terms of w * ((10**9 tf) div (1000 tf + 8 m)), all in 64-bit integers.

1. One pass over the whole texts keeps, for each document, the items' terms that it holds
   (`term_matches`, a written table), and counts of all documents, terms and holders.
2. The driver mines what items share (`sharing_plan`): terms that the same items hold are
   one set, and pairs of sets that several items hold become nodes of a DAG, again and again.
3. For each slice of documents every set's and every node's partial score is computed once;
   an item's scores are sums of its few remaining nodes.  Each task keeps its best k rows
   of an item, and a window merges the tasks' rows.

The items go to all tasks, in blocks of about BLOCK_TERMS pairs of item and term; the plan
decides how much is added up, never what is found.  Equality of terms is that of their
64-bit hashes.

Defined results: null and empty texts have no terms, do not count in N and are never found;
texts of any length are taken whole; repeated documents are each ranked; null ids of documents
come last among equal scores; rows that share an item id (null is one) are one item with the
terms of all; items without known terms give no rows; empty tables give none; extra columns
are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import _text as tx

BLOCK_TERMS = 1 << 18  # pairs of item and term in a block of items
SLICE_CELLS = 1 << 21  # nodes times documents that are summed at once
NEAR = 8  # nodes of an item are paired with so many that follow, by the number of items that hold them

_APART = np.ones(256, bool)
_APART[128:] = False
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def term_spans(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the terms, and for each text the number of its first term (one more at the end)."""
    return tx.word_spans(data, offsets, _APART)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term) of the items' whole texts."""
    at = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for row, data, offsets in tx.chunks(batch.column(1)):
                starts, ends, first = term_spans(data, offsets)
                raw = tx._LOWER[data].tobytes()
                terms = pa.array([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
                owner = pa.array(np.repeat(np.arange(row, row + len(offsets) - 1), np.diff(first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), terms], ["item", "term"])

    return at.mapInArrow(run, f"item {at.schema['item'].dataType.simpleString()}, term string").distinct()


def _hashes(terms: list[str]) -> np.ndarray:
    """The hashes that term_spans' terms have in a text."""
    parts = [t.encode() for t in terms]
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    return tx.span_hashes(np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends)


MATCH = "doc_id long, n long, terms array<int>, tfs array<long>, texts long, counts boolean"


def term_matches(documents: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold any of `terms`: doc_id, number of all terms, numbers of the held ones and how often they occur.

    Rows with `counts` hold one task's totals instead: documents with terms (texts), their terms (n), and holders of each term (tfs).
    """
    hashes = _hashes(terms)
    order = np.argsort(hashes)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((hashes[order], order.astype(np.int32)))  # about BLOCK_TERMS at most
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def lists(values: np.ndarray, bounds: np.ndarray, kind):
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))

    def run(batches):
        known, number = shared.value
        holders, texts, total = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for row, data, offsets in tx.chunks(batch.column(1)):
                starts, ends, first = term_spans(data, offsets)
                n = np.diff(first)
                texts, total = texts + int((n > 0).sum()), total + int(n.sum())
                found = tx.word_hashes(data, starts, ends, lower=True)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = np.flatnonzero(known[at] == found) if len(known) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(n)), n)[hit]
                keys, tfs = np.unique(owner * len(known) + number[at[hit]], return_counts=True)
                owner, term = np.divmod(keys, max(len(known), 1))
                holders += np.bincount(term, minlength=len(known))
                some = np.unique(owner)
                bounds = np.searchsorted(owner, np.append(some, len(n)))
                k = len(some)
                ids = batch.column(0).take(pa.array(row + some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[some], pa.int64()), lists(term, bounds, pa.int32()), lists(tfs, bounds, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.zeros(k, bool))], [c.split()[0] for c in MATCH.split(", ")])
        bounds = np.array([0, len(known)])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64()), lists(np.arange(len(known)), bounds, pa.int32()), lists(holders, bounds, pa.int64()), pa.array([texts], pa.int64()), pa.array([True])], [c.split()[0] for c in MATCH.split(", ")])

    return rows.mapInArrow(run, MATCH)


def sharing_plan(held: list[list[int]]) -> tuple[np.ndarray, list[tuple[int, int]], list[list[int]]]:
    """(set of each term, nodes as pairs of sets or earlier nodes, nodes of each item) for the terms that each item holds."""
    holders: dict[int, list[int]] = defaultdict(list)
    for item, terms in enumerate(held):
        for t in terms:
            holders[t].append(item)
    sets: dict[tuple, int] = {}
    set_of = np.zeros(max(holders, default=-1) + 1, np.int64)
    for t in sorted(holders):
        set_of[t] = sets.setdefault(tuple(holders[t]), len(sets))
    nodes = [set() for _ in held]
    popular = Counter()
    for owners, number in sets.items():
        popular[number] = len(owners)
        for item in owners:
            nodes[item].add(number)
    pairs: list[tuple[int, int]] = []
    while True:
        together: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item, own in enumerate(nodes):
            ranked = sorted((x for x in own if popular[x] > 1), key=lambda x: (-popular[x], x))
            for i, a in enumerate(ranked):
                for b in ranked[i + 1 : i + 1 + NEAR]:
                    together[min(a, b), max(a, b)].append(item)
        used: set[int] = set()
        for (a, b), items in sorted(((p, i) for p, i in together.items() if len(i) > 1), key=lambda x: (-len(x[1]), x[0])):
            if a in used or b in used:
                continue
            used |= {a, b}
            number = len(sets) + len(pairs)
            pairs.append((a, b))
            popular[number] = len(items)
            popular[a] -= len(items)
            popular[b] -= len(items)
            for item in items:
                nodes[item] -= {a, b}
                nodes[item].add(number)
        if not used:
            return set_of, pairs, [sorted(x) for x in nodes]


def weights(n_texts: int, holders: list[int]) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df + 1))) for df in holders], np.int64)


class _Best:
    """The best k rows of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # item, score, id, whether the id is null

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores[item, document]; rows below an item's k-th score so far cannot enter."""
        item, doc = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        new = (item, scores[item, doc], ids[doc], null[doc])
        item, score, at, none = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((at, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        self.rows = [item[place < self.k], score[order], at[order], none[order]]
        full = place[place < self.k] == self.k - 1
        self.least[self.rows[0][full]] = self.rows[1][full]


def _best_of_block(spark, matches: DataFrame, n_items: int, held: list[list[int]], weight: np.ndarray, n_texts: int, n_terms: int, k: int) -> DataFrame:
    """(item number, doc_id, score) of each task's best k documents of every item."""
    set_of, pairs, own = sharing_plan(held)
    n_sets = int(set_of.max(initial=-1)) + 1
    own = [np.array(x, np.int64) for x in own]
    shared = spark.sparkContext.broadcast((set_of, pairs, own, weight))  # bounded by the block's pairs of item and term

    def scores(n: np.ndarray, per: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        set_of, pairs, own, weight = shared.value
        m = 10 + 90 * n * n_texts // max(n_terms, 1)
        owner = np.repeat(np.arange(len(n)), per)
        gain = weight[terms] * (10**9 * tfs // (1000 * tfs + 8 * m[owner]))
        partial = np.zeros((n_sets + len(pairs), len(n)), np.int64)
        np.add.at(partial.reshape(-1), set_of[terms] * len(n) + owner, gain)
        for at, (a, b) in enumerate(pairs, n_sets):
            np.add(partial[a], partial[b], out=partial[at])
        return np.stack([partial[x].sum(axis=0) if len(x) else np.zeros(len(n), np.int64) for x in own])

    def run(batches):
        best = _Best(n_items, k)
        step = max(16, SLICE_CELLS // max(n_sets + len(pairs) + n_items, 1))
        for batch in batches:
            ids, null = tx.ids(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            bounds = batch.column(2).offsets.to_numpy(zero_copy_only=False)
            terms, tfs = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in (2, 3))
            for lo in range(0, len(n), step):
                hi = min(lo + step, len(n))
                a, b = bounds[lo], bounds[hi]
                best.add(scores(n[lo:hi], np.diff(bounds[lo : hi + 1]), terms[a:b], tfs[a:b]), ids[lo:hi], null[lo:hi])
        item, score, doc, none = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())], ["item_number", "doc_id", "score"])

    return matches.mapInArrow(run, "item_number int, doc_id long, score long")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
    spark = documents.sparkSession
    pairs = tx.written(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    kind = pairs.schema["item"].dataType.simpleString()
    out = None
    for block in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "term").collect()  # a block of the stated items
        names = list(dict.fromkeys(r.item for r in rows))
        number = {item: i for i, item in enumerate(names)}
        terms = sorted({r.term for r in rows})
        at = {t: i for i, t in enumerate(terms)}
        held: list[list[int]] = [[] for _ in names]
        for r in rows:
            held[number[r.item]].append(at[r.term])
        matches = tx.written(term_matches(documents, terms, id_col, text_col), "matches")
        totals = matches.filter("counts")
        n_texts, n_terms = totals.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        zipped = totals.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs").alias("df"))
        holders = {r.terms: r.df for r in zipped.collect()}  # one row a term of the block
        found = _best_of_block(spark, matches.filter("NOT counts"), len(names), [[t for t in x if holders.get(t)] for x in held], weights(n_texts, [holders.get(t, 0) for t in range(len(terms))]), n_texts, n_terms, k)
        best = Window.partitionBy("item_number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        table = spark.createDataFrame(list(enumerate(names)), f"item_number int, item {kind}")
        part = ranked.join(F.broadcast(table), "item_number").select(F.col("item").alias(item_col), "rank", "doc_id", "score")  # one row an item of the block
        out = part if out is None else out.unionByName(part)
    return out


ORACLE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS place FROM documents),
d AS (SELECT place, doc_id, len(terms) AS n, terms FROM low WHERE len(terms) > 0),
s AS (SELECT count(*) AS texts, sum(n)::BIGINT AS all_terms FROM d),
tf AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * texts + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
p AS (SELECT q.item_id, tf.place, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * s.texts) // s.all_terms)))) AS BIGINT) AS score
 FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

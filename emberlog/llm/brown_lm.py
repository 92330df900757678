"""LM scoring with Brown class-based bigrams.

Words are counted over all training documents.  The most frequent VOCABULARY words
get CLASSES classes by exchange clustering: each round counts, for every such word,
the classes of its neighbours over all training documents, and moves words to the
class that raises the likelihood of the class bigrams most.  Every other word seen
LEAST times or more then gets the class that does so, chosen in its bucket from the
classes before and after it each time, against the class bigrams of the exchange;
its neighbours that are not among the frequent words count as one class there.
Class bigrams are counted again over all classes.  Words seen less often form one
class, the end of a text another.  A token's probability is

    MIX * P(class | class before) * P(word | class) + (1 - MIX) * unigram(word),

with the same smoothed unigrams that give the base score, so it sums to one.

What the driver or a broadcast holds is bounded by VOCABULARY * CLASSES.  Counts and
neighbours of the other words never leave their buckets: each block of texts asks for
its distinct words there, and their classes and counts travel back.

Defined results: null and empty texts are one end token; long texts are scored whole;
a null doc_id trains and is scored as null; repeated rows are scored one by one; where
no document trains, every token is unknown; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import _text as tx

U64 = tx.U64
VOCABULARY, CLASSES, ROUNDS, MIX, ADD, ALPHA = 16384, 48, 3, 0.8, 0.1, 1.0
LEAST = 2  # of training occurrences of a word with a class of its own choice
FOLDS = 10
FLUSH = 1 << 20
PARTS = 16  # blocks in which neighbour counts are summed


def _words(column):
    """(first row, lower-case word hashes, bounds of each text) per chunk."""
    for row, data, offsets in tx.chunks(column):
        starts, ends, first = tx.word_spans(data, offsets)
        yield row, tx.word_hashes(data, starts, ends, lower=True), first


def _distinct(values: np.ndarray, counts: np.ndarray | None = None):
    if counts is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    head = tx.run_starts(values)
    return values[head], np.add.reduceat(counts, head) if len(head) else counts


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return ((values >> U64(20)) % U64(n)).astype(np.int32)


def word_counts(training: DataFrame, n: int) -> DataFrame:
    """One row per bucket: sorted word hashes, their counts, and the sum of the counts."""

    def run(batches):
        keys, counts, size = [], [], 0

        def flush():
            k, c = _distinct(np.concatenate(keys), np.concatenate(counts))
            return tx.pack(_bucket(k, n), n, 0, {"key": k, "count": c.astype(np.int64)})

        for batch in batches:
            for _, hashes, _ in _words(batch.column(0)):
                k, c = _distinct(hashes)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size >= FLUSH:
                    yield flush()
                    keys, counts, size = [], [], 0
        if keys:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        k, c = _distinct(tx.unpack(table, "key", U64), tx.unpack(table, "count", np.int64))
        return pa.table({"bucket": table.column("bucket")[:1], "key": [k.tobytes()], "count": [c.tobytes()], "total": pa.array([int(c.sum())], pa.int64()), "distinct": pa.array([len(k)], pa.int64()), "few": pa.array([int((c < LEAST).sum())], pa.int64()), "few_tokens": pa.array([int(c[c < LEAST].sum())], pa.int64())})

    packed = training.select("text").mapInArrow(run, tx.packed_schema(["key", "count"]))
    return packed.groupBy("bucket").applyInArrow(add, "bucket int, key binary, count binary, total long, distinct long, few long, few_tokens long")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the VOCABULARY most frequent words."""

    def best(batches):
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                key, count = np.frombuffer(k.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                top = np.lexsort((key, -count))[:VOCABULARY]
                yield pa.RecordBatch.from_arrays([pa.array(key[top]), pa.array(count[top])], ["key", "n"])

    rows = counts.select("key", "count").mapInArrow(best, "key long, n long").orderBy(F.col("n").desc(), "key").limit(VOCABULARY).toPandas()
    key, count = rows["key"].to_numpy(np.int64).view(U64), rows["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], count[order]


#: A row is a block of whole texts: ids of documents, marks (1 held out, 2 no id), tokens of each text as numbers of
#: frequent words (or RARE), END last, and for each rare token its place in the block's rare words (keys, by bucket and hash).
ENCODED = "block long, doc binary, mark binary, size binary, ids binary, place binary, keys binary"
BLOCK = 1 << 18
_TYPES = {"doc": np.int64, "mark": np.uint8, "size": np.int64, "ids": np.uint16, "place": np.uint32, "keys": U64, "label": np.uint8, "count": np.int64}


def _arrays(batch):
    """The arrays of each block of a batch, by name."""
    names = [(i, n) for i, n in enumerate(batch.schema.names) if n in _TYPES]
    for r in range(batch.num_rows):
        yield {n: np.frombuffer(batch.column(i)[r].as_py(), _TYPES[n]) for i, n in names}


def encoded(documents: DataFrame, frequent, n: int) -> DataFrame:
    def run(batches):
        words, part = frequent.value, TaskContext.get().partitionId() << 32
        rare_id, end_id = len(words), len(words) + 1
        held, size, number = {c: [] for c in ("doc", "mark", "size", "ids", "rare")}, 0, 0

        def flush():
            got = {c: np.concatenate(v) for c, v in held.items()}
            keys, place = np.unique(got.pop("rare"), return_inverse=True)
            order = np.argsort(_bucket(keys, n), kind="stable")
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys))
            got |= {"place": rank[place], "keys": keys[order]}
            return pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), *(pa.array([got[c].astype(_TYPES[c]).tobytes()], pa.binary()) for c in ("doc", "mark", "size", "ids", "place", "keys"))], ["block", "doc", "mark", "size", "ids", "place", "keys"])

        for batch in batches:
            doc = tx.ids(batch.column(0))
            mark = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            for row, hashes, first in _words(tx.strings(batch.column(2))):
                texts = len(first) - 1
                at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
                known = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
                new = {"doc": doc[row : row + texts], "mark": mark[row : row + texts], "size": np.diff(first) + 1, "ids": np.insert(np.where(known, at, rare_id), first[1:], end_id).astype(np.uint16), "rare": hashes[~known]}
                for name, values in new.items():
                    held[name].append(values.copy())
                size += len(hashes) + texts
                if size >= BLOCK:
                    yield flush()
                    held, size, number = {c: [] for c in held}, 0, number + 1
        if size:
            yield flush()

    return documents.mapInArrow(run, ENCODED)


def _classes_of(block: dict, label: np.ndarray, rare_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token of a block, and where its rare tokens are."""
    rare = np.flatnonzero(block["ids"] == rare_id)
    out = label[block["ids"]]
    if "label" in block and len(rare):
        out[rare] = block["label"][block["place"]]
    return out, rare


def _training(block: dict) -> np.ndarray:
    """Which tokens of a block stand in training texts."""
    return np.repeat((block["mark"] & 1) == 0, block["size"])


def _requests(table: DataFrame, classes, n_words: int, n: int) -> DataFrame:
    """For each block and bucket: its rare words, how often each is in training texts, and (class before, class after) each time."""

    def run(batches):
        label = classes.value
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), _arrays(batch), strict=True):
                keys = block["keys"]
                if not len(keys):
                    continue
                group, rare = _classes_of(block, label, n_words)
                train = _training(block)[rare]
                at, place = rare[train], block["place"][train]
                before = np.where(at > 0, group[at - 1], CLASSES + 1)
                pairs = np.stack([before, group[at + 1]], axis=1).astype(np.uint8)
                times = np.bincount(place, minlength=len(keys)).astype(np.uint32)
                bounds = np.searchsorted(_bucket(keys, n), np.arange(n + 1))
                used = np.flatnonzero(np.diff(bounds))
                pairs = pairs[np.argsort(place, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
                rows = [(keys[a:b].tobytes(), zlib.compress(times[a:b].tobytes(), 1), pairs[ends[a] : ends[b]].tobytes()) for a, b in zip(bounds[used].tolist(), bounds[used + 1].tolist(), strict=True)]
                columns = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), number), pa.int64()), *columns], ["bucket", "block", "key", "times", "pairs"])

    return table.select("block", "mark", "size", "ids", "place", "keys").mapInArrow(run, "bucket int, block long, key binary, times binary, pairs binary")


def best_classes(word: np.ndarray, pairs: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The class of each of n words that raises the likelihood of the class bigrams `table` most, from the classes before and after each time."""
    width = len(table)
    mass, best = table.sum(axis=1)[:CLASSES], np.zeros(n, np.int64)
    order = np.argsort(word, kind="stable")
    word, pairs = word[order], pairs[order]
    for lo in range(0, n, 4096):
        hi = min(n, lo + 4096)
        a, b = np.searchsorted(word, [lo, hi])
        gain = np.zeros((hi - lo, CLASSES))
        for side, rows in ((1, table), (0, table.T)):
            cell, times = np.unique((word[a:b] - lo) * width + pairs[a:b, side], return_counts=True)
            for s in range(0, len(cell), 1 << 14):
                w, c = np.divmod(cell[s : s + (1 << 14)], width)
                now = rows[:CLASSES, c].T
                np.add.at(gain, w, _xlogx(now + times[s : s + (1 << 14), None]) - _xlogx(now))
        own = np.bincount(word[a:b] - lo, minlength=hi - lo)[:, None]
        best[lo:hi] = (gain - 2 * (_xlogx(mass + own) - _xlogx(mass))).argmax(axis=1)
    return best


def _answers(requests: DataFrame, counts: DataFrame, bigrams) -> DataFrame:
    """The class and count of each rare word, for every block that holds it, in the order of its request; words seen less than LEAST times stay in the class of rare ones."""

    def choose(asked: pa.Table, counted: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "label": pa.array([], pa.binary()), "count": pa.array([], pa.binary())})
        have, c = tx.unpack(counted, "key", U64), tx.unpack(counted, "count", np.int64)
        key, times = tx.unpack(asked, "key", U64), np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in asked.column("times")), np.uint32)
        pairs = tx.unpack(asked, "pairs", np.uint8).reshape(-1, 2)
        words, at = np.unique(key, return_inverse=True)
        place = np.minimum(np.searchsorted(have, words), max(len(have) - 1, 0))
        count = np.where(have[place] == words, c[place], 0) if len(have) else np.zeros(len(words), np.int64)
        admitted = count >= LEAST
        label = np.full(len(words), CLASSES, np.int64)
        number = np.cumsum(admitted) - 1
        word = np.repeat(at, times)
        keep = admitted[word]
        label[admitted] = best_classes(number[word[keep]], pairs[keep], int(admitted.sum()), bigrams.value)
        label, count = label.astype(np.uint8)[at], count[at]
        ends = np.concatenate([[0], np.cumsum([len(x.as_buffer()) // 8 for x in asked.column("key")])])
        cut = lambda v: pa.array([zlib.compress(v[a:b].tobytes(), 1) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.table({"block": asked.column("block"), "part": asked.column("bucket"), "label": cut(label), "count": cut(count)})

    return requests.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(choose, "block long, part int, label binary, count binary")


LABELLED = "block long, doc binary, mark binary, size binary, ids binary, place binary, label binary, count binary"


def _labelled(table: DataFrame, answers: DataFrame) -> DataFrame:
    def join(blocks: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("part").to_numpy(), kind="stable").tolist()
        own = {c: [b"".join(zlib.decompress(found.column(c)[i].as_py()) for i in order)] for c in ("label", "count")}
        return pa.table({c: blocks.column(c) for c in ("block", "doc", "mark", "size", "ids", "place")} | {c: pa.array(v, pa.binary()) for c, v in own.items()})

    return table.drop("keys").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, LABELLED)


def class_counts(labelled: DataFrame, classes, n_words: int) -> np.ndarray:
    """How often each class follows each class in the training texts."""
    width = CLASSES + 2

    def run(batches):
        out = np.zeros(width * width, np.int64)
        for batch in batches:
            for block in _arrays(batch):
                group = _classes_of(block, classes.value, n_words)[0][_training(block)]
                out += np.bincount(_before(group, CLASSES + 1) * width + group, minlength=width * width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(out)], ["cell", "n"])

    rows = labelled.select("mark", "size", "ids", "place", "label").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(width * width, np.int64)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(width, width)


def _before(ids: np.ndarray, end_id: int) -> np.ndarray:
    """The token before each token; a text starts after an end."""
    return np.concatenate([[end_id], ids[:-1]])


def neighbour_counts(table: DataFrame, classes, n_words: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For every number: how often each class follows it and comes before it, over all training texts."""
    width = -(-(n_words + 2) // PARTS)

    def run(batches):
        label = classes.value
        right = np.zeros(PARTS * width * n_classes, np.int64)
        left = np.zeros_like(right)
        for batch in batches:
            for block in _arrays(batch):
                ids = block["ids"][_training(block)].astype(np.int64)
                prev = _before(ids, n_words + 1)
                right += np.bincount(prev * n_classes + label[ids], minlength=len(right))
                left += np.bincount(ids * n_classes + label[prev], minlength=len(left))
        cut = lambda a: [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in a.reshape(PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), pa.array(cut(right), pa.binary()), pa.array(cut(left), pa.binary())], ["part", "right", "left"])

    def add(t: pa.Table) -> pa.Table:
        total = lambda c: sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.int64) for x in t.column(c)).tobytes()
        return pa.table({"part": t.column("part")[:1], "right": [total("right")], "left": [total("left")]})

    schema = "part int, right binary, left binary"
    rows = {r.part: r for r in table.select("mark", "size", "ids").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect()}
    if not rows:
        return (np.zeros((n_words + 2, n_classes), np.int64),) * 2
    whole = lambda c: np.concatenate([np.frombuffer(rows[p][c], np.int64) for p in range(PARTS)]).reshape(-1, n_classes)[: n_words + 2]
    return whole("right"), whole("left")


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(label: np.ndarray, right: np.ndarray, left: np.ndarray, n_free: int, turn: int) -> np.ndarray:
    """One round: each word of every other number moves to its best class, given its neighbours' classes."""
    label = label.copy()
    n_classes = right.shape[1]
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, label, right)
    own = right.sum(axis=1).astype(float)
    mass = np.zeros(n_classes)
    np.add.at(mass, label, own)
    members = np.bincount(label, minlength=n_classes)
    f_table = _xlogx(table)
    order = np.argsort(-own[: len(label) - 2], kind="stable")
    for w in order[turn % 2 :: 2].tolist():
        a = label[w]
        if members[a] <= 1 or not own[w]:
            continue
        r, l = right[w].astype(float), left[w].astype(float)
        table[a] -= r
        table[:, a] -= l
        np.maximum(table, 0, out=table)
        mass[a] -= own[w]
        f_table[a], f_table[:, a] = _xlogx(table[a]), _xlogx(table[:, a])
        some_r, some_l = np.flatnonzero(r), np.flatnonzero(l)
        gain = (_xlogx(table[:n_free, some_r] + r[some_r]) - f_table[:n_free, some_r]).sum(axis=1)
        gain += (_xlogx(table[some_l, :n_free] + l[some_l, None]) - f_table[some_l, :n_free]).sum(axis=0)
        gain -= 2 * (_xlogx(mass[:n_free] + own[w]) - _xlogx(mass[:n_free]))
        b = int(gain.argmax())
        label[w] = b
        members[a] -= 1
        members[b] += 1
        table[b] += r
        table[:, b] += l
        mass[b] += own[w]
        f_table[b], f_table[:, b] = _xlogx(table[b]), _xlogx(table[:, b])
    return label


def _class_steps(bigrams: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed."""
    follow = bigrams.sum(axis=0)
    unigram = (follow + 1) / (follow.sum() + len(bigrams))
    return (bigrams + ALPHA * unigram) / (bigrams.sum(axis=1, keepdims=True) + ALPHA)


def token_probabilities(group, before, times, step, size, all_tokens, few_tokens) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the smoothed unigram and the mix with its class bigram.

    times: its training count; step: P(class | class before); size: tokens of each class;
    all_tokens, few_tokens: tokens and distinct ones, of all and of the class of words seen
    less than LEAST times.  Words that are not known count as one more word of that class.
    """
    base = (times + ADD) / (all_tokens[0] + ADD * (all_tokens[1] + 1))
    emit = np.where(group == CLASSES, (times + ADD) / (few_tokens[0] + ADD * (few_tokens[1] + 1)), times / np.maximum(size[group], 1))
    emit[group == CLASSES + 1] = 1.0
    return base, MIX * step[before, group] * emit + (1 - MIX) * base


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    n = tx.shuffle_partitions(spark) * tx.BUCKETS_PER_TASK
    doc_id = F.col(f"`{id_col}`").cast("long")
    held_out = F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))
    docs = documents.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    training = docs.filter("not held_out")
    counts = tx.written(word_counts(training, n), "counts")
    n_words_total, n_distinct = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_ends = training.count()
    train_tokens, n_distinct = n_words_total + n_ends, n_distinct + (n_ends > 0)
    words, count = frequent_words(counts)
    n_words, n_classes = len(words), CLASSES + 2
    table = tx.written(encoded(docs, spark.sparkContext.broadcast(words), n), "encoded")

    by_count = np.argsort(np.argsort(-count, kind="stable"))
    label = np.concatenate([by_count % CLASSES, [CLASSES, CLASSES + 1]]).astype(np.int64)
    for turn in range(2 * ROUNDS):  # every half of the words moves on counts of the classes as they then are
        right, left = neighbour_counts(table, spark.sparkContext.broadcast(label), n_words, n_classes)
        label = exchange(label, right, left, CLASSES, turn)
    right, left = neighbour_counts(table, spark.sparkContext.broadcast(label), n_words, n_classes)
    bigrams = np.zeros((n_classes, n_classes))
    np.add.at(bigrams, label, right)
    classes = spark.sparkContext.broadcast(label)
    answers = _answers(_requests(table, classes, n_words, n), counts, spark.sparkContext.broadcast(bigrams))
    labelled = tx.written(_labelled(table, answers), "labelled")
    tx.discard(table)
    bigrams = class_counts(labelled, classes, n_words)
    few = F.coalesce(F.sum("few"), F.lit(0)), F.coalesce(F.sum("few_tokens"), F.lit(0))
    rare_words, rare_tokens = counts.agg(*few).first() if n_words else (0, 0)
    in_head = count < LEAST  # only where the whole table has fewer than VOCABULARY words
    rare_words, rare_tokens = rare_words - int(in_head.sum()), rare_tokens - int(count[in_head].sum())
    model = spark.sparkContext.broadcast((label, count, _class_steps(bigrams), bigrams.sum(axis=0).astype(float)))

    def score(batches):
        label, count, step, size = model.value
        known_count = np.concatenate([count, [0, n_ends]])
        for batch in batches:
            for block in _arrays(batch):
                group, rare = _classes_of(block, label, n_words)
                times = known_count[block["ids"]]
                times[rare] = block["count"][block["place"]]
                base, mixed = token_probabilities(group, _before(group, CLASSES + 1), times, step, size, (train_tokens, n_distinct), (rare_tokens, rare_words))
                base, value = np.log10(base), np.log10(mixed)
                starts = np.cumsum(block["size"]) - block["size"]
                mark = block["mark"]
                sums = lambda v: np.add.reduceat(v, starts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc"], mask=(mark & 2) > 0), pa.array((mark & 1) > 0), pa.array(block["size"]), pa.array(sums((times > 0).astype(np.int64))), pa.array(np.full(len(mark), train_tokens), pa.int64()), pa.array(sums(base)), pa.array(sums(value))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return labelled.mapInArrow(score, RESULT)

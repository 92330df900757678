"""Classes of words beyond the most frequent ones."""

import math
import random
import zlib

import numpy as np
import pytest

from emberlog.llm import brown_lm


def test_words_beyond_the_frequent_ones_have_classes(spark, monkeypatch):
    rng = random.Random(3)
    # two kinds of words in turn, one of each frequent: with one class for the rare ones, what follows cannot be told
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = [" ".join(x for _ in range(60) for x in ("left", rng.choice([rng.choice(a), "A"]), rng.choice([rng.choice(b), "B"]), "right")) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(brown_lm, "VOCABULARY", 4)
    with_classes = sum(r.score for r in brown_lm.scores(docs).collect())
    monkeypatch.setattr(brown_lm, "LEAST", 1 << 40)
    one_class = sum(r.score for r in brown_lm.scores(docs).collect())
    assert with_classes > one_class


def gain_of(table):
    """The likelihood of class bigrams, up to terms that do not change."""
    x = lambda v: v * math.log(v) if v > 0 else 0.0
    return sum(x(v) for v in table.ravel().tolist()) - sum(x(v) for v in table.sum(axis=1).tolist()) - sum(x(v) for v in table.sum(axis=0).tolist())


def test_exchange_moves_each_word_to_its_best_class():
    rng = np.random.default_rng(2)
    n_words, n_free = 14, 4
    tokens = [rng.permutation(np.concatenate([rng.integers(0, n_words, 12), [n_words]])).tolist() + [n_words + 1] for _ in range(80)]
    flat = [t for text in tokens for t in text]
    pairs = list(zip([n_words + 1, *flat[:-1]], flat, strict=True))
    label = np.concatenate([np.arange(n_words) % n_free, [n_free, n_free + 1]])
    word = np.zeros((n_words + 2, n_words + 2))
    for a, b in pairs:
        word[a, b] += 1
    right, left = np.zeros((n_words + 2, n_free + 2)), np.zeros((n_words + 2, n_free + 2))
    for w in range(n_words + 2):
        np.add.at(right[w], label, word[w])
        np.add.at(left[w], label, word[:, w])

    def likelihood(lab):
        table = np.zeros((n_free + 2, n_free + 2))
        np.add.at(table, (lab[[a for a, _ in pairs]], lab[[b for _, b in pairs]]), 1)
        return gain_of(table)

    moved = brown_lm.exchange(label, right, left, n_free, 0)
    first = np.argsort(-right.sum(axis=1)[:n_words], kind="stable")[0]
    # the first word that moves is judged with all others where they were; a word beside itself is judged by its old class
    if not word[first, first]:
        best = max(range(n_free), key=lambda c: likelihood(np.where(np.arange(n_words + 2) == first, c, label)))
        assert likelihood(np.where(np.arange(n_words + 2) == first, moved[first], label)) == pytest.approx(likelihood(np.where(np.arange(n_words + 2) == first, best, label)))
    for turn in range(6):
        right, left = np.zeros((n_words + 2, n_free + 2)), np.zeros((n_words + 2, n_free + 2))
        for w in range(n_words + 2):
            np.add.at(right[w], moved, word[w])
            np.add.at(left[w], moved, word[:, w])
        moved = brown_lm.exchange(moved, right, left, n_free, turn)
    assert likelihood(moved) > likelihood(label)


def test_rare_words_choose_the_class_of_the_highest_likelihood():
    rng = np.random.default_rng(5)
    width = brown_lm.CLASSES + 2
    table = rng.integers(0, 60, (width, width)).astype(float)
    word = rng.integers(0, 9, 70)
    pairs = rng.integers(0, width, (70, 2)).astype(np.uint8)
    got = brown_lm.best_classes(word, pairs, 9, table)
    x = lambda v: v * np.log(np.maximum(v, 1))
    for w in range(9):
        mine = pairs[word == w]
        gains = []
        for c in range(brown_lm.CLASSES):
            rows, cols = table[c].copy(), table[:, c].copy()
            for before, after in mine.tolist():
                rows[after] += 1
                cols[before] += 1
            mass = table[c].sum()
            gains.append((x(rows) - x(table[c])).sum() + (x(cols) - x(table[:, c])).sum() - 2 * (x(mass + len(mine)) - x(mass)))
        assert gains[got[w]] == pytest.approx(max(gains))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(7)
    width = brown_lm.CLASSES + 2
    count = rng.integers(brown_lm.LEAST, 50, 300)
    group = np.concatenate([rng.integers(0, brown_lm.CLASSES, 300), [brown_lm.CLASSES] * 20, [brown_lm.CLASSES], [brown_lm.CLASSES + 1]])
    times = np.concatenate([count, [1] * 20, [0], [77]])  # words, words seen once, an unknown one, the end
    size = np.bincount(group, times, minlength=width)
    bigrams = rng.integers(0, 40, (width, width)).astype(float)
    bigrams[:, size == 0] = 0
    for before in range(width):
        base, mixed = brown_lm.token_probabilities(group, np.full(len(group), before), times.astype(float), brown_lm._class_steps(bigrams), size, (times.sum(), 321), (20, 20))
        assert base.sum() == pytest.approx(1)
        # classes without words keep a little of the smoothing
        assert mixed.sum() == pytest.approx(1, abs=2e-3)


def test_no_training_documents(spark):
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    rows = brown_lm.scores(spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(True, 4, 0, 0)] * 5
    assert all(math.isfinite(r.score) and r.base_score == pytest.approx(4 * math.log10(0.1 / 0.1)) for r in rows)

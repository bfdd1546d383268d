"""Substring dedup and near dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import Scratch, blank_words, corpus, frame, keyed, sha, shingles

from cubemerge.llm import near_dedup, substring_dedup


def plain_removal(rows, window=35):
    words = [blank_words(r[1]) for r in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((r[0], len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def plain_components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), first[find(i)], r[0] == first[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("window", [35, 8])
def test_removal_equals_brute_force(spark, window):
    rows = corpus(seed=window)
    with Scratch(spark, "t") as scratch:
        got = substring_dedup.substring_dedup(frame(spark, rows), scratch, window).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_removal(rows, window)


def test_removal_of_repeated_rows_and_null_ids(spark):
    rows = corpus(seed=3, n=12)
    rows = rows + rows[:2] + [(None, rows[5][1], None, None, None)]
    with Scratch(spark, "t") as scratch:
        got = substring_dedup.substring_dedup(frame(spark, rows), scratch).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_removal(rows)


def test_factors_name_a_row_with_a_copy(spark):
    rows = corpus(seed=4)
    with Scratch(spark, "t") as scratch:
        docs = keyed(frame(spark, rows), scratch)
        found = substring_dedup.remove_repeats(docs, scratch, with_text=True).collect()
    texts = {r[0]: b" ".join(blank_words(r[1])) for r in rows}
    for r in found:
        words = blank_words(texts[r[0]].decode())
        for f in r.factors:
            first = b" ".join(words[f.start : f.start + 35])
            assert first in texts[f.reference]


def test_stage_keeps_columns_and_clean_texts(spark):
    rows = corpus(seed=5)
    docs = frame(spark, rows).withColumnRenamed("source", "found")
    with Scratch(spark, "t") as scratch:
        done = substring_dedup.without_repeats(docs, scratch)
    got = {r.doc_id: r for r in done.collect()}
    assert done.columns == docs.columns
    for doc, _, gone, kept in plain_removal(rows):
        text = rows[doc][1]
        assert (got[doc].text == text) if not gone else sha(got[doc].text) == kept
        assert got[doc].n_chars == (None if got[doc].text is None else len(got[doc].text))


def near_corpus(seed):
    """A base text and copies with more and more edits: links chain from copy to copy."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(0, 7)):
            text[rng.randrange(len(text))] = f"e{i}x{rng.randrange(9)}"
        texts.append(" ".join(text))
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [corpus(seed=6), near_corpus(7), corpus(seed=8)[:20] + corpus(seed=8)[:3]])
def test_components_equal_brute_force(spark, rows):
    with Scratch(spark, "t") as scratch:
        got = near_dedup.near_duplicates(frame(spark, rows), scratch).collect()
    assert sorted(tuple(r) for r in got) == plain_components(rows)


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(1, 1 << 63, 4000, dtype=np.uint64) for _ in range(2))
    a, b = np.concatenate([x, y[:500]]), np.concatenate([x, y[500:1000]])
    merged = np.maximum(near_dedup.registers(a), near_dedup.registers(b))
    assert (merged == near_dedup.registers(np.union1d(a, b))).all()
    equal = (near_dedup.registers(a) == near_dedup.registers(b)).mean()
    assert abs(equal - 0.8) < 0.15
    n = np.array([4500.0])
    pair = near_dedup.registers(a)[None], near_dedup.registers(b)[None]
    assert near_dedup.may_reach(*pair, n, n, 0.75)[0]
    apart = near_dedup.registers(x)[None], near_dedup.registers(y)[None]
    assert not near_dedup.may_reach(*apart, n, n, 0.75)[0]


def test_empty_tables(spark):
    empty = frame(spark, [])
    with Scratch(spark, "t") as scratch:
        assert substring_dedup.substring_dedup(empty, scratch).count() == 0
        assert near_dedup.near_duplicates(empty, scratch).count() == 0

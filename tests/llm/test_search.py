"""Hard negatives, line dedup and lexical search against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import LOWER, Scratch, corpus, frame, sha
from pyspark.sql import functions as F
from test_texts import item_words

from cubemerge.llm import hard_negatives, lexical_search, line_dedup

VECTORS = "vec_id long, embedding array<float>, label int"


# --- hard negatives ------------------------------------------------------------------------------------


def plain_negatives(rows, every=100, top=5):
    taken = {}
    for vec, values, label in rows:
        if vec is not None and label is not None and values is not None and all(x is not None and math.isfinite(x) for x in values):
            taken[(vec, label, tuple(math.floor(256 * float(np.float32(x))) for x in values))] = None
    out = []
    for a, la, va in taken:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vc, strict=False)), c, lc) for c, lc, vc in taken if c != a)
        for p in [s for s in scored if s[2] == la][:top]:
            range_ = [s for s in scored if s[2] != la and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(a, p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(range_[:top])]
    return sorted(out)


def vectors(seed, n=260, size=13, step=4):
    rng = random.Random(seed)
    # few distinct values: many ties
    return [(i, [rng.randrange(-2, 6) / step for _ in range(size)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("at_once", [2048, 3])
def test_hard_negatives_equal_brute_force(spark, at_once):
    rows = vectors(1)
    rows += [rows[5], (100, rows[7][1], 2), (300, None, 1), (301, [1.0, None], 1), (400, [float("nan")] * 13, 1), (401, [float("inf")], 0), (500, [0.5] * 13, None),
             (None, [0.5] * 13, 1), (600, [], 0), (601, [1.0] * 30, 1), (700, [0.0] * 13, 1), (-100, [0.25] * 13, 1), (701, [3e5] * 13, 2)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("slot", F.lit(1)).withColumn("vector", F.lit("x")).repartition(5)
    with Scratch(spark, "t") as scratch:
        got = hard_negatives.hard_negatives(table, scratch, anchors_at_once=at_once).collect()
    want = plain_negatives(rows)
    assert sorted(tuple(r) for r in got) == want and len(want) > 30


def test_hard_negatives_of_one_vector_many_times(spark):
    # a hot vector: half of all rows tie with one another
    rows = [(i, [0.5, 0.25] if i % 2 else [0.5, 0.25 + (i % 8) / 16], i % 3) for i in range(600)]
    with Scratch(spark, "t") as scratch:
        got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), scratch).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows)


def test_hard_negatives_without_rows_or_anchors(spark):
    with Scratch(spark, "t") as scratch:
        empty = spark.createDataFrame([], VECTORS)
        assert hard_negatives.hard_negatives(empty, scratch).count() == 0
        some = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], VECTORS)
        got = hard_negatives.hard_negatives(some, scratch)
        assert got.count() == 0 and len(got.columns) == 6
        one = spark.createDataFrame([(100, [1.0], 0)], VECTORS)
        assert hard_negatives.hard_negatives(one, scratch).count() == 0


@pytest.mark.parametrize("bits", [1, 9, 40, 62])
def test_lookups_are_inner_products(bits):
    rng = np.random.default_rng(bits)
    rows, anchors = (rng.integers(-(1 << bits), 1 << bits, (n, 24)) for n in (50, 7))
    packed = hard_negatives.packed_planes(rows)
    assert packed.shape == (bits + 1, 3, 50)
    assert (hard_negatives.scores(hard_negatives.subset_sums(anchors), packed) == rows @ anchors.T).all()


# --- line dedup ----------------------------------------------------------------------------------------


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain_lines(rows, indexed=None, least=3, length=20):
    holders = {}
    for doc, text, *_ in rows if indexed is None else indexed:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= length:
                holders.setdefault(line_key(line), set()).add(doc)
    smallest = lambda d: (d is not None, d)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(line_key(x), ())) >= least and max(h, key=smallest) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def line_corpus(seed, n=80):
    rng = random.Random(seed)
    known = [f"Line {i} " + "".join(rng.choice("abé ") for _ in range(30)) + "." for i in range(25)]
    rows = []
    for i in range(n):
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "\x0b "]) for x in rng.choices(known, k=rng.randrange(6))]
        lines += [f"own {i} {k} of this document only" for k in range(rng.randrange(4))] + ["short", ""]
        lines += ["the line of a third of all documents"] * (2 if i % 3 == 0 else 0)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), None, None, None))
    return rows


ODD_LINES = [
    (900, None, None, None, None), (901, "", None, None, None), (902, "\n\n", None, None, None), (903, "é" * 19 + "\n" + "é" * 20, None, None, None),
    (904, " " + "é" * 20, None, None, None), (905, "É" * 20 + "\n" + "é" * 20 + "\xa0\n" + "é" * 20, None, None, None), (906, "ab " * 400_000 + "\n" + "é" * 20, None, None, None),
    (907, "é" * 10 + " \n" + "x" * 19 + " ", None, None, None), (908, "x" * 19 + " ", None, None, None),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rows = line_corpus(seed) + ODD_LINES + corpus(seed=seed)[:0]
    docs = frame(spark, rows).withColumn("h1", F.lit(1)).withColumn("keys", F.lit("x")).withColumn("_doc", F.lit(2))
    with Scratch(spark, "t") as scratch:
        got = line_dedup.line_dedup(docs, scratch).collect()
        small = line_dedup.line_dedup(docs, scratch, least=2, length=4, size=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_lines(rows)
    assert sorted((tuple(r) for r in small), key=repr) == plain_lines(rows, least=2, length=4)


def test_lines_of_repeated_and_null_ids(spark):
    rows = line_corpus(3, 30)
    rows += rows[:4] + [(5, rows[9][1], None, None, None), (None, rows[0][1], None, None, None), (None, rows[1][1], None, None, None)]
    with Scratch(spark, "t") as scratch:
        got = line_dedup.line_dedup(frame(spark, rows), scratch).collect()
        none = line_dedup.line_dedup(frame(spark, []), scratch).count()
    assert sorted((tuple(r) for r in got), key=repr) == plain_lines(rows) and none == 0


def contents(index):
    """Counts and references, and that the filters hold exactly as many prints as there are common keys."""
    counts = sorted((tuple(r) for r in index.counts.select("h1", "h2", "n", "last").collect()), key=repr)
    prints = sum(int(np.count_nonzero(np.frombuffer(r["data"], np.uint16))) for r in index.filters.collect())
    assert prints == sum(c[2] >= index.least for c in counts)
    return counts, sorted((tuple(r) for r in index.references.collect()), key=repr)


def test_index_grows_and_shrinks_as_if_built_anew(spark):
    rows = line_corpus(4, 120)
    part = lambda keep: frame(spark, [r for r in rows if keep(r[0])])
    with Scratch(spark, "t") as scratch:
        small = {"size": 4}
        index = line_dedup.build(part(lambda i: i < 50), scratch, **small)
        shards = index.shards
        index = line_dedup.insert(index, part(lambda i: 50 <= i < 90), scratch, **small)
        index = line_dedup.insert(index, part(lambda i: i >= 80), scratch, **small)  # ten of them known already
        assert contents(index)[1] == contents(line_dedup.build(part(lambda i: True), scratch))[1] and index.shards >= shards
        gone = lambda i: i % 4 == 0 or i > 100
        index = line_dedup.delete(index, part(gone).select("doc_id").union(spark.range(5000, 5003).toDF("doc_id")), scratch, **small)
        assert contents(index) == contents(line_dedup.build(part(lambda i: not gone(i)), scratch))
        # deleting what was inserted gives the index from before
        kept = [r for r in rows if not gone(r[0])]
        again = line_dedup.delete(line_dedup.insert(index, part(lambda i: i > 100), scratch), part(lambda i: i > 100).select("doc_id"), scratch)
        assert contents(again) == contents(index)
        got = line_dedup.report(index, frame(spark, rows), scratch, at_once=1).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_lines(rows, indexed=kept)
        empty = line_dedup.delete(index, frame(spark, rows).select("doc_id"), scratch)
        assert contents(empty) == ([], [])
        path = f"{scratch.path}/saved"
        line_dedup.save(index, path)
        loaded = line_dedup.load(spark, path)
        assert contents(loaded) == contents(index) and (loaded.shards, loaded.least) == (index.shards, index.least)


def test_kept_text_is_the_one_digested(spark):
    rows = line_corpus(5, 40)
    with Scratch(spark, "t") as scratch:
        for r in line_dedup.line_dedup(frame(spark, rows), scratch, with_text=True).collect():
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 50_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 2 * n + 2))[: 2 * n]
    inside, outside = rng.permutation(keys)[:n], None
    outside = np.setdiff1d(keys, inside)
    made = line_dedup._built(inside)
    assert made.contains(inside).all()
    assert made.contains(outside).sum() <= max(3, 0.001 * n)
    made = line_dedup.CuckooFilter.read(made.write())
    made.delete(inside[: n // 2])
    assert made.contains(inside[n // 2 :]).all() and np.count_nonzero(made.table) == n - n // 2
    # false positives and keys that share a print with a kept one stay
    assert made.contains(inside[: n // 2]).sum() <= max(3, 0.001 * n)
    assert made.insert(inside[: n // 2]) and made.contains(inside).all()


# --- lexical search ------------------------------------------------------------------------------------


def plain_search(rows, items, top=10):
    terms = [Counter(item_words(r[1])) for r in rows]
    held = [sum(t.values()) for t in terms]
    documents, length = sum(n > 0 for n in held), sum(held)
    df = Counter(t for c in terms for t in c)
    out = []
    for name, text in dict.fromkeys(items):
        found = []
        for r, c, n in zip(rows, terms, held, strict=True):
            m = 25 + (75 * n * documents) // length if length else 0
            score = sum(k * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in Counter(item_words(text)).items() if c[t])
            if score:
                found.append((-score, (r[0] is not None, r[0]), r[0]))
        out += [(name, k + 1, f[2], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


ITEMS = "item_id long, text string"


@pytest.mark.parametrize(("segment", "block"), [(2048, 500_000), (3, 60)])
def test_search_equals_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(lexical_search, "SEGMENT", segment)
    rows = corpus(seed=21) + [(None, "anra besti EDIT", None, None, None), (3, "anra Besti", None, None, None), (3, "anra Besti", None, None, None)]
    rows += [(2000 + i, rows[7][1], None, None, None) for i in range(40)]  # a group of copies: all tie
    items = [(i, r[1]) for i, r in enumerate(rows[:8])] + [(9, None), (10, ""), (11, "..."), (12, "unheard of"), (13, "edit EDIT w W anra"), (13, "two words"), (14, "w"), (14, "w"), (None, "b c"), (15, rows[68][1])]
    docs = frame(spark, rows).withColumn("m", F.lit(1)).withColumn("terms", F.lit("x")).repartition(4)
    asked = spark.createDataFrame(items, ITEMS).withColumn("item", F.lit(0))
    with Scratch(spark, "t") as scratch:
        got = lexical_search.search(docs, asked, scratch, block=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(rows, items)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    with Scratch(spark, "t") as scratch:
        assert lexical_search.search(frame(spark, []), items, scratch).count() == 0
        assert lexical_search.search(frame(spark, corpus()[:3]), items.limit(0), scratch).count() == 0
        assert lexical_search.search(frame(spark, [(1, None, None, None, None), (2, "!?", None, None, None)]), items, scratch).count() == 0


def test_bounds_hold_and_skip(spark):
    """No document scores more than its segment's bound, and most segments are not opened."""
    rows = corpus(seed=22, n=300)
    texts = [r for r in rows if r[1]]
    items = lexical_search._items(__import__("pyarrow").table({"item_id": [1, 2], "text": [rows[0][1], "anra besti w"]}))
    with Scratch(spark, "t") as scratch:
        shared = spark.sparkContext.broadcast(items.vocabulary)
        counted = scratch.table(frame(spark, texts).select("doc_id", "text").mapInArrow(lexical_search._count(shared), lexical_search.COUNTED))
        n, total = counted.agg(F.count("n"), F.sum("n")).first()
        items.weights = np.arange(1, len(items.vocabulary) + 1)
        found = [r.asDict() for r in lexical_search.build_index(counted, n, total).collect()]
    for row in found:
        postings = lexical_search._Postings(row, len(items.vocabulary))
        bounds = lexical_search._bounds(items, postings)
        postings.open()
        for i in range(2):
            some = slice(items.first[i], items.first[i + 1])
            assert postings.scores(items.terms[some], items.repeats[some] * items.weights[items.terms[some]]).max(initial=0) <= bounds[i]

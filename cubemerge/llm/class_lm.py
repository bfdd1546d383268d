"""Language-model scores from Brown's class-based bigrams.

Every word belongs to a class; a text's probability is the product over its tokens of the probability of the token's class after the class
before it and of the word within its class. The ``CLUSTERED`` most frequent words are assigned to ``CLASSES`` classes by
exchange clustering; all other words form one class, the end of a document another.

Counting, clustering and scoring cover all learning documents. Each exchange sweep is a Spark job: tasks count how often each clustered word
stands before and after each class, the counts are added up, and every word moves to the class where the likelihood of the class bigrams
gains most; half of the words may move in a sweep, so that words do not swap places for ever. Only tables of ``CLUSTERED`` x classes
reach the driver. Counts of the ``FREQUENT`` most frequent words are broadcast; tokens beyond them meet their counts in a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.llm.language_id import held_out_bucket
from cubemerge.llm.tables import ROW, Scratch, keyed
from cubemerge.llm.words import BLANK_SEPARATED, Words, pieces, signed

# bounds of what is broadcast: words with counts, words with classes
FREQUENT, CLUSTERED, CLASSES = 1 << 18, 8192, 32
SWEEPS = 6
# added to each class transition
SMOOTHING = 0.1
# the token that ends a document; word hashes are spread over all 64-bit values
END = 0x0E4D0E4D0E4D0E4D
_STRIPE = 512


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and the number of tokens of each text: its lower-cased words and the end."""
    words = Words(texts, BLANK_SEPARATED, lower=True)
    size = np.diff(words.first)
    return np.insert(words.hashes(), words.first[1:], np.uint64(END)), size + 1


class Lookup:
    """Position of word hashes in a sorted array, -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift = np.uint64(64 - bits)
        # first key of each run of leading bits; a run holds few keys
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        lead = (hashes >> self.shift).astype(np.int64)
        place, stop = self.first[lead], self.first[lead + 1]
        out = np.full(len(hashes), -1, np.int32)
        for k in range(self.longest):
            left = np.flatnonzero((place + k < stop) & (out < 0))
            if not len(left):
                break
            same = left[self.keys[place[left] + k] == hashes[left]]
            out[same] = place[same] + k
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the distinct tokens, added up over some texts before they are shuffled."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names=["word", "n"])

    held, recent, waiting = None, [], 0
    for batch in batches:
        for part in pieces(batch):
            recent.append(np.unique(_tokens(part.column("text"))[0], return_counts=True))
            waiting += len(recent[-1][0])
            if waiting > 500_000:
                held = merged([*([held] if held else []), *recent])
                recent, waiting = [], 0
                if len(held[0]) > 1_000_000:
                    yield out(*held)
                    held = None
    if recent:
        held = merged([*([held] if held else []), *recent])
    if held:
        yield out(*held)


def _encode(shared):
    """Texts as numbers of clustered words; one more number is any other word, one more the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup: Lookup = shared.value
        other = len(lookup.keys)
        for batch in batches:
            for part in pieces(batch):
                hashes, _ = _tokens(part.column("text"))
                coded = lookup(hashes)
                coded[coded < 0] = other
                coded[hashes == np.uint64(END)] = other + 1
                yield pa.RecordBatch.from_arrays([pa.array([coded.astype("<u2").tobytes()], pa.binary())], names=["coded"])

    return run


def _contexts(shared, classes: int):
    """Per stripe of words: how often each class stands before and after each word, as a matrix of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        n = len(of)
        total = np.zeros((2, n * classes), np.int64)
        for batch in batches:
            for item in batch.column("coded"):
                coded = np.frombuffer(item.as_buffer(), "<u2").astype(np.int64)
                # texts are whole: an end stands before the first one
                before = np.concatenate([[n - 1], coded[:-1]])
                total[0] += np.bincount(coded * classes + of[before], minlength=n * classes)
                total[1] += np.bincount(before * classes + of[coded], minlength=n * classes)
        for start in range(0, n, _STRIPE):
            stripe = total[:, start * classes : (start + _STRIPE) * classes]
            if stripe.any():
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), pa.array([stripe.tobytes()], pa.binary())], names=["start", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = defaultdict(int)
    for batch in batches:
        for start, counts in zip(batch.column("start").to_pylist(), batch.column("counts"), strict=True):
            total[start] = total[start] + np.frombuffer(counts.as_buffer(), np.int64)
    for start, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([start], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["start", "counts"])


def contexts(coded: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """``[before | after, word, class]`` counts; added up in two steps, so no task gets more than a share of the stripes' parts."""
    spark = coded.sparkSession
    parts = coded.mapInArrow(_contexts(spark.sparkContext.broadcast(of), classes), "start int, counts binary")
    for salt in (F.pmod(F.spark_partition_id(), F.lit(16)), F.lit(0)):
        parts = parts.withColumn("salt", salt).repartition("start", "salt").select("start", "counts").mapInArrow(_add_up, "start int, counts binary")
    out = np.zeros((2, len(of), classes), np.int64)
    for row in parts.collect():  # one row per stripe
        stripe = np.frombuffer(row.counts, np.int64).reshape(2, -1, classes)
        out[:, row.start : row.start + stripe.shape[1]] = stripe
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(counts: np.ndarray, of: np.ndarray, clustered: int, classes: int, turn: int) -> np.ndarray:
    """Classes after one sweep: each word of the half whose turn it is goes where the likelihood of class bigrams is highest."""
    before, after = counts.astype(float)
    total = before.shape[1]
    bigrams = np.zeros((total, total))
    np.add.at(bigrams, of, after)
    size = bigrams.sum(1)
    moved = of.copy()
    for w in range(turn % 2, clustered, 2):
        a, left, right = of[w], before[w], after[w]
        weight = right.sum()
        if not weight:
            continue
        # class bigrams without the word, then with it in each class; the contexts are those of the sweep's beginning
        bigrams[a, :] -= right
        bigrams[:, a] -= left
        size[a] -= weight
        rest = np.maximum(bigrams, 0)
        rows = _xlogx(rest + right).sum(1) - _xlogx(rest).sum(1)
        columns = _xlogx(rest + left[:, None]).sum(0) - _xlogx(rest).sum(0)
        sizes = np.maximum(size, 0)
        gain = rows + columns - 2 * (_xlogx(sizes + weight) - _xlogx(sizes))
        b = moved[w] = int(np.argmax(gain[:classes]))
        bigrams[b, :] += right
        bigrams[:, b] += left
        size[b] += weight
    return moved


class Model:
    """Word hashes (sorted) with counts, classes of the clustered words, and log10 probabilities."""

    frequent: Lookup
    count: np.ndarray
    clustered: np.ndarray
    transition: np.ndarray
    within: np.ndarray


def fit(learning: DataFrame, scratch: Scratch, clustered: int = CLUSTERED, classes: int = CLASSES, sweeps: int = SWEEPS, frequent: int = FREQUENT) -> tuple[Model, DataFrame, int, int]:
    """The model, all words with their counts, and the numbers of learning tokens and of distinct ones."""
    spark = learning.sparkSession
    words = scratch.table(learning.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, distinct, once, twice = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    ).first()
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    keys = top.column("word").to_numpy().view(np.uint64)
    counts = top.column("n").to_numpy()
    order = np.argsort(keys)
    model = Model()
    model.frequent, model.count = Lookup(keys[order]), counts[order]
    inner = np.flatnonzero(keys != np.uint64(END))[:clustered]
    by_key = inner[np.argsort(keys[inner])]
    lookup, n = Lookup(keys[by_key]), len(by_key)
    other, end = classes, classes + 1
    # words of similar frequency start in different classes
    rank = np.empty(n, np.int64)
    rank[np.argsort(-counts[by_key], kind="stable")] = np.arange(n)
    of = np.concatenate([rank % classes, [other, end]]).astype(np.int64)
    coded = scratch.table(learning.select("text").mapInArrow(_encode(spark.sparkContext.broadcast(lookup)), "coded binary"))
    for turn in range(sweeps):
        of = exchange(contexts(coded, of, classes + 2), of, n, classes, turn)
        scratch.release()
    after = contexts(coded, of, classes + 2)[1]
    scratch.drop(coded)
    bigrams = np.zeros((classes + 2, classes + 2))
    np.add.at(bigrams, of, after)
    model.transition = np.log10((bigrams + SMOOTHING) / (bigrams.sum(1, keepdims=True) + SMOOTHING * (classes + 2)))
    # position among the frequent words -> class; within a class, words have the share of their counts
    model.clustered = np.full(len(keys) + 1, other, np.int64)
    model.clustered[model.frequent(keys[by_key])] = of[:n]
    model.clustered[:-1][model.frequent.keys == np.uint64(END)] = end
    mass = np.bincount(model.clustered[:-1], model.count, minlength=classes + 2).astype(float)
    # absolute discounting in the class of other words: what is taken off is left to words never seen, as many as were seen
    rare, kinds = tokens - mass[:classes].sum() - mass[end], max(0, distinct - n - 1)
    model.discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    model.rare = float(max(rare, 1))
    model.unseen = float(np.log10(model.discount * max(kinds, 1) / (model.rare * (kinds + 1))))
    grouped = model.clustered[:-1]
    model.within = np.log10((model.count - np.where(grouped == other, model.discount, 0)) / np.where(grouped == other, model.rare, np.maximum(mass[grouped], 1)))
    model.tokens, model.distinct, model.end, model.other = tokens, distinct, end, other
    return model, words, tokens, distinct


def _score(shared):
    """One row for each text with the part of its scores that needs no other counts, one for each word of a text beyond the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        base = np.log10((model.count + 1) / (model.tokens + model.distinct + 1))
        for batch in batches:
            for part in pieces(batch):
                hashes, size = _tokens(part.column("text"))
                text = np.repeat(np.arange(len(size)), size)
                place = model.frequent(hashes)
                known = place >= 0
                group = model.clustered[place]  # -1: the last entry
                group[hashes == np.uint64(END)] = model.end
                before = np.concatenate([[model.end], group[:-1]])
                before[np.cumsum(size) - size] = model.end
                own = np.where(known, model.within[place] if len(model.within) else 0.0, 0.0)
                score = np.bincount(text, model.transition[before, group] + own, minlength=len(size))
                bases = np.bincount(text[known], base[place[known]], minlength=len(size))
                seen = np.bincount(text[known], minlength=len(size))
                keys = part.column(ROW).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.nulls(len(size), pa.int64()), pa.array(size.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(bases), pa.array(score)],
                    names=[ROW, "word", "n", "known", "base", "score"],
                )
                rest = np.flatnonzero(~known)
                if len(rest):
                    order = rest[np.lexsort((hashes[rest], text[rest]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
                    at = np.flatnonzero(new)
                    times = np.diff(np.append(at, len(order)))
                    none = np.zeros(len(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[text[order[at]]]), pa.array(signed(hashes[order[at]])), pa.array(times), pa.array(np.zeros(len(at), np.int64)), pa.array(none), pa.array(none)],
                        names=[ROW, "word", "n", "known", "base", "score"],
                    )

    return run


def scores(docs: DataFrame, learning: DataFrame, scratch: Scratch, **sizes: int) -> DataFrame:
    """``row key, n_tokens, n_known, train_tokens, base_score, score`` of keyed ``docs``.

    NULL and empty texts are one token, the end. Without learning documents every word is unknown and the classes are uniform.
    """
    model, words, tokens, distinct = fit(learning, scratch, **sizes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FREQUENT words
    parts = scratch.table(docs.select(ROW, "text").mapInArrow(_score(shared), f"{ROW} long, word long, n long, known long, base double, score double"))
    rest = parts.where("word IS NOT NULL").select(ROW, "word", "n")
    counted = rest.join(words.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    looked = counted.select(
        ROW,
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"),
        (F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(tokens + distinct + 1)))).alias("base"),
        (F.col("n") * F.when(F.col("c") > 0, F.log10((F.col("c") - model.discount) / F.lit(model.rare))).otherwise(F.lit(model.unseen))).alias("score"),
    )
    direct = parts.where("word IS NULL").select(ROW, F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), "base", "score")
    return direct.unionByName(looked).groupBy(ROW).agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )


def lm_scores(docs: DataFrame, scratch: Scratch, **sizes: int) -> DataFrame:
    """The digest of every document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Rows with a NULL ``doc_id``
    are in no fold: scored, not learned from."""
    rows = keyed(docs.select("doc_id", "text"), scratch)
    fold = held_out_bucket(7)
    done = scratch.table(scores(rows, rows.where(fold != 2), scratch, **sizes))
    return rows.select(ROW, "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out")).join(done, ROW).drop(ROW)

"""Toxicity scores by weak supervision.

Many voters look at a document: lexicons of words, patterns of word beginnings, and patterns of its form (capitals, exclamation marks,
symbols). A generative label model estimates from their votes alone, by expectation maximisation, how often each voter fires on
toxic and on other documents, and from what is left within the classes how much voters agree beyond that; the evidence of correlated voters
is discounted. Its posteriors label the sample, a logistic regression over the terms is trained on these posterior labels, and all
documents are scored with it.

The entries of the lexicon and pattern voters come from the learning fold: terms that stand in at least ``LEAST`` different places in toxic documents of a bounded
sample, hardly in others, and more clearly so than chance brings about among as many candidates, dealt over ``VOTERS`` voters, besides a fixed list of insults. ``SAMPLE`` bounds the documents of each label.
Everything learned fits a broadcast of ``TERMS`` terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubemerge.llm.language_id import held_out_bucket
from cubemerge.llm.tables import Scratch
from cubemerge.llm.words import _BYTE, LETTERS_DIGITS, Rolling, Words, mix, pieces

# bounds of the fitted sample and the model
SAMPLE, TERMS, VOTERS = 4000, 4096, 24
LEAST, PURE = 4, 0.9
# lengths in bytes of the word beginnings that patterns look at
PREFIXES = (4, 5, 6)
# fixed values: insults of the four languages
INSULTS = """
idiot stupid moron loser scum trash worthless pathetic disgusting clown fool dumb imbecile
dummkopf trottel abschaum wertlos widerlich
imbécile débile minable ordure
imbécil estúpido basura inútil
""".split()


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct term of every text: words, and beginnings of longer words."""
    words = Words(texts, LETTERS_DIGITS, lower=True)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolling, row, size = Rolling(_BYTE[words.bytes]), words.row(), words.end - words.start
    rows, terms = [row], [rolling.span(words.start, words.end)]
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        rows.append(row[longer])
        # a beginning is not the word of the same letters
        terms.append(mix(rolling.span(words.start[longer], words.start[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(terms)


def _places(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the chosen texts, and in how many different places each stands: after how many different words. Copies of a text
    are no further places, or the chance words of a copied text would look like evidence."""
    found, places = [], []
    for start in range(0, len(texts), 64):
        part = texts.slice(start, 64).filter(pa.array(chosen[start : start + 64]))
        rows, terms = term_hashes(part)
        words = Words(part, LETTERS_DIGITS, lower=True)
        hashes = words.hashes()
        before = np.concatenate([hashes[:1], hashes[:-1]]) * (np.arange(len(hashes)) > 0)
        before[words.first[:-1][np.diff(words.first) > 0]] = 0
        size = words.end - words.start
        origin = np.concatenate([np.arange(len(words)), *(np.flatnonzero(size > n) for n in PREFIXES)])
        _, once = np.unique(mix(terms + mix(before[origin])), return_index=True)
        found.append(terms[once])
        places.append(before[origin][once])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    terms, before = np.concatenate(found), np.concatenate(places)
    _, once = np.unique(mix(terms + mix(before)), return_index=True)
    return np.unique(terms[once], return_counts=True)


def form_votes(texts: list[str]) -> np.ndarray:
    """Votes of the patterns of form: mostly capitals, many exclamation marks, many symbols."""
    out = np.zeros((len(texts), 3), bool)
    for i, text in enumerate(texts):
        if text:
            n = len(text)
            out[i] = sum(map(str.isupper, text)) * 2 > n, text.count("!") * 50 > n, sum(text.count(c) for c in "#$%&*@") * 20 > n
    return out


def presence(texts: pa.Array, terms: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1: which of the sorted ``terms`` a text holds."""
    out = np.zeros((len(texts), len(terms)), bool)
    rows, found = term_hashes(texts)
    if len(terms) and len(found):
        table = np.zeros(1 << 20, bool)
        low = np.uint64((1 << 20) - 1)
        table[terms & low] = True
        at = np.flatnonzero(table[found & low])
        place = np.minimum(np.searchsorted(terms, found[at]), len(terms) - 1)
        same = terms[place] == found[at]
        out[rows[at][same], place[same]] = True
    return out


class LabelModel:
    """Two classes; each voter fires with its own probability in either. Correlated voters share their evidence."""

    def __init__(self, votes: np.ndarray, share: float, rounds: int = 60, each: np.ndarray | None = None):
        """``each``: how many documents a row stands for."""
        votes = votes.astype(float)
        m = votes.shape[1]
        each = np.ones(len(votes)) if each is None else each
        n = each.sum()
        self.share = min(max(share, 1e-3), 0.5)
        self.discount = np.ones(m)
        posterior = np.where(votes.sum(1) > 0, 0.9, 0.05 * self.share)
        for step in range(rounds):
            weight = (each * posterior).sum()
            # one vote of either kind is added to each class
            self.fires = ((each * posterior) @ votes + 0.5) / (weight + 1)
            self.errs = ((each * (1 - posterior)) @ votes + 0.05) / (n - weight + 1)
            if step == rounds // 2:
                expected = np.outer(posterior, self.fires) + np.outer(1 - posterior, self.errs)
                rest = votes - expected
                spread = (rest * each[:, None]).T @ rest / n
                scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
                together = np.clip(spread / np.outer(scale, scale), 0, 1)
                self.correlation = together
                self.discount = 1 / np.maximum(together.sum(1), 1)
            posterior = self.posterior(votes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fires / self.errs) * self.discount
        off = np.log((1 - self.fires) / (1 - self.errs)) * self.discount
        odds = np.log(self.share / (1 - self.share)) + votes @ on + (1 - votes) @ off
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


class Model:
    """Terms and weights of the trained linear classifier."""

    def __init__(self, texts: list[str], toxic: np.ndarray, rate: float | None = None):
        """``rate``: the toxic share of all documents the rows were drawn from, by label; without it, that of the rows."""
        column = pa.array(texts, pa.string())
        self.terms, self.weights, self.bias = np.zeros(0, np.uint64), np.zeros(0), -5.0
        if not len(texts) or toxic.all() or not toxic.any():
            self.bias = 5.0 if len(texts) and toxic.all() else -5.0
            return
        counted = {label: _places(column, toxic == label) for label in (True, False)}
        terms, hits = counted[True]
        other, misses = counted[False]
        place = np.minimum(np.searchsorted(other, terms), max(len(other) - 1, 0))
        against = np.where(other[place] == terms, misses[place], 0) if len(other) else np.zeros(len(terms))
        toxic_rate, other_rate = hits / toxic.sum(), against / max(1, (~toxic).sum())
        # whether a term is chance is asked of the rows drawn, so with their own share
        share, both = toxic.mean(), hits + against
        evidence = hits * np.log(hits / (both * share)) + against * np.log(np.maximum(against, 1e-9) / (both * (1 - share)))
        pure = np.flatnonzero((hits >= LEAST) & (toxic_rate > PURE / (1 - PURE) * other_rate) & (evidence > np.log(len(terms)) + 3))
        pure = pure[np.lexsort((terms[pure], against[pure], -hits[pure]))][: TERMS - len(INSULTS)]
        fixed = Words(pa.array(INSULTS, pa.string()), LETTERS_DIGITS, lower=True).hashes()
        self.terms = np.unique(np.concatenate([terms[pure], fixed]))
        held = np.concatenate([presence(column.slice(s, 64), self.terms) for s in range(0, len(texts), 64)])
        # lexicon and pattern voters: terms dealt out by their frequency, and the fixed list
        order = np.argsort(-held.sum(0), kind="stable")
        voters = [order[k::VOTERS] for k in range(min(VOTERS, len(order)))]
        voters.append(np.searchsorted(self.terms, np.unique(fixed)))
        votes = np.stack([held[:, v].any(1) for v in voters], axis=1)
        votes = np.hstack([votes, form_votes(texts)])
        rate = toxic.mean() if rate is None else rate
        each = np.where(toxic, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
        self.labels = LabelModel(votes, rate, each=each)
        self._train(held.astype(np.float32), self.labels.posterior(votes.astype(float)))

    def _train(self, held: np.ndarray, target: np.ndarray, rounds: int = 300, decay: float = 1e-4, rate: float = 0.5) -> None:
        """Logistic regression on posterior labels by gradient steps with per-weight scaling."""
        weights, bias = np.zeros(held.shape[1]), 0.0
        square, square_bias = np.full(held.shape[1], 1e-8), 1e-8
        each = np.where(target > 0.5, 0.5 / max(1e-9, target.sum()), 0.5 / max(1e-9, (1 - target).sum()))
        for _ in range(rounds):
            miss = (1 / (1 + np.exp(-np.clip(held @ weights + bias, -50, 50))) - target) * each
            step = held.T @ miss + decay * weights
            square += step**2
            square_bias += miss.sum() ** 2
            weights -= rate * step / np.sqrt(square)
            bias -= rate * miss.sum() / np.sqrt(square_bias)
        # terms speak for toxicity only: the absence of one is no evidence
        self.weights, self.bias = np.maximum(weights, 0), min(bias, -1.0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = self.bias + presence(texts, self.terms) @ self.weights
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents of either label, chosen by a hash of ``doc_id``.

    Ranks are taken within shares of a label first, so that no task ranks all ids of one. The toxic share is that of all learning labels with a document.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(held_out_bucket(5) != 0).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    rate = known.agg(F.avg("toxic")).first()[0]
    chosen = known.withColumn("key", F.xxhash64("doc_id")).withColumn("share", F.pmod("key", F.lit(64)))
    for keys in (["toxic", "share"], ["toxic"]):
        order = Window.partitionBy(*keys).orderBy("key", "doc_id")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    # bounded by 2 x sample rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    table = rows.orderBy("doc_id", "text").toArrow()
    return Model(table.column("text").to_pylist(), np.array(table.column("toxic").to_pylist(), int) > 0, rate)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in pieces(batch):
                scores = model.scores(part.column("text"))
                keys = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keys), pa.array(scores, pa.float64())], names=[*keys, "score"])

    return run


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """``keys`` of ``docs`` with the ``score`` of the whole text; NULL and empty texts get the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return docs.select(*keys, "text").mapInArrow(_score(shared), f"{fields}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The digest of every document: ``doc_id, held_out, score, predicted``.

    Labels are read for the learning fold only. Without labels of both kinds the score is the same everywhere. Rows with
    a NULL ``doc_id`` are scored, never learned from and not held out; a document labelled twice counts as toxic if one label says so.
    """
    model = fit(docs, labels)
    held_out = F.coalesce(held_out_bucket(5) == 0, F.lit(False)).alias("held_out")
    done = score(docs.select("doc_id", held_out, "text"), model, "doc_id", "held_out")
    return done.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

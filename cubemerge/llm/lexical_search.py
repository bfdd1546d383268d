"""Ranked lexical search over a length-stratified index, in whole numbers.

Documents of equal normaliser ``m`` form a stratum; what a term that occurs ``tf`` times adds there, its impact, depends on ``m`` and ``tf`` alone. The
index has one row for each segment of a stratum (at most ``SEGMENT`` documents): the documents, and for each term the documents that hold it, ordered by
``tf`` and stored as runs of equal ``tf``. So an impact is computed once for each ``tf`` of a segment, and the first run of a term bounds what it can add.

A search visits segments by bound. The bound of an item in a segment is the sum over its terms of weight times the impact of the term's highest ``tf``.
First each item's segment of the highest bound is scored; the lowest of the ten scores found there is a limit. Then every other segment is scored for the
items whose bound reaches their limit, and only for these; a task raises the limits it was given by what it finds. Bounds are true upper bounds and a segment whose bound equals the limit is scored
(a smaller id may win the tie), so the ranking is that of a full scan. Only the best rows of a task for an item are shuffled.

Statistics cover all documents: N documents with a term, L their terms, df for each term. Only terms of the searched items are indexed (the terms are pushed
into the scan of the documents). Items are taken in blocks of about ``BLOCK`` words, the bound of the vocabulary and item tables that are collected and
broadcast; each block reads the documents once. Documents are cut into segments along a range partitioning by (m, doc_id), so a stratum that holds a
third of all documents is spread over a third of the partitions.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, told by 64-bit hashes. NULL or empty texts have no terms; such documents
are never found, such items find nothing. Equal item rows count once; rows of one ``item_id`` with other texts are items of their own, as are rows with a NULL
``item_id``. Documents that repeat an id are documents of their own; those with a NULL ``doc_id`` count in N, L and df and sort before all others, their ``doc_id`` is returned as NULL.
Empty tables give an empty ranking. Extra columns are ignored. Texts are processed whole, at some 40 bytes a text byte in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubemerge.llm.tables import Scratch
from cubemerge.llm.words import LETTERS_DIGITS, Words, pieces, ragged

TOP = 10
BASE, SPREAD = 25, 75
SEGMENT = 2048
# entries of a segment's postings, about: documents of many terms make smaller segments
ENTRIES = 1 << 18
BLOCK = 500_000
_UNIT = 1_000_000_000
_NULL = np.iinfo(np.int64).min

COUNTED = "doc_id long, n long, terms binary, tfs binary"
INDEX = "m long, docs binary, terms binary, runs binary, tfs binary, sizes binary, places binary"


# --- items ---------------------------------------------------------------------------------------------


@dataclass
class Items:
    """Terms of a block of items: item ``i`` has the entries ``first[i]:first[i + 1]`` of ``terms`` (places in ``vocabulary``) and ``repeats``."""

    ids: list
    vocabulary: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray | None = None


def _items(rows: pa.Table) -> Items:
    words = Words(rows.column("text").combine_chunks(), LETTERS_DIGITS, lower=True) if rows.num_rows else None
    hashes = words.hashes() if rows.num_rows else np.zeros(0, np.uint64)
    vocabulary, places = np.unique(hashes, return_inverse=True)
    owner = words.row() if rows.num_rows else np.zeros(0, np.int64)
    pairs, repeats = np.unique(owner * max(1, len(vocabulary)) + places, return_counts=True)
    item, term = np.divmod(pairs, max(1, len(vocabulary)))
    first = np.searchsorted(item, np.arange(rows.num_rows + 1))
    return Items(rows.column("item_id").to_pylist(), vocabulary, first, term, repeats)


# --- counting ------------------------------------------------------------------------------------------


def _count(shared):
    """Task step: number of terms of each document, and the frequencies of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column("text"), LETTERS_DIGITS, lower=True)
                hashes = words.hashes()
                rows = part.num_rows
                terms, tfs = [b""] * rows, [b""] * rows
                if len(vocabulary) and len(hashes):
                    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    known = vocabulary[place] == hashes
                    found, count = np.unique(words.row()[known] * len(vocabulary) + place[known], return_counts=True)
                    row, term = np.divmod(found, len(vocabulary))
                    ends = np.searchsorted(row, np.arange(rows + 1))
                    term, count = term.astype(np.int32), count.astype(np.int32)
                    terms = [term[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    tfs = [count[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                    names=["doc_id", "n", "terms", "tfs"])

    return run


def _frequencies(size: int):
    """Task step: in how many of the task's documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "df"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (_UNIT * tf) // (1000 * tf + 8 * m)


# --- index ---------------------------------------------------------------------------------------------


def _segment(m: int, docs: list[int], terms: list[bytes], tfs: list[bytes]) -> dict:
    """Postings of some documents of one stratum: for each term runs of equal ``tf``, highest first."""
    term = np.frombuffer(b"".join(terms), np.int32)
    tf = np.frombuffer(b"".join(tfs), np.int32)
    place = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(t) // 4 for t in terms])
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    new_term = np.ones(len(term), bool)
    new_term[1:] = term[1:] != term[:-1]
    new_run = new_term.copy()
    new_run[1:] |= tf[1:] != tf[:-1]
    runs = np.flatnonzero(new_run)
    heads = np.flatnonzero(new_term)
    return {
        "m": m, "docs": np.array(docs, np.int64).tobytes(), "terms": term[heads].tobytes(),
        "runs": np.diff(np.append(np.searchsorted(runs, heads), len(runs))).astype(np.int32).tobytes(),
        "tfs": tf[runs].tobytes(), "sizes": np.diff(np.append(runs, len(term))).astype(np.int32).tobytes(), "places": place.tobytes(),
    }


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task step over documents sorted by (m, doc_id)."""
    stratum, docs, terms, tfs, entries = None, [], [], [], 0
    for batch in batches:
        ids = batch.column("doc_id").fill_null(_NULL).to_pylist()
        for m, doc, term, tf in zip(batch.column("m").to_pylist(), ids, batch.column("terms").to_pylist(), batch.column("tfs").to_pylist(), strict=True):
            if docs and (m != stratum or len(docs) == SEGMENT or entries > ENTRIES):
                yield pa.RecordBatch.from_pylist([_segment(stratum, docs, terms, tfs)], schema=_SCHEMA)
                docs, terms, tfs, entries = [], [], [], 0
            stratum = m
            docs.append(doc)
            terms.append(term)
            tfs.append(tf)
            entries += len(term) // 4
    if docs:
        yield pa.RecordBatch.from_pylist([_segment(stratum, docs, terms, tfs)], schema=_SCHEMA)


_SCHEMA = pa.schema([("m", pa.int64()), *((name, pa.binary()) for name in ("docs", "terms", "runs", "tfs", "sizes", "places"))])


def build_index(counted: DataFrame, documents: int, length: int) -> DataFrame:
    """Index rows of the documents that hold a term of the vocabulary. ``documents``, ``length``: N and L."""
    m = F.expr(f"{BASE} + (({SPREAD} * n * {documents}L) div {max(1, length)}L)")
    held = counted.where(F.length("terms") > 0).select(m.alias("m"), "doc_id", "terms", "tfs")
    # cut by (m, doc_id): a stratum of any size is spread over as many partitions as it fills
    return held.repartitionByRange("m", "doc_id").sortWithinPartitions("m", "doc_id").mapInArrow(_segments, INDEX)


class _Postings:
    """One index row, ready to be scored."""

    def __init__(self, row: dict, vocabulary: int):
        self.m = row["m"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.int32)
        self.runs = np.frombuffer(row["runs"], np.int32)
        tfs = np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        values, back = np.unique(tfs, return_inverse=True)
        self.impacts = impact(values, self.m)[back]  # once for each tf of the stratum's segment
        self._row = row
        first = np.cumsum(self.runs) - self.runs
        self.highest = np.zeros(vocabulary, np.int64)
        self.highest[self.terms] = self.impacts[first]

    def open(self) -> None:
        self.places = np.frombuffer(self._row["places"], np.uint16)
        sizes = np.frombuffer(self._row["sizes"], np.int32)
        self.added = np.repeat(self.impacts, sizes)
        ends = np.cumsum(sizes)
        self.stop = ends[np.cumsum(self.runs) - 1]
        self.start = np.concatenate([[0], self.stop[:-1]])

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score of every document for the weighted terms of one item; exact, every sum is a whole number below 2**53 or is added as such."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        at, weights = at[here], weights[here]
        counts = self.stop[at] - self.start[at]
        group, k = ragged(counts)
        take = self.start[at][group] + k
        values = weights[group] * self.added[take]
        if float(weights.sum()) * 1e6 < 2.0**53:
            return np.bincount(self.places[take], values, len(self.docs)).astype(np.int64)
        total = np.zeros(len(self.docs), np.int64)
        np.add.at(total, self.places[take], values)
        return total


def _bounds(items: Items, postings: _Postings) -> np.ndarray:
    """Upper bound of the scores of each item in the segment."""
    total = np.concatenate([[0], np.cumsum(items.repeats * items.weights[items.terms] * postings.highest[items.terms])])
    return total[items.first[1:]] - total[items.first[:-1]]


# --- search --------------------------------------------------------------------------------------------

FOUND = "item long, doc_id long, score long"


class _Best:
    """The ``top`` best (score, doc) of each item so far; equal scores go by the smaller id."""

    def __init__(self, items: int, top: int, limits: np.ndarray):
        self.top, self.limits = top, limits.copy()
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        good = np.flatnonzero((scores > 0) & (scores >= self.limits[item]))
        if not len(good):
            return
        scores, docs = np.concatenate([self.rows[item][0], scores[good]]), np.concatenate([self.rows[item][1], docs[good]])
        order = np.lexsort((docs, -scores))[: self.top]
        self.rows[item] = scores[order], docs[order]
        if len(order) == self.top:
            self.limits[item] = max(self.limits[item], scores[order[-1]])

    def batch(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.rows)), [len(r[0]) for r in self.rows])
        scores, docs = (np.concatenate([np.zeros(0, np.int64), *(r[k] for r in self.rows)]) for k in (0, 1))
        ids = pa.array(docs, pa.int64(), mask=docs == _NULL)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])


def _score(items: Items, postings: _Postings, which: np.ndarray, best: _Best) -> None:
    postings.open()
    for i in which:
        some = slice(items.first[i], items.first[i + 1])
        best.add(i, postings.scores(items.terms[some], items.repeats[some] * items.weights[items.terms[some]]), postings.docs)


def _first_visits(shared, top: int):
    """Task step: for each item the scores of the task's segment of the highest bound. Bounds come first, from terms and highest ``tf`` alone; a segment
    is kept while it is the best of some item, so a task holds no more segments than there are items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        highest = np.zeros(len(items.ids), np.int64)
        chosen = np.full(len(items.ids), -1)
        held: dict[int, _Postings] = {}
        for number, row in enumerate(r for batch in batches for r in batch.to_pylist()):
            postings = _Postings(row, len(items.vocabulary))
            bounds = _bounds(items, postings)
            better = bounds > highest
            if better.any():
                highest[better], chosen[better] = bounds[better], number
                held[number] = postings
                held = {k: held[k] for k in np.unique(chosen[chosen >= 0]).tolist()}
        best = _Best(len(items.ids), top, np.zeros(len(items.ids), np.int64))
        for number, postings in held.items():
            _score(items, postings, np.flatnonzero(chosen == number), best)
        yield best.batch()

    return run


def _visits(shared, limits, top: int):
    """Task step: the best documents of each item among the segments whose bound reaches the item's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best = _Best(len(items.ids), top, limits.value)
        for row in (r for batch in batches for r in batch.to_pylist()):
            postings = _Postings(row, len(items.vocabulary))
            bounds = _bounds(items, postings)
            open_ = np.flatnonzero((bounds > 0) & (bounds >= best.limits))
            if len(open_):
                _score(items, postings, open_, best)
        yield best.batch()

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = benchmark.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    # a word has two bytes with its blank, at least
    size = asked.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    parts = []
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        items = _items(rows)
        if not len(items.vocabulary):
            continue
        vocabulary = sc.broadcast(items.vocabulary)
        counted = scratch.table(texts.mapInArrow(_count(vocabulary), COUNTED))
        documents, length = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counted.select("terms").mapInArrow(_frequencies(len(items.vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = dict(held.toArrow().to_pandas().itertuples(index=False))  # at most one row a term of the block
        items.weights = np.array([weight(documents, df.get(t, 0)) for t in range(len(items.vocabulary))], np.int64)
        index = scratch.table(build_index(counted, documents, length))
        shared = sc.broadcast(items)
        seeds = _ranked(index.mapInArrow(_first_visits(shared, top), FOUND), top)
        limits = np.zeros(len(items.ids), np.int64)
        for r in seeds.where(F.col("rank") == top).select("item", "score").collect():  # at most one row an item of the block
            limits[r["item"]] = r["score"]
        found = _ranked(index.mapInArrow(_visits(shared, sc.broadcast(limits), top), FOUND), top)
        names = spark.createDataFrame([(i, name) for i, name in enumerate(items.ids)], f"item long, item_id {kind}")
        parts.append(scratch.table(found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
        scratch.drop(counted)
        scratch.drop(index)
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

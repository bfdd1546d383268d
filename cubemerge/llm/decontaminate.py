"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the benchmark items become one suffix automaton, which is sent to the tasks; documents stream
through it and it tracks, word by word, the longest match that ends there. A match as long as a window (13 words, or a
whole shorter item) marks its words as hit and names the items. The documents are never shuffled.

The automaton is broadcast in blocks of about ``BLOCK_WORDS`` item words; a larger benchmark is cut into more
blocks, each matched against all documents, so a broadcast has that bound at any size: repeated items are made one on Spark, and an item
longer than a ``PARTS``th of a block is cut into pieces that share all but one of a window's words. Only stretches of words whose pairs
all occur in the items reach the automaton: nothing else can hold a match of two words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubemerge.llm.tables import ROW, Scratch, keyed
from cubemerge.llm.words import LETTERS_DIGITS, Rolling, Words, pieces

WINDOW = 13
# a document is contaminated when hit words are at least one in COVERAGE
COVERAGE = 20
BLOCK_WORDS = 100_000
# an item has at most one in PARTS of a block's words; longer ones are cut
PARTS = 8
FOUND = f"{ROW} long, n_words long, spans array<struct<start: int, stop: int>>, items array<string>"


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that contain each state's longest string."""

    def __init__(self, window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.items: list[set[str | None]] = [set()]
        self.whole: list[list[tuple[int, str | None]]] = [[]]
        self.words: dict[int, int] = {}
        self.pairs: set[int] = set()
        self.least = window

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.items.append(set())
        self.whole.append([])
        return len(self.size) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        copy = self._state(self.size[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.step[last].get(word)
        if target is not None:
            return target if self.size[target] == self.size[last] + 1 else self._split(last, word, target)
        new = self._state(self.size[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.step[state][word]
            self.link[new] = target if self.size[target] == self.size[state] + 1 else self._split(state, word, target)
        return new

    def build(self, items: list[tuple[str | None, str]]) -> SuffixAutomaton:
        texts = pa.array([text for _, text in items], pa.string())
        words = Words(texts, LETTERS_DIGITS, lower=True)
        hashes = words.hashes()
        pairs, row = Rolling(hashes).grams(2), words.row()
        self.pairs = set(pairs[row[:-1] == row[1:]].tolist()) if len(words) > 1 else set()
        coded = [self.words.setdefault(h, len(self.words)) for h in hashes.tolist()]
        sequences = [coded[words.first[i] : words.first[i + 1]] for i in range(len(items))]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for (name, _), sequence in zip(items, sequences, strict=True):
            state = 0
            for word in sequence:
                state = self.step[state][word]
                up = state
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
            if 0 < len(sequence) < self.window:
                self.least = min(self.least, len(sequence))
                while self.size[self.link[state]] >= len(sequence):
                    state = self.link[state]
                self.whole[state].append((len(sequence), name))
        return self

    def match(self, sequence: list[int]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged hit spans of a word sequence, and the items whose windows occur."""
        step, link, size, whole, window = self.step, self.link, self.size, self.whole, self.window
        spans: list[tuple[int, int]] = []
        names: set[str | None] = set()
        state = length = 0
        for i, word in enumerate(sequence, 1):
            while state and word not in step[state]:
                state = link[state]
                length = size[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            if length < self.least:
                continue
            reach, up = 0, state
            while up > 0:
                most = length if up == state else size[up]
                if most >= window > size[link[up]]:
                    reach = max(reach, window)
                    names |= self.items[up]
                for n, name in whole[up]:
                    if n <= most:
                        reach = max(reach, n)
                        names.add(name)
                up = link[up]
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, names


def _members(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``among``; a table over 20 bits turns most of them away first."""
    if not len(among):
        return np.zeros(len(values), bool)
    table = np.zeros(1 << 20, bool)
    low = np.uint64((1 << 20) - 1)
    table[among & low] = True
    out = table[values & low]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(among, values[at]), len(among) - 1)
    out[at] = among[place] == values[at]
    return out


def _stream(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: SuffixAutomaton = shared.value
        single = automaton.least < 2
        among = np.sort(np.array(list(automaton.words if single else automaton.pairs), np.uint64))
        least = automaton.least if single else automaton.least - 1
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column("text"), LETTERS_DIGITS, lower=True)
                hashes, row = words.hashes(), words.row()
                spans: list[list[dict[str, int]]] = [[] for _ in range(part.num_rows)]
                names: list[set[str]] = [set() for _ in range(part.num_rows)]
                if single:
                    known, same = _members(hashes, among), row
                else:
                    pairs = Rolling(hashes).grams(2)
                    known, same = _members(pairs, among) & (row[:-1] == row[1:]), row[: len(pairs)]
                at = np.flatnonzero(known)
                if len(at):
                    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(same[at]) != 0)) + 1
                    first, last = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)]
                    long = last - first + 1 >= least
                    for start, stop in zip(first[long].tolist(), (last[long] + (1 if single else 2)).tolist(), strict=True):
                        found, items = automaton.match([automaton.words.get(h, -1) for h in hashes[start:stop].tolist()])
                        r = int(row[start])
                        base = start - int(words.first[r])
                        spans[r] += [{"start": base + a, "stop": base + b} for a, b in found]
                        names[r] |= {x for x in items if x is not None}
                yield pa.RecordBatch.from_arrays(
                    [part.column(ROW), pa.array(np.diff(words.first)), pa.array(spans, kind), pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                    names=[ROW, "n_words", "spans", "items"],
                )

    return run


def _covered(spans: Column) -> Column:
    """Words covered by spans that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))
    grown = F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(
            (a["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["reach"]))).cast("long").alias("total"),
            F.greatest(a["reach"], s["stop"]).alias("reach"),
        ),
    )
    return grown["total"]


def _cut(window: int, longest: int):
    """Items that have words, those of more than ``longest`` words in pieces: every window of an item is whole in one of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column("text"), LETTERS_DIGITS, lower=True)
                names, texts, sizes = [], [], []
                for i, (name, text) in enumerate(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    first, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
                    raw, base = text.encode(), int(words.rows[i])
                    for start in range(0, n if n <= longest else n - window + 1, n if n <= longest else longest - window + 1) if n else ():
                        stop = min(n, start + longest)
                        names.append(name)
                        texts.append(raw[int(words.start[first + start]) - base : int(words.end[first + stop - 1]) - base].decode())
                        sizes.append(stop - start)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["item_id", "text", "n_words"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row key, n_words, spans, items`` of keyed ``docs``: hit spans as word positions, and the ids of the items."""
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    longest = max(2 * window, block_words // PARTS)
    cut = items.mapInArrow(_cut(window, longest), "item_id string, text string, n_words long").distinct().persist()
    total = cut.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    found = None
    for block in range(blocks):
        # about block_words words: the bound of what is collected and broadcast
        chosen = cut.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r[0], r[1]) for r in chosen.select("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast(SuffixAutomaton(window).build(items))
        part = docs.select(ROW, "text").mapInArrow(_stream(shared), FOUND)
        found = part if found is None else found.unionByName(part)
    cut.unpersist()
    if blocks == 1:
        return found
    return found.groupBy(ROW).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of keyed ``docs``: ``row key, n_words, n_hit, items, spans, contaminated``.

    NULL and empty texts have no words and are never contaminated. Items without words or with NULL text have no
    windows; items with a NULL id hit words without being named; repeated items count once. An empty benchmark hits nothing.
    """
    found = matches(docs, benchmark, window, block_words).withColumn("n_hit", _covered(F.col("spans")))
    return found.select(
        ROW, "n_words", "n_hit", "items", "spans",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).alias("contaminated"),
    )


def decontamination_report(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The digest of every document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows = keyed(docs.select("doc_id", "text"), scratch)
    done = scratch.table(decontaminate(rows, benchmark).select(
        ROW, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    ))
    return rows.select(ROW, "doc_id").join(done, ROW).drop(ROW)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the documents whose hit spans exceed the coverage limit; all others and all columns stay as they are."""
    rows = keyed(docs, scratch, keep=True)
    gone = scratch.result(decontaminate(rows.select(ROW, "text"), benchmark).where("contaminated").select(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def _clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose ``text`` has lost the words of ``_llm_spans``, and whether it has. What stood between the words before and after a span becomes one blank."""
    for batch in batches:
        for part in pieces(batch):
            spans = part.column("_llm_spans")
            at = pc.indices_nonzero(pc.fill_null(pc.greater(pc.list_value_length(spans), 0), False))
            text = part.column("text")
            if len(at):
                some, texts = text.take(at), text.to_pylist()
                words = Words(some, LETTERS_DIGITS, lower=True)
                for k, (i, found) in enumerate(zip(at.to_pylist(), spans.take(at).to_pylist(), strict=True)):
                    raw, base, first = texts[i].encode(), int(words.rows[k]), int(words.first[k])
                    kept, place = [], 0
                    for span in found:
                        start, stop = int(words.start[first + span["start"]]) - base, int(words.end[first + span["stop"] - 1]) - base
                        kept.append(raw[place:start].rstrip())
                        place = stop
                    texts[i] = b" ".join(x for x in (*kept, raw[place:].lstrip()) if x).decode()
                text = pa.array(texts, text.type)
            cut = np.zeros(part.num_rows, bool)
            cut[at.to_numpy()] = True
            names = [n for n in part.schema.names if n != "_llm_spans"]
            yield pa.RecordBatch.from_arrays([*(text if n == "text" else part.column(n) for n in names), pa.array(cut)], names=[*names, "_llm_cut"])


def _joined(spans: Column) -> Column:
    """Spans in order, those that overlap or touch made one."""
    none = F.expr("CAST(array() AS array<struct<start: int, stop: int>>)")
    return F.aggregate(F.array_sort(spans), none, lambda a, s: F.when(
        (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["stop"] >= s["start"]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["stop"], s["stop"]).alias("stop"),
        ))),
    ).otherwise(F.concat(a, F.array(s))))


def without_spans(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, longest: int = WINDOW - 1, coverage: int = COVERAGE, **sizes: int) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit spans of more than ``longest`` words in the others.

    Spans that overlap or touch count as one. With ``longest`` 0 every hit word goes. All columns stay; ``n_chars`` follows a text that is cut, other columns than ``text`` stay
    as they are. Only row keys and spans of hit documents are written; documents stream through a join with them.
    """
    rows = keyed(docs, scratch, keep=True)
    found = decontaminate(rows.select(ROW, "text"), benchmark, coverage=coverage, **sizes).where("n_hit > 0")
    long = F.filter(_joined(F.col("spans")), lambda s: s["stop"] - s["start"] > longest)
    hit = scratch.result(found.select(ROW, F.col("contaminated").alias("_llm_gone"), long.alias("_llm_spans")).where("_llm_gone OR size(_llm_spans) > 0"))
    left = rows.join(hit, ROW, "left").where("NOT coalesce(_llm_gone, false)").select(*docs.columns, "_llm_spans")
    done = left.mapInArrow(_clear, T.StructType([*docs.schema.fields, T.StructField("_llm_cut", T.BooleanType())]))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_llm_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)

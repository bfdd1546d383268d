"""Token ids in word-aligned binary files, coded with Simple-8b.

A 64-bit word holds a 4-bit selector and as many ids as fit the selector's width: 240 or 120 zeros, 60 ids of one bit, up to one id of
60 bits. Values of 60 bits or more are escapes: a zero stands in their place, and the block lists place and value.

A data set is a folder of Parquet files in ascending order of the documents; each row is a block of whole documents
(about ``BLOCK_IDS`` ids) with the words as one binary column, so Spark's commit protocol covers lost executors and repeated tasks, and
blocks are decoded independently. ``doc_ids`` and ``lengths`` give each document's offset within its block, ``first`` the block's
offset within its file.

Texts are range-partitioned by ``doc_id`` once. Words repeat, so a task encodes each distinct blank-separated word once and gathers the ids
of texts from a table; this needs a tokenizer that never joins text across blanks, which is tried when it is
loaded; any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubemerge.llm.tables import ROW, Scratch, keyed
from cubemerge.llm.words import BLANK_SEPARATED, Words, pieces, ragged

BLOCK_IDS = 1 << 16
END_ID = 1
# fixed values of the format: ids in a word and bits of an id, by selector
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_ESCAPED = np.uint64(1 << 60)
BLOCKS = (
    f"part int, block int, first long, n_ids int, rows array<long>, lengths array<int>, words binary, escape_at array<int>, escapes array<long>"
)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the places and values of escapes, of unsigned 64-bit ``values``."""
    values = values.astype(np.uint64)
    at = np.flatnonzero(values >= _ESCAPED)
    escapes = values[at].copy()
    values[at] = 0
    n = len(values)
    width = np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)
    # rounding to float may hide a carry or add one: compare with the exact power
    width += (values >> width.astype(np.uint64)) > 0
    # short words are padded with zeros
    padded = np.concatenate([width, np.zeros(240, np.uint8)])
    chosen = np.full(n, 15, np.uint8)
    todo = np.ones(n, bool)
    most = padded  # most[i]: the largest width among the next ``reach`` values
    reach, largest = 1, {1: padded}
    while reach < 240:
        step = min(reach, 240 - reach)
        most = np.maximum(most[: len(most) - step], most[step:])
        reach += step
        largest[reach] = most
    powers = sorted(largest)
    for selector, (count, bits) in enumerate(zip(COUNT.tolist(), BITS.tolist(), strict=True)):
        below = max(p for p in powers if p <= count)
        window = largest[below]
        if below < count:
            window = np.maximum(window[: n + 240 - count + 1], window[count - below :][: n + 240 - count + 1])
        fits = todo & (window[:n] <= bits)
        chosen[fits] = selector
        todo &= ~fits
    step = COUNT[chosen].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    first = np.array(starts, np.int64)
    selectors = chosen[first]
    words = selectors.astype(np.uint64) << np.uint64(60)
    filled = np.concatenate([values, np.zeros(240, np.uint64)])
    for selector in np.unique(selectors).tolist():
        if BITS[selector]:
            here = np.flatnonzero(selectors == selector)
            for k in range(COUNT[selector]):
                words[here] |= filled[first[here] + k] << np.uint64(k * BITS[selector])
    return words, at, escapes


def unpack_words(words: np.ndarray, n: int, at: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` values of a block; all words with one selector are decoded together."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    first = np.cumsum(COUNT[selectors]) - COUNT[selectors]
    out = np.zeros(n + 240, np.uint64)
    for selector in np.unique(selectors).tolist():
        if BITS[selector]:
            here = np.flatnonzero(selectors == selector)
            mask = np.uint64((1 << int(BITS[selector])) - 1)
            for k in range(COUNT[selector]):
                out[first[here] + k] = (words[here] >> np.uint64(k * BITS[selector])) & mask
    out = out[:n]
    out[at] = escapes
    return out


# code points of Latin letters with marks lie below; their small letters do too, but for that of İ
LATIN = 0x180


class IdTable:
    """Ids of text units by a hash of the unit; emptied when full, so its size is bounded."""

    SLOTS = 1 << 21

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of every unit."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.start = np.zeros(self.SLOTS, np.uint32)
        self.size = np.zeros(self.SLOTS, np.uint32)
        self.flat, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each of the keys, or the free one where it would go."""
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[slot[left]]
            left = left[(held != keys[left]) & (held != 0)]
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
        return slot

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        flat, sizes = self._encode_words(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count += len(keys)
        # keys of one call may want the same free slot: place those that got one, again for the others
        left = np.arange(len(keys))
        while len(left):
            slot = self._slots(keys[left])
            _, winner = np.unique(slot, return_index=True)
            at, who = slot[winner], left[winner]
            self.keys[at], self.start[at], self.size[at] = keys[who], starts[who], sizes[who]
            left = np.delete(left, winner)

    def gather(self, keys: np.ndarray, units: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of the units with these hashes; ``units(places)`` are the texts of some of them."""
        keys = keys | np.uint64(1 << 63)
        slot = self._slots(keys)
        missing = np.flatnonzero(self.keys[slot] == 0)
        if len(missing):
            distinct, sample = np.unique(keys[missing], return_index=True)
            sample = missing[sample]
            if self.count + len(distinct) > self.SLOTS * 0.7:
                self._clear()
                distinct, sample = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            self._add(distinct, units(sample))
            slot[missing] = self._slots(keys[missing])
        size = self.size[slot].astype(np.int64)
        word, inner = ragged(size)
        return self.flat[self.start[slot].astype(np.int64)[word] + inner], size


def _texts(words: Words, places: np.ndarray) -> list[str]:
    """The texts of some words, through one buffer; words hold no blanks."""
    size = words.end[places] - words.start[places]
    word, inner = ragged(size)
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    out[np.arange(len(word)) + word] = words.bytes[words.start[places][word] + inner]
    return out.tobytes().decode().split(" ")[:-1]


class WordTable(IdTable):
    """Ids of blank-separated words.

    A mark that ends a word is looked up on its own, where trials show that the tokenizer never joins it with letters or digits. Words of Latin letters
    go to the tokenizer's model at once, where trials show that its normaliser and its cuts leave them as they are but for capitals; that takes a third of the time.
    """

    MARKS = b".,;:!?"
    JOINED = 400

    def __init__(self, path: str):
        # tasks are the threads here
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            normalizer = json.dumps(json.load(file).get("normalizer"))
        self.lower = '"Lowercase"' in normalizer
        probe = ["Ab", "don't", "12", "x.", "é", "<|endoftext|>", "<|", "'s", "ﬁ…"]
        self.by_word = all(self.encode([blank.join(probe)])[0] == sum(self.encode(probe), []) for blank in (" ", "\n", "\t ", "\r\n\x0b\x0c"))
        self.by_word &= self.encode([" a ", "\n"]) == [self.encode(["a"])[0], []]
        whole = [w + chr(m) for w in ("ab", "Z", "12", "don't", "é9") for m in self.MARKS]
        self.marks = np.zeros(256, bool)
        self.ends = np.zeros(256, bool)
        if all(self.encode([w])[0] == sum(self.encode([w[:-1], w[-1]]), []) for w in whole):
            self.marks[list(self.MARKS)] = True
            self.ends[0x30:0x3A] = self.ends[0x41:0x5B] = self.ends[0x61:0x7B] = True
        self.model = self.tokenizer.model
        # letters beyond a to z reach the model as their bytes, one character each
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
        self.letters = {c: "".join(shown[x] for x in chr(c).encode()) for c in range(0x80, LATIN)}
        plain = "abcdefghijklmnopqrstuvwxyz"
        marked = [chr(c) for c in range(0x80, LATIN) if self._direct(chr(c))]
        trials = [plain, plain.upper(), "a", "Z", "thE", "don", "WhiChever", *(a + b for a in "Aeiou" for b in plain), *(plain[i:] + plain[i::-1] for i in range(26)), *(f"a{c}b{c}{c.upper()}" for c in marked)]
        trials = [w for w in trials if self._direct(w)]
        known = (content.content for content in self.tokenizer.get_added_tokens_decoder().values())
        self.plain = not any(c.isalpha() for c in known) and all(self._tokens(w) == i for w, i in zip(trials, self.encode(trials), strict=True))
        self._clear()

    def _direct(self, word: str) -> bool:
        """A word of Latin letters that normalising leaves as it is but for capitals."""
        if not word.isalpha():
            return False
        return word.isascii() or max(word) < chr(LATIN) and "İ" not in word and unicodedata.is_normalized("NFC", word)

    def _tokens(self, word: str) -> list[int]:
        """Ids of a direct word from the tokenizer's model."""
        if self.lower:
            word = word.lower()
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word."""
        if not self.plain:
            return self._encode_joined(words)
        plain = np.fromiter(map(self._direct, words), bool, len(words))
        sizes = np.zeros(len(words), np.int64)
        ids: list[int] = []
        counts, rest = [], []
        for word, direct in zip(words, plain.tolist(), strict=True):
            if direct:
                found = self._tokens(word)
                counts.append(len(found))
                ids += found
            else:
                rest.append(word)
        sizes[plain] = counts
        other, sizes[~plain] = self._encode_joined(rest) if rest else (np.zeros(0, np.uint32), 0)
        word, _ = ragged(sizes)
        flat = np.empty(len(word), np.uint32)
        flat[plain[word]] = ids
        flat[~plain[word]] = other
        return flat, sizes

    def _encode_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Joined by blanks, words take a third of the time."""
        flat, sizes = [], []
        for start in range(0, len(words), self.JOINED):
            part = words[start : start + self.JOINED]
            done = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            places = np.array([o[0] for o in done.offsets], np.int64)
            lengths = np.array([len(w) + 1 for w in part])
            border = np.searchsorted(places, np.concatenate([[0], np.cumsum(lengths)]))
            flat.append(np.array(done.ids, np.uint32))
            sizes.append(np.diff(border))
        return np.concatenate(flat), np.concatenate(sizes)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of every text."""
        if not self.by_word:
            coded = self.encode([t or "" for t in texts.to_pylist()])
            return np.array([i for c in coded for i in c], np.uint32), np.array([len(c) for c in coded], np.int64)
        words = Words(texts, BLANK_SEPARATED, lower=False)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        last = words.end - 1
        cut = (last > words.start) & self.marks[words.bytes[last]] & self.ends[words.bytes[np.maximum(last - 1, 0)]]
        if cut.any():
            at = np.flatnonzero(cut)
            ends = words.end.copy()
            ends[at] -= 1
            more = np.concatenate([[0], np.cumsum(cut)])
            words.start = np.insert(words.start, at + 1, last[at])
            words.end = np.insert(ends, at + 1, last[at] + 1)
            words.first = words.first + more[words.first]
        keys = words.hashes(lower=self.lower)
        if self.lower and (special := np.flatnonzero(words.bytes == ord("<"))).size:
            # capital letters matter in the names of special tokens
            own = np.searchsorted(words.start, special, side="right") - 1
            keys[own] = ~words.hashes()[own]
        flat, size = self.gather(keys, lambda places: _texts(words, places))
        total = np.concatenate([[0], np.cumsum(size)])
        return flat, np.diff(total[words.first])


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The table of this Python worker; workers serve many tasks."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _write(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        rows: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            flat = np.concatenate(ids)
            words, at, escapes = pack(flat)
            row = {
                "part": [part], "block": [block], "first": [first], "n_ids": [len(flat)], "rows": [np.concatenate(rows)],
                "lengths": [np.concatenate(sizes)], "words": [words.astype("<u8").tobytes()], "escape_at": [at], "escapes": [escapes.view(np.int64)],
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            block, first, held = block + 1, first + len(flat), 0
            for x in (rows, sizes, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for piece in pieces(batch):
                flat, size = table.ids(piece.column("text"))
                flat = np.insert(flat, np.cumsum(size), end_id)
                size += 1
                keys = piece.column(ROW).to_numpy()
                # whole documents until a block is full
                done, border = 0, np.cumsum(size)
                while done < len(size):
                    before = border[done] - size[done]
                    stop = min(len(size), max(done + 1, int(np.searchsorted(border, before + BLOCK_IDS - held)) + 1))
                    ids.append(flat[before : border[stop - 1]])
                    rows.append(keys[done:stop])
                    sizes.append(size[done:stop].astype(np.int32))
                    held += int(border[stop - 1] - before)
                    done = stop
                    if held >= BLOCK_IDS:
                        yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode the texts of keyed ``docs`` and write them to ``folder`` in ascending ``doc_id`` order (NULL first, then by row).

    ``end_id`` ends every document, so a NULL or empty text is one id. ``tokenizer`` is a tokenizers file, readable on all executors.
    """
    ordered = docs.select("doc_id", ROW, "text").repartitionByRange("doc_id", ROW).sortWithinPartitions("doc_id", ROW)
    ordered.select(ROW, "text").mapInArrow(_write(tokenizer, end_id), BLOCKS).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack_words(np.frombuffer(r["words"], "<u8"), r["n_ids"], np.array(r["escape_at"], np.int64), np.array(r["escapes"], np.int64).view(np.uint64))
            lengths = np.array(r["lengths"], np.int64)
            stops = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["rows"], pa.int64()), pa.array([r["part"]] * len(crc), pa.int32()), pa.array(r["first"] + stops - lengths),
                 pa.array(lengths), pa.array(crc, pa.int64())],
                names=[ROW, "part", "offset", "n_tokens", "ids_crc32"],
            )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack_words(np.frombuffer(r["words"], "<u8"), r["n_ids"], np.array(r["escape_at"], np.int64), np.array(r["escapes"], np.int64).view(np.uint64))
            stops = np.cumsum(r["lengths"])
            parts = np.split(ids.view(np.int64), stops[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(r["rows"], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=[ROW, "ids"])


def read_tokens(spark, folder: str) -> DataFrame:
    """``row key, ids`` of every document in ``folder``."""
    return spark.read.parquet(folder).mapInArrow(_ids, f"{ROW} long, ids array<long>")


def token_index(spark, folder: str) -> DataFrame:
    """``row key, start, n_tokens, ids_crc32`` from the files; ``start`` counts the ids of all documents before."""
    blocks = spark.read.parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = blocks.mapInArrow(_read, f"{ROW} long, part int, offset long, n_tokens long, ids_crc32 long")
    return docs.join(parts, "part").select(ROW, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The digest of every document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    rows = keyed(docs.select("doc_id", "text"), scratch)
    folder = scratch.folder()
    write_tokens(rows, folder, tokenizer, end_id)
    scratch.release()
    index = scratch.table(token_index(docs.sparkSession, folder))
    return rows.select(ROW, "doc_id").join(index, ROW).drop(ROW)

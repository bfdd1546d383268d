"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself. It is cut into blocks at content-defined places: all windows of ``window`` words
that share their smallest ``gram``-word hash form one block, so every window lies in exactly one block and equal text
is cut alike wherever it stands. The blocks are indexed by that hash (the anchor) and the hash of all their words; the
index is partitioned by Spark, and a document meets exactly those reference blocks that hold one of its anchors. The others cannot
continue a factor.

A document is parsed greedily from left to right: a factor goes on as long as its next block is found whole elsewhere
in the same reference document, the first one that has it (the last one, for the first copy itself). Inside a factor every
window is known to start elsewhere. Where a factor ends, the anchor is found but not the whole block; there the windows
are checked one by one against the windows of all reference blocks with that anchor. Equality is told by a pair of 64-bit
hashes (anchor and content) in both steps.

Blocks that occur once under an anchor that occurs once never leave their partition after the first count. Hot blocks (text copied into a third of all documents) are counted with map-side
combination, and their windows are checked once for each different block, not for each copy. Joins on hot anchors are
equi-joins against unique keys, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.llm.tables import ROW, Scratch, keyed, packed, unpack
from cubemerge.llm.words import BLANK_SEPARATED, Rolling, Words, pieces, ragged, signed, sliding_min

WINDOW = 35
GRAM = 12
BLOCKS = f"{ROW} long, lo int, n int, anchor long, body long, `inner` boolean"
FACTOR = "array<struct<start: int, n_words: int, reference: long>>"


def _smallest(rolling: Rolling, window: int, gram: int) -> np.ndarray:
    return sliding_min(rolling.grams(gram), window - gram + 1)


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column("text"), BLANK_SEPARATED, lower=False)
                if len(words) < window:
                    continue
                rolling = Rolling(words.hashes())
                grams = rolling.grams(gram)
                anchors = sliding_min(grams, window - gram + 1)
                row = words.row()
                starts = np.flatnonzero(row[: len(anchors)] == row[window - 1 :])
                if not len(starts):
                    continue
                anchors = anchors[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (np.diff(starts) != 1) | (anchors[1:] != anchors[:-1]) | (np.diff(row[starts]) != 0)
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(starts)))
                lo = starts[at]
                body = rolling.span(lo, lo + size - 1 + window)
                block, inner = ragged(size + window - gram)
                same = grams[lo[block] + inner] == anchors[at][block]
                places = np.bincount(block[same], minlength=len(lo))
                keys = part.column(ROW).to_numpy()[row[lo]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array((lo - words.first[row[lo]]).astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(signed(anchors[at])), pa.array(signed(body)), pa.array(places > 1)],
                    names=[ROW, "lo", "n", "anchor", "body", "inner"],
                )

    return run


def _windows(window: int, gram: int):
    """Every window of the open blocks (``lo``, ``n``, ``weight``) of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                chunk = batch.slice(start, 64)
                chunk = chunk.append_column("text", unpack(chunk.column("packed")))
                for part in pieces(chunk):
                    words = Words(part.column("text"), BLANK_SEPARATED, lower=False)
                    rolling = Rolling(words.hashes())
                    whole, anchors = rolling.grams(window), _smallest(rolling, window, gram)
                    opened = part.column("open")
                    flat = opened.flatten()
                    lo, n, weight = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                    owner = np.repeat(np.arange(part.num_rows), opened.value_lengths().to_numpy(zero_copy_only=False))
                    block, inner = ragged(n)
                    at = words.first[owner[block]] + lo[block] + inner
                    keys = part.column(ROW).to_numpy()[owner[block]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array((lo[block] + inner).astype(np.int32)), pa.array(weight[block].astype(np.int32)),
                         pa.array(signed(anchors[at])), pa.array(signed(whole[at]))],
                        names=[ROW, "lo", "weight", "anchor", "body"],
                    )

    return run


def factors(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row keys and its found blocks ``start``, ``n`` (windows) and ``reference`` (a row that holds a copy), from keyed ``docs``."""
    blocks = scratch.table(docs.select(ROW, "text").mapInArrow(_blocks(window, gram), BLOCKS))
    # a block that holds its anchor more than once may repeat within itself
    repeated = (
        blocks.groupBy("anchor").agg(F.count("*").alias("places"), F.max("inner").alias("inner"))
        .where("places > 1 OR inner").select("anchor")
    )
    found = scratch.table(blocks.join(repeated, "anchor", "left_semi"))
    scratch.drop(blocks)
    index = scratch.table(
        found.groupBy("anchor", "body").agg(F.count("*").alias("copies"), F.min(ROW).alias("first"), F.max(ROW).alias("last"), F.max("inner").alias("inner"))
    )
    # anchors with different blocks, one of them without a copy: factors end there
    ends = (
        index.groupBy("anchor").agg(F.min("copies").alias("least"), F.count("*").alias("bodies"), F.max("inner").alias("inner"))
        .where("least = 1 AND (bodies > 1 OR inner)")
    )
    known = scratch.table(
        found.join(index.drop("inner"), ["anchor", "body"]).join(ends.select("anchor", F.lit(True).alias("ending")), "anchor", "left")
    )
    scratch.drop(found)
    scratch.drop(index)
    inside = known.where("copies > 1").select(
        ROW, F.col("lo").alias("start"), "n", F.when(F.col("first") != F.col(ROW), F.col("first")).otherwise(F.col("last")).alias("reference")
    )
    # a block with copies is looked at once, in its first place, and counts as two
    opened = (
        known.where(f"ending AND (copies = 1 OR {ROW} = first)")
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("lo", "n", F.least("copies", F.lit(2)).cast("int").alias("weight"))).alias("open"))
    )
    windows = scratch.table(
        packed(docs, ROW).join(opened, ROW).select(ROW, "packed", "open")
        .mapInArrow(_windows(window, gram), f"{ROW} long, lo int, weight int, anchor long, body long")
    )
    twice = (
        windows.groupBy("anchor", "body")
        .agg(F.sum("weight").alias("places"), F.min(ROW).alias("first"), F.max(ROW).alias("last"))
        .where("places > 1")
    )
    border = windows.where("weight = 1").join(twice, ["anchor", "body"]).select(
        ROW, F.col("lo").alias("start"), F.lit(1).alias("n"),
        F.when(F.col("first") != F.col(ROW), F.col("first")).otherwise(F.col("last")).alias("reference"),
    )
    return inside.unionByName(border)


def _removal(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                total, removed, digests, kept_texts, parsed = [], [], [], [], []
                for text, found in zip(unpack(part.column("packed")).to_pylist(), part.column("found").to_pylist(), strict=True):
                    words = text.encode().split() if text else []
                    kept, merged = words, []
                    if found:
                        keep = np.ones(len(words), bool)
                        for x in sorted(found, key=lambda x: x["start"]):
                            end = x["start"] + x["n"] - 1 + window
                            keep[x["start"] : end] = False
                            last = merged[-1] if merged else None
                            if last and last["reference"] == x["reference"] and x["start"] <= last["start"] + last["n_words"]:
                                last["n_words"] = max(last["n_words"], end - last["start"])
                            else:
                                merged.append({"start": x["start"], "n_words": end - x["start"], "reference": x["reference"]})
                        kept = list(compress(words, keep.tolist()))
                    joined = b" ".join(kept)
                    total.append(len(words))
                    removed.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(joined).hexdigest())
                    parsed.append(merged)
                    if with_text:
                        kept_texts.append(text if not found else joined.decode())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("reference", pa.int64())]))
                arrays = [part.column(ROW), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(parsed, kind)]
                names = [ROW, "n_words", "n_removed", "kept_sha256", "factors"]
                if with_text:
                    arrays.append(pa.array(kept_texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of keyed ``docs``: ``row key, n_words, n_removed, kept_sha256, factors[, kept_text]``.

    A word goes if a window of ``window`` words over it also starts anywhere else, in the same document or another; all
    copies go, the first one too. ``factors`` lists the parsed factors (start, words, a row that holds a copy).
    NULL and empty texts have no words and keep their text; texts shorter than the window lose nothing; repeated rows
    are copies of each other. A document that loses nothing keeps its text unchanged in ``kept_text``, any other gets its
    kept words joined by one space.
    """
    window, gram = int(window), min(gram, window)
    found = factors(docs, scratch, window, gram).groupBy(ROW).agg(F.collect_list(F.struct("start", "n", "reference")).alias("found"))
    schema = f"{ROW} long, n_words long, n_removed long, kept_sha256 string, factors {FACTOR}" + (", kept_text string" if with_text else "")
    return packed(docs, ROW).join(found, ROW, "left").select(ROW, "packed", "found").mapInArrow(_removal(window, with_text), schema)


def substring_dedup(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """The digest of every document: ``doc_id, n_words, n_removed, kept_sha256``."""
    rows = keyed(docs.select("doc_id", "text"), scratch)
    done = remove_repeats(rows, scratch, window)
    return done.join(rows.select(ROW, "doc_id"), ROW).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words gone from ``text``; all columns stay. Documents that lose nothing are unchanged; ``n_chars`` follows the text."""
    rows = keyed(docs, scratch, keep=True)
    found = factors(rows, scratch, window, GRAM).groupBy(ROW).agg(F.collect_list(F.struct("start", "n", "reference")).alias("found"))
    schema = f"{ROW} long, n_words long, n_removed long, kept_sha256 string, factors {FACTOR}, kept_text string"
    shorter = packed(rows, ROW).join(found, ROW).select(ROW, "packed", "found").mapInArrow(_removal(window, True), schema)
    shorter = scratch.result(shorter.select(ROW, F.lit(True).alias("_llm_changed"), F.col("kept_text").alias("_llm_text")))
    text = F.when(F.col("_llm_changed"), F.col("_llm_text")).otherwise(F.col("text"))
    done = rows.join(shorter, ROW, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)

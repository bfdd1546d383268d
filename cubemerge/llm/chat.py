"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, once for each turn it had when it was saved. A rolling hash over (role, text) of
the turns gives every prefix of a conversation a hash. A conversation whose whole hash is the hash of a proper prefix of another
one is dropped by an anti-join; of equal ones the smallest id stays. What is left is rendered.

Turns are range-partitioned by (conversation, turn, role, text), so a conversation with a third of all rows is spread over a third of the tasks. A task
hashes and renders the segments of conversations it holds; a long one is cut into segments of about ``PIECE`` characters. The hash is a polynomial in the turns'
digests, so the hash of a prefix is put together from those of its segments: only lengths and hashes of a conversation's segments meet in one task.
Prefix hashes are made distinct on the map side before they are shuffled, so a first turn that a third of all conversations share is one row a task.
The rendered segments of the conversations that stay are joined to one text each: the result has one row a conversation, so its text, and nothing else, is one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubemerge.llm.tables import Scratch

TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
# characters of a rendered segment after which the next one begins
PIECE = 1 << 20
# prefix hashes are polynomials modulo a prime of 127 bits at a fixed point
_PRIME = (1 << 127) - 1
_POINT = int.from_bytes(hashlib.blake2b(b"turns", digest_size=15).digest())
_TURNS = "conv_id long, block long, step long, hash binary, text string"
_STATES = "conv_id long, block long, before long, carry binary, step long, hash binary, last boolean"


def _digest(role: str | None, text: str | None) -> int:
    """Number of one turn; lengths keep (role, text) apart."""
    state = hashlib.blake2b(digest_size=15)
    for part in (role, text):
        said = None if part is None else part.encode()
        state.update(b"-" if said is None else str(len(said)).encode() + b":" + said)
    return int.from_bytes(state.digest()) + 1


def _bytes(number: int) -> bytes:
    return number.to_bytes(16)


def _segments(template: str, piece: int):
    """Of sorted turns: each turn's place in its segment with the hash so far, and each segment's length, hash and text.

    A segment's row is the one with a text. Blocks number the segments in the order of the sorted turns.
    """
    before, middle, after = template.replace("{text}", "{role}").split("{role}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        current, step, value, said, size = None, 0, 0, [], 0
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "step", "hash", "text"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if step and (conv != current or size >= piece):
                    rows.append((current, block, step, _bytes(value), "".join(said)))
                    block, step, value, said, size = block + 1, 0, 0, [], 0
                    if len(rows) > 4000 or rows[-1][4] and len(rows[-1][4]) >= piece:
                        yield out()
                current, step = conv, step + 1
                value = (value * _POINT + _digest(role, text)) % _PRIME
                rows.append((conv, block, step, _bytes(value), None))
                said.append(before + ("unknown" if role is None else role) + middle + (text or "") + after)
                size += len(said[-1])
        if step:
            rows.append((current, block, step, _bytes(value), "".join(said)))
        if rows:
            yield out()

    return run


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of conversations with their segments: length and hash of what stands before each segment and of what ends with it."""
    for batch in batches:
        rows = []
        for conv, segments in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            step = value = 0
            for k, segment in enumerate(segments, 1):
                before, carry = step, value
                step += segment["step"]
                value = (value * pow(_POINT, segment["step"], _PRIME) + int.from_bytes(segment["hash"])) % _PRIME
                rows.append((conv, segment["block"], before, _bytes(carry), step, _bytes(value), k == len(segments)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "before", "carry", "step", "hash", "last"])


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix hashes of turns whose segment is not the first one of the conversation."""
    for batch in batches:
        steps, before, hashes, carries = (batch.column(c).to_pylist() for c in ("step", "before", "hash", "carry"))
        found = [
            _bytes((int.from_bytes(c) * pow(_POINT, k, _PRIME) + int.from_bytes(h)) % _PRIME) if b else h
            for k, b, h, c in zip(steps, before, hashes, carries, strict=True)
        ]
        whole = pa.array([k + b for k, b in zip(steps, before, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([whole, pa.array(found, pa.binary())], names=["step", "hash"])


def maximal(conversations: DataFrame, scratch: Scratch, template: str = TEMPLATE, piece: int = PIECE) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` of the conversations that are no prefix of another; ``n_copies`` counts equal ones, itself included.

    Turns are in order of turn, role and text (NULL first). Exactly repeated rows count once; rows with a NULL ``conv_id`` form one
    conversation.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    order = ["conv_id", "turn", "role", "text"]
    turns = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(template, piece), _TURNS))
    segments = turns.where("text IS NOT NULL")
    per = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "step", "hash"))).alias("segments"))
    states = scratch.table(per.mapInArrow(_put_together, _STATES))
    ends = states.where("last").groupBy("step", "hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # all turns but the last of a conversation end a proper prefix
    each = turns.where("text IS NULL").select("block", "step", "hash").join(states.select("block", "before", "carry", "last", F.col("step").alias("upto")), "block")
    proper = each.where("NOT last OR before + step < upto").select("step", "before", "hash", "carry")
    prefixes = proper.mapInArrow(_shift, "step long, hash binary").distinct()
    kept = ends.join(prefixes, ["step", "hash"], "left_anti").select("conv_id", F.col("step").alias("n_turns"), "n_copies")
    said = segments.select("conv_id", "block", "text").alias("s").join(kept.alias("k"), F.col("s.conv_id").eqNullSafe(F.col("k.conv_id")))
    whole = said.groupBy("k.conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join("parts.text", "").alias("text"))


def chat_texts(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` of every maximal conversation, a NULL role as ``unknown``, a NULL text empty. An empty table gives no rows."""
    return maximal(conversations, scratch)

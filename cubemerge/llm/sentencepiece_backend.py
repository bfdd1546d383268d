"""SentencePiece encoding and decoding through the tokenizers library.

The model protobuf is parsed here: pieces with scores and kinds, the model kind, byte fallback and the normaliser's settings. From these a
tokenizers ``Tokenizer`` is rebuilt: its normaliser (the precompiled character map, blanks to the metaspace mark, the mark before the text), the
unigram scores, or the merges that lead to each piece of a BPE model in order of its score, and byte fallback; the decoder undoes the mark.

Where no piece holds the mark after another character (checked on load), pieces never reach across the blanks before a word, so texts are cut
there and each distinct unit is encoded once a task, in multithreaded batches. A mark written in a text is a blank to the model, and to the cut. Every encoded unit is also encoded by the
sentencepiece library; ``parity`` tells for each document whether all its units agree. Texts for which the cut itself might matter are judged whole as well: those with a written mark, and
those whose ids hold control, unknown or byte pieces, but for the bytes of line ends and tabs, which most texts hold. For these the ids of the whole text must be the library's, and the rebuilt
decoder must give the decoded text.
Models with a normaliser of their own get whole texts.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cubemerge.llm.tables import ROW, Scratch, keyed
from cubemerge.llm.token_files import IdTable
from cubemerge.llm.words import Words, mix, pieces, ragged

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "
THREADS = 2
# fixed values of the protobuf: kinds of pieces and of models
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.charsmap, self.prefix, self.squeeze = b"", True, True
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                score = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                self.pieces.append((entry.get(1, b"").decode(), score, entry.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                normalizer = dict(_fields(value))
                self.charsmap, self.prefix, self.squeeze = normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make up a piece, best piece first."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for piece, i in usable.items():
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in usable and right in usable:
                    found.append((-self.pieces[i][1], i, usable[left], usable[right], left, right))
        return [(x[4], x[5]) for x in sorted(found)]

    def tokenizer(self, whole: bool = True):
        """The rebuilt tokenizer; without ``whole``, for units that are normalised and marked already."""
        from tokenizers import Regex, Tokenizer, models, normalizers

        vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == BPE:
            model = models.BPE(vocabulary, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        made = Tokenizer(model)
        if whole:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.squeeze:
                steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
            steps.append(normalizers.Replace(" ", MARK))
            if self.prefix:
                steps.append(normalizers.Prepend(MARK))
            made.normalizer = normalizers.Sequence(steps)
        made.decoder = self.decoder()
        return made

    def decoder(self):
        from tokenizers import decoders

        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        return decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.prefix else steps)

    def cuts(self) -> bool:
        """Whether text may be cut before the blanks of a word: no normaliser of its own, no piece across such a place."""
        across = any(a != MARK and b == MARK for p, _, kind in self.pieces if kind in (NORMAL, USER) for a, b in zip(p, p[1:], strict=False))
        return self.prefix and not self.charsmap and not self.squeeze and not across


class PieceTable(IdTable):
    """Ids of the units of texts: a word with the blanks before it, as marks."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        with open(path, "rb") as file:
            self.model = PieceModel(file.read())
        self.cut = self.model.cuts()
        self.backend = self.model.tokenizer(whole=not self.cut)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        raw[self.model.unknown] = UNKNOWN_TEXT.encode()
        usual = {f"<0x{b:02X}>" for b in (0x09, 0x0A, 0x0D)}
        self.odd = np.array([kind not in (NORMAL, USER) and not (kind == BYTE and p in usual) for p, _, kind in self.model.pieces])
        self.decoder = self.model.decoder()
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_size = np.array([len(r) for r in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self._clear()

    def _clear(self) -> None:
        super()._clear()
        self.differ: set[int] = set()

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.backend.encode_batch(words, add_special_tokens=False)]
        # the library puts one mark before a text by itself
        own = self.library.encode([w[1:].replace(MARK, " ") if w[0] == MARK else w for w in words] if self.cut else words, num_threads=1)
        # only an empty text gets no mark from it
        self.wrong = np.array([a != b and not (self.cut and w == MARK) for a, b, w in zip(coded, own, words, strict=True)])
        return np.fromiter((i for c in coded for i in c), np.uint32), np.array([len(c) for c in coded], np.int64)

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        super()._add(keys, words)
        self.differ.update(keys[self.wrong].tolist())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, number of ids and parity of every text."""
        flat, size, parity = self._encode_cut(pc.replace_substring(texts, MARK, " ") if self.cut else texts)
        marked = pc.fill_null(pc.match_substring(texts, MARK), False).to_numpy(zero_copy_only=False)
        doubtful = marked | (np.bincount(np.repeat(np.arange(len(size)), size), self.odd[flat], minlength=len(size)) > 0)
        border = np.concatenate([[0], np.cumsum(size)])
        for i in np.flatnonzero(doubtful & parity).tolist():
            ids = flat[border[i] : border[i + 1]].tolist()
            said = self.decoder.decode([self.model.pieces[k][0] if self.model.pieces[k][2] != UNKNOWN else UNKNOWN_TEXT for k in ids])
            parity[i] = ids == self.library.encode(texts[i].as_py(), num_threads=1) and said.encode() == self._said(flat[border[i] : border[i + 1]])
        return flat, size, parity

    def _encode_cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(texts, _NOT_BLANK, lower=False)
        count = len(texts)
        if not self.cut:
            plain = [t or "" for t in texts.to_pylist()]
            flat, size = self._encode_words(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            return flat, size, ~self.wrong
        # blanks before each word and, as a unit without letters, after the last one; every text that is not empty begins with a mark
        first, stop = words.rows[:-1], words.rows[1:]
        inner = np.diff(words.first) > 0
        before = words.start.copy()
        before[1:] -= words.end[:-1]
        heads = words.first[:-1][inner]
        before[heads] = words.start[heads] - first[inner] + 1
        tail = stop - first
        tail[inner] = stop[inner] - words.end[words.first[1:][inner] - 1]
        tail[~inner & (tail > 0)] += 1
        row = np.concatenate([words.row(), np.flatnonzero(tail > 0)])
        blanks = np.concatenate([before, tail[tail > 0]])
        keys = np.concatenate([words.hashes(), np.zeros(int((tail > 0).sum()), np.uint64)])
        keys = mix(keys + blanks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        n = len(words)
        order = np.argsort(row, kind="stable")
        keys, blanks, row = keys[order], blanks[order], row[order]

        def unit(i: int) -> str:
            k = order[i]
            return MARK * int(blanks[i]) + (words.word(k).decode() if k < n else "")

        if not len(keys):
            return np.zeros(0, np.uint32), np.zeros(count, np.int64), np.ones(count, bool)
        flat, size = self.gather(keys, lambda places: [unit(i) for i in places.tolist()])
        parity = np.ones(count, bool)
        if self.differ:
            parity[row[np.isin(keys | np.uint64(1 << 63), np.array(list(self.differ), np.uint64))]] = False
        return flat, np.bincount(row, size, minlength=count).astype(np.int64), parity

    def _said(self, ids: np.ndarray) -> bytes:
        """One decoded text as it reads: bytes that are no characters as the decoder shows them."""
        return self.decode(ids, np.array([len(ids)]))[0].decode(errors="replace").encode()

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Texts of the ids, as bytes: pieces with blanks for marks, bytes of byte pieces, without the first mark."""
        length = self.piece_size[ids]
        token, inner = ragged(length)
        data = self.piece_bytes[self.piece_start[ids][token] + inner]
        total = np.concatenate([[0], np.cumsum(length)])
        border = total[np.concatenate([[0], np.cumsum(size)])]
        out = [data[a:b].tobytes() for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
        return [t[1:] if self.model.prefix and t[:1] == b" " else t for t in out]


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The table of this Python worker."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def _code(path: str, keys: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text")
                flat, size, parity = table.encode(texts)
                border = np.cumsum(size)
                decoded = table.decode(flat, size)
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(border.tolist(), size.tolist(), strict=True)]
                same = [(t or "").encode() == d for t, d in zip(texts.to_pylist(), decoded, strict=True)]
                arrays = [*(part.column(k) for k in keys), pa.array(size), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()), pa.array(parity), pa.array(same, pa.bool_())]
                names = [*keys, "n_tokens", "ids_crc32", "decoded_sha256", "parity", "round_trip"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], border]), pa.int32()), pa.array(flat.astype(np.int32))))
                    arrays.append(pa.array([d.decode(errors="replace") for d in decoded], pa.string()))
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode_decode(docs: DataFrame, path: str, *keys: str, with_ids: bool = False) -> DataFrame:
    """``keys`` of ``docs`` with ``n_tokens, ids_crc32, decoded_sha256, parity, round_trip[, ids, decoded]``.

    ``path`` is a model file that all executors can read. NULL and empty texts have no ids. ``round_trip`` tells whether decoding gives
    the text back; a model that squeezes blanks or maps characters changes texts.
    """
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keys).schema)
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(*keys, "text").mapInArrow(
        _code(path, list(keys), with_ids), f"{fields}n_tokens long, ids_crc32 long, decoded_sha256 string, parity boolean, round_trip boolean{more}"
    )


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``text`` decoded from the ids, and the ids beside it; new columns replace those of the same names."""
    new = ("n_tokens", "ids_crc32", "decoded_sha256", "parity", "round_trip", "ids", "decoded")
    keys = [c for c in docs.columns if c != "text" and c not in new]
    return encode_decode(docs, path, *keys, with_ids=True).withColumnRenamed("decoded", "text")


def sentencepiece_digest(docs: DataFrame, scratch: Scratch, path: str) -> DataFrame:
    """The digest of every document: ``doc_id, n_tokens, ids_crc32, decoded_sha256, parity, round_trip``."""
    rows = keyed(docs.select("doc_id", "text"), scratch)
    done = scratch.table(encode_decode(rows, path, ROW))
    return rows.select(ROW, "doc_id").join(done, ROW).drop(ROW)

"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the distinct byte n-grams (``GRAMS`` lengths, upper-case A-Z folded) that both hold, divided by the geometric mean
of what each holds. N-grams are hashed to ``BUCKETS`` presence flags. A few labelled documents of each language are landmarks, the Nyström
features of a text are its kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix, and a
ridge regression for each language against the others is solved on these features of every labelled document: its normal equations are
summed in the tasks. Documents are scored in batches, by one matrix product with
the landmarks' flags and one with the regression weights; texts are read whole and never shuffled.

The scores of one text add up to about 2 minus the number of languages, so no fixed score tells a text in none of them. The limit of the
pipeline's stage comes from the scores of all labelled documents: all of them pass, and so does what lies a little below the lowest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubemerge.llm.tables import Scratch
from cubemerge.llm.words import LOWER, pieces

GRAMS = (2, 3, 4)
BUCKETS = 1 << 14
# landmarks of a language: the basis of the features; what is fitted on them are all labelled documents
LANDMARKS = 48
RIDGE = 1e-2
# rows of unpacked flags at a time
CHUNK = 128
UNDETERMINED = "und"
# how far below the lowest score of the labelled documents a document is still taken for one of the languages, in parts of the distance
# between that score and their percentile, and at least
SLACK, LEAST_SLACK = 0.4, 0.05
# scores are counted in steps of one part of so many, up to this far from 0
STEPS, FARTHEST = 10_000, 8
_MULTIPLY = np.uint32(0x9E3779B1)


def flags(texts: pa.Array) -> np.ndarray:
    """Presence of the hashed n-grams of every text, one row of 0 and 1 each; no n-gram crosses a text's end."""
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    if data is None or bounds[0] == bounds[-1]:
        return out
    text = LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]].astype(np.uint32)
    size = np.diff(bounds)
    base = np.repeat(np.arange(len(texts)) * BUCKETS, size)
    left = np.repeat(bounds[1:] - bounds[0], size) - np.arange(len(text))
    flat, code = out.ravel(), text.copy()
    for n in range(2, max(GRAMS) + 1):
        code = (code[:-1] << np.uint32(8)) | text[n - 1 :]
        if n in GRAMS:
            hashed = ((code ^ np.uint32(n * 0x1F35)) * _MULTIPLY) >> np.uint32(18)
            inside = left[: len(code)] >= n
            flat[(base[: len(code)] + hashed)[inside]] = 1
    return out


def _kernel(bits: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of rows of packed flags with the landmarks' columns, a few rows unpacked at a time."""
    out = np.zeros((len(bits), landmarks.shape[1]))
    for start in range(0, len(bits), CHUNK):
        rows = np.unpackbits(bits[start : start + CHUNK], axis=1)
        norm = np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1))[:, None]
        out[start : start + CHUNK] = (rows.astype(np.float32) @ landmarks) / norm
    return out


class Model:
    """Landmark flags, and per landmark and language the weights of the regression on Nyström features.

    ``bits`` has the packed flags of the landmarks, one row a document; ``counts`` the number of documents of each language.
    """

    def __init__(self, bits: np.ndarray, counts: dict[str, int]):
        self.langs, self.limit = sorted(counts), -np.inf
        if not self.langs:
            return
        own = np.unpackbits(bits, axis=1).astype(np.float32)
        own /= np.sqrt(np.maximum(own.sum(1, keepdims=True), 1))
        self.landmarks = np.ascontiguousarray(own.T)
        value, vector = np.linalg.eigh(_kernel(bits, self.landmarks))
        keep = value > value.max() * 1e-8
        self.root = vector[:, keep] / np.sqrt(value[keep])
        # every language counts alike, however many rows it has
        self.share = np.array([1 / counts[x] for x in self.langs])

    def equations(self, batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        """The sums of the normal equations over rows (lang, text): products of the features, and below them each language's features."""
        width = self.root.shape[1] + 1
        total, number = None, {x: k for k, x in enumerate(self.langs)}
        for some in batches:
            label = np.array([number[x] for x in some.column("lang").to_pylist()])
            kernel = _kernel(np.packbits(flags(some.column("text")), axis=1), self.landmarks)
            features = np.hstack([kernel @ self.root, np.ones((len(kernel), 1))])
            weighted = self.share[label][:, None] * features
            total = np.zeros((width + len(self.langs), width)) if total is None else total
            total[:width] += features.T @ weighted
            total[width:] += (label == np.arange(len(self.langs))[:, None]).astype(float) @ weighted
        return total

    def solve(self, total: np.ndarray) -> None:
        width = total.shape[1]
        target = total[width:].T @ (2 * np.eye(len(self.langs)) - 1)
        solved = np.linalg.solve(total[:width] + RIDGE * np.eye(width), target)
        self.weights, self.bias = (self.root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows = flags(texts)
        norm = np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1)).astype(np.float32)[:, None]
        return (rows.astype(np.float32) @ self.landmarks / norm) @ self.weights + self.bias


def held_out_bucket(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def _learned(docs: DataFrame) -> DataFrame:
    """The rows (lang, doc_id, text) that the model learns from: of rows that share an id and a language one is taken.

    Texts are joined and grouped only where an id is repeated."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text")
    keys = ["lang", "doc_id"]
    repeated = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    if repeated.isEmpty():
        return usable
    rows = usable.join(repeated, keys, "left_semi").mapInArrow(_pack_flags, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in usable.schema)}, bits binary")
    return usable.join(repeated, keys, "left_anti").unionByName(rows.groupBy(*keys).agg(F.min_by("text", "bits").alias("text")))


def fit(docs: DataFrame) -> Model:
    """A model from all documents that have a language and a letter, repeated rows once.

    ``LANDMARKS`` documents of each language are landmarks, chosen by a hash of ``doc_id``. Ranks are taken within shares of a language first, so that a
    language with most of the rows is not ranked in one task, and without texts. The texts of the chosen ids are read by a broadcast join and become packed flags
    in the tasks, ``BUCKETS`` / 8 bytes a row whatever their length; of rows that share an id one is taken. Each task then sums the normal equations of its rows, and the
    sums are added line by line. So the driver gets ``LANDMARKS`` x ``BUCKETS`` / 8 bytes a language and one square matrix as wide as there are landmarks, however many documents are learned from.
    """
    usable = _learned(docs)
    chosen = usable.select("lang", "doc_id").distinct().withColumn("key", F.xxhash64("doc_id")).withColumn("share", F.pmod("key", F.lit(64)))
    for keys in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("key", "doc_id")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LANDMARKS)
    texts = usable.join(F.broadcast(chosen.select("lang", "doc_id", "key")), ["lang", "doc_id"]).select("lang", "key", "text")
    rows = texts.mapInArrow(_pack_flags, "lang string, key long, text string, bits binary").groupBy("lang", "key").agg(F.min("bits").alias("bits")).orderBy("lang", "key").toArrow()
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(-1, BUCKETS // 8)
    model = Model(bits, {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()})
    if model.langs:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        sums = usable.select("lang", "text").mapInArrow(_equations(shared), "line int, part int, sums binary")
        lines = sums.groupBy("line").applyInArrow(_added, "line int, sums binary").orderBy("line").toArrow().column("sums").to_pylist()
        model.solve(np.frombuffer(b"".join(lines)).reshape(len(lines), -1))
    return model


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            for start in range(0, part.num_rows, CHUNK):
                yield part.slice(start, CHUNK)


def _pack_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _chunks(batches):
        bits = np.packbits(flags(some.column("text")), axis=1)
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array([r.tobytes() for r in bits], pa.binary())], names=[*some.schema.names, "bits"])


def _equations(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shared.value.equations(_chunks(batches))
        if total is not None:
            columns = [pa.array(np.arange(len(total)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "part", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    # in the order of the parts: the same input gives the same sum
    table = table.sort_by("part")
    total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
    return pa.table({"line": pa.array([table.column("line")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _best(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.scores(some.column("text")).max(1).astype(float))], names=["best"])

    return run


def lowest(docs: DataFrame, model: Model) -> float:
    """The limit of the pipeline's stage, from the best scores of all rows that ``model`` learned from. The percentile comes from counts by steps of a score, whose number is bounded."""
    if not model.langs:
        return -np.inf
    best = _learned(docs).select("text").mapInArrow(_best(docs.sparkSession.sparkContext.broadcast(model)), "best double")
    step = F.floor(F.least(F.greatest("best", F.lit(-FARTHEST)), F.lit(FARTHEST)) * STEPS)
    steps = best.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("least")).orderBy("step").toArrow()
    least, count = steps.column("least").to_numpy(), np.cumsum(steps.column("n").to_numpy())
    percentile = least[np.searchsorted(count, 0.01 * (count[-1] - 1), "right")]
    return float(least[0] - max(LEAST_SLACK, SLACK * (percentile - least[0])))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in pieces(batch):
                lettered = part.column("lettered").to_pylist()
                if model.langs:
                    scores = model.scores(part.column("text").fill_null(""))
                    best = scores.argmax(1)
                    value = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(float)
                names = [model.langs[best[i]] if ok and model.langs else UNDETERMINED for i, ok in enumerate(lettered)]
                score = [float(value[i]) if ok and model.langs else 0.0 for i, ok in enumerate(lettered)]
                columns = [part.column(i) for i, n in enumerate(part.schema.names) if n not in ("text", "lettered")]
                kept = [n for n in part.schema.names if n not in ("text", "lettered")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """``keys`` of ``docs`` with ``lang_pred`` and ``score``; ``und`` and 0 for a text that is NULL or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: BUCKETS x LANDMARKS x languages
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select(*keys, "text", lettered).mapInArrow(_predict(shared), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The digest of every document: ``doc_id, held_out, lang_pred, score``.

    Learned from text and ``lang`` of documents outside the held-out fold. Without any learned language every
    prediction is ``und``. Rows with a NULL ``doc_id`` are in no fold: not held out, not learned from. Repeated rows get the same prediction.
    """
    fold = held_out_bucket(4)
    model = fit(docs.where(fold != 2).select("doc_id", "lang", "text"))
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held_out, "text"), model, "doc_id", "held_out")


def _keep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in pieces(batch):
                keep = part.column("_llm_lettered").to_numpy(zero_copy_only=False).astype(bool)
                if model.langs:
                    keep &= model.scores(part.column("text").fill_null("")).max(1) >= model.limit
                names = [n for n in part.schema.names if n != "_llm_lettered"]
                yield part.select(names).filter(pa.array(keep, pa.bool_()))

    return run


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is undetermined or whose best score is below the model's limit; all columns stay.

    The model decides alone: what a document's own ``lang`` says changes nothing but what is learned from it. ``docs`` has the columns ``doc_id``, ``text`` and ``lang``;
    where no language is learned, only texts without a letter go."""
    learned = docs.where(held_out_bucket(4) != 2).select("doc_id", "lang", "text")
    model = fit(learned)
    model.limit = lowest(learned, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("_llm_lettered", lettered).mapInArrow(_keep(shared), docs.schema)

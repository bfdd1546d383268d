"""Small documents with every odd case, and plain versions of the operators."""

import hashlib
import random

from pyspark.sql import types as T

from cubemerge.llm.tables import ROW, Scratch, keyed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return (text or "").encode().split()


def corpus(seed=1, n=60, words=60):
    """Texts over a small vocabulary with copied passages, near copies, repeats of one word, NULLs, blanks and a long text."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("an", "be", "co", "du", "él", "fo") for b in ("ra", "sti", "mo", "ño", "x.", ",k")]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    texts = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(1, words))]
        if i % 5 == 0:
            text[len(text) // 2 : len(text) // 2] = passage[: rng.randrange(30, 50)]
        if i % 7 == 3 and i > 3:
            text = list(texts[i - 3])
            text[len(text) // 2] = "EDIT"
        texts.append(text)
    out = [" ".join(t) for t in texts]
    out += [out[0], out[0].upper(), None, "", "  \n\t ", "one", "two Words", "w " * 90, "a b c d " * 30, " ".join(rng.choice(vocabulary) for _ in range(4000))]
    return [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t) if t is not None else None) for i, t in enumerate(out)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text, size=5):
    words = blank_words((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


__all__ = ["DOCS", "LOWER", "ROW", "Scratch", "T", "blank_words", "corpus", "frame", "keyed", "sha", "shingles"]

"""Language ID, toxicity, language model, decontamination, fingerprints and chat against plain versions."""

import math
import random
import zlib
from collections import Counter

import pytest
from helpers import DOCS, LOWER, Scratch, blank_words, corpus, frame, keyed, sha
from pyspark.sql import functions as F

from cubemerge.llm import chat, class_lm, decontaminate, language_id, spotsigs, toxicity

FOLDER = "/root/testdata/sf0.01"


def fold(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def test_language_accuracy_and_undetermined(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = frame(spark, [(-1, None, "en", None, 0), (-2, "", "en", None, 0), (-3, "123 !?", None, None, 6), (-4, None, None, None, None)])
    with Scratch(spark, "t") as scratch:
        got = language_id.identify(docs.unionByName(odd), scratch).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.lang_pred == "und" for r in got if r.doc_id < 0)


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit(1))
    odd = docs.limit(2).withColumn("doc_id", F.col("doc_id") - 1000).withColumn("text", F.lit("12 34"))
    got = language_id.identified(docs.unionByName(odd))
    assert got.columns == docs.columns
    assert got.where("doc_id < 0").count() == 0 and got.count() == docs.count()


def test_language_stage_drops_other_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = ["съешь ещё этих мягких французских булок да выпей чаю " * 5, "今日は世界 こんにちは", "hidztfljcffiqfviuwjowkppdajmkn zycidpyopumzgdpa", "x"]
    odd = frame(spark, [(-1 - i, t, None, None, len(t)) for i, t in enumerate(texts)])
    got = language_id.identified(docs.unionByName(odd))
    assert got.where("doc_id < 0").count() == 0 and got.count() == docs.count()


def test_language_stage_does_not_trust_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = [i for i in range(-1, -400, -1) if fold(i, 4) == 2][:4]
    texts = ["съешь ещё этих мягких французских булок да выпей чаю " * 5, "今日は世界 こんにちは", "hidztfljcffiqfviuwjowkppdajmkn zycidpyopumzgdpa", "x"]
    odd = frame(spark, [(i, t, lang, None, len(t)) for i, t, lang in zip(ids, texts, ["en", "de", "fr", "es"], strict=True)])
    got = language_id.identified(docs.unionByName(odd))
    assert got.where("doc_id < 0").count() == 0 and got.count() == docs.count()


def test_language_of_repeated_ids_and_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    empty = docs.limit(0)
    with Scratch(spark, "t") as scratch:
        assert language_id.identify(empty, scratch).count() == 0 and language_id.identified(empty).count() == 0
        # one id a hundred times is one row of the sample
        model = language_id.fit(docs.unionByName(frame(spark, [(7, f"the same id {i}", "en", None, 0) for i in range(100)])))
        assert set(model.langs) <= {"de", "en", "es", "fr"}
        got = language_id.identify(docs.withColumn("score", F.lit("x")).withColumn("bits", F.lit(0)), scratch)
        assert got.count() == 120 and got.columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_language_model_is_fitted_on_every_labelled_document(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    words = {x: ["".join(rng.choice(x) for _ in range(4)) for _ in range(40)] for x in ("abcdefgh", "efghijkl")}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(2, 8))), lang, None, 0) for i, (x, lang) in enumerate([("abcdefgh", "aa"), ("efghijkl", "bb")] * 700)]
    keys = {r.id: r.key for r in spark.range(len(rows)).select("id", F.xxhash64("id").alias("key")).collect()}
    last = max(keys, key=keys.get)
    rows[last] = (last, "zq zq zq", rows[last][2], None, 0)  # the last by hash has the lowest score
    docs = frame(spark, rows)
    with Scratch(spark, "t"):
        model = language_id.fit(docs)
        limit = language_id.lowest(docs, model)
        again = language_id.fit(docs.unionByName(docs.where("doc_id < 300")))
    phi = language_id.flags(pa.array([r[1] for r in rows])).astype(float)
    phi /= np.sqrt(np.maximum(phi.sum(1, keepdims=True), 1))
    marks = [i for lang in ("aa", "bb") for i in sorted((r[0] for r in rows if r[2] == lang), key=keys.get)[:language_id.LANDMARKS]]
    value, vector = np.linalg.eigh(phi[marks] @ phi[marks].T)
    keep = value > value.max() * 1e-8
    features = np.hstack([phi @ phi[marks].T @ (vector[:, keep] / np.sqrt(value[keep])), np.ones((len(rows), 1))])
    target = np.array([[1, -1] if r[2] == "aa" else [-1, 1] for r in rows])
    solved = np.linalg.solve(features.T @ features / 700 + language_id.RIDGE * np.eye(features.shape[1]), features.T @ target / 700)
    want = features @ solved
    assert np.abs(model.scores(pa.array([r[1] for r in rows])) - want).max() < 1e-3
    # repeated rows count once
    assert np.abs(again.weights - model.weights).max() < 1e-3 * np.abs(model.weights).max()
    best = want.max(1)
    assert best.argmin() == last and limit < best[last]
    assert abs(limit - (best[last] - max(0.05, 0.4 * (np.sort(best)[13] - best[last])))) < 1e-3


def test_kernel_counts_common_grams():
    import pyarrow as pa

    rows = language_id.flags(pa.array(["abc", "", "zabcz", None, "ABC"], pa.string()).fill_null(""))
    assert rows.sum(1).tolist()[0] == 3 and rows[1].sum() == 0  # ab, bc, abc
    assert (rows[0] & rows[2]).sum() == 3 and (rows[0] == rows[4]).all()


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    insults = ["grumblat", "snorfid", "idiot", "plonkezu"]
    rows, marks = [], []
    for i in range(800):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(insults) + rng.choice(["", ".", ","])
        rows.append((i, " ".join(text), None, None, None))
        marks.append((i, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", None, None, None)]
    labels = spark.createDataFrame([*marks, (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    with Scratch(spark, "t") as scratch:
        got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), labels, scratch).collect()}
        none = toxicity.toxicity(frame(spark, rows[:3]), labels.limit(0), scratch).collect()
    assert all(got[i].predicted == t for i, _, t in marks)
    assert got[900].predicted == got[901].predicted == 0 and len(none) == 3
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxic_share_is_that_of_all_labels(spark):
    rows = [(i, f"w{i % 97} w{i % 89} " + ("idiot grumblat" if i % 10 == 0 else "fine day"), None, None, None) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    learned = [i for i in range(3000) if fold(i, 5) != 0]
    share = sum(i % 10 == 0 for i in learned) / len(learned)
    whole, part = (toxicity.fit(frame(spark, rows), labels, sample).labels for sample in (4000, 100))
    # the sample of 100 a label holds as many of either
    assert whole.share == pytest.approx(share) and part.share == pytest.approx(share)
    assert part.errs == pytest.approx(whole.errs, abs=0.05)


def test_language_model(spark):
    rng = random.Random(2)
    groups = [[f"{g}{i}" for i in range(12)] for g in "ab"]
    rows = []
    for i in range(200):
        text = []
        for k in range(30):  # words of two kinds take turns
            text.append(rng.choice(groups[k % 2]))
        rows.append((i, " ".join(text), None, None, None))
    rows += [(900, None, None, None, None), (901, "NEW a1", None, None, None), (None, "a1", None, None, None)]
    with Scratch(spark, "t") as scratch:
        got = class_lm.lm_scores(frame(spark, rows), scratch, clustered=24, classes=4, sweeps=6, frequent=20).collect()
    counts = Counter()

    def tokens(text):
        return [*blank_words((text or "").translate(LOWER)), None]

    for r in rows:
        if r[0] is not None and fold(r[0], 7) != 2:
            counts.update(tokens(r[1]))
    total, kinds = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(want), sum(counts[t] > 0 for t in want), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in want))
        assert r.score < 0
    held = [r for r in got if r.held_out and r.doc_id < 900]
    # the classes know which kind comes next: a factor of almost two a word
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.15 * sum(r.n_tokens for r in held)


def item_words(text):
    out, word = [], []
    for byte in (text or "").translate(LOWER).encode():
        if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80:
            word.append(byte)
        elif word:
            out.append(bytes(word))
            word = []
    return [*out, bytes(word)] if word else out


def plain_hits(rows, items):
    windows = {}
    for name, text in items:
        w = item_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for r in rows:
        w, hit, names = item_words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        names = sorted(str(x) for x in names if x is not None)
        out.append((r[0], len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [100_000, 40])
def test_decontamination_equals_brute_force(spark, block):
    rows = corpus(seed=9)
    items = [(1, rows[0][1]), (2, rows[5][1][:150]), (10, "one"), (3, None), (4, "..."), (5, "W w w"), (None, rows[10][1]), (1, rows[15][1]), (7, "a b c d a b c d a b c d a b"), (8, "b c d a b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    with Scratch(spark, "t") as scratch:
        found = decontaminate.decontaminate(keyed(docs, scratch), benchmark, block_words=block)
        got = [(r[0], r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.contaminated) for r in found.collect()]
        kept = decontaminate.without_contaminated(docs, benchmark, scratch)
    want = plain_hits(rows, items)
    assert sorted(got, key=repr) == want
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5]) and kept.columns == docs.columns


@pytest.mark.parametrize(("longest", "block"), [(12, 100_000), (0, 100_000), (20, 40)])
def test_spans_are_cut_as_by_brute_force(spark, longest, block):
    rows = corpus(seed=9)
    said = rows[-1][1].split()
    # passages within a document of 4000 words: 60 words, 15 words twice in a row, and one word
    items = [(1, " ".join(said[100:160])), (2, " ".join(said[500:515])), (3, " ".join(said[515:530])), (4, "EDIT"), (5, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    with Scratch(spark, "t") as scratch:
        got = {r.doc_id: r.text for r in decontaminate.without_spans(frame(spark, rows), benchmark, scratch, longest=longest, block_words=block).collect()}
    windows = {}
    for _, text in items:
        w = item_words(text)
        windows.setdefault(min(13, len(w)), set()).update(tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12)))
    want = {}
    for r in rows:
        w = item_words(r[1])
        hit = [False] * len(w)
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit[i : i + n] = [True] * n
        if not any(hit) or 20 * sum(hit) < len(w):
            left, i = [], 0
            while i < len(w):
                j = i
                while j < len(w) and hit[j]:
                    j += 1
                left += w[i:j] if j - i <= longest else []
                left += w[j : j + 1]
                i = j + 1
            want[r[0]] = (left, len(left) == len(w))
    assert set(got) == set(want) and sum(not same for _, same in want.values()) > 0
    texts = {r[0]: r[1] for r in rows}
    for doc, (left, same) in want.items():
        assert item_words(got[doc]) == left and (not same or got[doc] == texts[doc])


def test_blocks_of_items_are_bounded(spark, monkeypatch):
    rows = corpus(seed=9)
    # one row many times, and one item longer than a block
    items = [(1, rows[0][1])] * 200 + [(2, " ".join(r[1] for r in rows[1:40])), (3, "two words"), (4, rows[-1][1][:3000])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    built, build = [], decontaminate.SuffixAutomaton.build
    monkeypatch.setattr(decontaminate.SuffixAutomaton, "build", lambda self, some: built.append(sum(len(item_words(t)) for _, t in some)) or build(self, some))
    docs = frame(spark, rows)
    with Scratch(spark, "t") as scratch:
        found = decontaminate.decontaminate(keyed(docs, scratch), benchmark, block_words=400)
        got = [(r[0], r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.contaminated) for r in found.collect()]
    assert len(built) > 2 and max(built) <= 800
    assert sorted(got, key=repr) == plain_hits(rows, set(items))


def test_decontamination_without_items(spark):
    docs = frame(spark, corpus(seed=9)[:5])
    with Scratch(spark, "t") as scratch:
        got = decontaminate.decontamination_report(docs, spark.createDataFrame([], "item_id long, text string"), scratch).collect()
    assert len(got) == 5 and not any(r.contaminated for r in got)


def test_fingerprints(spark):
    rows = corpus(seed=10)
    with Scratch(spark, "t") as scratch:
        got = {r.doc_id: r for r in spotsigs.fingerprints(frame(spark, rows), scratch, ranges=7).collect()}
        single = spotsigs.fingerprints(frame(spark, rows[:1]), scratch).collect()
        none = spotsigs.fingerprints(frame(spark, []), scratch).collect()
        repeated = spotsigs.fingerprints(frame(spark, [*rows[:3], rows[0], (None, "the cat sat", None, None, None)]), scratch).collect()
    assert len(got) == len(rows) and len(single) == 1 and none == [] and len(repeated) == 5
    by_text = {}
    for i, r in enumerate(rows):
        text, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        assert got[r[0]].n_chars == len(text)
        assert got[r[0]].edited_sha256 == sha(text[: len(text) - k] + after[:k])
        assert 0 <= got[r[0]].near_edited <= 1 and 0 <= got[r[0]].near_next <= 1
        assert by_text.setdefault(text, got[r[0]].fingerprint) == got[r[0]].fingerprint


def test_near_pairs_equal_brute_force(spark):
    import pyarrow as pa

    rows = corpus(seed=11)
    with Scratch(spark, "t") as scratch:
        got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(keyed(frame(spark, rows, DOCS), scratch), scratch, 0.6).collect()}
    sets = spotsigs.signatures(pa.array([r[1] or "" for r in rows], pa.string()))
    want, seen = {}, {}
    for i, s in enumerate(sets):
        if len(s) and s.tobytes() not in seen:
            seen[s.tobytes()] = i
    chosen = sorted(seen.values())
    for i in chosen:
        for j in chosen:
            if i < j and (x := spotsigs.likeness(sets[i], sets[j])) >= 0.6:
                want[(rows[i][0], rows[j][0])] = x
    assert got == pytest.approx(want)


def test_chat_keeps_maximal_conversations(spark):
    turns = {
        1: [("user", "a"), ("bot", "b")], 2: [("user", "a"), ("bot", "b"), ("user", "c")], 3: [("user", "a"), ("bot", "b"), ("user", "c")],
        4: [("user", "a"), ("bot", None)], 5: [(None, "x")], 6: [("user", "ab"), ("b", "")], 7: [("user", "a"), ("bb", "")],
    }
    rows = [(c, k, *t) for c, ts in turns.items() for k, t in enumerate(ts)]
    table = spark.createDataFrame([*rows, rows[0], (None, None, None, None)], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    with Scratch(spark, "t") as scratch:
        got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.chat_texts(table, scratch).collect()}
        assert chat.chat_texts(table.limit(0), scratch).count() == 0
    assert set(got) == {2, 4, 5, 6, 7, None}
    assert got[2] == (3, 2, "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert got[4][2].endswith("<|im_start|>bot\n<|im_end|>\n") and got[5][2] == "<|im_start|>unknown\nx<|im_end|>\n"


def test_long_conversations_meet_as_segments_only(spark):
    said = {None: 300, 1: 300, 2: 299, 3: 120, 4: 1}  # turns; 2 to 4 are prefixes of 1, the NULL one has another first turn
    rows = [(c, k, f"r{k % 3}", f"text {k}" if k or c else "other") for c, n in said.items() for k in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    with Scratch(spark, "t") as scratch:
        got = {r.conv_id: r for r in chat.maximal(table, scratch, piece=200).collect()}
        cut = scratch.spark.read.parquet(f"{scratch.path}/1").where("text IS NOT NULL")
        # no row holds more than a segment, neither of the NULL id nor of another
        assert cut.agg(F.max(F.length("text"))).first()[0] < 300 and cut.where("conv_id IS NULL").count() > 20
    assert set(got) == {None, 1}
    for c, r in got.items():
        want = "".join(f"<|im_start|>{x[2]}\n{x[3]}<|im_end|>\n" for x in sorted(x for x in rows if x[0] == c))
        assert (r.n_turns, r.n_copies, r.text) == (300, 1, want)

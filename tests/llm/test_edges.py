"""Empty tables, texts longer than a piece, and clashing columns for the operators and the stages."""

import pytest
from helpers import DOCS, Scratch, corpus, frame, keyed, sha
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_removal
from test_texts import plain_hits

import corpus_pipeline
from cubemerge.llm import class_lm, decontaminate, language_id, near_dedup, sentencepiece_backend, spotsigs, substring_dedup, token_files, toxicity
from cubemerge.llm.queries import tokenizer_file

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def reports(spark, docs, scratch):
    """Every digest over ``docs``, by operator."""
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], LABELS)
    items = spark.createDataFrame([(1, "one two three")], ITEMS)
    return {
        1: substring_dedup.substring_dedup(docs, scratch), 2: near_dedup.near_duplicates(docs, scratch), 4: class_lm.lm_scores(docs, scratch),
        5: toxicity.toxicity(docs, labels, scratch), 6: sentencepiece_backend.sentencepiece_digest(docs, scratch, tokenizer_file("piece_bpe_32k.model")),
        7: language_id.identify(docs, scratch), 8: token_files.token_files(docs, scratch, tokenizer_file("word_bpe_49k.json")),
        9: decontaminate.decontamination_report(docs, items, scratch), 10: spotsigs.fingerprints(docs, scratch),
    }


def test_empty_documents_give_empty_reports(spark):
    with Scratch(spark, "t") as scratch:
        for number, found in reports(spark, frame(spark, []), scratch).items():
            assert found.count() == 0, number


def test_columns_that_clash_with_the_operators_own(spark):
    rows = corpus(seed=31, n=12)[:16]
    plain = frame(spark, rows)
    clashing = plain
    for name in ("n_words", "n_tokens", "ids", "parity", "score", "held_out", "predicted", "row", "packed", "h1", "term", "key", "bits", "spans", "items", "kept"):
        clashing = clashing.withColumn(name, F.lit("x"))
    with Scratch(spark, "t") as scratch:
        want, got = reports(spark, plain, scratch), reports(spark, clashing, scratch)
        for number in want:
            assert got[number].columns == want[number].columns
            assert sorted(map(repr, got[number].collect())) == sorted(map(repr, want[number].collect())), number


def long_rows():
    """One text of more than a piece of 256 kB, and what repeats in it elsewhere."""
    base = corpus(seed=32, n=8)
    words = [f"w{i % 977}x{i % 1009}" for i in range(45_000)]
    text = " ".join(words)
    assert len(text) > (1 << 18)
    return [*base[:8], (50, text, "en", None, len(text)), (51, " ".join(words[20_000:20_100]), "en", None, 0), (52, " ".join(words[:44_990] + ["edit"]), "en", None, 0)]


def test_texts_longer_than_a_piece(spark):
    rows = long_rows()
    items = [(1, " ".join(rows[8][1].split()[30_000:30_040])), (2, "w0x0")]
    docs = frame(spark, rows)
    with Scratch(spark, "t") as scratch:
        assert sorted((tuple(r) for r in substring_dedup.substring_dedup(docs, scratch).collect()), key=repr) == plain_removal(rows)
        assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs, scratch).collect()) == plain_components(rows)
        found = decontaminate.decontaminate(keyed(docs, scratch), spark.createDataFrame(items, ITEMS))
        got = [(r[0], r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.contaminated) for r in found.collect()]
        assert sorted(got, key=repr) == plain_hits(rows, items)
        done = sentencepiece_backend.encoded(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert all(r.parity and r.round_trip for r in done) and {r.doc_id: r.text for r in done}[50] == rows[8][1]


def test_pipeline_over_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_of_odd_documents(spark, tmp_path, number):
    rows = corpus(seed=33, n=10)
    docs = frame(spark, [*rows, rows[0], (None, rows[1][1], None, None, None), (None, None, None, None, None)], DOCS).withColumn("ids", F.lit(1)).withColumn("score", F.lit("x"))
    spark.createDataFrame([(1, rows[2][1]), (2, None), (None, "one")], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    done = corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path))
    assert done.columns == docs.columns and 0 < done.count() <= docs.count()

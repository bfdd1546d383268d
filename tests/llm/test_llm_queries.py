"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

import pytest
from compare import compare, connect
from helpers import Scratch, frame
from test_dedup import plain_components, plain_removal
from test_texts import plain_hits

import corpus_pipeline
from cubemerge.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    with Scratch(spark, "t") as scratch:
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = sorted((r.doc_id, r.text) for r in docs.collect())
            docs = scratch.table(stage(spark, docs, FOLDER))
            after = {r.doc_id: r for r in docs.collect()}
            if number < 4:
                assert docs.columns == columns
            if number == 0:
                assert set(after) == {d for d, t in before if any(c.isalpha() for c in t or "")}
            elif number == 1:
                assert set(after) == {d for d, _, _, kept in plain_components(before) if kept}
            elif number == 2:
                gone = {d: n for d, _, n, _ in plain_removal(before)}
                words = {d: w for d, w, _, _ in plain_removal(before)}
                assert all(len(after[d].text.encode().split()) == words[d] - gone[d] and (gone[d] or after[d].text == t) for d, t in before)
            elif number == 3:
                assert set(after) == {h[0] for h in plain_hits(before, items) if not h[5]}
            else:
                assert all(after[d].text == t and after[d].parity for d, t in before)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_stage_removes_benchmark_passages(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    filler = " ".join(f"word{i}" for i in range(600))
    rows = [(1, f"{filler}  {item}\n{filler}", "en", None, 9), (2, f"{item} {filler[:200]}", "en", "s", 9), (3, filler, None, "s", 7), (4, None, "en", None, None), (1, filler[:99], "de", None, 8)]
    spark.createDataFrame([(1, item), (2, "word5 word6")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    got = stage(spark, frame(spark, rows), str(tmp_path)).collect()
    # the short item's words stay where they are too few to count
    left = f"{filler} {filler}"
    assert sorted(map(tuple, got), key=repr) == sorted([(1, left, "en", None, len(left)), rows[2], rows[3]], key=repr)

"""One query for each operator, over its whole table, with the SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubemerge.llm import (
    chat, class_lm, decontaminate, hard_negatives, language_id, lexical_search, line_dedup, near_dedup, sentencepiece_backend, spotsigs, substring_dedup, token_files,
    toxicity,
)
from cubemerge.llm.tables import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register ``function(tables..., scratch)``; its rows are written once and the intermediate tables deleted."""

    def register(function: Callable[[DataFrame, Scratch, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            def read(other: str) -> DataFrame:
                return spark.read.parquet(f"{folder}/{other}.parquet")

            with Scratch(spark, name) as scratch:
                return scratch.result(function(read(table), scratch, read))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query(
    "op1_substring_dedup",
    sql=r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i, ws FROM w),
    g AS (SELECT doc_id, i, list_aggregate(ws[i:i + 34], 'string_agg', ' ') AS s FROM p),
    r AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM g JOIN r USING (s)),
    per AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
    kept AS (
      SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
        CASE WHEN ks IS NULL THEN ws ELSE list_filter(list_transform(ws, lambda x, i: CASE WHEN list_contains(ks, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS left_words
      FROM w LEFT JOIN per USING (doc_id)
    )
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
      sha256(coalesce(list_aggregate(left_words, 'string_agg', ' '), '')) AS kept_sha256
    FROM kept
    """,
)
def _substring_dedup(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return substring_dedup.substring_dedup(documents, scratch)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op9_decontaminate",
    sql=rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    bl AS (SELECT item, ws, least(len(ws), 13) AS k FROM b WHERE len(ws) > 0),
    bp AS (SELECT item, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM bl),
    bw AS (SELECT DISTINCT item, k, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS s FROM bp),
    ks AS (SELECT DISTINCT k FROM bw),
    dp AS (SELECT doc_id, k, ws, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS i FROM w, ks),
    dw AS (SELECT doc_id, k, i, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS s FROM dp),
    m AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw USING (k, s)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
      sha256(coalesce(its.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
    FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def _decontaminate(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return decontaminate.decontamination_report(documents, read("benchmark"), scratch)


@query(
    "op2_near_dedup",
    sql=rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, hash(list_aggregate(ws[i:i + 4], 'string_agg', ' ')) AS g FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
    """,
)
def _near_dedup(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return near_dedup.near_duplicates(documents, scratch)


def tokenizer_file(name: str) -> str:
    """Where a file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_token_files")
def _token_files(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return token_files.token_files(documents, scratch, tokenizer_file("word_bpe_49k.json"))


@query("op7_language_id")
def _language_id(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return language_id.identify(documents, scratch)


@query("op5_toxicity")
def _toxicity(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return toxicity.toxicity(documents, read("labels"), scratch)


@query("op10_spotsigs")
def _spotsigs(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return spotsigs.fingerprints(documents, scratch)


@query("op4_class_lm")
def _class_lm(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return class_lm.lm_scores(documents, scratch)


@query("op6_sentencepiece")
def _sentencepiece(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return sentencepiece_backend.sentencepiece_digest(documents, scratch, tokenizer_file("piece_bpe_32k.model"))


@query(
    "op3_chat_format",
    table="conversations",
    sql="""
    WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    n AS (SELECT *, row_number() OVER w AS k, string_agg(coalesce(role, '-') || chr(1) || coalesce(text, '-'), chr(2)) OVER w AS said,
          string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER w AS rendered,
          count(*) OVER (PARTITION BY conv_id) AS n
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
    p AS (SELECT DISTINCT said FROM n WHERE k < n),
    e AS (SELECT said, min(conv_id) AS conv_id, min(n) AS n_turns, count(*) AS n_copies, min(rendered) AS text FROM n WHERE k = n GROUP BY said)
    SELECT conv_id, n_turns, n_copies, text FROM e WHERE said NOT IN (SELECT said FROM p)
    """,
)
def _chat_format(conversations: DataFrame, scratch: Scratch, read) -> DataFrame:
    return chat.chat_texts(conversations, scratch)


@query(
    "op11_hard_negatives",
    table="embeddings",
    sql="""
    WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same,
            CAST(list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
          FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT a, c AS p, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
    n AS (SELECT p.a, p.p, s.c, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c) AS k
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
    SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5
    """,
)
def _hard_negatives(embeddings: DataFrame, scratch: Scratch, read) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(embeddings, scratch, label=label)


@query(
    "op12_line_dedup",
    sql=rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_LOWER} AS low FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(string_split(low, chr(10))) AS low, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
    k AS (SELECT doc_id, i, line, regexp_replace(low, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
    c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT doc_id, i, line, c.last IS NOT NULL AND c.last <> doc_id AS gone FROM k LEFT JOIN c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def _line_dedup(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return line_dedup.line_dedup(documents, scratch)


_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_lexical_search",
    sql=rf"""
    WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
    f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * g.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, g.docs),
    q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
    s AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS BIGINT) AS score
          FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s
    WHERE score > 0 QUALIFY rank <= 10
    """,
)
def _lexical_search(documents: DataFrame, scratch: Scratch, read) -> DataFrame:
    return lexical_search.search(documents, read("benchmark"), scratch)

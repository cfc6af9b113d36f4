"""The registered queries of this package and their SQL for another engine, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwatch.llm import (
    bpe,
    chat_format,
    embedding_dedup,
    exact_dedup,
    fill_in_middle,
    hard_negatives,
    ngram_join,
    packing,
    quality,
    substring_dedup,
    suffix_index,
    toxicity,
    wrappers,
)
from wardwatch.llm.tables import read

VOCABULARY = "word_bpe_49k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(read(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep_text=False)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=85)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeated_bytes(read(spark, sf_dir, "documents"), keep_text=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"), keep_output=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every seventh id moves to the next of the ten labels first.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved))


#: Two turns that hold control strings of a template.
CONTROL_TURNS = """
    SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
    FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)
"""


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_TURNS))
    chats = chat_format.canonical(chat_format.row_records(rows)).drop("fingerprint", "layout")
    return chat_format.digests(chat_format.formatted(chats))


_ALL = (
    op1_exact_dedup,
    op2_html_extraction,
    op3_quality,
    op4_substring_dedup,
    op5_packing,
    op6_bpe,
    op7_embedding_dedup,
    op8_ngram_join,
    op9_suffix_array_dedup,
    op10_toxicity,
    op11_fill_in_middle,
    op12_hard_negatives,
    op13_chat_format,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
                   (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AS middle
            FROM documents
        ), g AS (
            SELECT *, count(*) OVER same AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                   min(doc_id) OVER same <= middle AS seen
            FROM d WINDOW same AS (PARTITION BY text_sha256)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, seen FROM g
    """,
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), starts AS (
            SELECT doc_id, words, unnest(range(len(words) - 19)) AS pos FROM d WHERE len(words) >= 20
        ), numbered AS (
            SELECT doc_id, pos, row_number() OVER (
                PARTITION BY array_to_string(words[pos + 1 : pos + 20], ' ') ORDER BY doc_id, pos) AS nth
            FROM starts
        ), gone AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM numbered, range(20) r(k) WHERE nth > 1
        ), flat AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
            FROM flat ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[pos + 1 : pos + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 3, 1))) AS pos FROM d WHERE len(words) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), overlap AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
            FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
        ), link AS (
            SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
        ), edge AS (
            SELECT a, b FROM link UNION ALL SELECT b, a FROM link
        ), reach AS (
            SELECT doc_id, doc_id AS seen FROM d
            UNION
            SELECT reach.doc_id, b FROM reach JOIN edge ON a = seen
        )
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id
        FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
    """,
    "op7_embedding_dedup": r"""
        WITH RECURSIVE e AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), link AS (
            SELECT x.vec_id AS a, y.vec_id AS b
            FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id
            WHERE list_cosine_similarity(x.v, y.v) >= 0.98
        ), reach AS (
            SELECT vec_id, vec_id AS seen FROM e
            UNION
            SELECT reach.vec_id, b FROM reach JOIN link ON a = seen
        ), n AS (
            SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
        )
        SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(seen) AS component_id, vec_id = min(seen) AS kept
        FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
    """,
    "op11_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
        ), g AS (
            SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                             OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), c AS (
            SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s
            FROM g
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM c
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
            FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                   row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
            FROM s WHERE same
        ), n AS (
            SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
            WHERE nth <= 5
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
    "op13_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), f AS (
            SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(role || chr(0) || text, '\\', '\\\\'),
                '<|im_start|>', '<\\|im_start|>'), '<|im_sep|>', '<\\|im_sep|>'), '<|im_end|>', '<\\|im_end|>'),
                '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'),
                '<|endoftext|>', '<\\|endoftext|>'), '<|eot_id|>', '<\\|eot_id|>') AS body
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(body) - 1 + length('<|im_start|><|im_sep|><|im_end|>')) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id
    """,
}

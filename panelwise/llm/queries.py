"""Registered queries of the operators: each on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import chat, decontaminate, exact, html, jaccard, licenses, merkle, mixing, negatives, pii, secrets, tokens, toxicity
from panelwise.llm.common import scratch, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # a conversation whose texts are control strings
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    segments = scratch(chat.format_turns(chat.text_parts(turns.unionByName(more))), "chat")
    return chat.digests(segments)


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_documents(tokens.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER, END_ID))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_personal_data": personal_data,
    "op2_main_text": main_text,
    "op3_license_notices": license_notices,
    "op4_decontamination": decontamination,
    "op5_source_mix": source_mix,
    "op6_chat_format": chat_format,
    "op7_jaccard_join": jaccard_join,
    "op8_toxicity": toxicity_scores,
    "op9_exact_dedup": exact_dedup,
    "op10_token_ids": token_ids,
    "op11_secrets": secret_scan,
    "op12_hard_negatives": hard_negatives,
    "op13_merkle_manifest": merkle_manifest,
}

ORACLE = {
    "op5_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
          FROM documents),
        p AS (
          SELECT *, md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS place FROM d),
        s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, CAST(3 * sum(size) AS HUGEINT) AS cap FROM d GROUP BY source),
        w AS (
          SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS HUGEINT) AS w, sum(source_size) OVER () AS total
          FROM s),
        f AS (
          SELECT *, coalesce(sum(cap) OVER (ORDER BY cap * 6 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
            sum(w) OVER (ORDER BY cap * 6 // w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
          FROM w),
        l AS (
          SELECT *, (total - taken) * w >= cap * weights AS is_full FROM f),
        g AS (
          SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS given, sum(CASE WHEN NOT is_full THEN w END) OVER () AS open_w
          FROM l),
        t AS (
          SELECT source, CAST(source_size AS BIGINT) AS source_size,
            CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(w * (total - given) AS DOUBLE) / CAST(open_w AS DOUBLE) END AS target
          FROM g),
        r AS (
          SELECT p.doc_id, p.size, t.source_size, t.target,
            CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
            sum(p.size) OVER (PARTITION BY p.source ORDER BY p.place, p.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
          FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
          CAST(size * (whole + CASE WHEN size > 0 AND so_far - size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM r""",
    "op6_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        m AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS masked FROM c)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(sum(length(masked)) AS BIGINT) AS loss_chars,
          sha256(string_agg(masked, '' ORDER BY turn, role, text)) AS loss_sha256,
          CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op9_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS squeezed
          FROM documents),
        g AS (
          SELECT doc_id, first_value(doc_id) OVER (PARTITION BY squeezed ORDER BY n DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY squeezed) AS group_size,
            row_number() OVER (PARTITION BY squeezed ORDER BY n DESC, doc_id) = 1 AS kept, sha256(squeezed) AS text_sha256
          FROM d)
        SELECT * FROM g""",
    "op12_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
          SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
            CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS name FROM documents),
        bits AS (
          SELECT *, list_reduce([4294967295] || flatten(list_transform(range(1, length(name) + 1),
              lambda i: [ascii(name[i]), -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS reversed_crc
          FROM d),
        f AS (
          SELECT *, concat(
              coalesce(octet_length(encode(name)) || ':' || name, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
              coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
            CASE WHEN xor(reversed_crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
          FROM bits),
        h AS (
          SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
            sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) AS tampered
          FROM f),
        l AS (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
          FROM h),
        inner_nodes AS (
          SELECT 0 AS level, source, place, n, leaf AS digest FROM l
          UNION ALL
          SELECT level + 1, source, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
          FROM inner_nodes WHERE n > 1 GROUP BY level, source, place // 3, n),
        tops AS (
          SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS source_place, count(*) OVER () AS sources
          FROM inner_nodes WHERE n = 1),
        outer_nodes AS (
          SELECT 0 AS level, source_place AS place, sources AS n, subroot AS digest FROM tops
          UNION ALL
          SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
          FROM outer_nodes WHERE n > 1 GROUP BY level, place // 3, n),
        whole AS (SELECT digest AS root FROM outer_nodes WHERE n = 1),
        nodes AS (
          SELECT coalesce('=' || source, '') AS key, level, place, n, digest FROM inner_nodes
          UNION ALL SELECT NULL, level, place, n, digest FROM outer_nodes),
        walk AS (
          SELECT row_number() OVER () AS id, l.doc_id, coalesce('=' || l.source, '') AS key, coalesce('=' || l.source, '') AS tree, 0 AS level, l.place, l.n,
            l.tampered AS digest, '' AS proof, t.source_place, t.sources, l.leaf, t.subroot
          FROM l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
          UNION ALL
          SELECT * FROM (
            SELECT w.id, w.doc_id, w.key, w.tree, w.level + 1, w.place // 3, (w.n + 2) // 3,
              sha256(string_agg(CASE WHEN x.place = w.place THEN w.digest ELSE x.digest END, '' ORDER BY x.place)),
              w.proof || coalesce(string_agg(CASE WHEN x.place <> w.place THEN x.digest END, '' ORDER BY x.place), ''),
              w.source_place, w.sources, w.leaf, w.subroot
            FROM walk w JOIN nodes x ON x.key IS NOT DISTINCT FROM w.tree AND x.level = w.level AND x.place // 3 = w.place // 3
            WHERE w.n > 1
            GROUP BY w.id, w.doc_id, w.key, w.tree, w.level, w.place, w.n, w.digest, w.proof, w.source_place, w.sources, w.leaf, w.subroot
            UNION ALL
            SELECT w.id, w.doc_id, w.key, NULL, 0, w.source_place, w.sources, w.digest, w.proof, w.source_place, w.sources, w.leaf, w.subroot
            FROM walk w WHERE w.n = 1 AND w.tree IS NOT NULL))
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
        FROM walk, whole WHERE tree IS NULL AND n = 1""",
}

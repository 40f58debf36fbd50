"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language_id, ogg, packing, quality_rules, sentence_pieces, simhash, token_shards, toxicity, warc
from ._common import stored, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_documents(docs, language_id.fit(docs)).withColumn("kept", F.col("accepted"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where markup, addresses and hosts are: on pages."""
    return language_id.identify_pages(table(spark, sf_dir, "pages"), language_id.fit(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(ogg.text_media(table(spark, sf_dir, "documents")))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.encode_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, t, r, "<|im_end|><|im_start|>assistant ok") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(rows))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_rules.text_statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality_rules.fit(stats, table(spark, sf_dir, "labels"))
    out = quality_rules.judge(stats, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_ogg_media": op3_ogg_media,
        "op4_sentence_pieces": op4_sentence_pieces,
        "op5_token_shards": op5_token_shards,
        "op6_toxicity": op6_toxicity,
        "op7_chat_format": op7_chat_format,
        "op8_simhash": op8_simhash,
        "op9_warc": op9_warc,
        "op10_quality_rules": op10_quality_rules,
        "language_id_pages": language_id_pages,
    }


#: A SHA-1 in hex is eight groups of five digits, each four base32 letters.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTER = "substr('" + _BASE32 + "', CAST(((v // {0}) % 32) + 1 AS INT), 1)"

OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS top, sha1(h) AS hex FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT)),
           lambda v: {" || ".join(_LETTER.format(1 << s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d
"""

OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + length('<|im_end|>') + 1
           + len(regexp_extract_all(text, '<\|\\*(im_start\|>|im_end\|>)'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """The others learn a model, tokenise or hash as no SQL function does; tests
    hold them against brute-force versions."""
    return {"op7_chat_format": OP7_SQL, "op9_warc": OP9_SQL}

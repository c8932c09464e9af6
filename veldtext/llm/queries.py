"""One query for each operator of this subpackage, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldtext.llm.byte_bpe import encode_documents
from veldtext.llm.common import table
from veldtext.llm.exact_dedup import exact_groups
from veldtext.llm.language_id import language_evidence
from veldtext.llm.near_dedup import near_components
from veldtext.llm.packing import pack_documents
from veldtext.llm.quality import quality_rules
from veldtext.llm.sharding import shard_documents
from veldtext.llm.suffix_dedup import remove_repeats
from veldtext.llm.tool_calls import link_conversations
from veldtext.llm.toxicity import toxicity


def _tokenizers():
    """The folder of public tokenizers; its module is looked up only when a query needs it."""
    import public_tokenizers

    return public_tokenizers


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (with a doc_id) and all pages (with a page_id)."""
    found = language_evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    return found.select(
        "doc_id", "page_id", "host", "declared", "text_lang", "lang", "probability", F.col("accepted").alias("kept")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizers()
    return pack_documents(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizers()
    return encode_documents(
        table(spark, sf_dir, "documents"), files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """broken_rules: the names of the rules that reject the document, joined by commas."""
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ",").alias("broken_rules"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_dedup": op6_near_dedup,
    "op7_shard_documents": op7_shard_documents,
    "op8_tool_call_linking": op8_tool_call_linking,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op8_tool_call_linking": r"""
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, conv_id || ':' || turn AS call_id, coalesce(text, '') AS text,
                   CASE WHEN turn >= 2 THEN 'ask_again' ELSE 'ask' END AS tool,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
                   CASE WHEN turn >= 2 THEN conv_id || ':' || (turn // 2) END AS about
            FROM conversations WHERE role = 'user'),
        ordered AS (
            SELECT call_id, 0 AS level FROM calls WHERE about IS NULL OR about NOT IN (SELECT call_id FROM calls)
            UNION ALL
            SELECT c.call_id, o.level + 1 FROM ordered o JOIN calls c ON c.about = o.call_id),
        results AS (
            SELECT conv_id || ':' || (turn - 1) AS call_id, count(*) AS n_results,
                   min(turn) AS result_turn, arg_min(text, (turn, text)) AS content
            FROM conversations WHERE role = 'assistant' GROUP BY 1),
        checked AS (
            SELECT c.*, o.level, r.n_results, r.result_turn, r.content,
                   CASE WHEN about IS NULL THEN '{' ELSE '{"about":' || to_json(about) || ',' END
                       || '"text":' || to_json(c.text) || ',"words":' || words || '}' AS arguments,
                   array_to_string(list_filter([
                       CASE WHEN length(c.text) NOT BETWEEN 1 AND 400 THEN 'range:text' END,
                       CASE WHEN words NOT BETWEEN 1 AND 60 THEN 'range:words' END], lambda x: x IS NOT NULL), ',') AS problems
            FROM calls c JOIN ordered o ON c.call_id = o.call_id LEFT JOIN results r ON c.call_id = r.call_id)
        SELECT conv_id, turn, call_id, tool, n_results IS NOT NULL AS linked, result_turn,
               coalesce(n_results, 0) AS n_results, level, problems = '' AS valid, problems, arguments,
               '{"arguments":' || arguments || ',"id":' || to_json(call_id) || ',"result":'
                   || coalesce(to_json(content)::VARCHAR, 'null') || ',"tool":' || to_json(tool) || '}' AS message
        FROM checked""",
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        g AS (
            SELECT norm, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id
            FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm""",
}

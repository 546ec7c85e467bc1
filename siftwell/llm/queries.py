"""The training-data operators as named queries over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.toxicity import toxicity, train

    docs = documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.suffixes import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.lines import fuzzy_lines

    return fuzzy_lines(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftwell.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftwell.llm.sentencepieces import piece_digests

    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.lm_scoring import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftwell.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.quality import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_suffix_dedup, op3_line_dedup, op4_token_counts, op5_lm_scoring, op6_simhash, op7_packing, op8_quality_rules, op9_exact_dedup, op10_sentencepiece]
    return {f.__name__: f for f in found}


ORACLES: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}

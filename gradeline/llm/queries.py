"""The registered queries of this subpackage and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm import (
    embed_dedup, exact_topk, language, minhash, mixing, neighbours, packing, quality, repair, secrets, substring, token_links,
    tokens,
)
from gradeline.llm.common import held_out, table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rated = quality.score(docs, model)
    return rated.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    told = language.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_languages")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicate_classes(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.with_token_counts(docs, word_vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_links.align(table(spark, sf_dir, "documents"), *files)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damaged(conversations), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_scores, op2_substring_dedup, op3_embedding_dedup, op4_secret_scan, op5_nearest_neighbours, op6_minhash_dedup, op8_language_mixture, op7_best_fit_packing, op9_token_counts, op10_source_mixing,
        op11_token_alignment, op12_exact_topk, op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring.ORACLE, "op3_embedding_dedup": embed_dedup.ORACLE, "op6_minhash_dedup": minhash.ORACLE,
    "op10_source_mixing": mixing.ORACLE, "op12_exact_topk": exact_topk.ORACLE, "op13_conversation_repair": repair.ORACLE,
}

"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longfeat.llm import chat, counting, decontaminate, fim, jaccard, licenses, linededup, lpf, packing, quality, rlz, tokenfile, whitening
from longfeat.sources.storage import fresh_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but the folder is at the same place."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_distribution_divergence(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.judge(table(spark, root, "documents").select("doc_id", "lang", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "class_distance", "word_distance")


def op2_relative_lempel_ziv(spark: SparkSession, root: str) -> DataFrame:
    found = rlz.dedup_words(table(spark, root, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", "kept_sha256", "n_spans")


def op3_elias_fano_tokens(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    folder = fresh_path(spark, "tokens")
    tokenfile.write_token_files(docs, folder, tokenizer("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_token_files(spark, folder)


def op4_snapshot_collapse(spark: SparkSession, root: str) -> DataFrame:
    return chat.render(chat.collapse(table(spark, root, "conversations").select("conv_id", "turn", "role", "text")))


def op5_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return linededup.drop_shared_lines(docs, least=10, most_docs=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_online_packing(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), size=2048, end_id=1)


def op7_block_max_wand(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op8_longest_previous_factor(spark: SparkSession, root: str) -> DataFrame:
    found = lpf.dedup_bytes(table(spark, root, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op9_rank_synchronous_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return counting.token_counts(docs, tokenizer("piece_bpe_32k.model"), limit=4096)


def op10_parity_sketch_join(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs, jaccard.Rule(words=3, percent=90))


def op11_rare_token_index(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(table(spark, root, "documents").select("doc_id", "text")).drop("text")


def op12_polarisation_covariance(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"), most=32)


def op13_displacement_scatter(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    back = fim.restore(fim.transform(docs).drop("text"))
    return back.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_distribution_divergence,
        op2_relative_lempel_ziv,
        op3_elias_fano_tokens,
        op4_snapshot_collapse,
        op5_line_dedup,
        op6_online_packing,
        op7_block_max_wand,
        op8_longest_previous_factor,
        op9_rank_synchronous_counts,
        op10_parity_sketch_join,
        op11_rare_token_index,
        op12_polarisation_covariance,
        op13_displacement_scatter,
    )
}

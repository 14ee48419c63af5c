"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet in the session's shared folder and read again by the
next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longfeat.llm import decontaminate, jaccard, linededup, packing, quality
from longfeat.llm.queries import reach, table, tokenizer
from longfeat.sources.storage import materialize


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """What an operator reads, and all other columns in one that no operator names."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return docs.select(*needed, rest.alias("__row"))


def unpacked(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they were, but for the text."""
    return made.select(*(F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    reach(spark)
    return unpacked(quality.judge(packed(docs, "doc_id", "lang", "text")).where("kept"), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that an earlier document has; ``n_chars`` follows the text."""
    reach(spark)
    left = unpacked(linededup.drop_shared_lines(packed(docs, "doc_id", "text")), docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of five-word shingles (similarity 0.8 or more) the one with the smallest id stays."""
    reach(spark)
    found = jaccard.near_duplicates(docs.select("doc_id", "text"), jaccard.Rule(words=5, percent=80))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return unpacked(packed(docs, "doc_id", "text").join(gone, "doc_id", "left_anti"), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    flagged = decontaminate.flag_leaks(packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return unpacked(flagged.where(F.size("leaks") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    reach(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"), size=2048, end_id=1)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_shared_lines),
    ("jaccard", keep_one_of_each_group),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: Tokenizers and the quality distances are not expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The training corpus: documents through four filters, then encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as Parquet to
the shared folder and reads it again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, decontamination, langid, line_dedup, simhash, vocab
from factweave.llm.staging import small_batches, stage


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that no language explains better than the rest together. Null and empty texts have none.

    Ties go to the language that sorts first and do not matter here; a long text is scored whole, in segments; rows that repeat stay or go alike.
    """
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs, vocab.path("piece_bpe_32k.model")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 40 characters or more that five documents hold, but for the last of these documents.

    A null text stays null; rows of the largest key tie and all keep the line; a text that loses all its lines is empty and stays.
    """
    kept = line_dedup.line_dedup(docs)
    chars = F.when(F.col(kept.columns[-1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Of a group the least key stays, with all its rows where rows share it; texts without a word are one group; rows without a key stay.
    Long texts are cut into shingles in steps.
    """
    small_batches(spark)
    return simhash.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, also with other numbers and names. A null or empty text holds none; one item is enough."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether decoding the ids gives the text again; a null text has no ids."""
    small_batches(spark)
    encoded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), vocab.path("byte_bpe_50k.json"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: SQL expresses neither the language model nor the similarity search nor the encoder; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

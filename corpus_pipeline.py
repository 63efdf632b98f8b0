"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return docs' columns: the
first three leave out what they reject, the fourth repeats or leaves out documents as the mix takes them, in the
mix's order. The last returns doc_id, start, n_tokens and ids_crc32, read back from the written token files.

An empty docs table passes through every stage; nulls, ties and repeated rows are treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lontar.llm import decontaminate, language, mixing, near_dup, scratch, token_ids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the filter is fitted on docs' own labels."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of the benchmark table leaked."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and their index read back."""
    import public_tokenizers

    return token_ids.read_index(token_ids.write(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: The language, near-duplicate and tokenizer stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder for the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

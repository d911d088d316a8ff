"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a table; it works on all rows its predecessor
kept, and all but the last return the columns of documents. Null and empty texts are kept by the first
three stages (they hold nothing toxic, no shingles and no items), are mixed as others are, and are one end
id; rows that share a doc_id are one document to near-dedup and stay or go together; rows without doc_id
are no duplicates of anything; further columns pass through all stages but the last. An empty table gives an empty
one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, minhash, mixing, queries, shared, token_files, toxicity

#: SQL can't express the classifier, MinHash, banded alignment or the tokenizer.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier predicts toxic go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, shared.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity of 0.8 or more) the document of
    the smallest doc_id stays."""
    return minhash.keep_first(docs, minhash.Likeness(size=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a window of a long one, go."""
    return decontamination.keep_clean(docs, shared.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at their source's rate (0 times too) and dealt out in a random order."""
    return mixing.mix_documents(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; their index, read back from them."""
    return token_files.token_digest(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_binary", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to shared storage and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over documents, each one operator of ``courtledger.llm``.

A stage takes the session, the documents its predecessor kept and the folder of
the tables. All but the last return documents with the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtledger.llm.aho_decontaminate import uncontaminated
from courtledger.llm.cotrain_quality import accepted_documents
from courtledger.llm.lpf_dedup import without_repeats
from courtledger.llm.lsh_forest import one_of_each
from courtledger.llm.tree_bpe import encode_and_decode
from courtledger.llm.workers import importable
from courtledger.session import fresh_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    return accepted_documents(docs, importable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    importable(spark)
    return one_of_each(docs, size=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages go from the texts, the first copy stays; n_chars follows."""
    importable(spark)
    cut = without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return uncontaminated(docs, importable(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bit), and digests of the ids and of the decoded text."""
    importable(spark)
    found = encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", tokenize),
]

#: No stage but the fourth can be written as SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return done
        done.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{name}")
    return docs

"""Corpus pipeline: language, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet and rereads as the next
stage's documents. All but the last return the columns of documents; rows with NULL ids or texts follow the rules of the
operators. The language stage rejects only documents that the operator gives no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from visitflow.llm.common import stored
from visitflow.llm.queries import table, tokenizer_bytes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language stay; those with a NULL text or without letters (``und``) go."""
    found = language_id.identify(docs, language_id.fit(docs), keep=COLUMNS)
    return found.filter(F.col("lang_pred") != "und").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id (NULL last), of those that share it the one with the
    least hash of its text. Groups are told apart by their fingerprints, so unlike documents with NULL or equal ids all stay.
    """
    stay = simhash.first_of_groups(simhash.near_duplicates(docs, shingle=3)).toDF("stay_id", "stay_hash")
    hashed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("stay_id")) & (F.col("text_hash") == F.col("stay_hash"))
    return hashed.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings that repeat go; a character that a cut has split goes with them."""
    found = suffix_dedup.remove_repeats(docs, keep=COLUMNS, with_text=True)
    text = F.col("kept_text")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go; all others stay as they are, empty ones too."""
    found = decontaminate.tile_documents(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; an empty or NULL text is its end token."""
    return packing.pack_documents(docs, tokenizer_bytes("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language ID", language), ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings), ("benchmark decontamination", benchmark_passages), ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

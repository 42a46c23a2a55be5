"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing, packing.

Each stage works on all that its predecessor kept and returns the columns of ``documents`` (the last one
returns the packed pieces). The driver writes every stage as Parquet and rereads it; ``run`` chains them and
writes each stage to the shared folder itself.

SQL can express neither the language model nor the tokeniser, so ``ORACLE_SQL`` is None; the tests hold every
stage against a brute-force version. Columns of ``documents`` of any name pass through all stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.llm import language_id, line_dedup, mixing, near_text, packing
from synframe.llm.columns import freed, held
from synframe.runtime import Written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without an n-gram of any language, go; a missing lang is filled in."""
    model = language_id.train(docs)
    known = language_id.predict(held(docs, "text", "lang"), model, ["text", "lang", "_rest"])
    known = known.filter((F.col("lang_pred") != "und") & (F.col("score") > 0))
    return freed(known.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, "text", "lang")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go from all but the first document; a document left without a word goes too."""
    used = ("doc_id", "text", "n_chars")
    cut = line_dedup.drop_repeated_lines(held(docs, *used))
    left = cut.filter((F.col("deleted_lines") == 0) | F.col("text").rlike(r"\S"))
    n = F.when(F.col("deleted_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return freed(left.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)), docs, *used)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those linked by fingerprints or by word 5-grams at a Jaccard similarity of 0.8 or more. A document that lost
    lines is compared by its text in ``documents`` as well: line dedup leaves a remnant of a near copy, which is like nothing else."""
    return near_text.drop_near_texts(docs, earlier=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    used = ("doc_id", "text", "source", "lang")
    return freed(mixing.mix(held(docs, *used)), docs, *used)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_neardup", dedup_near),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), Written(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept.cut(docs)
    return docs

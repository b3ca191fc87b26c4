"""A cleaning pipeline over the documents table: language, repeated lines, near copies, benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents, whatever these are; rows are never changed without being decided on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.llm import bpe, decontam, langid, linedup, simhash
from watchpost.llm.common import fresh, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents given and drops those that the model rejects: no letter, or in none of its
    languages. The others keep all columns; a missing lang is filled with the prediction. Needs the column lang."""
    names = fresh(docs, "lang_pred", "score", "rejected")
    judged = langid.predict(docs, langid.train(docs), docs.columns, names)
    return judged.where(~F.col(names[2])).withColumn("lang", F.coalesce("lang", names[0])).drop(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many documents repeat; a document that loses all of its lines goes, others stay. n_chars, where there is such a
    column, follows the text."""
    names = fresh(docs, "n_lines", "n_dropped")
    cut = linedup.drop_repeated_lines(docs, names=names)
    left = cut.where((F.col(names[1]) == 0) | (F.btrim("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.drop(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles of similarity 0.8 or more) the document with the smallest doc_id stays (with every row that has this doc_id);
    rows without a doc_id stay if their group has no doc_id at all. Texts without words are no copies of each other.
    Fingerprints come first, their links are verified; the exact join finds those at 0.8 that 64 bits can't tell (README has figures)."""
    groups = simhash.similar_groups(docs)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    # A doc_id can be the smallest of one group and lose in another only where rows repeat it with other texts: it stays then.
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    gone = gone.join(first, F.col("_gone").eqNullSafe(F.col("_first")), "left_anti")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of the bytes that they decode to."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: SQL has neither the language models nor XXH64 fingerprints nor the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs.drop("ids")

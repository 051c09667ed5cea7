"""From documents to packed training sequences: five stages, each written out and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarevar_spark.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from rarevar_spark.llm.shared import keep

#: No SQL expresses the language model, the tokenizer and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Null, empty and letterless texts go, as do texts that no language has a score of a half for; if no row has a lang, all go. Rows are judged
    each by its text, ties go to the language first by name; repeated rows stay repeated.
    """
    return language_id.keep_identified(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they repeat; those of which no word is left go. n_chars follows the text.

    Texts that lose no line stay as they are, null ones too. Of equal lines the smallest doc_id keeps its own; rows of one doc_id are
    not held against each other and lose the same lines.
    """
    out = line_dedup.delete_repeated_lines(docs)
    out = out.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).drop("n_lines_removed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near copies.

    Null, empty and wordless texts are in no group and stay. Repeated rows of a doc_id stay or go together.
    """
    return ngram_join.keep_one_of_each(docs, words=5, threshold=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and wordless texts hold none; rows that repeat a doc_id with an item go, whatever their text."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens. Null and empty texts are one piece; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives no rows. Further columns pass all stages but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

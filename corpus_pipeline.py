"""The corpus pipeline: stages applied to documents in order, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tocsin.llm import decontaminate, linededup, neardup, tokens, toxicity
from tocsin.llm.common import SPACE, settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; the model learns from those of ``docs`` with labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay only where they come first.

    A document that loses lines and has nothing but blanks left goes; all others stay, empty ones included.
    n_chars, if there, is that of the new text.
    """
    cut = linededup.drop_lines(docs, min_docs=10, keep_first=True)
    text = F.coalesce(cut["text"], F.lit(""))
    cut = cut.filter((F.col("n_dropped") == 0) | (F.btrim(text, F.lit(SPACE)) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 on five-word shingles."""
    return neardup.drop_near_duplicates(docs, size=5, share=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and the decoded text of every document."""
    return tokens.encode_texts(docs, tokens.default_model()).select("doc_id", "n_tokens", "token_ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: SQL expresses neither the classifier nor the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

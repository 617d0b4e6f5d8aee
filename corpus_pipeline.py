"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark passages, tokens.

Every stage takes all documents that its predecessor kept and returns documents with the columns they
came with; the last adds their tokens.  `run` writes each stage's result to the shared folder and reads
it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, decontaminate, langid, neardup, substring
from skyledger.llm.common import stored, table
from skyledger.llm.queries import rank_file

#: Rows that go to a Python worker at a time: texts of a few MB instead of tens, on both sides of the pipe.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from the documents themselves."""
    small_batches(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of texts alike in 0.8 of their five-word shingles."""
    small_batches(spark)
    return neardup.deduplicated(docs, size=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that also start earlier are cut out; documents of which nothing is left go."""
    small_batches(spark)
    had = f"had_{uuid.uuid4().hex}"
    cut = substring.trimmed(docs.withColumn(had, F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0), length=50)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return cut.where(~F.col(had) | (F.length("text") > 0)).drop(had)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    small_batches(spark)
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and token ids, and their number."""
    small_batches(spark)
    coded = bpe.encode_column(docs, rank_file(), ids_col="token_ids")
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: Trained and iterative stages; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

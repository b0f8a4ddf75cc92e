"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark decontamination, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps. ``run`` writes
each stage's result to the shared folder and reads it again for the next.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns, whatever their
names: null and empty texts, which have no language, go in the first stage; rows that share a key stand or fall together in the
others; a null key is never dropped as a copy or as contaminated; of ties the smallest key stays; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm import decontaminate, jaccard, langid, linededup, mixing
from trackframe.llm.common import read, written

#: Documents whose best language has less than this share of their words' probability are rejected, as are those without letters.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose words agree on a language; null texts and texts without a letter have none."""
    model = langid.fit(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(True))))
    return langid.kept(docs, model, LEAST_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines of three-line windows that stand earlier in the corpus; n_chars follows the text (null for a null text). No document goes."""
    out = linededup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item; null and empty ones overlap none. An empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null and empty texts give none. A null source is a source."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The language stage learns a model and the near-duplicate stage builds components: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

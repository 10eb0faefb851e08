"""A training corpus from ``documents``: language, repeated lines, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from codestrata.llm.common import save, table
from codestrata.llm.queries import fold, tokenizer_path

#: Share of its language below which a document is rejected; with few languages any text of a known one has more.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and mixtures in which no language has a fair share, go."""
    model = language_id.fit(docs.filter(~fold(4, 2)))
    found = language_id.identify(docs, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of three lines or more go; a document of which no line stays goes."""
    cut = line_dedup.dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a test item occurs go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into token sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("best-fit packing", sequences)]

#: SQL can't express the first stage, so neither the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

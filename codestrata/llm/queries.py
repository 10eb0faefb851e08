"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import ann, decontamination, html_extraction, jaccard_join, language_id, line_dedup, packing, sharding, token_counts, toxicity
from codestrata.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fold(of: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``part`` when divided by ``of``; false without a doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == part, F.lit(False))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~fold(4, 2)))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "first_word", "end_word")


def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~fold(5, 0)))
    return toxicity.score(docs, model).select("doc_id", fold(5, 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def html_extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    "op1_line_dedup": line_dedup_query,
    "op2_token_counts": token_counts_query,
    "op3_sharding": sharding_query,
    "op4_best_fit_packing": packing_query,
    "op5_language_id": language_id_query,
    "op6_decontamination": decontamination_query,
    "op7_nearest_neighbours": ann_query,
    "op8_toxicity": toxicity_query,
    "op9_html_extraction": html_extraction_query,
    "op10_jaccard_join": jaccard_join_query,
}

ORACLES = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op3_sharding": sharding.ORACLE_SQL}

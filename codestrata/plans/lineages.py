"""Search over all versions on the test tables: vectors of ``embeddings`` as chunks, their labels as versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.lineage import occurrences, search_all_versions
from codestrata.plans.retrieval import asked, read, rounded
from codestrata.scratch import save

Q: dict = {}
SQL: dict[str, str] = {}


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, d, "embeddings")
    n = F.col("vec_id")
    file = F.floor(n / 70)  # seven names a file: about ten chunks share a name, as versions do
    chunks = e.select(
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("commit"), F.format_string("f%d.py#g%d@%d", file, n % 7, n).alias("id"), F.format_string("f%d.py", file).alias("path"),
        F.format_string("g%d", n % 7).alias("name"), F.when(n % 11 == 0, "module").otherwise("function").alias("kind"), n.cast("int").alias("start_line"), (n + 1).cast("int").alias("end_line"),
        n.cast("string").alias("hash"), F.lit("python").alias("language"),
    )
    versions = e.select("label").distinct().select(
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("commit"), F.lit("short").alias("short"), F.array(F.concat(F.lit("v"), F.col("label").cast("string"))).alias("refs"),
        F.concat(F.lit("202"), F.col("label").cast("string")).alias("committed_at"),
    )
    # what a source of all versions makes once, when it is opened
    return save(occurrences(chunks, versions), "occurrences"), versions, e.select(n.cast("string").alias("hash"), F.col("embedding").alias("vector"))


def lineage_clusters(spark: SparkSession, d: str) -> DataFrame:
    """K10, K11, M, G3, F3: the ten best pieces of code for each query; thresholds suit vectors that are hardly alike."""
    occ, _, vectors = _tables(spark, d)
    found = search_all_versions(asked(spark, d), occ, vectors, 10, duplicate=0.2, renamed=0.15)["lineages"]
    return found.select("query_id", "rank", "path", "name", "kind", F.round("rank_score", 6).alias("rank_score"), "n_distinct_code", "changed", "timeline")


def lineage_flat(spark: SparkSession, d: str) -> DataFrame:
    """The ungrouped best rows of each query with the lineage of each."""
    occ, _, vectors = _tables(spark, d)
    return rounded(search_all_versions(asked(spark, d), occ, vectors, 10, duplicate=0.2, renamed=0.15)["flat"])


Q |= {"lineage_clusters": lineage_clusters, "lineage_flat": lineage_flat}

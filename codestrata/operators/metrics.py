"""Ranking metrics of a run against judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10, 20, 100, 1000)


def per_query(run: DataFrame, qrels: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """Metrics of each judged query: run (query_id, doc_id, rank), qrels (query_id, doc_id, score); positive scores are relevant."""
    positive = qrels.filter("score > 0")
    gain = F.col("score") / F.log2(F.col("nth") + 1)
    ideal = positive.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("nth") <= k, gain)).alias(f"ideal_{k}") for k in cuts])
    found = run.select("query_id", "doc_id", "rank").join(positive, ["query_id", "doc_id"])
    found = found.withColumn("hits", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    at = lambda k, x: F.when(F.col("rank") <= k, x)
    sums = found.groupBy("query_id").agg(
        *[F.sum(at(k, F.col("score") / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}") for k in cuts],
        *[F.sum(at(k, F.col("hits") / F.col("rank"))).alias(f"ap_{k}") for k in cuts],
        *[F.count(at(k, F.lit(1))).alias(f"hits_{k}") for k in cuts],
        F.min("rank").alias("first"),
    )
    both = ideal.join(sums, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = []
    for k in cuts:
        hits = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        out += [
            zero(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_at_{k}"), zero(F.col(f"ap_{k}") / F.least(F.col("relevant"), F.lit(k))).alias(f"map_at_{k}"),
            (hits / F.col("relevant")).alias(f"recall_at_{k}"), (hits / F.lit(k)).alias(f"precision_at_{k}"),
            zero(F.when(F.col("first") <= k, 1 / F.col("first"))).alias(f"mrr_at_{k}"), (hits > 0).cast("double").alias(f"hit_rate_at_{k}"),
            (hits > 0).cast("double").alias(f"accuracy_at_{k}"),
        ]
    return both.select("query_id", *out)


def evaluate(run: DataFrame, qrels: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """One row of means over all judged queries."""
    return means(per_query(run, qrels, cuts))


def means(each: DataFrame) -> DataFrame:
    """One row: the number of queries and the means of their metrics."""
    return each.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in each.columns[1:]])


def duplicates(ranked_lineages: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n, duplicates): results among the k best that repeat a lineage; input (query_id, rank, lineage)."""
    top = ranked_lineages.filter(F.col("rank") <= k)
    return top.groupBy("query_id").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("lineage")).alias("duplicates"))

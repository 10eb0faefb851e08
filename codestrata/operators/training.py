"""Data for fine-tuning a retriever: positive pairs, held-out split, hard negatives, evaluation subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.search import dense_topk, ranked
from codestrata.scratch import save, spread


def positive(qrels: DataFrame) -> DataFrame:
    return qrels.filter("score > 0")


def guard_partition(queries: DataFrame, qrels: DataFrame, wanted: str = "train") -> DataFrame:
    """``queries``; a judged query of another partition is an error."""
    bad = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi").filter(F.coalesce("partition", F.lit(wanted)) != wanted)
    if (row := bad.limit(1).first()) is not None:
        raise ValueError(f"query {row['query_id']} isn't of partition {wanted}")
    return queries


def occurring(items: DataFrame, docs: DataFrame, run: int = 4) -> DataFrame:
    """Judgements (query_id, doc_id, score 1): the documents (doc_id, text) in which the text of an item (query_id, text) occurs.

    Where an item occurs, so do its second to fifth word, between blanks: hashed runs of ``run`` words are joined, then the pairs
    that meet are written and verified; texts go with pairs only. Items of fewer than ``run`` + 2 words are held against every document.
    """
    split = F.split("text", " ")
    asked = items.filter("text <> ''").withColumn("words", split).withColumn("long", F.size("words") >= run + 2)
    at = lambda words, k: F.xxhash64(*[F.get(words, k + j) for j in range(run)])
    wanted = asked.filter("long").select("query_id", F.col("text").alias("item"), at(F.col("words"), F.lit(1)).alias("hash"))
    words = spread(docs, "doc_id").withColumn("words", split).filter(F.size("words") >= run)
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - run), lambda k: at(F.col("words"), k))
    hashed = words.select("doc_id", F.explode(F.array_distinct(runs)).alias("hash"))
    meeting = save(hashed.join(wanted.select("query_id", "hash"), "hash").select("query_id", "doc_id").distinct(), "meeting")
    met = docs.join(meeting, "doc_id").join(wanted.select("query_id", "item"), "query_id").filter(F.contains("text", "item"))
    short = docs.join(asked.filter("not long").select("query_id", F.col("text").alias("item")), F.contains("text", "item"))
    return met.select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id")).distinct().withColumn("score", F.lit(1))


def pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, anchor, positive); judgements without a query or a document drop out."""
    q = queries.select("query_id", F.col("text").alias("anchor"))
    return positive(qrels).join(q, "query_id").join(corpus.select("doc_id", F.col("text").alias("positive")), "doc_id").select("query_id", "doc_id", "anchor", "positive")


def missing(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Counts of judgements whose query or document is missing."""
    p = positive(qrels)
    lost = lambda other, key: p.join(other, key, "left_anti").agg(F.count("*").alias("n"))
    return lost(queries, "query_id").withColumn("missing", F.lit("query")).unionByName(lost(corpus, "doc_id").withColumn("missing", F.lit("document")))


def split(rows: DataFrame, key: str, held_out: int = 500, seed: int = 0) -> DataFrame:
    """``rows`` with held_out: true for the ``held_out`` keys that come first by hash. Python's shuffle has no equal in SQL."""
    chosen = rows.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), key), key).limit(held_out).withColumn("held_out", F.lit(True))
    return rows.join(chosen, key, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def subset(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, n_queries: int, n_docs: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first judged queries, and their documents with distractors drawn by hash up to ``n_docs``."""
    q = queries.join(positive(qrels), "query_id", "left_semi").orderBy("query_id").limit(n_queries)
    relevant = corpus.join(positive(qrels).join(q, "query_id", "left_semi"), "doc_id", "left_semi")
    rest = corpus.join(relevant.select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    return q, relevant.unionByName(rest.limit(max(0, n_docs - relevant.count())))


def hard_negatives(queries: DataFrame, docs: DataFrame, qrels: DataFrame, held_out: DataFrame, n: int = 3, depth: int = 50, skip: int = 0) -> DataFrame:
    """The ``n`` nearest documents of each query from place ``skip`` on that are neither relevant nor held out."""
    allowed = docs.join(held_out.select("doc_id"), "doc_id", "left_anti")
    near = dense_topk(queries, allowed, depth + skip).filter(F.col("rank") > skip)
    return ranked(near.drop("rank").join(positive(qrels), ["query_id", "doc_id"], "left_anti"), n)


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch with the highest mrr of (epoch, mrr, seconds), and the running time until each."""
    from pyspark.sql import Window

    total = F.sum("seconds").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    best = F.row_number().over(Window.orderBy(F.desc("mrr"), "epoch")) == 1
    return history.withColumn("total_seconds", total).withColumn("best", best)

"""Evaluation runs: every retriever with every way to clean queries, on one data set, with metrics at all cuts."""

from __future__ import annotations

import time
from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import clean_query, code_words, tokenize_code
from codestrata.functions.vector import l2_normalise
from codestrata.operators import metrics, search
from codestrata.operators.corpus_index import cached_vectors
from codestrata.operators.dataset import Dataset, clean_statistics, write_json
from codestrata.scratch import save

RETRIEVERS = ("dense", "bm25", "hybrid")
DEPTH = 1000


class Retrievers:
    """Runs (query_id, doc_id, score, rank) on one corpus; what is made of the corpus is made once."""

    def __init__(self, documents: DataFrame, embedder=None, cache: str | None = None, rrf_k: int = search.RRF_K, bm25_weight: float = 1.0, prefix: str = "") -> None:
        self.documents, self.embedder, self.cache, self.rrf_k, self.bm25_weight, self.prefix = documents, embedder, cache, rrf_k, bm25_weight, prefix
        self._made: dict = {}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        if self.embedder is None:
            raise ValueError("dense retrieval needs an embedder")
        docs = self._once("vectors", lambda: save(cached_vectors(self.documents, self.embedder, self.cache), "vectors"))
        asked = queries.select("query_id", self.embedder.documents(F.concat(F.lit(self.prefix), "text")).alias("vector")).withColumn("vector", l2_normalise(F.col("vector")))
        return search.dense_topk(save(asked, "queries"), docs, k)

    def bm25(self, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        index = self._once("bm25", lambda: search.Bm25(self.documents.select("doc_id", *code_words(F.trim("text")))))
        asked = queries.select("query_id", tokenize_code(F.col("text")).alias("tokens"))
        if candidates is None:
            return index.topk(asked, k)
        return search.ranked(search.restrict(index.scores(asked).withColumn("score", F.round("score", 9)), candidates), k)

    def hybrid(self, queries: DataFrame, k: int) -> DataFrame:
        return search.rrf([(self.dense(queries, k), 1.0), (self.bm25(queries, k), self.bm25_weight)], k, self.rrf_k)

    def run(self, retriever: str, queries: DataFrame, k: int = DEPTH) -> DataFrame:
        if retriever not in RETRIEVERS:
            raise ValueError(f"unknown retriever {retriever!r}: one of {', '.join(RETRIEVERS)}")
        return getattr(self, retriever)(queries, k)


def grid(modes: Sequence[str], retrievers: Sequence[str]) -> list[tuple[str, str]]:
    """(query_clean, retriever), each once, in the order given."""
    return list(product(dict.fromkeys(modes), dict.fromkeys(retrievers)))


def _area(rates: np.ndarray, values: np.ndarray, order: np.ndarray) -> tuple[float, float]:
    """The area under the mean of what stays when a share of the first of ``order`` is abstained from, and the mean of all."""
    n, kept = len(values), values[order]
    away = [min(round(r * n + 0.5), n - 1) for r in rates]
    curve = np.array([kept[a:].mean() for a in away])
    return float(((curve[1:] + curve[:-1]) / 2 * np.diff(rates)).sum()), float(curve[0])


def abstention(confidence: np.ndarray, values: np.ndarray) -> float:
    """How much better it is to abstain where confidence is low than to answer all, as a share of what knowing the metric would give."""
    rates = np.linspace(0, 1, 11)[:-1]
    own, _ = _area(rates, values, np.argsort(confidence, kind="stable"))
    ideal, first = _area(rates, values, np.argsort(values, kind="stable"))
    flat = first * (rates[-1] - rates[0])
    return float("nan") if ideal == flat else (own - flat) / (ideal - flat)


def abstentions(run: DataFrame, each: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """abstention() of the metrics ``names`` by three confidences: the best score, the spread of scores, and the lead of the best. The
    driver holds three numbers and the metrics of each query."""
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    top = F.max("score")
    seen = run.groupBy("query_id").agg(top.alias("max"), F.stddev_pop("score").alias("std"), (top - F.coalesce(second, top)).alias("diff1"))
    table = each.join(seen, "query_id", "left").orderBy("query_id").select(*[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("max", "std", "diff1", *names)]).toPandas()
    return {f"nauc_{n}_{c}": abstention(table[c].to_numpy(), table[n].to_numpy()) for n in names for c in ("max", "std", "diff1")} if len(table) else {}


def evaluate(
    data: Dataset, retrievers: Sequence[str] = ("dense",), modes: Sequence[str] = ("desc-io",), embedder=None, cuts: Sequence[int] = metrics.CUTS, out: str | None = None, cache: str | None = None,
    rrf_k: int = search.RRF_K, bm25_weight: float = 1.0, query_prefix: str = "", doc_prefix: str = "", **about,
) -> dict:
    """The report of all variants; with ``out`` it and each variant's scores are written there as JSON. Variants start from the same queries."""
    spark, began = data.queries.sparkSession, time.time()
    made = Retrievers(save(data.documents(doc_prefix), "documents"), embedder, cache, rrf_k, bm25_weight, query_prefix)
    variants = []
    for mode, retriever in grid(modes, retrievers):
        start = time.time()
        asked = save(data.queries.select("query_id", clean_query(F.col("text"), mode).alias("text")), "asked")
        run = save(made.run(retriever, asked, max(cuts)), "run")
        each = save(metrics.per_query(run, data.qrels, cuts), "each")
        scores = metrics.means(each).first().asDict() | abstentions(run, each, [f"{m}_at_{k}" for m in ("ndcg", "mrr") for k in cuts if k in (1, 10)])
        stats = clean_statistics(data.queries, mode).first().asDict()
        found = {"variant": f"{retriever}/{mode}", "retriever": retriever, "query_clean": mode, "scores": scores, "queries": stats, "seconds": round(time.time() - start, 3)}
        variants.append(found)
        if out:
            write_json(spark, f"{out.rstrip('/')}/{retriever}_{mode}.json", found)
    report = about | {
        "model": getattr(embedder, "model_id", None), "query_prefix": query_prefix, "doc_prefix": doc_prefix, "rrf_k": rrf_k, "bm25_weight": bm25_weight, "variants": variants,
        "total_s": round(time.time() - began, 3),
    }
    if out:
        write_json(spark, f"{out.rstrip('/')}/results.json", report)
    return report


def summary(report: dict) -> str:
    width = max([7, *(len(v["variant"]) for v in report["variants"])])
    number = lambda v, x: f"{v['scores'].get(x) or 0:8.4f}"
    rows = [f"{v['variant']:<{width}}  {number(v, 'ndcg_at_10')}  {number(v, 'mrr_at_10')}  {v['seconds']:8.1f}" for v in report["variants"]]
    return "\n".join([f"{'variant':<{width}}   NDCG@10    MRR@10   seconds", *rows])


class EncoderAdapter:
    """An embedder by the protocol of a benchmark harness: batches of {"text": [..]} in, unit vectors out."""

    def __init__(self, spark, embedder, query_prefix: str = "", doc_prefix: str = "", query_clean: str = "none") -> None:
        self.spark, self.embedder, self.query_prefix, self.doc_prefix, self.query_clean = spark, embedder, query_prefix, doc_prefix, query_clean

    def encode(self, inputs, *, task_metadata=None, hf_split=None, hf_subset=None, prompt_type=None, **options) -> np.ndarray:
        asks = str(getattr(prompt_type, "value", prompt_type)) == "query"
        rows = [(n, t) for n, t in enumerate(t for batch in inputs for t in batch["text"])]
        text = F.concat(F.lit(self.query_prefix), clean_query(F.col("text"), self.query_clean)) if asks else F.concat(F.lit(self.doc_prefix), "text")
        vectors = self.spark.createDataFrame(rows, "n long, text string").select("n", self.embedder.documents(text).alias("vector"))
        vectors = vectors.withColumn("vector", l2_normalise(F.col("vector"))).orderBy("n").collect()
        return np.array([r["vector"] for r in vectors], np.float32)


class SearchAdapter:
    """The word index by the protocol of a benchmark harness: index() a corpus, then search() it."""

    def __init__(self, spark) -> None:
        self.spark, self.made = spark, None

    def index(self, corpus, *, task_metadata=None, hf_split=None, hf_subset=None, encode_kwargs=None, num_proc=None) -> None:
        rows = [(str(d["id"]), f"{d['title']} {d['text']}" if d.get("title") else d["text"]) for d in corpus]
        self.made = Retrievers(self.spark.createDataFrame(rows, "doc_id string, text string"))

    def search(self, queries, *, top_k: int, task_metadata=None, hf_split=None, hf_subset=None, encode_kwargs=None, top_ranked=None, num_proc=None) -> dict[str, dict[str, float]]:
        if self.made is None:
            raise ValueError("index a corpus before searching it")
        asked = self.spark.createDataFrame([(str(q["id"]), q["text"]) for q in queries], "query_id string, text string")
        allowed = None if top_ranked is None else self.spark.createDataFrame([(str(q), str(d)) for q, ds in top_ranked.items() for d in ds], "query_id string, doc_id string")
        out: dict[str, dict[str, float]] = {str(q["id"]): {} for q in queries}
        for r in self.made.bm25(asked, top_k, allowed).orderBy("query_id", "rank").collect():
            out[r["query_id"]][r["doc_id"]] = r["score"]
        return out

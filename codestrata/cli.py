"""python -m codestrata: index, update, query, list-versions, report, benchmark, corpus-index and evaluate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codestrata.functions.hashing import HashingEmbedder
from codestrata.functions.text import CLEAN_MODES
from codestrata.operators import dataset
from codestrata.operators.builder import build, repo_name, summary
from codestrata.operators.corpus_index import write_index
from codestrata.operators.evaluation import RETRIEVERS, evaluate
from codestrata.operators.evaluation import summary as summarise
from codestrata.operators.lineage import occurrences, search_all_versions
from codestrata.operators.search import RRF_K, check_query, dense_topk
from codestrata.operators.store import Store
from codestrata.operators.versioned import benchmark, card, lineage_report


def embedder_of(store: Store, name: str | None = None):
    """The embedder that the store was made with; a store without versions takes the hashing one."""
    model = store.model_id() or name or "hashing-256"
    if not model.startswith("hashing-"):
        raise ValueError(f"the store needs the model {model}; open it through the library with a ModelEmbedder")
    return HashingEmbedder(int(model.rpartition("-")[2]))


def search(store: Store, text: str, commit: str, k: int = 10):
    """The k best chunks of one version, code joined after ranking."""
    check_query(text, k)
    vector = embedder_of(store).query(text)
    query = store.spark.createDataFrame([(0, vector)], "query_id long, vector array<float>")
    # a string that sorts as path, line and name do
    view = store.view(commit).withColumn("doc_id", F.concat_ws("\0", "path", F.lpad(F.col("start_line").cast("string"), 10, "0"), "name"))
    found = dense_topk(query, view, k)
    return store.with_code(found.join(view.drop("vector"), "doc_id")).orderBy("rank")


def search_all(store: Store, text: str, k: int = 10, **options):
    check_query(text, k)
    embedder = embedder_of(store)
    query = store.spark.createDataFrame([(0, embedder.query(text))], "query_id long, vector array<float>")
    return search_all_versions(query, occurrences(store.chunks(), store.versions()), store.embeddings(embedder.model_id), k, **options)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codestrata")
    parser.add_argument("--store", required=True)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("index", "update"):
        p = verbs.add_parser(verb)
        p.add_argument("--repo", required=True)
        p.add_argument("--commit", required=True)
        p.add_argument("--base")
        p.add_argument("--ref", action="append")
        p.add_argument("--full", action="store_true")
        p.add_argument("--force", action="store_true")
    p = verbs.add_parser("query")
    p.add_argument("text")
    p.add_argument("--commit", default="all")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--prefer", choices=("latest", "score"), default="latest")
    verbs.add_parser("list-versions")
    p = verbs.add_parser("report", help="pieces of code with their history, and how many results repeat one")
    p.add_argument("text", nargs="+")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--prefer", choices=("latest", "score"), default="latest")
    p.add_argument("--tie", type=float, default=0.01)
    p.add_argument("--duplicate", type=float, default=0.95)
    p = verbs.add_parser("benchmark", help="incremental builds against full ones")
    p.add_argument("--repo", required=True)
    p.add_argument("--refs", nargs="+", required=True, help="oldest first")
    p.add_argument("--steps", nargs="*", default=[], metavar="A:B")
    p.add_argument("--scratch", help="folder for the full builds; without it there are none")
    p = verbs.add_parser("corpus-index", help="embed the corpus of a data set into the store's folder")
    p.add_argument("--data", required=True)
    p.add_argument("--name", default="corpus")
    p.add_argument("--limit", type=int)
    p.add_argument("--cache")
    p = verbs.add_parser("evaluate", help="ranking metrics of retrievers on a data set; the store's folder takes the results")
    p.add_argument("--data", required=True)
    p.add_argument("--retriever", nargs="+", choices=RETRIEVERS, default=["dense"])
    p.add_argument("--query-clean", nargs="+", choices=CLEAN_MODES, default=["desc-io"])
    p.add_argument("--rrf-k", type=int, default=RRF_K)
    p.add_argument("--bm25-weight", type=float, default=1.0)
    p.add_argument("--query-prefix", default="")
    p.add_argument("--doc-prefix", default="")
    p.add_argument("--cache")
    p.add_argument("--smoke", nargs=2, type=int, metavar=("QUERIES", "DOCS"))
    a = parser.parse_args(args)
    store = Store(spark or SparkSession.builder.appName("codestrata").getOrCreate(), a.store)
    try:
        if a.verb in ("index", "update"):
            print(summary(build(store, a.repo, embedder_of(store), a.commit, a.base, a.verb == "update" and not a.full, a.force, a.ref)))
        elif a.verb == "report":
            print(lineage_report(store, embedder_of(store), a.text, a.k, prefer=a.prefer, tie=a.tie, duplicate=a.duplicate))
        elif a.verb == "benchmark":
            steps = [tuple(s.split(":", 1)) for s in a.steps]
            print(card(benchmark(store, a.repo, embedder_of(store), a.refs, steps, a.scratch, repo_name(a.repo))))
        elif a.verb == "corpus-index":
            corpus = dataset.limited(dataset.load(store.spark, a.data).corpus, a.limit)
            manifest = write_index(corpus, HashingEmbedder(), a.store, a.name, a.cache, limit=a.limit)
            print(f"{manifest['n_docs']} documents, vectors of {manifest['dim']} numbers")
        elif a.verb == "evaluate":
            data = dataset.load(store.spark, a.data)
            data = data.smoke(*a.smoke) if a.smoke else data
            options = {"rrf_k": a.rrf_k, "bm25_weight": a.bm25_weight, "query_prefix": a.query_prefix, "doc_prefix": a.doc_prefix, "smoke": a.smoke}
            print(summarise(evaluate(data, a.retriever, a.query_clean, HashingEmbedder(), out=a.store, cache=a.cache, **options)))
        elif a.verb == "list-versions":
            for v in store.listed():
                print(f"{v['short']} {(v['committed_at'] or '')[:10]} {', '.join(v['refs'] or [])} {v['n_chunks']} chunks")
        elif a.commit == "all":
            for r in search_all(store, a.text, a.k, prefer=a.prefer)["lineages"].orderBy("rank").collect():
                print(f"{r['rank']:2d} {r['rank_score']:.3f} {r['path']}:{r['start_line']}-{r['end_line']} {r['name']}  {r['timeline']}")
        else:
            for r in search(store, a.text, a.commit, a.k).collect():
                print(f"{r['rank']:2d} {r['score']:.3f} {r['path']}:{r['start_line']}-{r['end_line']} {r['name']}")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0

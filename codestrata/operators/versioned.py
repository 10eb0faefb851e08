"""The versions of a repository as sources of a search engine, one for each commit and one for all at once, and reports on them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import github_url, location
from codestrata.functions.vector import l2_normalise
from codestrata.operators import metrics
from codestrata.operators.builder import build
from codestrata.operators.dataset import write_json, write_text
from codestrata.operators.lineage import occurrences, search_all_versions
from codestrata.operators.search import SearchSource
from codestrata.operators.store import Store, unembedded
from codestrata.scratch import save
from codestrata.sources import git


class VersionSource(SearchSource):
    """One indexed commit; doc_id is the id of a chunk."""

    def __init__(self, store: Store, repo: str, version: dict) -> None:
        self.store, self.repo, self.version = store, repo, version
        self.label = (version["refs"] or [version["short"]])[0]
        super().__init__(f"{repo}@{version['short']}", store.view(version["commit"]).withColumnRenamed("id", "doc_id"))

    def describe(self, hits: DataFrame) -> DataFrame:
        """``hits`` (doc_id, ..) with code, place and link; code is joined to hits alone."""
        place = ["path", "start_line", "end_line"]
        found = self.store.with_code(hits.join(self.docs.drop("vector"), "doc_id"))
        return found.withColumns({"url": github_url(F.lit(self.repo), F.lit(self.version["commit"]), *map(F.col, place)), "location": location(*map(F.col, place)), "label": F.lit(self.label)})


class AllVersionsSource(SearchSource):
    """All indexed commits: a hit is a piece of code with its history, scored by its best version; doc_id is ``lineage:`` and the id of the
    chunk that is shown."""

    label = "All versions"

    def __init__(self, store: Store, repo: str, prefer: str = "latest", name: str | None = None) -> None:
        self.store, self.repo, self.prefer = store, repo, prefer
        # made once for all searches
        self.occurrences, self.vectors = save(occurrences(store.chunks(), store.versions()), "occurrences"), store.embeddings(store.model_id())
        super().__init__(name or f"{repo}@all", self.vectors.withColumnRenamed("hash", "doc_id"))

    def __len__(self) -> int:
        """Distinct texts of all versions."""
        return self.occurrences.select("hash").distinct().count()

    def found(self, queries: DataFrame, k: int) -> DataFrame:
        return search_all_versions(queries, self.occurrences, self.vectors, k, prefer=self.prefer)["lineages"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.found(queries, k).select("query_id", F.concat(F.lit("lineage:"), "id").alias("doc_id"), F.col("best_score").alias("score"), "rank")

    def describe(self, queries: DataFrame, k: int) -> DataFrame:
        """The hits with code, link, timeline and the score of the version that is shown."""
        named = self.occurrences.select("version", "commit", "label").distinct()
        rows = self.store.with_code(self.found(queries, k).join(named, "version"))
        present = F.size(F.filter(F.split("timeline", " "), lambda x: x.isin("●", "○")))
        return rows.withColumns({"url": github_url(F.lit(self.repo), *map(F.col, ("commit", "path", "start_line", "end_line"))), "versions_present": present})


def repo_sources(store: Store, repo: str = "repo", all_versions: bool = False) -> list[SearchSource]:
    """A source for each indexed commit, oldest first, and one for all of them last."""
    sources: list[SearchSource] = [VersionSource(store, repo, v) for v in store.listed()]
    return [*sources, AllVersionsSource(store, repo)] if all_versions and sources else sources


def duplicate_report(found: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """(query_id, flat_duplicates, flat_unique, grouped_duplicates, grouped_unique) of the ``k`` best results of search_all_versions()."""
    flat = metrics.duplicates(found["flat"], k).select("query_id", F.col("duplicates").alias("flat_duplicates"), (F.col("n") - F.col("duplicates")).alias("flat_unique"))
    grouped = metrics.duplicates(found["ranked"].select("query_id", "rank", "lineage"), k)
    return flat.join(grouped.select("query_id", F.col("duplicates").alias("grouped_duplicates"), (F.col("n") - F.col("duplicates")).alias("grouped_unique")), "query_id")


def mean_report(report: DataFrame) -> DataFrame:
    """One row of means over the queries."""
    return report.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in report.columns[1:]])


def lineage_report(store: Store, embedder, texts: list[str], k: int = 10, **options) -> str:
    """For each text its pieces of code with their history, the ungrouped list, and how many results repeat a piece, as text."""
    spark = store.spark
    rows = [(n, [float(x) for x in embedder.query(t)]) for n, t in enumerate(texts)]
    queries = spark.createDataFrame(rows, "query_id long, vector array<double>").withColumn("vector", l2_normalise(F.col("vector")))
    occ = save(occurrences(store.chunks(), store.versions()), "occurrences")
    found = search_all_versions(queries, occ, store.embeddings(embedder.model_id), k, **options)
    label = {r["version"]: r["label"] for r in occ.select("version", "label").distinct().collect()}
    best = found["lineages"].orderBy("query_id", "rank").collect()
    flat = found["flat"].orderBy("query_id", "rank").collect()
    report = save(duplicate_report(found), "duplicates")
    counts = {r["query_id"]: r for r in report.collect()}
    out = [f"{len(label)} versions: {', '.join(label[v] for v in sorted(label))}; {occ.count()} chunk rows"]
    for n, text in enumerate(texts):
        out += ["", f"Q: {text}"]
        for r in (r for r in best if r["query_id"] == n):
            note = f" [-{r['penalty']:.2f} {r['kind']}]" if r["penalty"] else ""
            out.append(f"  {r['rank']:2d}. {r['best_score']:.4f}{note} {r['path']}::{r['name']} [shown {label[r['version']]}:{r['start_line']}-{r['end_line']}] {r['timeline']} {'changed' if r['changed'] else 'unchanged'}")
        out += [f"      {r['score']:.4f} {label[r['version']]} {r['id']} (lineage {r['lineage']})" for r in flat if r["query_id"] == n]
        if n in counts:
            out.append(f"  repeated among the first ten: flat {counts[n]['flat_duplicates']}, grouped {counts[n]['grouped_duplicates']}")
    mean = mean_report(report).first()
    if mean["queries"]:
        out += ["", f"mean of {mean['queries']}: flat {mean['flat_duplicates']:.1f} repeated, {mean['flat_unique']:.1f} unique; grouped {mean['grouped_duplicates']:.1f}, {mean['grouped_unique']:.1f}"]
    return "\n".join(out)


def speedup(full: float, incremental: float) -> float:
    return full / max(incremental, 1e-9)


def benchmark(store: Store, repo: str, embedder, refs: list[str], steps: list[tuple[str, str]] = (), scratch: str | None = None, name: str = "repo") -> dict:
    """Index ``refs`` each from the one before, and compare with full builds into empty stores; ``steps`` are pairs that are compared alone.

    The report is written into the store as benchmark.json and README.md. Full builds are skipped without ``scratch``, a folder for them.
    """
    spark, chain, full, measured, before = store.spark, [], {}, [], None
    fresh = lambda n: Store(spark, f"{scratch.rstrip('/')}/{n}-{time.time_ns()}")
    for ref in refs:
        chain.append(build(store, repo, embedder, ref, before, incremental=before is not None, refs=[ref]))
        before = chain[-1]["commit"]
    for ref in refs if scratch else ():
        full[ref] = build(fresh("full"), repo, embedder, ref, incremental=False, refs=[ref])
    for a, b in steps if scratch else ():
        own = fresh("step")
        build(own, repo, embedder, a, incremental=False, refs=[a])
        step, cold = build(own, repo, embedder, b, a, refs=[b]), build(fresh("cold"), repo, embedder, b, incremental=False, refs=[b])
        changed = git.diff(spark, repo, step["base"], step["commit"]).count()
        measured.append({
            "from": a, "to": b, "files_changed": changed, "n_chunks": step["n_chunks"], "files_rechunked": step["files_rechunked"], "chunks_embedded": step["chunks_embedded"],
            "chunks_reused": step["chunks_reused"], "incremental_s": step["build_s"], "full_s": cold["build_s"], "speedup": speedup(cold["build_s"], step["build_s"]),
        })
    versions = []
    for ref, r in zip(refs, chain):
        cold = full.get(ref, {}).get("build_s")
        versions.append(r | {"ref": ref, "full_build_s": cold, "speedup": speedup(cold, r["build_s"]) if cold and r["mode"] == "incremental" else None})
    rows = store.chunks().agg(F.count("*").alias("total_chunk_rows"), F.countDistinct("hash").alias("distinct_chunks")).first().asDict()
    report = {"repo": name, "model_id": embedder.model_id, "versions": versions, "steps": measured, **rows, "not_embedded": unembedded(store.chunks(), store.embeddings(embedder.model_id)).count()}
    write_json(spark, f"{store.path}/benchmark.json", report)
    write_text(spark, f"{store.path}/README.md", card(report))
    return report


def card(report: dict) -> str:
    """The report as a page."""
    number = lambda x: "" if x is None else f"{x:.2f}"
    out = [f"# Versions of {report['repo']}", "", f"{report['total_chunk_rows']} chunk rows, {report['distinct_chunks']} different texts, each embedded once by {report['model_id']}.", ""]
    out += ["| ref | commit | mode | files | chunks | embedded | reused | seconds | full | times |", "|-|-|-|-|-|-|-|-|-|-|"]
    out += [
        f"| {v['ref']} | {v['short']} | {v['mode']} | {v.get('n_files')} | {v.get('n_chunks')} | {v.get('chunks_embedded')} | {v.get('chunks_reused')} | {number(v.get('build_s'))} | {number(v['full_build_s'])} | {number(v['speedup'])} |"
        for v in report["versions"]
    ]
    if report["steps"]:
        out += ["", "| from | to | files changed | embedded | seconds | full | times |", "|-|-|-|-|-|-|-|"]
        out += [f"| {s['from']} | {s['to']} | {s['files_changed']} | {s['chunks_embedded']} | {s['incremental_s']:.2f} | {s['full_s']:.2f} | {s['speedup']:.1f} |" for s in report["steps"]]
    return "\n".join([*out, ""])

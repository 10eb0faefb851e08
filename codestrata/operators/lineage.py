"""Search over all versions at once: one result for each piece of code, with its history.

Distinct texts are scored once, then occurrences are joined. Which items are one piece of code is decided for each query by a
greedy merge that depends on order and on the versions already joined, so that step alone runs in Python, on the few
items of a query's pool, in parallel over queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import canonical_path
from codestrata.functions.vector import dot, l2_normalise
from codestrata.operators.search import dense_topk
from codestrata.scratch import drop, save

NEW, SAME, ABSENT = "●", "○", "–"
DUPLICATE, RENAMED, PENALTY, TIE = 0.95, 0.9, 0.05, 0.01


def indexed_versions(versions: DataFrame) -> DataFrame:
    """(version, commit, label, date): versions numbered from 0 by date as text, then commit."""
    order = F.row_number().over(Window.orderBy("committed_at", "commit")) - 1
    refs = F.col("refs")
    label = F.when(F.size(refs) > 0, F.get(refs, 0)).otherwise(F.col("short"))
    return versions.select(order.alias("version"), "commit", label.alias("label"), F.substring("committed_at", 1, 10).alias("date"))


def identity_key(tag_module: Column) -> Column:
    """A name in a file, or for module blocks that share a file the text; one struct with nulls for both forms."""
    path = canonical_path(F.col("path"))
    none = F.lit(None).cast("string")
    named = F.struct(F.lit("name").alias("tag"), path.alias("path"), F.col("kind").alias("kind"), F.col("name").alias("name"), none.alias("hash"))
    hashed = F.struct(F.lit("hash").alias("tag"), path.alias("path"), none.alias("kind"), none.alias("name"), F.col("hash").alias("hash"))
    return F.when(tag_module, hashed).otherwise(named)


def occurrences(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of all versions with version, key and ord, a string that sorts as the first appearance of their hash does."""
    rows = chunks.join(indexed_versions(versions), "commit")
    modules = F.count_if(F.col("kind") == "module").over(Window.partitionBy("commit", "path"))
    rows = rows.withColumn("key", identity_key((F.col("kind") == "module") & (modules != 1)))
    first = rows.groupBy("hash").agg(F.min(F.struct("version", "path", "start_line", "name")).alias("first"))
    at = lambda x: F.lpad(F.col(f"first.{x}").cast("string"), 10, "0")
    first = first.select("hash", F.concat_ws("\0", at("version"), "first.path", at("start_line"), "first.name", "hash").alias("ord"))
    return rows.join(first, "hash")


def versions_of(occ: DataFrame) -> DataFrame:
    return occ.select("version", "label").distinct()


def merge_threshold(a: str, b: str, duplicate: float = DUPLICATE, renamed: float = RENAMED) -> Column:
    """The similarity that two keys must exceed to be one piece of code; null if they never are."""
    f = lambda k, x: F.col(f"{k}.{x}")
    module = lambda k: (f(k, "tag") == "hash") | (f(k, "kind") == "module")
    last = lambda k: F.substring_index(f(k, "name"), ".", -1)
    return (
        F.when(module(a) | module(b), F.when(module(a) & module(b) & (f(a, "path") == f(b, "path")), F.lit(renamed)))
        .when(f(a, "name") == f(b, "name"), F.lit(duplicate))
        .when(f(a, "path") != f(b, "path"), F.lit(None))
        .when((f(a, "kind") == "method") & (f(b, "kind") == "method") & (last(a) == last(b)), F.lit(renamed))
        .otherwise(F.lit(duplicate))
    )


def threshold(a: dict, b: dict, duplicate: float = DUPLICATE, renamed: float = RENAMED) -> float | None:
    """The same for two keys as dictionaries."""
    blocks = [k["tag"] == "hash" or k["kind"] == "module" for k in (a, b)]
    if any(blocks):
        return renamed if all(blocks) and a["path"] == b["path"] else None
    if a["name"] != b["name"] and a["path"] != b["path"]:
        return None
    moved = a["name"] != b["name"] and a["kind"] == b["kind"] == "method" and a["name"].rpartition(".")[2] == b["name"].rpartition(".")[2]
    return renamed if moved else duplicate


def _pairs(keys: list[dict], similar: np.ndarray, i: int, duplicate: float, renamed: float) -> list[tuple[float, int, int]]:
    """(-similarity, i, j) of the items j after i that are like it enough to be the same code."""
    out = []
    for j in range(i + 1, len(keys)):
        least = threshold(keys[i], keys[j], duplicate, renamed)
        if least is not None and similar[j] > least:
            out.append((-float(similar[j]), i, j))
    return out


def _grouped(duplicate: float, renamed: float):
    """Greedy merge of one query's items: the most similar pairs first, unless a version holds both sides."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("item")
        item = rows.column("item").to_numpy()
        vectors = rows.column("vector").combine_chunks()
        v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(item), -1)
        items, first = np.unique(item, return_index=True)
        ends = [*first[1:].tolist(), len(item)]
        keys = [rows.column("key")[k].as_py() for k in first.tolist()]
        held = [set() for _ in keys]
        for at, versions in zip(np.searchsorted(items, item).tolist(), rows.column("versions").to_pylist()):
            held[at].update(versions)
        edges = []
        for i, (a, b) in enumerate(zip(first.tolist(), ends)):
            similar = np.maximum.reduceat((v[a:b] @ v.T).max(0), first)  # the best of all pairs of their texts
            edges += _pairs(keys, similar, i, duplicate, renamed)
        root = list(range(len(keys)))

        def top(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for _, i, j in sorted(edges):
            i, j = top(i), top(j)
            if i != j and held[i].isdisjoint(held[j]):
                root[j] = i
                held[i] |= held[j]
        tops = [top(i) for i in range(len(keys))]
        number = {t: n for n, t in enumerate(sorted(set(tops)))}
        lineage = [number[t] for t in tops]
        query = pa.array([rows.column("query_id")[0].as_py()] * len(keys), pa.int64())
        return pa.table({"query_id": query, "item": pa.array(items, pa.int32()), "lineage": pa.array(lineage, pa.int32())})

    return run


def search_all_versions(
    queries: DataFrame, occ: DataFrame, vectors: DataFrame, k: int = 10, prefer: str = "latest", tie: float = TIE, duplicate: float = DUPLICATE,
    renamed: float = RENAMED, penalty: float = PENALTY, pool: int | None = None,
) -> dict[str, DataFrame]:
    """lineages, timeline and flat for (query_id, vector); ``occ`` from occurrences(), ``vectors`` (hash, vector). Timelines are those of
    the ``k`` lineages."""
    if prefer not in ("latest", "score"):
        raise ValueError("prefer is latest or score")
    size = pool or max(10 * k, 100)
    unit = queries.select("query_id", l2_normalise(F.col("vector")).alias("vector"))
    distinct = occ.select("hash", "ord").distinct().join(vectors.select("hash", "vector"), "hash")
    nearest = dense_topk(unit, distinct.select(F.col("ord").alias("doc_id"), "vector"), size)
    top = nearest.select("query_id", F.substring_index("doc_id", "\0", -1).alias("hash"), F.col("doc_id").alias("ord"), "score", F.col("rank").alias("nth"))
    touched = top.join(occ.select("hash", "key", "version", "path", "start_line", "name"), "hash")
    first = touched.groupBy("query_id", "key").agg(F.min(F.struct("nth", "version", "path", "start_line", "name")).alias("first"))
    items = first.select("query_id", "key", (F.row_number().over(Window.partitionBy("query_id").orderBy("first")) - 1).alias("item"))
    # the texts of each item: those of all versions, whether in the pool or not
    texts = occ.groupBy("key", "hash").agg(F.collect_set("version").alias("versions"))
    codes = items.join(texts, "key").join(vectors.select("hash", "vector"), "hash").join(unit.withColumnRenamed("vector", "qv"), "query_id")
    codes = save(codes.select("query_id", "item", "key", "hash", "versions", "vector", dot(F.col("qv"), F.col("vector")).alias("score")), "codes")
    grouped = codes.select("query_id", "item", "key", "versions", "vector").groupBy("query_id").applyInArrow(_grouped(duplicate, renamed), "query_id long, item int, lineage int")
    # read by the ranking, the timelines and the flat list: a pool's rows for each query
    scored = codes.select("query_id", "item", "key", "hash", "score").join(grouped, ["query_id", "item"])
    rows = save(scored.join(occ, ["key", "hash"]), "rows")
    drop(codes)
    order = Window.partitionBy("query_id", "lineage", "version").orderBy(F.desc("score"), "item", "ord", "path", "start_line", "name")
    per_version = rows.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    of = Window.partitionBy("query_id", "lineage")
    top_score = F.max("score").over(of)
    near = (F.col("score") >= F.col("best_score") - tie) if prefer == "latest" else (F.col("score") == F.col("best_score"))
    best_rows = per_version.withColumn("best_score", top_score).withColumn("shown", F.max(F.when(near, F.col("version"))).over(of))
    minus = F.when((F.col("kind") == "module") | ((F.col("kind") == "file") & (F.col("language") != "python")), F.lit(penalty)).otherwise(F.lit(0.0))
    codes_of = best_rows.groupBy("query_id", "lineage").agg(F.countDistinct("hash").alias("n_distinct_code"))
    shown = best_rows.filter("version = shown").withColumn("penalty", minus).withColumn("rank_score", F.col("best_score") - F.col("penalty"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), F.desc("version"), "lineage"))
    lineages = shown.join(codes_of, ["query_id", "lineage"]).withColumn("rank", place).select(
        "query_id", "rank", "lineage", "id", "path", "name", "kind", "start_line", "end_line", "hash", F.col("version"), F.col("score").alias("representative_score"),
        "best_score", "penalty", "rank_score", "n_distinct_code", (F.col("n_distinct_code") > 1).alias("changed"),
    )
    # versions are as few as someone chose to index; only the lineages that are shown have a timeline
    best = save(lineages.filter(F.col("rank") <= k), "lineages")
    every = best.select("query_id", "lineage").crossJoin(versions_of(occ))
    states = every.join(best_rows.select("query_id", "lineage", "version", "hash", "score"), ["query_id", "lineage", "version"], "left")
    earlier = Window.partitionBy("query_id", "lineage").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("hash", ignorenulls=True).over(earlier)  # of the last version that had the code
    states = states.withColumn("before", before)
    state = F.when(F.col("hash").isNull(), ABSENT).when(F.col("before").eqNullSafe(F.col("hash")), SAME).otherwise(NEW)
    timeline = states.select("query_id", "lineage", "version", "label", state.alias("state"), "score")
    text = timeline.groupBy("query_id", "lineage").agg(F.sort_array(F.collect_list(F.struct("version", "label", "state"))).alias("t"))
    text = text.select("query_id", "lineage", F.array_join(F.transform("t", lambda x: F.concat(x["label"], F.lit(" "), x["state"])), " ").alias("timeline"))
    flat = top.join(occ.select("hash", "version", "id"), "hash").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("version"), "nth", "id")))
    of_chunk = rows.groupBy("query_id", "version", "id").agg(F.max("lineage").alias("lineage"))
    flat = flat.filter(F.col("rank") <= max(k, 10)).join(of_chunk, ["query_id", "version", "id"]).select("query_id", "rank", "version", "id", "score", "lineage")
    return {"lineages": best.join(text, ["query_id", "lineage"]), "ranked": lineages, "timeline": timeline, "flat": flat}

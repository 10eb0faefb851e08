import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.operators import metrics, search
from codestrata.operators.lineage import occurrences, search_all_versions


def vectors(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} long, vector array<double>")


def test_dense_paths_agree_on_ties(spark):
    rng = np.random.default_rng(0)
    docs = vectors(spark, [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(200)])
    q = vectors(spark, [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(7)], "query_id")
    a = search.dense_topk(q, docs, 5).select("query_id", "rank", "doc_id", "score").collect()
    b = search.dense_topk_blocks(q, docs, 5).select("query_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 35
    with pytest.raises(ValueError):
        search.dense_topk(q, docs, 0)


def test_topk_keeps_few_rows_before_the_shuffle(spark):
    docs = vectors(spark, [(i, [float(i)]) for i in range(10)])
    plan = search.dense_topk(vectors(spark, [(0, [1.0])], "query_id"), docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bm25_against_brute_force(spark):
    docs = {1: "a b b c".split(), 2: "a c d".split(), 3: "a a a".split(), 4: []}
    query = "a b b z".split()
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    want = {d: sum(idf.get(t, 0) * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / avgdl)) for t in query) for d, ts in docs.items()}
    index = search.Bm25(spark.createDataFrame(list(docs.items()), "doc_id long, tokens array<string>"))
    got = {r["doc_id"]: r["score"] for r in index.scores(spark.createDataFrame([(0, query)], "query_id long, tokens array<string>")).collect()}
    assert got == pytest.approx({d: s for d, s in want.items() if s > 0})
    none = search.Bm25(spark.createDataFrame([], "doc_id long, tokens array<string>"))
    assert none.weights().count() == 0 == none.scores(spark.createDataFrame([(0, query)], "query_id long, tokens array<string>")).count()


def test_few_and_many_queries_give_the_same(spark):
    """Vectors that hold nulls or no numbers, or are of another length, never come back, whatever the number of queries."""
    docs = vectors(spark, [(1, [1.0, 0.0]), (2, [0.5, 0.1]), (3, [math.nan, 1.0]), (4, [None, 1.0]), (5, [math.inf, 1.0]), (6, [1.0]), (7, None), (8, []), (9, [1.0, 0.0])])
    for n in (1, 64, 65, 200):
        q = vectors(spark, [*[(i, [1.0, float(i)]) for i in range(n)], (1000, None), (1001, [math.nan, 1.0])], "query_id")
        got = [(r["doc_id"], r["score"], r["rank"]) for r in search.dense_topk(q, docs, 5).filter("query_id = 0").orderBy("rank").collect()]
        assert got == [(1, 1.0, 1), (9, 1.0, 2), (2, 0.5, 3)]
        with pytest.raises(ValueError):
            search.dense_topk(q, docs.withColumn("doc_id", F.struct("doc_id")), 5)
        with pytest.raises(ValueError):
            search.dense_topk(q.union(vectors(spark, [(5000, [1.0])], "query_id")), docs, 5)
    assert search.dense_topk(q.limit(0), docs, 5).count() == 0


def test_occurring(spark):
    from codestrata.operators.training import occurring

    docs = {1: "x one two three four five six seven", 2: "one two three four five si", 3: "xone two three four five sixty", 4: "short item", 5: "", 6: None}
    items = {10: "one two three four five six", 11: "short", 12: "", 13: None, 14: "two  three"}
    got = occurring(spark.createDataFrame(list(items.items()), "query_id long, text string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in got) == sorted((q, d) for q, i in items.items() for d, t in docs.items() if i and t and i in t)


def test_engine(spark):
    docs = vectors(spark, [(1, [1.0]), (2, [0.5])])
    engine = search.SearchEngine([search.SearchSource("b", docs), search.SearchSource("a", docs)])
    got = engine.search(vectors(spark, [(0, [1.0])], "query_id"), 3).orderBy("rank").collect()
    assert [(r["source"], r["doc_id"]) for r in got] == [("b", 1), ("a", 1), ("b", 2)]
    for bad in ({"sources": ["c"]}, {"k": 0}):
        with pytest.raises(ValueError):
            engine.search(vectors(spark, [(0, [1.0])], "query_id"), **bad)
    with pytest.raises(ValueError):
        search.SearchEngine([search.SearchSource("a", docs)] * 2)
    assert engine.search(vectors(spark, [(0, [1.0])], "query_id"), 3, []).count() == 3  # no names: all sources

    class Encoder:
        def query(self, text):
            return [2.0]

    asked = search.SearchEngine([search.SearchSource("a", docs, 1)], Encoder()).ask("what", 5)
    assert [(h["doc_id"], h["score"]) for h in asked["hits"]] == [(1, 1.0), (2, 0.5)] and asked["n_searched"] == 2 and asked["total_ms"] >= asked["search_ms"] > 0
    with pytest.raises(ValueError):
        search.SearchSource("a", docs, 2).search(vectors(spark, [(0, [1.0])], "query_id"), 1)


def test_best_of_each_is_what_sources_find(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, rng.integers(0, 3, 3).astype(float).tolist(), i % 4) for i in range(90)], "doc_id long, vector array<double>, label int")
    q = vectors(spark, [(i, rng.integers(0, 3, 3).astype(float).tolist()) for i in range(5)], "query_id")
    engine = search.SearchEngine([search.SearchSource(str(n), docs.filter(F.col("label") == n)) for n in range(4)])
    want = sorted((r["query_id"], r["rank"], int(r["source"]), r["doc_id"], r["score"]) for r in engine.search(q, 6).collect())
    assert want == sorted((r["query_id"], r["rank"], r["label"], r["doc_id"], r["score"]) for r in search.best_of_each(q, docs, "label", 6).collect())


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 12, 1), (2, 99, 1), (3, 5, 0)], "query_id long, doc_id long, score int")
    r = metrics.evaluate(run, qrels, (2, 10)).first()
    first = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert r["queries"] == 2 and r["ndcg_at_10"] == pytest.approx(first / 2) and r["mrr_at_10"] == 0.25
    assert r["recall_at_2"] == 0.25 and r["map_at_10"] == pytest.approx((1 / 2 + 2 / 3) / 4) and r["precision_at_2"] == 0.25


def at(cos):
    """A unit vector with that similarity to (1, 0)."""
    return [cos, math.sqrt(1 - cos * cos)]


def lineages(spark, versions, codes, **options):
    """Chunks of each version as (path, name, kind, hash), and the vector of each hash."""
    rows = [(f"c{v}", f"{p}#{n}@{k}", p, n, kind, k, k, h, "python" if p.endswith(".py") else "markdown") for v, chunks in enumerate(versions) for k, (p, n, kind, h) in enumerate(chunks)]
    chunks = spark.createDataFrame(rows, "commit string, id string, path string, name string, kind string, start_line int, end_line int, hash string, language string")
    meta = spark.createDataFrame([(f"c{v}", f"s{v}", [f"v{v}"], f"202{v}") for v in range(len(versions))], "commit string, short string, refs array<string>, committed_at string")
    vecs = spark.createDataFrame(list(codes.items()), "hash string, vector array<double>")
    found = search_all_versions(spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>"), occurrences(chunks, meta), vecs, **options)
    return found["lineages"].orderBy("rank").collect()


def test_latest_near_best_is_shown(spark):
    v = [[("a.py", "f", "function", "x")], [("a.py", "f", "function", "y")]]
    codes = {"x": at(0.80), "y": at(0.795)}
    assert lineages(spark, v, codes)[0]["version"] == 1
    assert lineages(spark, v, codes, prefer="score")[0]["version"] == 0
    assert lineages(spark, v, codes, tie=0.001)[0]["version"] == 0


def test_merges(spark):
    turn = lambda c, d: [c * d - math.sqrt(1 - c * c) * math.sqrt(1 - d * d), c * math.sqrt(1 - d * d) + d * math.sqrt(1 - c * c)]
    f = lambda p, n, kind, h: (p, n, kind, h)
    x = at(0.8)
    cases = [
        ([[f("a.py", "f", "function", "x"), f("a.py", "g", "function", "y")]], 0.99, 2),  # both in one version
        ([[f("a.py", "f", "function", "x")], [f("a.py", "g", "function", "y")]], 0.97, 1),  # renamed in place
        ([[f("a.py", "f", "function", "x")], [f("b.py", "g", "function", "y")]], 0.99, 2),  # other name and file
        ([[f("a.py", "f", "function", "x")], [f("b.py", "f", "function", "y")]], 0.97, 1),  # moved
        ([[f("a.py", "A.f", "method", "x")], [f("a.py", "B.f", "method", "y")]], 0.92, 1),  # class renamed
        ([[f("a.py", "A.f", "method", "x")], [f("a.py", "B.f", "method", "y")]], 0.85, 2),
        ([[f("a.py", "<module>", "module", "x"), f("a.py", "<module>", "module", "z")], [f("a.py", "<module>", "module", "y")]], 0.92, 2),
    ]
    for versions, cos, n in cases:
        assert len(lineages(spark, versions, {"x": x, "y": turn(0.8, cos), "z": [-1.0, 0.0]})) == n, (versions, cos)


def test_penalties_and_guards(spark):
    v = [[("a.py", "f", "function", "x"), ("a.py", "<module>", "module", "y"), ("R.md", "R.md", "file", "z")]]
    got = lineages(spark, v, {"x": at(0.5), "y": at(0.54), "z": at(0.53)})
    assert [r["name"] for r in got] == ["f", "<module>", "R.md"]
    with pytest.raises(ValueError):
        lineages(spark, v, {"x": at(0.5), "y": at(0.5), "z": at(0.5)}, prefer="newest")


def test_restrict(spark):
    run = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query_id long, doc_id long, score double")
    assert search.restrict(run, run.filter(F.col("doc_id") == 2).select("query_id", "doc_id")).count() == 1


def test_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(150)] + [(900, None), (901, []), (902, [1.0]), (903, [math.nan, 0.0, 0.0, 0.0])]
    q, docs = vectors(spark, rows[:100], "query_id"), vectors(spark, rows)
    one = search.dense_topk(q, docs, 5).collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 30)
    several = search.dense_topk(q, docs, 5).collect()
    want = []
    for i, v in rows[:100]:
        best = sorted(((-float(np.dot(v, w)), j) for j, w in rows[:150]))[:5]
        want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, one)) == sorted(map(tuple, several)) == sorted(want)
    named = search.dense_topk(q, docs.withColumn("doc_id", F.format_string("%04d", "doc_id")), 5).collect()
    assert sorted((r[0], int(r[1]), r[2], r[3]) for r in named) == sorted(want)
    with pytest.raises(ValueError):
        search.dense_topk(q, docs.withColumn("doc_id", F.struct("doc_id")), 5)
    with pytest.raises(ValueError):
        search.dense_topk_blocks(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])], "query_id"), docs, 5)
    assert search.dense_topk_blocks(q.filter("query_id < 0"), docs, 5).count() == 0 == search.dense_topk_blocks(q, docs.filter("doc_id < 0"), 5).count()


def test_near_best(spark):
    docs = spark.createDataFrame([(i, [float(i % 7)], i % 3) for i in range(60)], "doc_id long, vector array<double>, label int")
    got = search.near_best(vectors(spark, [(1, [1.0]), (2, [-1.0])], "query_id"), docs, "label", 1.0).collect()
    want = {(q, i) for q, sign in ((1, 1), (2, -1)) for i in range(60) if sign * (i % 7) >= max(sign * (j % 7) for j in range(60) if j % 3 == i % 3) - 1}
    assert {(r["query_id"], r["doc_id"]) for r in got} == want


@pytest.mark.parametrize("find", ["dense_topk_blocks", "best_of_each", "near_best"])
def test_memory_of_a_task_with_a_whole_block_of_queries(monkeypatch, find):
    """A task holds the k best of each query and a part's scores: not all pairs of its queries and rows, nor an id for each pair."""

    class Caught(Exception):
        pass

    def caught(queries, docs, columns, keep):
        raise Caught(columns, keep)

    monkeypatch.setattr(search, "_each_block", caught)
    with pytest.raises(Caught) as stopped:
        {"dense_topk_blocks": lambda: search.dense_topk_blocks(None, None, 20), "best_of_each": lambda: search.best_of_each(None, None, "label", 20), "near_best": lambda: search.near_best(None, None, "label")}[find]()
    columns, keep = stopped.value.args
    n, rng = 2048, np.random.default_rng(0)
    rows = {"doc_id": [f"{i:060d}" for i in range(n)], "label": [f"{i % 10:030d}" for i in range(n)], "vector": rng.normal(size=(n, 8)).astype(np.float32).tolist()}
    queries, got = rng.normal(size=(search.QUERY_BLOCK, 8)), 0
    tracemalloc.start()
    for at, _, _ in keep(queries, search._slices(iter([pa.RecordBatch.from_pydict({k: rows[k] for k in {*columns, "vector"}})]), columns)):
        got += len(at)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert got >= 10 * search.QUERY_BLOCK and peak < 120, peak


def test_equal_scores_beyond_the_kth_place(spark):
    """Copies of one vector, many more than k, in any order and in several partitions: the smallest ids come back."""
    docs = spark.createDataFrame([(f"d{(i * 7919) % 5000:04d}", [1.0, float(i % 2)]) for i in range(5000)], "doc_id string, vector array<double>").repartition(3)
    q = vectors(spark, [(i, [1.0, float(i % 3)]) for i in range(70)], "query_id")
    got = search.dense_topk_blocks(q, docs, 7).filter("query_id = 0").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [f"d{i:04d}" for i in range(7)]
    best = search.best_of_each(q, docs.withColumn("label", F.substring("doc_id", 5, 1)), "label", 7).filter("query_id = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in best] == sorted((x for x in {f"d{(i * 7919) % 5000:04d}" for i in range(1, 5000, 2)}), key=lambda x: (x[4], x))[:7]


def test_postings_are_not_shuffled(spark):
    """Whatever Spark may broadcast: scores are summed where a document is, and a term's statistics need no join with its postings."""
    from codestrata.plans import retrieval

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for f in (retrieval.bm25_topk, retrieval.bm25_stats)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("Join" in p for p in plans) and {x.partition("#")[0] for x in re.findall(r"hashpartitioning\(([^)]*)\)", plans[0])} == {"query_id"}


def test_word_index_in_small_parts(spark, monkeypatch):
    """Blocks of queries, parts of documents and of sums give what brute force gives; ties go to the smaller id, negative idf included."""
    for name, value in (("QUERY_BLOCK", 3), ("PENDING", 20), ("COUNTED", 7), ("OUT_ROWS", 4)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    docs = {i: [f"t{x}" for x in rng.integers(0, 6, rng.integers(0, 9))] for i in range(40)} | {40: ["every"], 41: None}
    docs = {i: [*d, "every"] if d is not None and i % 4 else d for i, d in docs.items()}
    asked = {q: [f"t{x}" for x in rng.integers(0, 8, 5)] + ["every"] for q in range(8)}
    index = search.Bm25(spark.createDataFrame(list(docs.items()), "doc_id long, tokens array<string>"))
    n, avgdl = len(docs), sum(len(d or []) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d or []))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if v < 0 else v for t, v in raw.items()}
    weight = lambda t, d: idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) if d else 0
    queries = spark.createDataFrame(list(asked.items()), "query_id long, tokens array<string>")
    want = {(q, i): s for q, ts in asked.items() for i, d in docs.items() if (s := sum(weight(t, d) for t in ts)) > 0}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in index.scores(queries).collect()} == pytest.approx(want)
    few = [i for i in docs if i % 3]
    for among in (None, spark.createDataFrame([(i,) for i in few], "doc_id long")):
        got = {(r["query_id"], r["rank"]): r["doc_id"] for r in index.topk(queries, 4, among).collect()}
        for q in asked:
            best = sorted((-round(s, 9), i) for (x, i), s in want.items() if x == q and (among is None or i in few))[:4]
            assert [got.get((q, r)) for r in range(1, len(best) + 1)] == [i for _, i in best]
    found = {r["term"]: (r["df"], r["occurrences"], round(r["top_weight"], 9)) for r in index.statistics().collect()}
    assert found == {t: (f, sum((d or []).count(t) for d in docs.values()), round(max(weight(t, d) for d in docs.values() if d and t in d), 9)) for t, f in df.items()}


def test_judgements_read_documents_once_and_carry_no_text_with_runs(spark, monkeypatch):
    """What metrics read of the judgements is a written table, and what is joined by runs of words holds no texts."""
    from codestrata.operators import training
    from codestrata.plans import retrieval

    saved = []
    monkeypatch.setattr(training, "save", lambda df, name: saved.append(df._jdf.queryExecution().optimizedPlan().toString()) or retrieval.save(df, name), raising=False)
    plan = retrieval._qrels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert len(saved) == 1 and not any("text#" in line.split("Generate")[1].split("[")[-1] for line in saved[0].splitlines() if "Generate" in line)

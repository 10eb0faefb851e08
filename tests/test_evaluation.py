import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.cli import main
from codestrata.functions.hashing import HashingEmbedder, ModelEmbedder
from codestrata.operators import dataset, metrics, training
from codestrata.operators.corpus_index import cached_vectors, load_index, write_index
from codestrata.operators.evaluation import EncoderAdapter, Retrievers, SearchAdapter, abstention, evaluate, grid, summary

CORPUS = [("d1", "", "def parse_line(line): return line.split()", None, "test", "Python"), ("d2", "Wait", "def backoff_delay(n): return 2 ** n", "", "test", None), ("d3", None, "class Client: pass", "http://x", "test", "python"), ("d4", "", "def open_socket(host): return host", None, "test", "python")]
QUERIES = [("q1", "parse a line\n-----Input-----\nline\n-----Examples-----\n1", "test"), ("q2", "backoff delay", "test"), ("q3", "unjudged", "test")]
QRELS = [("q1", "d1", 1), ("q2", "d2", 1), ("q2", "d3", 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    (path / "queries.jsonl").write_text("".join(json.dumps(dict(zip(("query_id", "text", "partition"), q))) + "\n\n" for q in QUERIES))
    spark.createDataFrame([(*c[:1], *c[1:], 7) for c in CORPUS], "doc_id string, title string, text string, url string, partition string, language string, extra int").write.parquet(str(path / "corpus.parquet"))
    spark.createDataFrame(QRELS, "query_id string, doc_id string, score int").write.parquet(str(path / "qrels.parquet"))
    return str(path)


def test_files(spark, folder, tmp_path):
    assert dataset.read_jsonl(spark, f"{folder}/queries.jsonl", dataset.QUERIES).count() == 3 and dataset.read_jsonl(spark, f"{folder}/none.jsonl", dataset.QUERIES).count() == 0
    (tmp_path / "broken.jsonl").write_text('{"query_id": "q"\n')
    with pytest.raises(Exception):  # noqa: B017
        dataset.read_jsonl(spark, str(tmp_path / "broken.jsonl"), dataset.QUERIES).collect()
    rows = spark.createDataFrame([("é", None)], "a string, b string")
    dataset.write_jsonl(rows, str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert lines == '{"a":"é","b":null}\n'
    for content in ({"é": 1}, {"a": [2]}):
        dataset.write_json(spark, str(tmp_path / "x.json"), content)
        assert dataset.read_json(spark, str(tmp_path / "x.json")) == content
    assert [p.name for p in tmp_path.iterdir() if "x.json" in p.name and not p.name.startswith(".")] == ["x.json"] and dataset.read_json(spark, str(tmp_path / "y.json")) is None


def test_load(spark, folder, tmp_path):
    data = dataset.load(spark, folder)
    assert (data.queries.count(), data.corpus.count(), data.qrels.count()) == (3, 4, 3) and "extra" not in data.corpus.columns
    judged = dataset.load(spark, folder, "test")
    assert {r[0] for r in judged.queries.select("query_id").collect()} == {"q1", "q2"} and {r[0] for r in judged.corpus.select("doc_id").collect()} == {"d1", "d2"}
    with pytest.raises(ValueError):
        dataset.load(spark, folder, "train")
    assert {r["doc_id"]: r["text"] for r in data.documents("> ").collect()}["d2"] == "> Wait def backoff_delay(n): return 2 ** n"
    small = data.smoke(1, 3)
    assert [r[0] for r in small.queries.select("query_id").collect()] == ["q1"] and small.corpus.count() == 3 and small.qrels.count() == 1
    assert [r[0] for r in dataset.limited(data.corpus, 2).select("doc_id").collect()] == ["d1", "d2"] and dataset.limited(data.corpus, None) is data.corpus
    lost = {r["missing"]: r["n"] for r in training.missing(data.qrels, data.queries.filter("query_id = 'q1'"), data.corpus.limit(0)).collect()}
    assert lost == {"query": 1, "document": 2}
    spark.createDataFrame([QUERIES[0]] * 2, dataset.QUERIES).write.parquet(str(tmp_path / "queries.parquet"))
    with pytest.raises(ValueError):
        dataset.load(spark, str(tmp_path))


def test_settings(tmp_path):
    assert dataset.resolve_preset()[0] == dataset.DEFAULT_PRESET == dataset.resolve_preset(model="nomic-ai/CodeRankEmbed")[0]
    assert dataset.resolve_preset(model="x")[1]["query_prefix"] == "" and dataset.resolve_preset(model="x")[0] == "custom"
    with pytest.raises(ValueError):
        dataset.resolve_preset("none")
    model = tmp_path / "model"
    model.mkdir()
    (model / "weights").write_bytes(b"1")
    first = dataset.fingerprint(str(model))
    (model / "weights").write_bytes(b"22")
    assert len(first) == 12 and dataset.fingerprint(str(model)) != first and dataset.fingerprint("a/b") == ""
    (model / "finetune_config.json").write_text('{"run_id": "r7", "base_preset": "coderankembed"}')
    assert dataset.fingerprint(str(model)) == "r7" and dataset.resolve_preset(model=str(model))[0] == "coderankembed"
    assert dataset.cache_key("a/b c", 512, 3, "x").startswith("a_b_c__len512__p1__n3_") and dataset.cache_key("a", 1, 1, "x") != dataset.cache_key("a", 1, 1, "y")


def test_statistics(spark, folder):
    data = dataset.load(spark, folder)
    r = dataset.clean_statistics(data.queries, "desc").first()
    assert r["queries"] == 3 and r["changed"] == 1 and r["chars_after"] == pytest.approx((12 + 13 + 8) / 3)
    one, again, other = (dataset.digest(df, "doc_id", "text").first() for df in (data.corpus, data.corpus.repartition(5), data.corpus.withColumn("text", F.upper("text"))))
    assert one == again != other and dataset.digest(data.corpus.limit(0), "doc_id", "text").first()["digest"] == "0"


def test_corpus_index(spark, folder, tmp_path):
    corpus, path = dataset.load(spark, folder).corpus, str(tmp_path / "index")
    manifest = write_index(corpus, HashingEmbedder(32), path, "demo", cache=str(tmp_path / "cache"))
    source = load_index(spark, path)
    assert source.manifest == manifest and len(source) == 4 and source.dim == 32 and source.name == "demo"
    query = spark.createDataFrame([(0, HashingEmbedder(32).query("backoff delay"))], "query_id long, vector array<float>")
    assert source.search(query, 1).first()["doc_id"] == "d2"
    assert {r["doc_id"]: (r["url"], r["language"]) for r in source.docs.collect()}["d2"] == (None, "python")
    with pytest.raises(ValueError):
        source.search(query.withColumn("vector", F.array(F.lit(1.0))), 1)

    class Never:
        model_id = "hashing-32"

        def documents(self, text):
            return F.raise_error(F.lit("embedded again")).cast("array<float>")

    docs = dataset.Dataset(corpus, corpus, corpus).documents()
    assert cached_vectors(docs, Never(), str(tmp_path / "cache")).count() == 4
    rows = spark.createDataFrame(spark.read.parquet(f"{path}/docs").collect(), spark.read.parquet(f"{path}/docs").schema)
    first = rows.filter("id = 'd1'")
    for broken in (rows.filter("id <> 'd1'"), rows.filter("id <> 'd2'").unionByName(first), rows.withColumn("vector", F.slice("vector", 1, 8)), rows.withColumn("code", F.upper("code"))):
        broken.write.mode("overwrite").parquet(f"{path}/docs")
        with pytest.raises(ValueError):
            load_index(spark, path)
    dataset.write_json(spark, f"{path}/manifest.json", manifest | {"format_version": 99})
    with pytest.raises(ValueError):
        load_index(spark, path)
    with pytest.raises(ValueError):
        load_index(spark, str(tmp_path / "nothing"))


def test_abstention():
    values = np.array([0.0, 0.0, 1.0, 1.0, 1.0, 0.5, 0.2, 0.9, 0.1, 0.7])
    assert abstention(values, values) == pytest.approx(1) and abstention(-values, values) < 0
    assert math.isnan(abstention(values, np.ones(10)))


def test_grid_and_runs(spark, folder, tmp_path):
    assert grid(["desc", "none", "desc"], ["bm25", "dense"]) == [("desc", "bm25"), ("desc", "dense"), ("none", "bm25"), ("none", "dense")]
    data = dataset.load(spark, folder)
    report = evaluate(data, ["dense", "bm25", "hybrid"], ["none", "desc-io"], HashingEmbedder(), cuts=(1, 10), out=str(tmp_path / "out"))
    assert [v["variant"] for v in report["variants"]] == [f"{r}/{m}" for m in ("none", "desc-io") for r in ("dense", "bm25", "hybrid")]
    for v in report["variants"]:
        made = Retrievers(data.documents(), HashingEmbedder())
        asked = data.queries if v["query_clean"] == "none" else data.queries.withColumn("text", F.when(F.col("query_id") == "q1", "parse a line\n\nInput:\nline").otherwise(F.col("text")))
        run = {(r["query_id"], r["doc_id"]): r["rank"] for r in made.run(v["retriever"], asked, 10).collect()}
        gain = lambda q, d: 1 / math.log2(run[q, d] + 1) if (q, d) in run else 0.0  # noqa: B023, E731
        assert v["scores"]["ndcg_at_10"] == pytest.approx((gain("q1", "d1") + gain("q2", "d2")) / 2) and v["scores"]["queries"] == 2
        assert v["scores"]["accuracy_at_1"] == sum(run.get(x) == 1 for x in (("q1", "d1"), ("q2", "d2"))) / 2
        assert dataset.read_json(spark, f"{tmp_path}/out/{v['retriever']}_{v['query_clean']}.json")["variant"] == v["variant"]
    assert report["variants"][3]["queries"]["changed"] == 1 and len(summary(report).splitlines()) == 7
    assert len(dataset.read_json(spark, f"{tmp_path}/out/results.json")["variants"]) == 6
    with pytest.raises(ValueError):
        Retrievers(data.documents()).run("dense", data.queries)
    with pytest.raises(ValueError):
        Retrievers(data.documents()).run("guess", data.queries)


def test_all_cuts(spark):
    run = spark.createDataFrame([(1, 10 + n, n) for n in range(1, 31)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 14, 1), (1, 30, 1), (1, 99, 1)], "query_id long, doc_id long, score int")
    r = metrics.evaluate(run, qrels).first()
    found = [4, 20]
    for k in metrics.CUTS:
        hits = [x for x in found if x <= k]
        ideal = sum(1 / math.log2(n + 2) for n in range(min(3, k)))
        assert r[f"ndcg_at_{k}"] == pytest.approx(sum(1 / math.log2(x + 1) for x in hits) / ideal) and r[f"recall_at_{k}"] == pytest.approx(len(hits) / 3)
        assert r[f"precision_at_{k}"] == pytest.approx(len(hits) / k) and r[f"mrr_at_{k}"] == pytest.approx(1 / 4 if hits else 0)
        assert r[f"map_at_{k}"] == pytest.approx(sum((n + 1) / x for n, x in enumerate(hits)) / min(3, k)) and r[f"accuracy_at_{k}"] == r[f"hit_rate_at_{k}"] == bool(hits)


def test_adapters(spark):
    class Kind:
        value = "query"

    own = EncoderAdapter(spark, HashingEmbedder(16), query_prefix="find ", query_clean="desc")
    got = own.encode([{"text": ["parse line", "x"]}, {"text": [""]}], prompt_type=None)
    assert got.shape == (3, 16) and np.allclose(np.linalg.norm(got, axis=1), [1, 1, 0], atol=1e-6)
    assert not np.allclose(own.encode([{"text": ["parse line"]}], prompt_type=Kind())[0], got[0])
    found = SearchAdapter(spark)
    with pytest.raises(ValueError):
        found.search([], top_k=1)
    found.index([{"id": i, "title": t, "text": x} for i, t, x, *_ in CORPUS])
    asked = [{"id": "q", "text": "backoff delay"}, {"id": "z", "text": "nothing here"}]
    assert list(found.search(asked, top_k=2)["q"]) == ["d2"] and found.search(asked, top_k=2)["z"] == {}
    assert found.search(asked, top_k=2, top_ranked={"q": ["d1"]})["q"] == {}


def test_model_embedder(spark):
    made = ModelEmbedder("toy", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], "q: ", "none")
    rows = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [list(r[0]) for r in rows.select(made.documents(F.col("text"))).collect()] == [[2.0, 1.0], [0.0, 1.0]] and made.query(" ab ") == [5.0, 1.0]


def test_training_helpers(spark):
    history = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.7, 3.0), (3, 0.7, 4.0)], "epoch int, mrr double, seconds double")
    got = {r["epoch"]: (r["total_seconds"], r["best"]) for r in training.best_epoch(history).collect()}
    assert got == {1: (2.0, False), 2: (5.0, True), 3: (9.0, False)}


def test_commands(spark, folder, tmp_path, capsys):
    assert main(["--store", str(tmp_path / "index"), "corpus-index", "--data", folder, "--limit", "3"], spark) == 0
    assert main(["--store", str(tmp_path / "eval"), "evaluate", "--data", folder, "--retriever", "bm25", "--query-clean", "none", "--smoke", "2", "4"], spark) == 0
    out = capsys.readouterr().out
    assert "3 documents" in out and "bm25/none" in out and load_index(spark, str(tmp_path / "index")).manifest["limit"] == 3

import pytest

from codestrata.cli import main, search, search_all
from codestrata.functions.hashing import HashingEmbedder
from codestrata.operators.builder import build, repo_name
from codestrata.operators.store import Store
from codestrata.sources import git


@pytest.fixture(scope="module")
def built(spark, repo, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    return store, [build(store, repo, HashingEmbedder(), r) for r in ("r1", "r2", "r3")]


def test_sources(spark, repo):
    rows = {r["path"] for r in git.tree(spark, repo, git.resolve(repo, "r1")).collect()}
    assert rows == {"core.py", "old.py", "README.md", "logo.png"}
    a, b = git.resolve(repo, "r1"), git.resolve(repo, "r2")
    by_git = {(r["path"], r["status"]) for r in git.diff(spark, repo, a, b).collect()}
    by_join = {tuple(r) for r in git.tree_diff(git.tree(spark, repo, a), git.tree(spark, repo, b)).collect()}
    assert by_git == by_join == {("core.py", "M"), ("wait.py", "A"), ("README.md", "D")}
    assert git.is_ancestor(repo, a, b) and not git.is_ancestor(repo, b, a) and git.commits_between(repo, a, b) == 1


def test_reports(built):
    _, (one, two, three) = built
    assert one["mode"] == "full" and one["files_rechunked"] == 4 and one["n_files"] == 3 and one["chunks_reused"] == 0
    assert two["mode"] == "incremental" and two["files_rechunked"] == 2 and two["files_deleted"] == 1 and two["files_carried"] == 1 and two["embeddings_new"] == 2
    assert three["embeddings_new"] == 0 and three["files_rechunked"] == 1
    for r in built[1]:
        assert r["chunks_embedded"] + r["chunks_reused"] == r["n_chunks"]


def test_incremental_equals_full(spark, repo, built, tmp_path):
    full = Store(spark, str(tmp_path))
    build(full, repo, HashingEmbedder(), "r3", incremental=False)
    c = git.resolve(repo, "r3")
    a, b = built[0].chunks(c), full.chunks(c)
    assert a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def test_invariants(built):
    store, _ = built
    n = store.chunks().select("hash").distinct().count()
    assert n == store.content().count() == store.embeddings().count() < store.chunks().count()


def test_again_and_resolve(built, repo):
    store, (one, *_) = built
    again = build(store, repo, HashingEmbedder(), "r1")
    assert again["mode"] == "exists" and again["n_chunks"] == one["n_chunks"]
    assert store.resolve("r1") == store.resolve(one["commit"][:6]) == one["commit"]
    with pytest.raises(ValueError):
        store.resolve(one["commit"][:3])
    with pytest.raises(ValueError):
        build(store, repo, HashingEmbedder(64), "r1")
    assert [v["refs"] for v in store.listed()] == [["r1"], ["r2"], ["r3"]]


def test_search(built):
    store, _ = built
    top = search(store, "backoff delay of an attempt", "r2", 3).collect()
    assert top[0]["name"] == "backoff_delay" and "2 ** attempt" in top[0]["code"]
    assert all(r["name"] != "backoff_delay" for r in search(store, "backoff delay of an attempt", "r1", 3).collect())


def test_timelines(built):
    store, _ = built
    found = {r["name"]: r for r in search_all(store, "parse line parts", 10)["lineages"].collect()}
    assert found["parse_line"]["timeline"] == "r1 ● r2 ● r3 ○" and found["parse_line"]["n_distinct_code"] == 2
    assert found["Client.open"]["timeline"] == "r1 ● r2 ○ r3 ○"
    if "backoff_delay" in found:
        assert found["backoff_delay"]["timeline"] == "r1 – r2 ● r3 ○"


def test_command_line(spark, repo, built, capsys):
    store, _ = built
    assert main(["--store", store.path, "list-versions"], spark) == 0
    assert main(["--store", store.path, "query", "backoff delay", "--commit", "r2", "-k", "1"], spark) == 0
    out = capsys.readouterr().out
    assert "r3" in out and "backoff_delay" in out
    assert main(["--store", store.path, "query", "  "], spark) == 2


def test_repo_name():
    assert repo_name("git@github.com:a/b.git") == "a/b" and repo_name("", "dir") == "dir"


def test_stream(spark, repo, tmp_path):
    import json

    from codestrata.streaming.ingest import index_stream, requests

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"repo": repo, "ref": r, "requested_at": "2024-01-01T00:00:00"}) + "\n" for r in ("r1", "r1")))
    store = Store(spark, str(tmp_path / "store"))
    q = index_stream(requests(spark, str(tmp_path / "in")), store, HashingEmbedder(), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert [v["refs"] for v in store.listed()] == [["r1"]]


def test_sources_of_versions(spark, built, repo):
    from codestrata.operators.search import SearchEngine
    from codestrata.operators.versioned import AllVersionsSource, duplicate_report, repo_sources

    store, reports = built
    sources = repo_sources(store, "a/b", all_versions=True)
    assert [s.label for s in sources] == ["r1", "r2", "r3", "All versions"] and len(sources[-1]) == store.content().count() and len(sources[0]) == reports[0]["n_chunks"]
    found = SearchEngine(sources, HashingEmbedder()).ask("backoff delay of an attempt", 3, ["a/b@all"])
    assert found["hits"][0]["doc_id"].startswith("lineage:") and "backoff_delay" in found["hits"][0]["doc_id"] and found["n_searched"] == len(sources[-1])
    query = spark.createDataFrame([(0, HashingEmbedder().query("backoff delay of an attempt"))], "query_id long, vector array<float>")
    hit = sources[1].describe(sources[1].search(query, 1)).first()
    assert "2 ** attempt" in hit["code"] and hit["url"] == f"https://github.com/a/b/blob/{reports[1]['commit']}/wait.py#L1-L2" and hit["location"] == "wait.py:1-2"
    best = {r["name"]: r for r in sources[-1].describe(query, 5).collect()}["backoff_delay"]
    assert best["timeline"] == "r1 – r2 ● r3 ○" and best["versions_present"] == 2 and "attempt" in best["code"]
    report = duplicate_report(AllVersionsSource(store, "a/b").found and search_all(store, "parse line parts", 10)).first()
    assert report["grouped_duplicates"] == 0 < report["flat_duplicates"]


def test_lost_content_and_unknown_base(spark, built, repo, tmp_path):
    store, _ = built
    with pytest.raises(Exception, match="no content of"):
        store.with_code(spark.createDataFrame([("00",)], "hash string")).collect()
    with pytest.raises(ValueError, match="unknown commit"):
        build(Store(spark, str(tmp_path / "s")), repo, HashingEmbedder(), "r2", base="nowhere")
    with pytest.raises(ValueError, match="not indexed"):
        build(Store(spark, str(tmp_path / "s")), repo, HashingEmbedder(), "r2", base="r1")


def test_store_format_and_forced_build(spark, repo, tmp_path):
    from codestrata.operators.dataset import write_json

    store = Store(spark, str(tmp_path))
    first = build(store, repo, HashingEmbedder(), "r1")
    again = build(store, repo, HashingEmbedder(), "r1", force=True)
    assert again["mode"] == "full" and again["n_chunks"] == first["n_chunks"] == store.chunks().count() and again["embeddings_new"] == 0
    write_json(spark, f"{tmp_path}/format.json", {"format": 9})
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).listed()


def test_a_build_that_breaks_leaves_no_version(spark, repo, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    monkeypatch.setattr(Store, "write_version", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        build(store, repo, HashingEmbedder(), "r1")
    monkeypatch.undo()
    assert store.listed() == [] and store.chunks().count() == 0
    report = build(store, repo, HashingEmbedder(), "r1")
    assert store.chunks().count() == report["n_chunks"] and report["embeddings_new"] == 0


def test_benchmark_and_reports(spark, repo, tmp_path, capsys):
    from codestrata.operators.dataset import read_json
    from codestrata.operators.versioned import speedup

    place = str(tmp_path / "store")
    assert main(["--store", place, "benchmark", "--repo", repo, "--refs", "r1", "r2", "--steps", "r1:r2", "--scratch", str(tmp_path / "cold")], spark) == 0
    report = read_json(spark, f"{place}/benchmark.json")
    assert [v["mode"] for v in report["versions"]] == ["full", "incremental"] and report["steps"][0]["files_changed"] == 3 and report["not_embedded"] == 0
    assert report["total_chunk_rows"] > report["distinct_chunks"] and (tmp_path / "store" / "README.md").read_text().startswith("# Versions of")
    assert main(["--store", place, "report", "parse line parts", "backoff delay", "-k", "3"], spark) == 0
    out = capsys.readouterr().out
    assert "Q: backoff delay" in out and "r1 ●" in out and "mean of 2" in out and speedup(3.0, 0.0) == 3e9


def test_clone(repo, tmp_path):
    git.clone(repo, str(tmp_path / "copy"))
    git.clone(repo, str(tmp_path / "copy"))
    assert git.resolve(str(tmp_path / "copy"), "r2") == git.resolve(repo, "r2")


def test_git_sources(spark, repo):
    git.register(spark)
    rows = spark.read.format("git_commits").option("repo", repo).option("commits", "r1, r2").load().orderBy("committed_at").collect()
    assert [r["subject"] for r in rows] == ["r1", "r2"] and rows[1]["git_parent"] == rows[0]["commit"]
    data = {r["path"]: r["data"] for r in git.blobs(git.tree(spark, repo, git.resolve(repo, "r1")), repo).collect()}
    assert data["README.md"] == b"# demo\n\ntext\n" and data["logo.png"] == b"\x89PNG\0"
    with pytest.raises(Exception, match="no blob"):
        git.blobs(git.tree(spark, repo, git.resolve(repo, "r1")).selectExpr("commit", "path", "repeat('0', 40) AS blob", "mode"), repo).collect()


def test_hourly_counts(spark, tmp_path):
    from codestrata.streaming.ingest import hourly_counts

    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'a', 4.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.table("hours").collect()) == [(1, 4.0), (2, 3.0)]

"""The index of a fixed corpus: vectors and codes as Parquet, and a manifest, written last, that says what they must be."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.vector import l2_normalise
from codestrata.operators.dataset import cache_key, digest, read_json, write_json, write_text
from codestrata.operators.search import SearchSource

FORMAT = 1


def cached_vectors(documents: DataFrame, embedder, folder: str | None, max_length: int = 512) -> DataFrame:
    """(doc_id, vector) of (doc_id, text), from ``folder`` if the same texts were embedded by the same model before."""
    fresh = documents.select("doc_id", embedder.documents(F.col("text")).alias("vector")).withColumn("vector", l2_normalise(F.col("vector")).cast("array<float>"))
    if folder is None:
        return fresh
    spark = documents.sparkSession
    n, content = digest(documents, "doc_id", "text").first()
    path = f"{folder.rstrip('/')}/{cache_key(embedder.model_id, max_length, n, content)}"
    if read_json(spark, f"{path}.json") is None:  # the mark of a cache that is whole
        fresh.write.mode("overwrite").parquet(path)
        write_json(spark, f"{path}.json", {"n": n, "digest": content, "model_id": embedder.model_id})
    return spark.read.parquet(path)


def _content(index: DataFrame) -> tuple[int, str]:
    vector = F.md5(F.array_join(F.transform("vector", lambda x: F.hex(F.round(x.cast("double") * 1e6).cast("long"))), " "))
    n, found = digest(index.select("id", F.concat_ws(" ", vector, F.coalesce("code", F.lit(""))).alias("content")), "id", "content").first()
    return n, found


def write_index(corpus: DataFrame, embedder, folder: str, name: str, cache: str | None = None, doc_prefix: str = "", query_prefix: str = "", max_length: int = 512, **about) -> dict:
    """Embed (doc_id, title, text, url, partition, language) and write the index; gives the manifest."""
    from codestrata.operators.dataset import Dataset

    spark, folder = corpus.sparkSession, folder.rstrip("/")
    texts = Dataset(corpus, corpus, corpus).documents(doc_prefix)
    vectors = cached_vectors(texts, embedder, cache, max_length)
    rows = corpus.join(vectors, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("code"), F.nullif("url", F.lit("")).alias("url"), "partition", F.lower(F.coalesce("language", F.lit("python"))).alias("language"), "vector"
    )
    rows.write.mode("overwrite").parquet(f"{folder}/docs")
    index = spark.read.parquet(f"{folder}/docs")
    n, content = _content(index)
    row = index.select(F.size("vector").alias("dim")).first()
    manifest = about | {
        "format_version": FORMAT, "name": name, "model_id": embedder.model_id, "query_prefix": query_prefix, "doc_prefix": doc_prefix, "max_seq_length": max_length, "n_docs": n,
        "dim": row["dim"] if row else 0, "normalized": True, "similarity": "cosine", "digest": content, "created_at": datetime.now(UTC).isoformat(timespec="seconds"),
    }
    write_text(spark, f"{folder}/README.md", card(manifest))
    write_json(spark, f"{folder}/manifest.json", manifest)
    return manifest


def card(manifest: dict) -> str:
    lines = [f"# {manifest['name']}", "", f"{manifest['n_docs']} documents, vectors of {manifest['dim']} numbers by {manifest['model_id']}.", "", "| | |", "|-|-|"]
    return "\n".join([*lines, *(f"| {k} | {v} |" for k, v in sorted(manifest.items())), ""])


def load_index(spark: SparkSession, folder: str, name: str | None = None, verify: bool = True) -> SearchSource:
    """The index as a source, with its ``manifest``. Another format, number of documents, length of vectors or content than the manifest
    says, or an id that occurs twice, is an error."""
    folder = folder.rstrip("/")
    manifest = read_json(spark, f"{folder}/manifest.json")
    if manifest is None:
        raise ValueError(f"no index in {folder}")
    if manifest.get("format_version") != FORMAT:
        raise ValueError(f"unsupported index format {manifest.get('format_version')!r}")
    index = spark.read.parquet(f"{folder}/docs")
    n, ids, least, most = index.agg(F.count("*"), F.countDistinct("id"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if n != manifest["n_docs"]:
        raise ValueError(f"the index has {n} documents, its manifest says {manifest['n_docs']}")
    if ids != n:
        raise ValueError("ids of documents must differ")
    if n and (least != manifest["dim"] or most != manifest["dim"]):
        raise ValueError(f"vectors have {least} to {most} numbers, the manifest says {manifest['dim']}")
    if verify and _content(index)[1] != manifest["digest"]:
        raise ValueError("the index isn't what its manifest was made for")
    source = SearchSource(name or manifest["name"], index.withColumnRenamed("id", "doc_id"), manifest["dim"])
    source.manifest = manifest
    return source

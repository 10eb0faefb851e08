"""The versioned store: content, embeddings and chunks as Parquet, and one row for each version, written last.

A version whose row is there is complete: its content and vectors were written before. A code text and its vector are kept
once, whatever the number of versions that hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.text import version_label
from codestrata.operators.dataset import read_json, write_json
from codestrata.schemas import CHUNK_ROW, CONTENT, EMBEDDING, VERSION
from codestrata.scratch import drop, save


FORMAT = 1


def unembedded(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The distinct hashes of ``chunks`` that ``embeddings`` doesn't hold."""
    return chunks.select("hash").distinct().join(embeddings.select("hash"), "hash", "left_anti")


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._checked = spark, path.rstrip("/"), False

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def content(self) -> DataFrame:
        return self._read("content", CONTENT)

    def embeddings(self, model_id: str | None = None) -> DataFrame:
        found = self._read("embeddings", EMBEDDING)
        return found if model_id is None else found.filter(F.col("model_id") == model_id)

    def chunks(self, commit: str | None = None) -> DataFrame:
        found = self._read("chunks", f"{CHUNK_ROW}, commit string, build string")
        live = self.versions().select("commit", F.col("built_at").alias("build"))
        found = found.join(live, ["commit", "build"], "left_semi").drop("build")
        return found if commit is None else found.filter(F.col("commit") == commit)

    def _check_format(self) -> None:
        """A store that another format was written in is an error; an empty folder has none yet."""
        if not self._checked:
            found = (read_json(self.spark, f"{self.path}/format.json") or {}).get("format", FORMAT)
            if found != FORMAT:
                raise ValueError(f"unsupported store format {found!r}")
            self._checked = True

    def versions(self) -> DataFrame:
        """The newest row of each commit, oldest commit first by its date as text."""
        self._check_format()
        rows = self._read("versions", VERSION)
        newest = F.row_number().over(Window.partitionBy("commit").orderBy(F.desc("built_at"), F.desc(F.size("refs"))))
        return rows.withColumn("nth", newest).filter("nth = 1").drop("nth").orderBy("committed_at", "commit")

    def listed(self) -> list[dict]:
        """The registry, oldest first; it is as long as the versions that someone chose to index."""
        return [r.asDict() for r in self.versions().collect()]

    def model_id(self) -> str | None:
        row = self.versions().select("model_id").first()
        return row["model_id"] if row else None

    def resolve(self, ref: str) -> str:
        """The commit of a sha, a ref, or a prefix of four digits or more of a sha."""
        rows = self.listed()
        if any(r["commit"] == ref for r in rows):
            return ref
        found = [r["commit"] for r in rows if ref in (r["refs"] or []) or len(ref) >= 4 and r["commit"].startswith(ref)]
        if len(found) != 1:
            raise ValueError(f"{ref!r} is {'not indexed' if not found else 'ambiguous'}")
        return found[0]

    def labels(self) -> DataFrame:
        return self.versions().select("commit", version_label(F.col("refs"), F.col("short")).alias("label"))

    def view(self, ref: str) -> DataFrame:
        """Chunks of one version with vectors; code is joined after ranking, see ``with_code``. A chunk without a vector is an error."""
        commit = self.resolve(ref)
        vectors = self.embeddings(self.model_id()).select("hash", "vector")
        joined = self.chunks(commit).join(vectors, "hash", "left")
        return joined.withColumn("vector", F.when(F.col("vector").isNull(), F.raise_error(F.concat(F.lit("no vector of "), "hash"))).otherwise(F.col("vector")))

    def with_code(self, rows: DataFrame) -> DataFrame:
        """``rows`` with code; a hash without content is an error."""
        joined = rows.join(self.content(), "hash", "left")
        return joined.withColumn("code", F.when(F.col("code").isNull(), F.raise_error(F.concat(F.lit("no content of "), "hash"))).otherwise(F.col("code")))

    def add_content(self, chunks: DataFrame) -> None:
        """Keep the texts whose hashes are new; the first of a hash stays."""
        chunks.select("hash", "code").dropDuplicates(["hash"]).join(self.content(), "hash", "left_anti").select("hash", "code").write.mode("append").parquet(f"{self.path}/content")

    def embed_missing(self, chunks: DataFrame, embedder) -> int:
        """Embed each distinct new text once: the embedder stands above the anti-join. Gives the number of new vectors."""
        missing = save(self.missing(chunks, embedder.model_id), "missing")
        new = missing.join(self.content(), "hash").withColumn("vector", embedder.documents(F.col("code")))
        new.select(F.lit(embedder.model_id).alias("model_id"), "hash", "vector").write.mode("append").parquet(f"{self.path}/embeddings")
        made = missing.count()
        drop(missing)
        return made

    def missing(self, chunks: DataFrame, model_id: str) -> DataFrame:
        """The distinct hashes of ``chunks`` that have no vector of the model."""
        return unembedded(chunks, self.embeddings(model_id))

    def write_chunks(self, commit: str, chunks: DataFrame, build: str) -> None:
        rows = chunks.withColumns({"commit": F.lit(commit), "build": F.lit(build)}).drop("code")
        rows.sortWithinPartitions("path", "start_line", "name").write.mode("append").partitionBy("commit", "build").parquet(f"{self.path}/chunks")

    def write_version(self, meta: dict) -> None:
        """The commit marker; only after this does the version exist."""
        self._check_format()
        write_json(self.spark, f"{self.path}/format.json", {"format": FORMAT})
        self.spark.createDataFrame([tuple(meta.get(f.split()[0]) for f in VERSION.split(", "))], VERSION).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

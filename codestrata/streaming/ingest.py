"""Continuous indexing: files of commit requests are read as a stream, and each commit is built once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.operators.builder import build
from codestrata.operators.store import Store

REQUEST = "repo string, ref string, requested_at timestamp"


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that land in ``folder``; a request repeated within a day is dropped."""
    return spark.readStream.schema(REQUEST).json(folder).withWatermark("requested_at", "1 day").dropDuplicatesWithinWatermark(["repo", "ref"])


def index_stream(stream: DataFrame, store: Store, embedder, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Build every requested commit. A batch that is run again finds its commits indexed and changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.select("repo", "ref", "requested_at").orderBy("requested_at", "ref").toLocalIterator():
            build(store, r["repo"], embedder, r["ref"])

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events by type and hour; event time must be a timestamp with zone, so one without is cast."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

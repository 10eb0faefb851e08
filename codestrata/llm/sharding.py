"""Sharding by extendible hashing: a directory of hash prefixes, in which only oversized buckets take another bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import drop, save

#: Bits of the hash, and bytes of text that a shard holds at most.
BITS = 60
LIMIT = 1 << 20


def _prefix(bits: str, of: int, depth) -> Column:
    """The first ``depth`` of the ``of`` bits in column ``bits``."""
    return F.call_function("shiftrightunsigned", F.col(bits), (F.lit(of) - depth).cast("int"))


def _hash() -> Column:
    """60 bits of the MD5 of doc_id and text."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _assigned(units: DataFrame, limit: int) -> DataFrame:
    """``units`` (bits, n_bytes, ..) with shard_bits, shard and oversized.

    The directory starts with as many bits as the bytes fill shards; only rows of buckets that are too large then go on to more
    bits. A bucket closes where its rows fit or have one hash, and all below it is closed as well, so shards are the closed
    buckets whose parent is open. No table here has a size bound, so nothing is broadcast.
    """
    total = units.agg(F.sum("n_bytes")).first()[0] or 0
    low, deep = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))))
    left, done, named = units, None, units.columns
    while True:
        own = left.withColumn("fine", _prefix("bits", BITS, F.lit(deep)))
        fine = save(own.groupBy("fine").agg(F.sum("n_bytes").alias("n"), F.min("bits").alias("lo"), F.max("bits").alias("hi")), "buckets")
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(deep)))).withColumn("prefix", _prefix("fine", deep, F.col("depth")))
        held = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        closed = save(held.filter((F.col("n") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "prefix", (F.col("n") > limit).alias("oversized")), "closed")
        above = closed.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")).hint("merge")
        leaves = closed.withColumn("parent", F.shiftright("prefix", 1)).join(above, ["depth", "parent"], "left_anti")
        width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(deep) - F.col("depth"))
        inside = F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1))
        directory = save(leaves.select(inside.alias("fine"), F.col("depth").alias("shard_bits"), F.col("prefix").alias("shard"), "oversized"), "directory")
        placed = own.join(directory.hint("merge"), "fine", "left")
        now = placed.filter("shard is not null").select(*named, "shard_bits", "shard", "oversized")
        done = now if done is None else done.unionByName(now)
        if deep >= BITS or fine.join(directory.hint("merge"), "fine", "left_anti").isEmpty():
            return done
        drop(fine, closed)
        left = save(placed.filter("shard is null").select(*named), "units")
        low, deep = deep + 1, min(BITS, deep + 6)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (of the text in UTF-8, 0 for null), shard_bits (depth of its shard), shard (the first
    shard_bits bits of its hash) and oversized.

    The hash is 60 bits of the MD5 of doc_id and text. A shard is the shortest prefix whose rows have ``limit`` bytes or less;
    one of all rows if they fit. Rows with the same id and text have one hash and stay together; where they, or a single row,
    exceed the limit on their own, no bit can split them, and they are a shard of their own depth, marked oversized. An empty table
    gives no rows; other columns play no part.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    units = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash().alias("bits"), size.alias("n_bytes")), "units")
    return _assigned(units, limit).drop("bits")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write all rows of ``docs`` as Parquet, a folder ``shard_bits=../shard=..`` for each shard. A task writes whole shards, one after the other.

    Columns of ``docs`` named shard_bits or shard are replaced.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    units = save(docs.select(_hash().alias("bits"), size.alias("n_bytes")), "units")
    # one row for each hash: it decides the shard, so rows that repeat it meet one row
    own = _assigned(units, limit).select(F.col("bits").alias("__shard_hash"), F.col("shard_bits").alias("__shard_bits"), F.col("shard").alias("__shard")).distinct()
    joined = docs.withColumn("__shard_hash", _hash()).join(own, "__shard_hash")
    joined = joined.withColumns({"shard_bits": F.col("__shard_bits"), "shard": F.col("__shard")}).drop("__shard_hash", "__shard_bits", "__shard")
    joined.repartition("shard_bits", "shard").write.partitionBy("shard_bits", "shard").parquet(path)


ORACLE_SQL = f"""
WITH u AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ' ' || text), 1, 15) AS BIGINT) AS bits FROM documents),
v AS (SELECT u.*, d AS depth, bits >> ({BITS} - d) AS prefix FROM u, range(0, 33) AS r(d)),
b AS (SELECT depth, prefix FROM v GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT} OR min(bits) = max(bits)),
s AS (SELECT doc_id, bits, n_bytes, min(depth) AS depth FROM v JOIN b USING (depth, prefix) GROUP BY doc_id, bits, n_bytes)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS shard_bits, bits >> ({BITS} - depth) AS shard, n_bytes > {LIMIT} AS oversized FROM s
"""

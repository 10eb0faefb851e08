"""Queries on the versioned index, with their DuckDB equivalents. The tables hold no repository, so ``source`` stands for a version,
doc_id modulo 50 for a path, and a document's text for its code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.functions.hashing import hash_embed
from codestrata.operators import dataset
from codestrata.operators.chunking import chunk_files
from codestrata.operators.lineage import ABSENT, NEW, SAME, merge_threshold
from codestrata.operators.store import unembedded
from codestrata.plans.retrieval import read
from codestrata.sources.git import tree_diff

Q: dict = {}
SQL: dict[str, str] = {}
PATHS = 50


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_C = f"WITH c AS (SELECT doc_id, source AS version, doc_id % {PATHS} AS path, left(sha256(text), 32) AS hash, text, lang, n_chars FROM documents) "


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        "doc_id", F.col("source").alias("version"), (F.col("doc_id") % PATHS).alias("path"), X.content_hash(F.col("text")).alias("hash"), "text", "lang", "n_chars"
    )


@query(_C + "SELECT hash, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS n FROM c) WHERE n = 1")
def content_dedup(spark, d):
    """One row for each distinct text, the first."""
    rows = chunks(spark, d).select("hash", "doc_id", "n_chars")
    return rows.groupBy("hash").agg(F.min(F.struct("doc_id", "n_chars")).alias("first")).select("hash", "first.doc_id", "first.n_chars")


@query(
    _C + ", f AS (SELECT hash, min(version) AS first FROM c GROUP BY hash) SELECT c.version, count(*) AS n_chunks, count(CASE WHEN c.version = f.first THEN 1 END) AS chunks_embedded, "
    "count(CASE WHEN c.version > f.first THEN 1 END) AS chunks_reused, count(DISTINCT CASE WHEN c.version = f.first THEN c.hash END) AS embeddings_new FROM c JOIN f USING (hash) GROUP BY c.version"
)
def embedding_reuse_counts(spark, d):
    """What each version embeds anew, versions in order of name."""
    c = chunks(spark, d).select("version", "hash")
    first = c.groupBy("hash").agg(F.min("version").alias("first"))
    new = F.col("version") == F.col("first")
    return c.join(first, "hash").groupBy("version").agg(
        F.count("*").alias("n_chunks"), F.count_if(new).alias("chunks_embedded"), F.count_if(~new).alias("chunks_reused"), F.countDistinct(F.when(new, F.col("hash"))).alias("embeddings_new")
    )


# every version against the one before it in order of name; a path's blob stands for all texts that the version has there
_PAIRS = (
    _C + ", v AS (SELECT version, row_number() OVER (ORDER BY version) AS nth FROM (SELECT DISTINCT version FROM c)), "
    "t AS (SELECT nth, path, md5(string_agg(hash, '' ORDER BY hash)) AS blob FROM c JOIN v USING (version) GROUP BY nth, path), "
    "d AS (SELECT pair, path, CASE WHEN b.blob IS NULL THEN 'A' WHEN n.blob IS NULL THEN 'D' ELSE 'M' END AS status FROM (SELECT nth + 1 AS pair, path, blob FROM t WHERE nth < (SELECT max(nth) FROM v)) b "
    "FULL JOIN (SELECT nth AS pair, path, blob FROM t WHERE nth > 1) n USING (pair, path) WHERE b.blob IS DISTINCT FROM n.blob) "
)


def _numbered(spark, d) -> DataFrame:
    """Chunks with nth, the place of their version in order of name; versions are few."""
    c = chunks(spark, d).select("doc_id", "version", "path", "hash")
    return c.join(c.select("version").distinct().withColumn("nth", F.row_number().over(Window.orderBy("version"))), "version")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` as the base and as the new side of each pair of versions, which the newer one's number names."""
    last = rows.agg(F.max("nth").alias("last"))  # one row
    return rows.crossJoin(F.broadcast(last)).filter("nth < last").withColumn("pair", F.col("nth") + 1).drop("last"), rows.filter("nth > 1").withColumn("pair", F.col("nth"))


def _touched(rows: DataFrame) -> DataFrame:
    trees = rows.groupBy("nth", "path").agg(F.md5(F.array_join(F.sort_array(F.collect_list("hash")), "")).alias("blob")).withColumn("mode", F.lit("100644"))
    return tree_diff(*_sides(trees), by=("pair",))


@query(_PAIRS + "SELECT pair, path, status FROM d")
def tree_difference(spark, d):
    """A3: what differs between each two consecutive versions."""
    return _touched(_numbered(spark, d))


@query(
    _PAIRS + "SELECT pair, c.doc_id, c.path, 'carried' AS origin FROM (SELECT nth + 1 AS pair, doc_id, path FROM c JOIN v USING (version) WHERE nth < (SELECT max(nth) FROM v)) c ANTI JOIN d USING (pair, path) "
    "UNION ALL SELECT pair, c.doc_id, c.path, 'new' FROM (SELECT nth AS pair, doc_id, path FROM c JOIN v USING (version)) c SEMI JOIN d USING (pair, path)"
)
def incremental_carry(spark, d):
    """Each version built from the one before: chunks of unchanged paths are carried, those of touched paths are new."""
    rows = _numbered(spark, d)
    touched = _touched(rows).select("pair", "path")
    base, new = _sides(rows)
    carried = base.join(touched, ["pair", "path"], "left_anti").withColumn("origin", F.lit("carried"))
    return carried.unionByName(new.join(touched, ["pair", "path"], "left_semi").withColumn("origin", F.lit("new"))).select("pair", "doc_id", "path", "origin")


@query(
    _PAIRS + ", x AS (SELECT nth + 1 AS pair, hash FROM c JOIN v USING (version) WHERE nth < (SELECT max(nth) FROM v)), y AS (SELECT nth AS pair, hash FROM c JOIN v USING (version) WHERE nth > 1) "
    "SELECT pair, count(CASE WHEN side = 0 THEN 1 END) AS only_base, count(CASE WHEN side = 1 THEN 1 END) AS only_new FROM ((SELECT *, 0 AS side FROM (FROM x EXCEPT ALL FROM y)) UNION ALL (SELECT *, 1 FROM (FROM y EXCEPT ALL FROM x))) GROUP BY pair"
)
def multiset_difference(spark, d):
    """H7, H2: each two consecutive versions as multisets of texts; equal builds would differ in nothing."""
    a, b = (x.select("pair", "hash") for x in _sides(_numbered(spark, d)))
    both = a.exceptAll(b).withColumn("side", F.lit(0)).unionByName(b.exceptAll(a).withColumn("side", F.lit(1)))
    return both.groupBy("pair").agg(F.count_if(F.col("side") == 0).alias("only_base"), F.count_if(F.col("side") == 1).alias("only_new"))


@query(
    _C + ", f AS (SELECT hash, min(version) AS first FROM c GROUP BY hash) SELECT hash, count(*) AS chunks FROM c JOIN f USING (hash) WHERE first > 'src3' GROUP BY hash"
)
def missing_hashes(spark, d):
    """The texts that no version up to src3 held, by the store's own anti-join."""
    c = chunks(spark, d).select("version", "hash")
    lost = unembedded(c, c.filter("version <= 'src3'"))
    return c.join(lost, "hash").groupBy("hash").agg(F.count("*").alias("chunks"))


@query(_C + "SELECT version, count(*) AS n_chunks, count(DISTINCT path) AS n_files, count(DISTINCT hash) AS n_distinct, count(CASE WHEN lang = 'en' THEN 1 END) AS english FROM c GROUP BY version")
def build_report(spark, d):
    """Counters of each version."""
    return chunks(spark, d).groupBy("version").agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_files"), F.countDistinct("hash").alias("n_distinct"), F.count_if(F.col("lang") == "en").alias("english"))


_VERSIONS = "v AS (SELECT version, CAST(row_number() OVER (ORDER BY version) - 1 AS INTEGER) AS nth FROM (SELECT DISTINCT version FROM c))"
_STATES = (
    ", " + _VERSIONS + ", h AS (SELECT path, version, max(hash) AS hash FROM c GROUP BY path, version), p AS (SELECT DISTINCT path FROM h), "
    "s AS (SELECT p.path, v.version, v.nth, h.hash, lag(h.hash IGNORE NULLS) OVER (PARTITION BY p.path ORDER BY v.nth) AS before FROM p CROSS JOIN v LEFT JOIN h ON h.path = p.path AND h.version = v.version), "
    "z AS (SELECT path, version, nth, CASE WHEN hash IS NULL THEN '–' WHEN hash = before THEN '○' ELSE '●' END AS state FROM s) "
)


def _states(spark, d):
    c = chunks(spark, d)
    versions = c.select("version").distinct().withColumn("nth", F.row_number().over(Window.orderBy("version")) - 1)
    held = c.groupBy("path", "version").agg(F.max("hash").alias("hash"))
    every = held.select("path").distinct().crossJoin(versions).join(held, ["path", "version"], "left")
    earlier = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("hash", ignorenulls=True).over(earlier)
    state = F.when(F.col("hash").isNull(), ABSENT).when(before.eqNullSafe(F.col("hash")), SAME).otherwise(NEW)
    return every.select("path", "version", "nth", state.alias("state"))


@query(_C + _STATES + "SELECT path, version, nth, state FROM z")
def timeline_states(spark, d):
    """new or changed, same, or absent, against the last version that had the path."""
    return _states(spark, d)


@query(
    _C + _STATES + "SELECT path, string_agg(version || ' ' || state, ' ' ORDER BY nth) AS timeline, count(CASE WHEN state <> '–' THEN 1 END) AS versions_present, "
    "count(CASE WHEN state = '●' THEN 1 END) > 1 AS changed FROM z GROUP BY path"
)
def timeline_text(spark, d):
    """The timeline of each path as text."""
    s = _states(spark, d)
    rows = F.sort_array(F.collect_list(F.struct("nth", "version", "state")))
    return s.groupBy("path").agg(
        F.array_join(F.transform(rows, lambda x: F.concat(x["version"], F.lit(" "), x["state"])), " ").alias("timeline"),
        F.count_if(F.col("state") != ABSENT).alias("versions_present"), (F.count_if(F.col("state") == NEW) > 1).alias("changed"),
    )


@query(_C + "SELECT doc_id, count(CASE WHEN lang = 'en' THEN 1 END) OVER (PARTITION BY version, path) AS n_modules FROM c")
def module_counts(spark, d):
    """Blocks of one kind in each file of each version."""
    return chunks(spark, d).select("doc_id", F.count_if(F.col("lang") == "en").over(Window.partitionBy("version", "path")).alias("n_modules"))


@query(_C + "SELECT path, count(DISTINCT hash) AS n_distinct_code, count(DISTINCT hash) > 1 AS changed FROM (SELECT *, row_number() OVER (PARTITION BY path, version ORDER BY n_chars DESC, doc_id) AS n FROM c) WHERE n = 1 GROUP BY path")
def distinct_code_count(spark, d):
    """Distinct texts among the best of each version."""
    best = F.row_number().over(Window.partitionBy("path", "version").orderBy(F.desc("n_chars"), "doc_id"))
    rows = chunks(spark, d).select("path", "hash", "version", "n_chars", "doc_id").withColumn("n", best).filter("n = 1")
    return rows.groupBy("path").agg(F.countDistinct("hash").alias("n_distinct_code"), (F.countDistinct("hash") > 1).alias("changed"))


@query(_C + "SELECT version, previous FROM (SELECT version, lag(version) OVER (ORDER BY version) AS previous FROM (SELECT DISTINCT version FROM c))")
def version_chain(spark, d):
    """each version with the one before it."""
    return chunks(spark, d).select("version").distinct().select("version", F.lag("version").over(Window.orderBy("version")).alias("previous"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM pages")
def slug_sql(spark, d):
    """I3."""
    return read(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


_PATH = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"


@query(
    f"SELECT page_id, CASE WHEN p LIKE 'src/%' THEN substr(p, 5) WHEN regexp_matches(p, '^test_[^/]*\\.py$') THEN 'tests/' || p ELSE p END AS path FROM "
    f"(SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'src/' || {_PATH} WHEN 1 THEN 'test_' || page_id || '.py' ELSE {_PATH} END AS p FROM pages)"
)
def canonical_path_sql(spark, d):
    """I4."""
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    n = F.col("page_id") % 3
    p = F.when(n == 0, F.concat(F.lit("src/"), path)).when(n == 1, F.concat(F.lit("test_"), F.col("page_id").cast("string"), F.lit(".py"))).otherwise(path)
    return read(spark, d, "pages").select("page_id", X.canonical_path(p).alias("path"))


@query(
    "WITH s AS (SELECT page_id, lower(regexp_extract(url, '(\\.[A-Za-z]+)([?#].*)?$', 1)) AS suffix FROM pages) "
    "SELECT page_id, CASE suffix WHEN '.html' THEN 'html' WHEN '.js' THEN 'javascript' WHEN '.css' THEN 'css' WHEN '.py' THEN 'python' ELSE 'text' END AS language FROM s"
)
def file_language(spark, d):
    """C4: language by suffix."""
    path = F.regexp_replace("url", "[?#].*$", "")
    return read(spark, d, "pages").select("page_id", X.language_of(F.regexp_replace(path, "/+$", "/x")).alias("language"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '1234' OR (NOT EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '1234') AND starts_with(CAST(o_orderkey AS VARCHAR), '1234'))")
def registry_resolve(spark, d):
    """An exact key wins, else keys with that prefix."""
    key = F.col("o_orderkey").cast("string")
    rows = read(spark, d, "orders").filter(key.startswith("1234")).select("o_orderkey", (key == "1234").alias("exact"))
    any_exact = rows.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("any_exact"))  # one row
    return rows.crossJoin(F.broadcast(any_exact)).filter("exact or not any_exact").select("o_orderkey")


# keys of code made from vectors: every eleventh a block told by its text, others modules, methods or functions of a few files
_KEYS = (
    "k AS (SELECT vec_id AS n, CASE WHEN vec_id % 11 = 0 THEN 'hash' ELSE 'name' END AS tag, 'f' || ((vec_id // 7) % 3) || '.py' AS path, "
    "CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 'module' WHEN vec_id % 3 = 0 THEN 'method' ELSE 'function' END AS kind, "
    "CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN '<module>' WHEN vec_id % 3 = 0 THEN 'C' || (vec_id % 4) || '.m' || (vec_id % 2) ELSE 'g' || (vec_id % 6) END AS name FROM embeddings)"
)


@query(
    f"WITH {_KEYS}, p AS (SELECT a.n AS a, b.n AS b, a.tag = 'hash' OR coalesce(a.kind = 'module', false) AS ma, b.tag = 'hash' OR coalesce(b.kind = 'module', false) AS mb, a.path = b.path AS same_file, a.name = b.name AS same_name, "
    "a.kind = 'method' AND b.kind = 'method' AND regexp_extract(a.name, '[^.]*$') = regexp_extract(b.name, '[^.]*$') AS same_method FROM k a JOIN k b ON a.n // 40 = b.n // 40 AND a.n < b.n) "
    "SELECT a, b, CASE WHEN ma AND mb AND same_file THEN 0.9 WHEN ma OR mb THEN NULL WHEN same_name THEN 0.95 WHEN NOT same_file THEN NULL WHEN same_method THEN 0.9 ELSE 0.95 END::DOUBLE AS threshold FROM p"
)
def merge_threshold_pairs(spark, d):
    """The similarity that two keys must exceed, for all pairs within forty vectors."""
    n = F.col("vec_id")
    told, module, method = n % 11 == 0, n % 5 == 0, n % 3 == 0
    kind = F.when(told, None).when(module, "module").when(method, "method").otherwise("function")
    name = F.when(told, None).when(module, "<module>").when(method, F.format_string("C%d.m%d", n % 4, n % 2)).otherwise(F.format_string("g%d", n % 6))
    key = F.struct(F.when(told, "hash").otherwise("name").alias("tag"), F.format_string("f%d.py", F.floor(n / 7) % 3).alias("path"), kind.alias("kind"), name.alias("name"), n.cast("string").alias("hash"))
    k = read(spark, d, "embeddings").select(n.alias("n"), F.floor(n / 40).alias("of"), key.alias("key"))
    x, y = k.toDF("a", "of", "ka"), k.toDF("b", "of", "kb")
    return x.join(y, "of").filter("a < b").select("a", "b", merge_threshold("ka", "kb").cast("double").alias("threshold"))


_STATEMENT = (
    "CASE doc_id % 4 WHEN 0 THEN 'Task ' || doc_id || '.' || chr(10) || '-----Input-----' || chr(10) || lang || chr(10) || '=====Output Format=====' || chr(10) || source || chr(10) || 'Note:' || chr(10) || 'gone' "
    "WHEN 1 THEN 'Task ' || doc_id || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || lang || chr(10) || 'Example 1:' || chr(10) || source WHEN 2 THEN 'Task ' || doc_id ELSE 'Examples' || chr(10) || source END"
)


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Task ' || doc_id || '.' || chr(10) || chr(10) || 'Input:' || chr(10) || lang || chr(10) || chr(10) || 'Output format:' || chr(10) || source "
    "WHEN 1 THEN 'Task ' || doc_id || chr(10) || chr(10) || lang WHEN 2 THEN 'Task ' || doc_id ELSE 'Examples' || chr(10) || source END AS cleaned FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"
)
def clean_query(spark, d):
    """A statement with sections made from each document."""
    rows = read(spark, d, "documents").filter("lang is not null and source is not null")
    return rows.select("doc_id", X.clean_query(F.expr(_STATEMENT.replace("chr(10)", "char(10)"))).alias("cleaned"))


@query(
    f"WITH s AS (SELECT doc_id, {_STATEMENT} AS text FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT count(*) AS queries, count(CASE WHEN doc_id % 4 < 2 THEN 1 END) AS changed, "
    "round(avg(length(text)), 6) AS chars_before, round(avg(CASE doc_id % 4 WHEN 0 THEN instr(text, chr(10)) - 1 WHEN 1 THEN length('Task ' || doc_id) + 2 + instr(split_part(text, chr(10) || chr(10) || chr(10) || chr(10), 2), chr(10)) - 1 "
    "ELSE length(text) END), 6) AS chars_after FROM s"
)
def clean_query_statistics(spark, d):
    """What cleaning those statements to their descriptions changes."""
    rows = read(spark, d, "documents").filter("lang is not null and source is not null").select(F.expr(_STATEMENT.replace("chr(10)", "char(10)")).alias("text"))
    got = dataset.clean_statistics(rows, "desc")
    return got.select("queries", "changed", *[F.round(c, 6).alias(c) for c in ("chars_before", "chars_after")])


@query("SELECT count(*) AS n, CAST(coalesce(sum(CAST('0x' || substr(md5(doc_id || ' ' || coalesce(text, '')), 1, 15) AS BIGINT)::HUGEINT), 0) AS VARCHAR) AS digest FROM documents")
def corpus_digest(spark, d):
    """A digest of the corpus that doesn't depend on the order of its rows."""
    return dataset.digest(read(spark, d, "documents"), "doc_id", "text")


# a file for each document: Python with some blank lines before its function, Python that doesn't parse, prose, and a type that is skipped
_FILE = (
    "CASE doc_id % 4 WHEN 0 THEN 'import os' || chr(10) || 'LIMIT = 3' || chr(10) || repeat(chr(10), CAST(doc_id % 7 AS INT)) || '@cache' || chr(10) || 'def f(x):' || chr(10) || '    return x' || chr(10) || 'class A:' || chr(10) || '    z = 1' || chr(10) || '    def g(self):' || chr(10) || '        return 1' || chr(10) "
    "WHEN 1 THEN 'print ' || chr(39) || doc_id || chr(39) || repeat(chr(10), 2) WHEN 2 THEN repeat('line' || chr(10), CAST(doc_id % 5 AS INT)) ELSE 'x' END"
)
_PATHS = "'p' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.PY' WHEN 2 THEN '.md' ELSE '.lock' END"


@query(
    f"WITH f AS (SELECT doc_id, {_PATHS} AS path, CAST(doc_id % 7 AS INTEGER) AS k, CAST(doc_id % 5 AS INTEGER) AS l FROM documents) "
    "SELECT path, '<module>' AS name, 'module' AS kind, 2 AS start_line, 2 AS end_line FROM f WHERE doc_id % 4 = 0 UNION ALL SELECT path, 'f', 'function', 3 + k, 5 + k FROM f WHERE doc_id % 4 = 0 "
    "UNION ALL SELECT path, 'A', 'class', 6 + k, 7 + k FROM f WHERE doc_id % 4 = 0 UNION ALL SELECT path, 'A.g', 'method', 8 + k, 9 + k FROM f WHERE doc_id % 4 = 0 "
    "UNION ALL SELECT path, path, 'file', 1, 1 FROM f WHERE doc_id % 4 = 1 UNION ALL SELECT path, path, 'file', 1, l FROM f WHERE doc_id % 4 = 2 AND l > 0"
)
def chunk_python(spark, d):
    """A file for each document, in chunks."""
    expr = lambda x: F.expr(x.replace("chr(", "char("))
    files = read(spark, d, "documents").select(expr(_PATHS).alias("path"), expr(_FILE).cast("binary").alias("data"))
    return chunk_files(files).select("path", "name", "kind", "start_line", "end_line")


@query()
def hash_embed_documents(spark, d):
    """Every document as a bag of hashed identifier parts."""
    v = read(spark, d, "documents").select("doc_id", hash_embed(F.col("text")).alias("vector"))
    return v.select("doc_id", F.size(F.filter("vector", lambda x: x > 0)).alias("filled"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 5).alias("squared"))

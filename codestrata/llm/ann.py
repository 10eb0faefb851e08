"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one point. Each of several orderings projects the points onto a few random directions, shifts them and sorts them
along a Hilbert curve, by range. An ordering is cut into blocks of neighbouring points; a query is compared with all points of the
blocks in its window, and the best of all orderings are merged and reranked.

How many orderings are used and how wide the windows are follows from a measurement: a bounded number of queries are compared with all
points, and of the choices that find enough of their neighbours the one with least work is taken. On vectors with structure windows
are a constant number of points; where neighbours hardly lie nearer than any others, as with random directions, no window below a
share of all points finds them, and the measurement says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import drop, runs, save

BITS = 8


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points with integer coordinates of ``bits`` bits (Skilling's transform, by columns)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: Orderings, at least and at most; directions of each; points of a block, at least and at most.
FEWEST, CURVES, DIMS, BLOCK, LARGEST_BLOCK = 3, 12, 8, 512, 16_384
#: Points from which the scale of the projections is taken; queries that are measured; the share of their neighbours to be found.
SCALE_ROWS, MEASURED, TARGET = 4096, 64, 0.94
#: Comparisons that take as long as moving one point to its block.
MOVE = 100


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def _best(q: np.ndarray, x: np.ndarray, xid: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest points of x to each row of q, their first vec_id, by which ties go, and their scores. The fast product only
    preselects: what counts is each pair's own sum, so that equal vectors have equal scores wherever they stand."""
    for a in range(0, len(q), 256):
        for r, row in enumerate(q[a : a + 256] @ x.T):
            c = np.flatnonzero(np.isfinite(row))
            if len(c) > k:
                least = np.partition(row[c], len(c) - k)[len(c) - k]
                c = c[row[c] >= least - 1e-9 * max(1.0, abs(least))]
            s = (x[c] * q[a + r]).sum(1)
            o = np.lexsort((xid[c], first[c], -s))[:k]
            yield xid[c][o], first[c][o], s[o]


def _found(asks: pa.Array, best: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each asking point, with lists of what ``_best`` gives."""
    at = pa.array(np.cumsum([0, *[len(b[0]) for b in best]]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, t), *(b[n] for b in best)]))) for n, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.RecordBatch.from_arrays([asks, *lists], ["asks", "points", "firsts", "scores"])


_FOUND = "asks long, points array<long>, firsts array<long>, scores array<double>"


def _merged(k: int):
    """(asks, point, score): the k best of all that was found for each asking point; the rows come sorted by asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["asks"]):
            point, first, score = (group.column(x).combine_chunks().flatten().to_numpy() for x in ("points", "firsts", "scores"))
            _, one = np.unique(point, return_index=True)
            o = one[np.lexsort((point[one], first[one], -score[one]))[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), group.column("asks")[0].as_py())), pa.array(point[o]), pa.array(score[o])], ["asks", "point", "score"])

    return run


def _merge(found: DataFrame, k: int) -> DataFrame:
    return found.repartition("asks").sortWithinPartitions("asks").mapInArrow(_merged(k), "asks long, point long, score double")


def _points(vectors: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Points (point, embedding, members, first, asking) and queries (vec_id, row, point): the rows of equal vectors are one point, named by the
    row that comes first by (vec_id, row), with as many members as one query can find."""
    e = F.col("embedding")
    off = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).filter(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, off) & F.exists(e, lambda x: x != 0))
    rows = save(valid.withColumns({"row": F.monotonically_increasing_id(), "a": F.xxhash64(F.lit(1), e), "b": F.xxhash64(F.lit(2), e)}), "vectors")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id", "row"))
    # a vector that a large part of all rows hold is cut down by each of many tasks before its rows meet
    few = rows.select("a", "b", "vec_id", "row").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(1024)))
    few = few.withColumn("n", first("a", "b", "salt")).filter(F.col("n") <= k + 1).withColumn("n", first("a", "b")).filter(F.col("n") <= k + 1)
    members = few.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members")).withColumn("point", F.col("members")[0]["row"])
    asked = rows.filter(F.col("vec_id") % every == 0).select("a", "b", "vec_id", "row")
    members = save(members.join(asked.select("a", "b", F.lit(True).alias("asking")).distinct(), ["a", "b"], "left").withColumn("asking", F.coalesce("asking", F.lit(False))), "members")
    points = members.select("point", "members", "asking", F.col("members")[0]["vec_id"].alias("first")).join(rows.select(F.col("row").alias("point"), "embedding"), "point")
    return points, asked.join(members.filter("asking").select("a", "b", "point"), ["a", "b"]).select("vec_id", "row", "point")


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, dims: int = DIMS, block: int = BLOCK, target: float = TARGET, measured: int = MEASURED, seed: int = 1
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding. Nearness is the inner product in double precision; ties go to the smaller vec_id. Rows whose
    vec_id is null, whose vector is null or zero or holds null or non-finite components, or has another length than most vectors, take
    no part. A row doesn't find itself; rows that share its vec_id are rows of their own, each of which may ask and be found. Of rows
    with equal vectors a query that finds one finds all that its ``k`` places have room for. An empty table gives no rows. All rows
    are indexed; from samples come only the scale of the projections (``SCALE_ROWS`` points) and the choice of windows (``measured`` queries).
    """
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.elementType.simpleString()
    points, queries = _points(vectors, k, every)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = points.groupBy(F.size("embedding").alias("size")).agg(F.sum(F.size("members")).alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), "size").first()
    if length is None:
        return empty
    width, total = length["size"], length["n"]
    points = points.filter(F.size("embedding") == width)
    rng = np.random.default_rng(seed)
    axes, shifts = rng.normal(size=(curves, width, dims)), rng.uniform(0, 1, size=(curves, 1, dims))
    bits = min(BITS, 60 // dims)
    unit = _matrix(points.orderBy(F.xxhash64("point"), "point").limit(SCALE_ROWS).select("embedding").toArrow().column(0).combine_chunks())
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    spread = [unit @ a for a in axes]
    middle, scale = [s.mean(0) for s in spread], [np.maximum(s.std(0), 1e-12) for s in spread]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding")).reshape(-1, width)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = np.empty((len(x), curves), np.int64)
            for c in range(curves):
                y = ((x @ axes[c] - middle[c]) / scale[c] + 4 + shifts[c]) / 9 * (1 << bits)
                keys[:, c] = hilbert(np.clip(y, 0, (1 << bits) - 1).astype(np.int64), bits)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * curves), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in named), listed], [*named, "keys"])

    named = ["point", "members", "first", "asking", "embedding"]
    schema = f"point long, members array<struct<vec_id:bigint,row:bigint>>, first long, asking boolean, embedding array<{kind}>, keys array<long>"
    keyed = save(points.select(*named).mapInArrow(order, schema), "points")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(curves, np.int64)
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            n = np.bincount(curve, minlength=curves)
            # sorted by curve: places go on from where the last batch ended
            at = np.arange(len(curve)) - np.concatenate([[0], np.cumsum(n)])[curve] + seen[curve]
            seen += n
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("point"), pa.array(np.full(len(at), part, np.int32)), pa.array(at)], ["curve", "point", "part", "at"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = keyed.select("point", F.posexplode("keys").alias("curve", "key")).repartitionByRange(tasks, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    places = save(places.mapInArrow(number, "curve int, point long, part int, at long"), "places")
    # a number for each task and ordering
    sizes = {(r["curve"], r["part"]): r["n"] for r in places.groupBy("curve", "part").agg(F.count("*").alias("n")).collect()}
    before: dict[tuple[int, int], int] = {}
    done = [0] * curves
    for c, part in sorted(sizes):
        before[c, part] = done[c]
        done[c] += sizes[c, part]
    used, window = (FEWEST, total) if total <= 3 * block else _measure(keyed, places, before, total, k, block, curves, target, measured)
    # a wide window is cut into larger blocks, so that a query meets a few
    block = min(max(block, -(-window // 2)), LARGEST_BLOCK)
    blocks = max(1, -(-total // block))
    near = min(blocks - 1, -(-window // block))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = np.array([before[x] for x in zip(batch.column("curve").to_pylist(), batch.column("part").to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("curve"), pa.array((base + batch.column("at").to_numpy()) // block)], ["point", "curve", "block"])

    own = places.filter(F.col("curve") < used).mapInArrow(blocked, "point long, curve int, block long").join(keyed.select("point", "first", "asking", "embedding"), "point")
    around = F.sequence(F.greatest(F.lit(0), F.least(F.col("block") - near, F.lit(blocks - 1 - 2 * near))), F.least(F.lit(blocks - 1), F.greatest(F.col("block") + near, F.lit(2 * near))))
    dealt = own.select("curve", "block", F.lit(0).alias("asks"), "point", "first", "embedding").unionByName(
        own.filter("asking").select("curve", F.explode(around).alias("block"), F.lit(1).alias("asks"), "point", "first", "embedding")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            c, b, asks = (batch.column(n).to_numpy() for n in ("curve", "block", "asks"))
            cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (asks[1:] != asks[:-1]), [True]])) if len(c) else []
            for x, y in zip(cut[:-1], cut[1:]):
                part = batch.slice(x, y - x)
                if at != (c[x], b[x]):
                    held, at = [], (c[x], b[x])
                v = _matrix(part.column("embedding"))
                if not asks[x]:
                    held.append((v, part.column("point").to_numpy(), part.column("first").to_numpy()))
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(h) for h in zip(*held))]
                    yield _found(part.column("point"), list(_best(v, *held[0], k + 1)))

    met = dealt.repartition("curve", "block").sortWithinPartitions("curve", "block", "asks").mapInArrow(compare, _FOUND)
    # a row among the k + 1 nearest belongs to a point among the k + 1 nearest, the own one included
    top = _merge(met, k + 1)
    each = top.join(keyed.select("point", "members"), "point").select("asks", "score", F.explode("members").alias("m"))
    place = F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("score"), "m"))
    lists = each.withColumn("n", place).filter(F.col("n") <= k + 1).groupBy("asks").agg(F.sort_array(F.collect_list(F.struct("n", "m", "score"))).alias("found"))
    mine = queries.join(lists, queries["point"] == lists["asks"]).select("vec_id", "row", "found")
    others = F.slice(F.filter("found", lambda x: x["m"]["row"] != F.col("row")), 1, k)
    listed = mine.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.m.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _measure(keyed: DataFrame, places: DataFrame, before: dict, total: int, k: int, block: int, curves: int, target: float, measured: int) -> tuple[int, int]:
    """Orderings, and points on either side of a query, that with the least work find ``target`` of the neighbours of ``measured`` asking points."""
    sample = keyed.filter("asking").orderBy(F.xxhash64(F.lit(9), "point"), "point").limit(measured).select("point", "embedding").toArrow()
    asking = sample.column("point").combine_chunks()
    if not len(asking):
        return FEWEST, 0
    q = _matrix(sample.column("embedding").combine_chunks())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                yield _found(asking, list(_best(q, _matrix(part.column("embedding")), part.column("point").to_numpy(), part.column("first").to_numpy(), k + 1)))

    # at most k + 1 points for each of the measured queries, and they themselves
    true = save(_merge(keyed.select("point", "first", "embedding").mapInArrow(compare, _FOUND), k + 1), "neighbours")
    ids = true.select("point").union(true.select("asks")).distinct()
    at = {(r["point"], r["curve"]): before[r["curve"], r["part"]] + r["at"] for r in places.join(F.broadcast(ids), "point").collect()}
    pairs = [(r["asks"], r["point"]) for r in true.collect() if r["asks"] != r["point"]]
    drop(true)
    if not pairs:
        return FEWEST, 0
    far = np.array([[abs(at[a, c] - at[p, c]) for c in range(curves)] for a, p in pairs])
    n_asking = keyed.filter("asking").count()
    choices = []
    for c in range(min(FEWEST, curves), curves + 1):
        least = np.sort(far[:, :c].min(1))
        window = int(least[min(len(least) - 1, int(np.ceil(target * len(least))) - 1)])
        choices.append((c * (min(total, max(block, 2 * window)) * n_asking + MOVE * total), c, window))
    return min(choices)[1:]

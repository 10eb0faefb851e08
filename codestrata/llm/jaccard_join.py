"""N-gram Jaccard join: texts whose sets of 5-word shingles have a similarity of 0.8 or more, and their components.

Jaccard distance is a metric on sets, and the join is a metric-space join in three levels:

* Equal sets (distance 0) become one class, whatever their number.
* Level 1: the pivots are the one-shingle sets {s}. A set x lies at distance 1 - 1/|x| of each pivot it holds and at 1 of
  all others; ties go to the first pivot in one global order (rare shingles by hash, then the commonest by count). So a set's
  Voronoi region is that of its first shingle. For a partner y within 0.2 the triangle inequality bounds what x and y do
  not share to (|x|+|y|)/9 shingles, so y's region is among those of x's first |x| - ceil(0.8|x|) + 1 shingles: the set
  is replicated into exactly that window, and two partners meet in the region of the first shingle they share, where their
  positions i and j satisfy i + j <= (|x|+|y|)/9. Members without such a partner leave the region.
* Level 2: regions with the same smallest member are one cell, whose pivot is that member. Members leave it unless the parity
  sketch of another one is near: sketches differ in no more bits than the sets in shingles, so no partner is lost, and
  few texts travel.
* Level 3: what stays in a cell is compared exactly, unless already connected. A task returns a spanning forest, never all pairs.

A cell with more members than a task holds is joined recursively around members picked as new pivots. In level 2 members near
one of them are settled; the rest pick pivots among themselves while it is large, and what is left at last is held against
the whole cell, block by block. In level 3 each block of the cell is joined with the pivots; what that connects to the
cell's largest component is settled, and only the rest is held against all blocks. So a group of near copies of any number
costs a constant number of rows each, and a task's memory is bounded for any group.

Which shingles count as common only affects speed: any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm import kernel
from codestrata.llm.common import drop, runs, save, text_key
from codestrata.llm.components import components

#: Shingles at most that are ordered by count, the commonest; each costs 16 bytes on every executor.
HOT = 1 << 17
#: Shingles at most of a block of one cell.
CELL_SHINGLES = 3_000_000
#: Sketches at most of a block of one cell; rows beyond which a region is passed on as it comes.
CELL_ROWS, LONG = 1_000, 200_000
#: Pivots that a large cell picks in a round; rounds at most.
PIVOTS, PICKS = 8, 4
#: Shingles whose counts a task keeps; beyond twice as many the rarest are counted down (Misra and Gries).
COUNTED = 1 << 17
_ONE, _TWO = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x6C8E9CF570932BD5)


def _signatures(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    return tuple(kernel.mix(kernel.sums(kernel.mix(u ^ k), at)).view(np.int64) for k in (_ONE, _TWO))


class _Counts:
    """Counts of shingles in bounded memory: what is counted down was rarer than all that stays."""

    def __init__(self) -> None:
        self.token, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @staticmethod
    def _cut(token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(token) <= 2 * COUNTED:
            return token, count
        count = count - np.partition(count, -COUNTED - 1)[-COUNTED - 1]
        return token[count > 0], count[count > 0]

    def add(self, tokens: np.ndarray) -> None:
        token, count = self._cut(*np.unique(tokens, return_counts=True))
        if len(self.token):
            token, where = np.unique(np.concatenate([self.token, token]), return_inverse=True)
            count = np.bincount(where, np.concatenate([self.count, count]), len(token)).astype(np.int64)
        self.token, self.count = self._cut(token, count)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one (token, seen) for each shingle that several different sets of the task hold."""
    names = ["doc_id", "th", "n", "key", "key2", "sketch", "token", "seen"]
    counts = _Counts()
    pool: list[np.ndarray] = []

    def flush() -> None:
        if pool:
            counts.add(np.concatenate(pool))
            pool.clear()

    for batch in batches:
        seen: set[int] = set()
        size, one, two, sketch = [], [], [], []
        for _, _, u, at in kernel.shingle_sets(batch.column("text")):
            a, b = _signatures(u, at)
            size.append(np.diff(at))
            one.append(a)
            two.append(b)
            sketch += [_sketch(u[x:y]) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            for k, key in enumerate(a.tolist()):
                if key not in seen:
                    seen.add(key)
                    pool.append(u[at[k] : at[k + 1]])
            if sum(map(len, pool)) > 4 * COUNTED:
                flush()
        none = pa.nulls(batch.num_rows, pa.int64())
        out = [batch.column("doc_id"), batch.column("th"), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (size, one, two)), pa.array(sketch, pa.binary()), none, none]
        yield pa.RecordBatch.from_arrays(out, names)
    flush()
    token, count = counts.token[counts.count > 2].view(np.int64), counts.count[counts.count > 2]
    for a in range(0, len(token), 50_000):
        own, void = token[a : a + 50_000], pa.nulls(len(token[a : a + 50_000]), pa.int64())
        yield pa.RecordBatch.from_arrays([void] * 5 + [pa.nulls(len(own), pa.binary()), pa.array(own, pa.int64()), pa.array(count[a : a + 50_000], pa.int64())], names)


def _windows(hot: np.ndarray, rank: np.ndarray):
    """The level-1 windows of every set; hot: sorted common shingles, rank: their places in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, _, u, at in kernel.shingle_sets(batch.column("text")):
                n = np.diff(at)
                key, _ = _signatures(u, at)
                want = n - (4 * n + 4) // 5 + 1
                place = np.searchsorted(hot, u) if len(hot) else np.zeros(len(u), np.int64)
                common = (hot[np.minimum(place, len(hot) - 1)] == u) if len(hot) else np.zeros(len(u), bool)
                rare = ~common
                before = np.concatenate([[0], np.cumsum(rare)])
                rares = before[at[1:]] - before[at[:-1]]
                doc = np.repeat(np.arange(len(n)), n)
                new = np.zeros(len(n), bool)
                for k, x in enumerate(key.tolist()):
                    if n[k] and x not in seen:
                        seen.add(x)
                        new[k] = True
                pos = before[:-1] - before[at[:-1]][doc]
                take = rare & (pos < want[doc]) & new[doc]
                toks, docs, poss = [u[take]], [doc[take]], [pos[take]]
                for k in np.flatnonzero(new & (rares < want)).tolist():
                    x = slice(at[k], at[k + 1])
                    more = u[x][common[x]][np.argsort(rank[place[x][common[x]]], kind="stable")][: want[k] - rares[k]]
                    toks.append(more)
                    docs.append(np.full(len(more), k))
                    poss.append(rares[k] + np.arange(len(more)))
                d = np.concatenate(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(toks).view(np.int64)), pa.array(key[d]), pa.array(n[d].astype(np.int32)), pa.array(np.concatenate(poss).astype(np.int32))],
                    ["token", "key", "n", "pos"],
                )

    return run


def _regions(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    """(pivot, key) of the members of every region that may have partners; the rows come sorted by token and key.

    A region of more than ``long`` rows is passed on as it comes, without the test that needs it whole.
    """
    names = ("token", "key", "n", "pos")
    held = [np.zeros(0, np.int64)] * 4
    streamed: tuple[int, int] | None = None  # token and pivot of a long region under way

    def made(pivots, keys):
        return pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(keys, pa.int64())], ["pivot", "key"])

    def whole(cols):
        token, key, n, pos = cols
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, n, pos = token[keep], key[keep], n[keep], pos[keep]
        cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        size = np.diff(cut)
        p = cut[:-1][size == 2]
        h = (n[p] + n[p + 1]) // 9
        p = p[(np.abs(n[p] - n[p + 1]) <= h) & (pos[p] + pos[p + 1] <= h)]
        pivots, keys = [key[p], key[p]], [key[p], key[p + 1]]
        for a, m in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            nn, pp, kk = n[a : a + m], pos[a : a + m], key[a : a + m]
            o = np.argsort(nn, kind="stable")
            nn, pp, kk = nn[o], pp[o], kk[o]
            chain = np.flatnonzero(np.concatenate([[True], 4 * nn[1:] > 5 * nn[:-1], [True]]))
            for x, y in zip(chain[:-1].tolist(), chain[1:].tolist()):
                if y - x > 1:
                    two = np.partition(pp[x:y], 1)[:2]
                    least = np.where(pp[x:y] == two[0], two[1], two[0])
                    fit = 4 * (pp[x:y] + least) <= nn[x:y]  # (n + 1.25 n) / 9
                    if fit.sum() > 1:
                        k = kk[x:y][fit]
                        pivots.append(np.full(len(k), k.min()))
                        keys.append(k)
        return made(np.concatenate(pivots), np.concatenate(keys))

    for batch in batches:
        cols = [batch.column(x).to_numpy().astype(np.int64, copy=False) for x in names]
        if not len(cols[0]):
            continue
        if streamed is not None:
            m = int(np.searchsorted(cols[0], streamed[0], "right"))
            if m:
                yield made(np.full(m, streamed[1]), cols[1][:m])
                cols = [c[m:] for c in cols]
            if not len(cols[0]):
                continue
            streamed = None
        cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if last:
            yield whole([c[:last] for c in cols])
        held = [c[last:] for c in cols]
        if len(held[0]) > long:
            streamed = (int(held[0][0]), int(held[1][0]))
            yield made(np.full(len(held[1]), streamed[1]), held[1])
            held = [np.zeros(0, np.int64)] * 4
    if len(held[0]):
        yield whole(held)


def _sketch(u: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits, two to four bits a shingle: two sketches differ in no more bits than the sets
    in members."""
    width = min(max(64, 1 << int(2 * len(u) - 1).bit_length()), 8192)
    odd = np.bincount((u & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketch: bytes, words: int) -> np.ndarray:
    """The sketch of that many 64-bit words that a longer one holds."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, words))


def _close(sketch: bytes, n: int, other: bytes, m: int) -> bool:
    """Whether sets of n and m members with these sketches may be partners."""
    w = min(len(sketch), len(other)) // 8
    d = int(np.bitwise_count(_folded(sketch, w) ^ _folded(other, w)).sum())
    return 9 * d <= n + m and 9 * abs(n - m) <= n + m


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of large cells, with whether one of the cell's ``pivots`` (another one than itself) is near."""
    kept = ["pivot", "key", "n", "sketch"]
    last, pivots = None, []
    for batch in batches:
        near = []
        for k, (pivot, key, n, sketch) in enumerate(zip(*(batch.column(x).to_pylist() for x in kept))):
            if pivot != last:  # the same for all rows of a cell
                last, pivots = pivot, batch.column("pivots")[k].as_py()
            near.append(any(p["key"] != key and _close(sketch, n, p["sketch"], p["n"]) for p in pivots))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(near, pa.bool_())], [*kept, "near"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, key) of the members of each task whose sketch is near that of another one; only those that ask look."""
    pivots: list[int] = []
    keys: list[int] = []
    for group in runs(batches, ["pivot", "one", "two"]):
        _, first = np.unique(group.column("key").to_numpy(), return_index=True)  # those that ask come first
        group = group.take(pa.array(first))
        key, n, asks = (group.column(x).to_numpy() for x in ("key", "n", "asks"))
        sketch = group.column("sketch").to_pylist()
        words = np.array([len(x) // 8 for x in sketch])
        keep = np.zeros(len(key), bool)
        for w in np.unique(words).tolist():
            # partners differ in size by a quarter at most, so in the width of their sketches by a factor of two
            both = np.concatenate([np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)])
            folded = np.stack([_folded(sketch[k], w) for k in both.tolist()])
            for x, k in enumerate(both.tolist()):
                if keep[k] or not asks[k]:
                    continue  # one that is near another already; those left look at all themselves, in both widths
                d = np.bitwise_count(folded ^ folded[x]).sum(1, dtype=np.int64)
                total = n[both] + n[k]
                fits = (9 * d <= total) & (9 * np.abs(n[both] - n[k]) <= total)
                if words[k] != w:
                    fits &= words[both] == w  # its own width and the next come with the next turn
                fits[x] = False
                if fits.any():
                    keep[k] = True
                    keep[both[fits]] = True
        keys += key[keep].tolist()
        pivots += [group.column("pivot")[0].as_py()] * int(keep.sum())
        if len(keys) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(keys, pa.int64())], ["pivot", "key"])
            pivots, keys = [], []
    yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(keys, pa.int64())], ["pivot", "key"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= 80 * (len(a) + len(b) - inter)


def _cell(keys: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the linked members of one task: a spanning forest. Members of one component that is ``known`` are connected, and
    of two members one must ask."""
    order = sorted(range(len(keys)), key=lambda k: (len(sets[k]), int(keys[k])))
    keys, sets, asks = keys[order], [sets[k] for k in order], asks[order]
    n = np.array([len(s) for s in sets])
    root = np.unique(known[order], return_inverse=True)[1]
    edges: list[tuple[int, int]] = []
    made = [_sketch(s) for s in sets] if len(keys) > 2 else []
    words = min(map(len, made), default=0) // 8
    sketch = np.stack([_folded(x, words) for x in made]) if made else None
    for k in range(1, len(keys)):
        low = int(np.searchsorted(5 * n[:k], 4 * n[k], "left"))
        cand = np.flatnonzero((root[low:k] != root[k]) & (asks[low:k] | asks[k])) + low
        if sketch is not None and len(cand):
            d = np.bitwise_count(sketch[cand] ^ sketch[k]).sum(1, dtype=np.int64)
            fits = 9 * d <= n[cand] + n[k]
            cand = cand[fits][np.argsort(d[fits], kind="stable")]
        for j in cand.tolist():
            if root[j] != root[k] and _linked(sets[j], sets[k]):
                edges.append((int(keys[j]), int(keys[k])))
                root[root == root[k]] = root[j]
    return edges


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    for group in runs(batches, ["pivot", "one", "two"]):
        _, first = np.unique(group.column("key").to_numpy(), return_index=True)  # those that ask come first
        if len(first) > 1:
            group = group.take(pa.array(first))
            sets = [u[at[k] : at[k + 1]] for x, y, u, at in kernel.shingle_sets(group.column("text")) for k in range(y - x)]
            for x, y in _cell(group.column("key").to_numpy(), sets, group.column("asks").to_numpy(), group.column("known").to_numpy()):
                a.append(x)
                b.append(y)
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _whole() -> dict[str, Column]:
    """Columns of cells that are one task."""
    return {"one": F.lit(0), "two": F.lit(0), "asks": F.lit(True)}


def _large(cells: DataFrame, size, limit: int) -> DataFrame | None:
    """(pivot, blocks) of the cells whose ``size`` is above ``limit``, None if there are none. Written, so that Spark knows how many there are
    before it joins: a handful is broadcast, and no cell, however large, need meet in one task."""
    large = save(cells.groupBy("pivot").agg(size.alias("size")).filter(F.col("size") > limit).select("pivot", F.ceil(F.col("size") / limit).cast("int").alias("blocks")), "large")
    return None if large.isEmpty() else large


def _against_all(cell: DataFrame, left: DataFrame, size, limit: int) -> DataFrame:
    """Tasks in which the members ``left`` (pivot, key, ..), that ask, meet all members of their ``cell`` (pivot, key, .., blocks), block by block."""
    parts = save(left.groupBy("pivot").agg(F.ceil(size / limit).cast("int").alias("parts")), "parts")
    block = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = cell.join(parts, "pivot").withColumn("one", block).withColumn("two", every("parts")).withColumn("asks", F.lit(False)).drop("blocks", "parts")
    asking = left.join(parts, "pivot").withColumn("two", F.pmod(F.xxhash64("key", F.lit(1)), "parts").cast("int")).withColumn("one", every("blocks"))
    return own.unionByName(asking.withColumn("asks", F.lit(True)).select(*own.columns))


def _picked(cell: DataFrame, turn: int, columns: list[str]) -> DataFrame:
    """(pivot, pivots): a few members of each large cell, spread by hash; some 64 of each are looked at."""
    mark = F.xxhash64(F.lit(turn), "key")
    share = cell.groupBy("pivot").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 64)).alias("of"))
    some = cell.join(share, "pivot").filter(F.pmod(mark, F.col("of")) == 0)
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("pivot").orderBy(mark, "key"))).filter(F.col("nth") <= PIVOTS)
    return save(some.groupBy("pivot").agg(F.collect_list(F.struct(*columns)).alias("pivots")), "pivots")


def _near_members(sized: DataFrame, cell_rows: int) -> DataFrame:
    """(pivot, key) of all members of cells whose sketch is near that of another member; ``sized`` has pivot, key, n and sketch."""
    large = _large(sized, F.count("*"), cell_rows)
    if large is None:
        tasks, settled = sized.withColumns(_whole()), None
    else:
        cell = save(sized.join(large, "pivot"), "cell")
        left, settled = cell.drop("blocks"), []
        for turn in range(PICKS):
            met = left.join(_picked(left, turn, ["key", "n", "sketch"]), "pivot").mapInArrow(_settle, "pivot long, key long, n long, sketch binary, near boolean")
            met = save(met, "met")
            settled.append(met.filter("near").select("pivot", "key"))
            left = met.filter("not near").drop("near")
            if left.groupBy("pivot").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows).isEmpty():
                break
        rest = _against_all(cell, left.join(large, "pivot"), F.count("*"), cell_rows)
        tasks = sized.join(large, "pivot", "left_anti").withColumns(_whole()).unionByName(rest)
    order = ["pivot", "one", "two"]
    found = tasks.repartition(*order).sortWithinPartitions(*order, "key", F.desc("asks")).mapInArrow(_near, "pivot long, key long")
    for part in settled or []:
        found = found.unionByName(part)
    return save(found.distinct(), "near")


def _edges(near: DataFrame, texts: DataFrame, classes: DataFrame, cell_shingles: int) -> DataFrame:
    """(a, b) edges that connect all linked members of the cells ``near`` (pivot, key)."""

    def compared(tasks: DataFrame) -> DataFrame:
        packed = tasks.groupBy("key").agg(F.collect_list(F.struct("pivot", "one", "two", "asks", "known")).alias("tasks"))
        wanted = packed.join(classes, "key").select("key", "tasks", F.col("doc_id").alias("d"), F.col("th").alias("t"))
        found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("key", "text", F.inline("tasks"))
        order = ["pivot", "one", "two"]
        return save(found.repartition(*order).sortWithinPartitions(*order, "key", F.desc("asks")).mapInArrow(_cells, "a long, b long"), "edges")

    counted = near.join(classes.select("key", "n"), "key")
    large = _large(counted, F.sum("n"), cell_shingles)
    if large is None:
        return compared(near.withColumns(_whole() | {"known": F.col("key")}))
    cell = save(counted.join(large, "pivot"), "cell")
    # each block of a large cell by itself, and with a few members that all its blocks hold
    block = {"one": F.pmod(F.xxhash64("key"), "blocks").cast("int"), "two": F.lit(0), "asks": F.lit(True), "known": F.col("key")}
    blocks = cell.withColumns(block).drop("n", "blocks")
    shared = _picked(cell, 0, ["key"]).join(large, "pivot").select("pivot", "blocks", F.explode("pivots.key").alias("key"))
    shared = shared.withColumns({"one": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "two": F.lit(0), "asks": F.lit(True), "known": F.col("key")}).drop("blocks")
    whole = near.join(large, "pivot", "left_anti").withColumns(_whole() | {"known": F.col("key")})
    edges = compared(whole.unionByName(blocks).unionByName(shared))
    known = save(components(edges), "known").withColumnRenamed("node", "key")
    placed = save(cell.join(known, "key", "left").withColumn("known", F.coalesce("component", "key")).drop("component"), "placed")
    main = placed.groupBy("pivot", "known").agg(F.sum("n").alias("w")).groupBy("pivot").agg(F.max_by("known", F.struct("w", "known")).alias("main"))
    left = save(placed.join(main, "pivot").filter(F.col("known") != F.col("main")).drop("main"), "left")
    if left.isEmpty():
        return edges
    return edges.unionByName(compared(_against_all(placed, left, F.sum("n"), cell_shingles).drop("n")))


def jaccard_components(docs: DataFrame, hot: int = HOT, cell_shingles: int = CELL_SHINGLES, cell_rows: int = CELL_ROWS, long: int = LONG) -> DataFrame:
    """Per row of ``docs``: doc_id, th (hash of the text), n_shingles, key (the class of equal sets), group (the same for
    all rows of one component, null for a text without words) and component_id (the smallest doc_id of the component).

    Null texts and texts without words have an empty set, link with nothing and are their own component. A null doc_id never
    is the smallest one while the component has another; rows with equal doc_id are kept apart. An empty table gives an
    empty result. Sets are told apart by 64-bit hashes of their shingles. Other columns of ``docs`` play no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("th", text_key(F.col("text")))
    described = save(texts.mapInArrow(_describe, "doc_id long, th long, n long, key long, key2 long, sketch binary, token long, seen long"), "sets")
    rows = described.filter("token is null").select("doc_id", "th", "n", "key")
    sketched = described.filter("token is null and n > 0")
    common = described.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter("seen >= 8")
    got = common.orderBy(F.desc("seen"), "token").limit(hot).collect()
    tokens = np.array([r.token for r in got], np.int64).view(np.uint64)
    counts = np.array([r.seen for r in got], np.int64)
    o = np.argsort(tokens)
    rank = np.empty(len(o), np.int64)
    rank[np.lexsort((tokens[o], counts[o]))] = np.arange(len(o))

    members = (
        texts.mapInArrow(_windows(tokens[o], rank), "token long, key long, n int, pos int")
        .repartition("token").sortWithinPartitions("token", "key")
        .mapInArrow(lambda batches: _regions(batches, long), "pivot long, key long")
    )
    members = save(members.groupBy("pivot", "key").agg(F.lit(1).alias("one")).select("pivot", "key"), "members")
    classes = save(
        sketched.groupBy("key").agg(F.max("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "sketch")).alias("least"))
        .select("key", "n", F.col("least.doc_id").alias("doc_id"), F.col("least.th").alias("th"), F.col("least.sketch").alias("sketch")),
        "classes",
    )
    sized = members.join(classes.select("key", "n", "sketch"), "key")
    near = _near_members(sized, cell_rows)
    edges = _edges(near, texts, classes, cell_shingles)
    joined = components(edges).withColumnRenamed("node", "key")
    grouped = classes.select("key", "doc_id").join(joined, "key", "left").withColumn("group", F.coalesce("component", "key"))
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    labels = save(grouped.select("key", "group").join(least, "group"), "labels")
    drop(members, near, classes)
    return rows.join(labels, (rows["key"] == labels["key"]) & (rows["n"] > 0), "left").select(
        rows["doc_id"], rows["th"], rows["n"].alias("n_shingles"), rows["key"], labels["group"],
        F.when(labels["group"].isNull(), rows["doc_id"]).otherwise(labels["component_id"]).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for all of each component save its first document: the smallest doc_id (null last), then the
    smallest hash of the text. Of rows that repeat that document's id and text one stays. Texts without words all stay."""
    found = jaccard_components(docs)
    first = found.filter("`group` is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("least"))
    blank = found.filter("`group` is null").select("doc_id", "th", F.lit(False).alias("worded")).distinct()
    keep = first.select("least.doc_id", "least.th", F.lit(True).alias("worded")).unionByName(blank)
    often = found.groupBy("doc_id", "th").agg(F.count("*").alias("rows")).filter("rows > 1")
    both = (F.col("k.doc_id").eqNullSafe(F.col("o.doc_id"))) & (F.col("k.th") == F.col("o.th"))
    keep = save(
        keep.alias("k").join(often.alias("o"), both, "left")
        .select(F.col("k.doc_id").alias("__keep_id"), F.col("k.th").alias("__keep_th"), (F.col("worded") & F.col("rows").isNotNull()).alias("__keep_once")),
        "keep",
    )
    named = docs.columns
    src = docs.withColumn("__row_id", F.col("doc_id").cast("long")).withColumn("__row_th", text_key(F.col("text").cast("string")))
    kept = lambda once: src.join(keep.filter(F.col("__keep_once") == once), F.col("__row_id").eqNullSafe(F.col("__keep_id")) & (F.col("__row_th") == F.col("__keep_th")), "left_semi")
    return kept(False).unionByName(kept(True).dropDuplicates(["__row_id", "__row_th"])).select(*named)

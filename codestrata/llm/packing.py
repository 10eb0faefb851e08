"""Best-fit packing of token sequences: gaps are filled exactly by single lengths, pairs and triples, then best-fit.

A sequence is known by the lengths it holds, and there are no more lengths than the capacity. So the plan is made on the
driver from the counts of each length (1024 numbers for any input), and the pieces find their places by their rank among
those of their length, in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import save
from codestrata.llm.tokens import encoder, groups

CAPACITY, END = 1024, 2
#: Pieces of one length that one task ranks.
SALT = 50_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text: its ids and ``end``, cut where longer than ``capacity``.

    A null text is empty, so it is the one id ``end``. Of a cut text all pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, some in groups(texts):
                row, piece, start, length, crc, data = [], [], [], [], [], []
                for k, text in enumerate(some):
                    got = own_encoder.ids(text).tobytes() + stop
                    n = len(got) // 4
                    x = 0
                    for p, y in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        own = got[4 * x : 4 * y]
                        row.append(a + k)
                        piece.append(p)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            data.append(np.frombuffer(own, "<u4").astype(np.int64))
                        x = y
                out = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(data, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class Sums:
    """The lengths that are left, indexed by the sums of one, two and three of them. ``left`` (pieces of each length) only ever falls, so
    an entry that has run out is dropped for good when a search meets it."""

    def __init__(self, left: np.ndarray, capacity: int) -> None:
        self.left = left
        have = left > 0
        # by sum: the larger length of each pair, ascending; one length of each triple whose others are a pair
        self.pairs: list[list[int]] = [[] for _ in range(capacity + 1)]
        for total in range(2, capacity + 1):
            a = np.arange((total + 1) // 2, total)
            self.pairs[total] = a[have[a] & have[total - a]].tolist()
        paired = np.array([bool(x) for x in self.pairs])
        self.triples: list[list[int]] = [[] for _ in range(capacity + 1)]
        for total in range(3, capacity + 1):
            a = np.arange((total + 2) // 3, total - 1)
            self.triples[total] = a[have[a] & paired[total - a]].tolist()

    def times(self, lengths: list[int]) -> int:
        """How often these lengths can be taken together."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def _live(self, entries: list[int], lost) -> list[int]:
        if any(map(lost, entries)):
            entries[:] = [a for a in entries if not lost(a)]
        return entries

    def pair(self, total: int, held: list[int]) -> list[int] | None:
        """Two lengths with that sum that are left beside those ``held``, the larger ones first."""
        for a in reversed(self._live(self.pairs[total], lambda a: not (self.left[a] and self.left[total - a]))):
            if self.times([*held, a, total - a]):
                return [a, total - a]
        return None

    def exact(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three lengths that fill ``gap``."""
        if self.left[gap] and self.times([*held, gap]):
            return [gap]
        if two := self.pair(gap, held):
            return two
        for a in reversed(self._live(self.triples[gap], lambda a: not (self.left[a] and self.pairs[gap - a]))):
            if self.times([*held, a]) and (two := self.pair(gap - a, [*held, a])):
                return [a, *two]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces a sequence, sequences, first sequence, offset): where the pieces of each length go."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    sums = Sums(left, capacity)
    out: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def emit(lengths: list[int]) -> None:
        nonlocal made
        n, offset = sums.times(lengths), 0
        for x, same in groupby(sorted(lengths, reverse=True)):
            m = len(list(same))
            out.append((x, int(used[x]), m, n, made, offset))
            used[x] += m * n
            left[x] -= m * n
            offset += m * x
        made += n

    if left[capacity]:
        emit([capacity])
    for x in range(capacity - 1, 0, -1):
        while left[x] and (more := sums.exact(capacity - x, [x])):
            emit([x, *more])
    while (rest := np.flatnonzero(left)).size:
        held = [int(rest[-1])]
        gap = capacity - held[0]
        while gap > 0:
            # best fit: the single, pair or triple that leaves least
            more = next((m for g in range(gap, 0, -1) if (m := sums.exact(g, held))), None)
            if not more:
                break
            held += more
            gap -= sum(more)
        emit(held)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, salt: int = SALT) -> DataFrame:
    """The pieces of ``cut`` (any columns with length between 1 and ``capacity``) with sequence_id and offset (both long).

    Pieces of one length are interchangeable; they are ranked as they stand in the written table, in groups of ``salt`` at most and of
    an even part of all tasks' rows, whatever their ids. An empty table stays empty.
    """
    spark, named = cut.sparkSession, cut.columns
    cut = save(cut.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries = sorted(plan(counts, capacity))
    key = np.array([(e[0] << 44) + e[1] for e in entries], np.int64)
    cols = [np.array([e[k] for e in entries], np.int64) for k in range(6)]
    size = max(1, min(salt, sum(counts.values()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    sizes = spark.createDataFrame([(x, -(-n // size)) for x, n in sorted(counts.items())], "length long, __salts long")
    # as many rows as there are lengths
    salted = cut.join(F.broadcast(sizes), "length").withColumn("__salt", F.pmod(F.xxhash64("__row"), "__salts"))
    base = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    base = base.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__base"))
    number = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__row")) - 1
    ranked = salted.withColumn("__number", number).join(base, ["length", "__salt"])
    ranked = ranked.select(*named, (F.col("__number") + F.col("__base")).cast("long").alias("__rank"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy().astype(np.int64) for x in ("length", "__rank"))
            k = np.searchsorted(key, (length << 44) + rank, "right") - 1
            _, first, per, _, seq, offset = (c[k] for c in cols)
            own = [batch.column(x) for x in named]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(seq + (rank - first) // per), pa.array(offset + (rank - first) % per * length)],
                [*named, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """pieces() of ``docs``, packed. Repeated rows are packed each; a null doc_id stays null."""
    return pack(pieces(docs, tokenizer, capacity, end, with_ids), capacity)

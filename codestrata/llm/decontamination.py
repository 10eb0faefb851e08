"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are sequences of words (runs of ASCII letters and digits and of characters beyond ASCII, A-Z taken as
a-z). An item of n words may differ by k = n // 8 word edits, so if it is cut into k + 1 pieces, one of them occurs unchanged.
The first words of each piece are looked up in the hashed text, and each hit is verified by Myers's bit-parallel edit distance
over the words around it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import kernel
from codestrata.llm.common import save, text_key

#: Words of an item for each edit; words of a piece that are looked up; items, and bytes of them, whose pieces the executors hold at once.
WORDS_AN_EDIT, PROBE, ITEMS_AT_ONCE, BYTES_AT_ONCE = 8, 4, 20_000, 1 << 25


def budget(n: int) -> int:
    return n // WORDS_AN_EDIT


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """Edit distance of ``pattern`` to the best part of ``text`` that ends at each place."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for j, c in enumerate(pattern):
        peq[c] |= 1 << j
    plus, minus, score, out = mask, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & mask
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        plus, minus = (mh | ~(xv | ph)) & mask, ph & xv
        out.append(score)
    return out


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; places near the end are hashed as if zeros followed."""
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    out = np.zeros(len(h), np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + padded[j : j + len(h)]
    return kernel.mix(out)


class Items:
    """The pieces of a block of items, by the hash of their first words."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.items: list[tuple[int, list[int]]] = []
        probes: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, text in rows:
            _, _, data, bounds = next(kernel.slices(pa.array([text or ""])))
            s, e, _ = kernel.words(data, bounds, kernel.WORDY)
            h = kernel.hashes(data, s, e)
            if not len(h):
                continue
            pieces = budget(len(h)) + 1
            cuts = [len(h) * k // pieces for k in range(pieces)]
            size = min(PROBE, len(h))
            hashed = _windows(h, size)
            for at in cuts:
                probes[size][int(hashed[at])].append((len(self.items), at))
            self.items.append((item, h.tolist()))
        self.probes = [(size, np.array(sorted(found), np.uint64), dict(found)) for size, found in sorted(probes.items())]

    def find(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item_id, distance, first word, end word) of the nearest, then first, match of each item in each text."""
        hits: set[tuple[int, int, int]] = set()
        for size, keys, found in self.probes:
            hashed = _windows(h, size)
            low = np.zeros(1 << 20, bool)
            low[keys & np.uint64(0xFFFFF)] = True
            at = np.flatnonzero(low[hashed & np.uint64(0xFFFFF)])
            at = at[np.isin(hashed[at], keys)]
            doc = np.searchsorted(first, at, "right") - 1
            for d, p in zip(doc.tolist(), at.tolist()):
                if p + size <= first[d + 1]:
                    for item, piece in found[int(hashed[p])]:
                        hits.add((d, item, p - piece))
        spans: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        for d, item, start in sorted(hits):
            n = len(self.items[item][1])
            a, b = max(int(first[d]), start - budget(n)), min(int(first[d + 1]), start + n + budget(n))
            own = spans[d, item]
            if own and a <= own[-1][1]:  # windows that meet are read as one, so that no match is cut or read twice
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        for (d, item), own in spans.items():
            name, words = self.items[item]
            best = None
            for a, b in own:
                text = h[a:b].tolist()
                scores = myers(words, text)
                least = min(scores, default=len(words))
                if least > budget(len(words)) or best is not None and least >= best[0]:
                    continue
                end = scores.index(least) + 1
                # the match stays within len(words) + least words before its end
                back = myers(words[::-1], text[max(0, end - len(words) - least) : end][::-1])
                begin = end - (back.index(least) + 1)
                best = (least, a + begin - int(first[d]), a + end - int(first[d]))
            if best is not None:
                yield d, name, *best


def contaminated(docs: DataFrame, items: DataFrame, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, th, item_id, distance, first_word, end_word): the nearest match of each item in each text that holds it.

    th is the hash of the text, which tells rows with equal doc_id apart; rows equal in both give a match each. Null and empty
    texts and items match nothing. Items of fewer than 8 words must occur exactly. ``items`` (item_id, text) are a query set: they
    are held against all rows in blocks of about ``items_at_once`` items and ``BYTES_AT_ONCE`` bytes. Of equal matches the first, and of
    those that end together the shortest, counts. Items may repeat.
    """
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // items_at_once), -(-size // BYTES_AT_ONCE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, th long, item_id long, distance int, first_word int, end_word int"
    out = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select(F.col("item_id").cast("long"), "text").collect()
        held = Items([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], held: Items = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for a, _, data, bounds in kernel.slices(batch.column("text")):
                    s, e, first = kernel.words(data, bounds, kernel.WORDY)
                    found += [(a + d, *x) for d, *x in held.find(kernel.hashes(data, s, e), first)]
                cols = list(zip(*found)) or [()] * 5
                row = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])],
                    ["doc_id", "th", "item_id", "distance", "first_word", "end_word"],
                )

        got = texts.mapInArrow(run, schema)
        got = save(got, "matches") if blocks > 1 else got
        out = got if out is None else out.unionByName(got)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with the same columns."""
    found = save(contaminated(docs, items).select(F.col("doc_id").alias("__match_id"), F.col("th").alias("__match_th")).distinct(), "found")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__match_id")) & (text_key(F.col("text").cast("string")) == F.col("__match_th"))
    return docs.join(found, same, "left_anti")

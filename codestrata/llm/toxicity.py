"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is, and only documents are labelled.

A sentence's score is a logistic function of its words and of their first letters; a document's is the noisy-or of its sentences', 1 - prod(1 - p). The
weights are fitted to the documents' labels through the noisy-or, after which high sentence scores locate what offends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import kernel
from codestrata.llm.common import drop, save, text_key

#: Hashed words; labelled documents at most that the model is fitted on, and bytes of their weighted words; documents that must hold a word
#: for it to have a weight.
BUCKETS, SAMPLE, BYTES, LEAST_DOCS = 1 << 18, 8_000, 1 << 26, 8
#: Standard deviations by which the toxic documents that hold a word must differ from chance for it to have a weight.
LEAST_Z = 3.0
ROUNDS, RATE, DECAY, START = 150, 0.2, 3e-4, -6.0
#: Bytes of the beginnings of a word that count beside the word, 0 for the whole word.
FORMS = (0, 4, 5)
LETTERS = kernel.WORDY.copy()
LETTERS[0x30:0x3A] = False
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


def _sentences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the forms of all words; first word of each sentence that has words; first sentence of each text; first word of each text."""
    s, e, first = kernel.words(data, bounds, LETTERS)
    forms = [kernel.hashes(data, s, np.minimum(e, s + n) if n else e) + np.uint64(n) for n in FORMS]
    word = (kernel.mix(np.stack(forms, 1)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    n = stops[s] if len(s) else np.zeros(0, np.int64)
    new = np.ones(len(s), bool)
    new[1:] = n[1:] != n[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(new)
    return word, np.append(at, len(s)), np.searchsorted(at, first), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, docs, toxic): the documents of a task that hold each word, and the toxic ones; bucket -1 counts all that hold any."""
    docs, toxic = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for a, b, data, bounds in kernel.slices(batch.column("text")):
            word, _, _, first = _sentences(data, bounds)
            for k in range(b - a):
                own = np.unique(word[first[k] : first[k + 1]])
                if len(own):
                    own = np.append(own, -1)
                    docs[own] += 1
                    toxic[own] += label[a + k]
    k = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(k < BUCKETS, k, -1)), pa.array(docs[k]), pa.array(toxic[k])], ["bucket", "docs", "toxic"])


def _features(used: np.ndarray):
    """For each text with words its label, the used words' numbers, their sentences, and the number of its sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, order = batch.column("toxic").to_pylist(), batch.column("order").to_pylist()
            rows = []
            for a, b, data, bounds in kernel.slices(batch.column("text")):
                word, at, sent, first = _sentences(data, bounds)
                place = np.minimum(np.searchsorted(used, word), max(0, len(used) - 1))
                fits = (used[place] == word) if len(used) else np.zeros(word.shape, bool)
                for k in np.flatnonzero(np.diff(first)).tolist():
                    own = slice(first[k], first[k + 1])
                    n, _ = np.nonzero(fits[own])
                    inside = np.searchsorted(at[sent[k] : sent[k + 1]], n + first[k], "right") - 1
                    rows.append((order[a + k], label[a + k], place[own][fits[own]].astype("<i4").tobytes(), inside.astype("<i4").tobytes(), int(sent[k + 1] - sent[k])))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["order", "toxic", "words", "inside", "sentences"])

    return run


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500.0, 500.0)))


def used_words(bucket: np.ndarray, docs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The buckets that get a weight, sorted, by the documents that hold them; bucket -1 stands for all documents."""
    every = bucket == -1
    if not every.any():
        return np.zeros(0, np.int64)
    mean = toxic[every][0] / docs[every][0]
    even = docs * mean
    return np.sort(bucket[(docs >= LEAST_DOCS) & (np.abs(toxic - even) > LEAST_Z * np.sqrt(even * (1 - mean))) & ~every])


def slope(w: np.ndarray, bias: float, y: np.ndarray, word: np.ndarray, sentence: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """Derivatives, by the weights and the intercept, of the mean of -log of the chance that the noisy-or gives each label ``y``.

    Word ``word[i]`` stands in sentence ``sentence[i]``; the sentences of document d are at[d] to at[d + 1].
    """
    z = bias + np.bincount(sentence, w[word], int(at[-1]))
    clean = kernel.sums(_softplus(z), at)  # -log of the chance that no sentence offends
    odds = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(clean, 50.0)), 1e-6), 1.0) / len(y)
    g = _logistic(z) * np.repeat(odds, np.diff(at))
    return np.bincount(word, g[sentence], len(w)), float(g.sum())


def train(y: np.ndarray, word: np.ndarray, sentence: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights of ``n`` words and the intercept, see ``slope``."""
    if not len(y) or y.min() == y.max():
        return np.zeros(n), START if not len(y) or y.max() < 1 else -START
    w, bias = np.zeros(n), START
    m1, m2, b1, b2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        gw, gb = slope(w, bias, y, word, sentence, at)
        gw = gw + DECAY * np.sign(w)
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        rate = RATE * min(1.0, 2 * (1 - t / (ROUNDS + 1)))
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        bias -= 0.3 * rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = BYTES) -> tuple[np.ndarray, float]:
    """The model from the documents that ``labels`` (doc_id, toxic 0 or 1) covers: all, or the ``sample`` first by hash of doc_id, of
    these as many as ``size`` bytes of weighted words hold.

    Rows without doc_id, text or label are left out. Of several labels of a document the largest counts, of several texts the
    one that comes first by hash. Texts stay on the executors; the driver sees the counts of words and the words that have a weight.
    """
    picked = (
        labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.lit(8), "doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # ``sample`` rows at most
    met = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.any_value("toxic").alias("toxic"), F.min(F.struct(text_key(F.col("text")), "text")).alias("least"))
    own = save(met.select("toxic", F.col("least.text").alias("text"), F.xxhash64(F.lit(8), "doc_id").alias("order")), "labelled")
    counts = own.mapInArrow(_count, "bucket long, docs long, toxic long").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    counted = counts.filter((F.col("docs") >= LEAST_DOCS) | (F.col("bucket") == -1)).toArrow()
    used = used_words(*(counted.column(c).to_numpy() for c in ("bucket", "docs", "toxic")))
    found = save(own.mapInArrow(_features(used), "order long, toxic int, words binary, inside binary, sentences long"), "features")
    total = found.agg(F.coalesce(F.sum(2 * F.length("words") + 64), F.lit(0))).first()[0]
    if total > size:
        found = found.filter(F.pmod("order", F.lit(1_000_000)) < int(size / total * 1e6))
    table = found.orderBy("order", "words").toArrow()
    drop(own)
    words, inside = ([np.frombuffer(x, "<i4").astype(np.int64) for x in table.column(c).to_pylist()] for c in ("words", "inside"))
    at = np.concatenate([[0], np.cumsum(table.column("sentences").to_numpy())]).astype(np.int64)
    none = [np.zeros(0, np.int64)]
    y = table.column("toxic").to_numpy().astype(np.float64)
    w, bias = train(y, np.concatenate(none + words), np.concatenate(none + [x + first for x, first in zip(inside, at[:-1])]), at, len(used))
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = w
    return weight, bias


def score_slice(data: np.ndarray, bounds: np.ndarray, model: tuple[np.ndarray, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the texts, scores of their sentences, and first sentence of each text."""
    weight, bias = model
    word, at, sent, _ = _sentences(data, bounds)
    z = bias + kernel.sums(weight[word].astype(np.float64).sum(1), at)
    return -np.expm1(-kernel.sums(_softplus(z), sent)), _logistic(z), sent


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, predicted, offending) of every whole text: offending holds the numbers (from 0) of the sentences with a score
    of 0.5 or more, or the worst one if the document is predicted toxic without any; sentences are the parts between ``.!?`` and
    line ends that hold a letter. Null, empty and letterless texts have the score 0. Repeated rows are scored each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in kernel.slices(batch.column("text")):
                p, each, sent = score_slice(data, bounds, model)
                p = np.clip(p, 0.0, 1.0)
                bad: list[list[int]] = [[] for _ in range(b - a)]
                for k in np.flatnonzero(p >= 0.5).tolist():
                    own = each[sent[k] : sent[k + 1]]
                    bad[k] = np.flatnonzero(own >= 0.5).tolist() or [int(own.argmax())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(bad, pa.list_(pa.int32()))],
                    ["doc_id", "score", "predicted", "offending"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, offending array<int>"
    )

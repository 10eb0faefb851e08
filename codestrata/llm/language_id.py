"""Language identification by multilingual mixtures: each document is a mixture of languages, whose shares expectation
maximisation estimates from the n-gram likelihoods of its words; the set of languages is chosen by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import kernel
from codestrata.llm.common import save

#: Hashed byte trigrams; documents of each language that the model is fitted on, in expectation; likelihoods (words x languages) that are
#: held at once, but for a longer text.
BUCKETS, SAMPLE, CELLS = 1 << 16, 2000, 1 << 18
#: Rounds of expectation maximisation; weight of the penalty, log(words) / 2 a share.
ROUNDS, PENALTY = 10, 4.0
LETTERS = kernel.WORDY.copy()
LETTERS[0x30:0x3A] = False


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every byte of every word (edges count as 0), and the first one of each word."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    low = kernel.LOWER[data]
    own = np.repeat(starts - at[:-1], ends - starts) + np.arange(at[-1])
    mid = low[own].astype(np.uint32)
    before = np.empty_like(mid)
    before[1:] = mid[:-1]
    before[at[:-1]] = 0
    after = np.empty_like(mid)
    after[:-1] = mid[1:]
    after[at[1:] - 1] = 0
    return ((before * np.uint32(0x9E3779B1) ^ mid * np.uint32(0x85EBCA6B) ^ after * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist())
        for a, b, data, bounds in kernel.slices(batch.column("text")):
            s, e, first = kernel.words(data, bounds, LETTERS)
            if not len(s):
                continue
            g, at = _grams(data, s, e)
            doc = np.repeat(np.repeat(np.arange(b - a), np.diff(first)), e - s)
            for x in np.unique(lang[a:b]).tolist():
                own = np.bincount(g[(lang[a:b] == x)[doc]], minlength=BUCKETS)
                total[x] = total[x] + own if x in total else own
    for x, n in total.items():
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n[k].astype(np.int64))], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and the log-likelihoods of trigrams under each, from ``labelled`` (doc_id, text, lang).

    About ``sample`` documents of each language are used, chosen by a hash of doc_id; rows without lang, text or doc_id are not. Every
    language that occurs is learned: the model's size is that of languages x ``BUCKETS``.
    """
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    share = save(rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*") * 1e6).alias("share")), "languages")
    picked = rows.join(share, "lang").filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < F.col("share"))
    found = picked.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    # a language whose sample is empty or without letters counts too: all trigrams are alike under it
    names = sorted(r["lang"] for r in share.select("lang").collect())
    if not names:
        return [], np.zeros((0, BUCKETS), np.float32)
    place = np.array([names.index(x) for x in lang.dictionary.to_pylist()], np.int64)
    counts = np.zeros((len(names), BUCKETS), np.float32)
    if len(lang):
        counts[place[lang.indices.to_numpy()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return names, np.log((counts + 0.5) / (counts.sum(1, keepdims=True, dtype=np.float64) + 0.5 * BUCKETS)).astype(np.float32)


def _mixture(like: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after ``rounds`` of expectation maximisation, and each document's log-likelihood (less that of the best language of
    each word). like: likelihood of each word in each language; the words of document d are first[d] to first[d + 1]."""
    n = np.diff(first)
    for _ in range(rounds):
        part = like * np.repeat(share, n, 0)
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        share = np.stack([kernel.sums(part[:, k].astype(np.float64), first) for k in range(part.shape[1])], 1)
        share /= np.maximum(n, 1)[:, None]
    total = np.log(np.maximum((like * np.repeat(share, n, 0)).sum(1), 1e-30)).astype(np.float64)
    return share, kernel.sums(total, first)


def predict_slice(data: np.ndarray, bounds: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x languages) shares of the chosen language sets, and the number of words of each document."""
    s, e, first = kernel.words(data, bounds, LETTERS)
    n = np.diff(first)
    best = np.full((len(n), len(logp)), 1.0 / max(1, len(logp)))
    if not len(s) or not len(logp):
        return best, n
    a = 0
    while a < len(n):
        # consecutive texts whose likelihoods fit, one at least
        b = max(a + 1, int(np.searchsorted(first, first[a] + CELLS // len(logp), "right")) - 1)
        own = slice(first[a], first[b])
        best[a:b] = _predict(data, s[own], e[own], first[a : b + 1] - first[a], logp)
        a = b
    return best, n


def _predict(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Shares of the language sets of the texts whose words are ``s`` to ``e``. The sets are nested: those of the m largest shares."""
    n = np.diff(first)
    langs = len(logp)
    best = np.full((len(n), langs), 1.0 / langs)
    if not len(s):
        return best
    g, at = _grams(data, s, e)
    ll = np.stack([kernel.sums(p[g].astype(np.float64), at) for p in logp], 1)
    like = np.exp(ll - ll.max(1, keepdims=True)).astype(np.float32)
    del ll
    share, _ = _mixture(like, first, best, ROUNDS)
    order = np.argsort(-share, 1, kind="stable")
    top = np.full(len(n), -np.inf)
    for m in range(1, langs + 1):
        penalty = PENALTY * 0.5 * (m - 1) * np.log(np.maximum(n, 2))
        # no set's log-likelihood is above 0: documents for which the penalty alone is too much are settled
        left = np.flatnonzero(1e-3 - penalty > top)
        if not len(left):
            break
        own_words = like[np.repeat(np.isin(np.arange(len(n)), left), n)]
        own_first = np.concatenate([[0], np.cumsum(n[left])])
        inside = np.zeros_like(share[left])
        np.put_along_axis(inside, order[left, :m], 1.0, 1)
        start = share[left] * inside + 1e-9 * inside
        own, fit = _mixture(own_words, own_first, start / start.sum(1, keepdims=True), 0 if m == 1 else 4)
        fit -= penalty[left]
        better = fit > top[left]
        best[left[better]], top[left[better]] = own[better], fit[better]
    return best


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred, score (the share of that language, 0 to 1) and langs (all languages of the chosen set).

    Texts that are null or hold no letter are ``und`` with score 0 and no langs; so is everything if the model knows no language.
    Whole texts are read. Equal shares go to the language that comes first by name. Columns of ``docs`` with these three names
    are replaced.
    """
    names, logp = model
    plain = [c for c in docs.columns if c not in ("lang_pred", "score", "langs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            for a, b, data, bounds in kernel.slices(col):
                share, n = predict_slice(data, bounds, logp)
                some = n > 0
                ascii_letter = np.zeros(len(data) + 1, np.int64)
                ascii_letter[1:] = np.cumsum(LETTERS[data] & (data < 0x80))
                plainly = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
                for k in np.flatnonzero(some & ~plainly).tolist():
                    some[k] = any(map(str.isalpha, col[a + k].as_py() or ""))
                some &= bool(names)
                k = share.argmax(1) if names else np.zeros(len(n), int)
                pred = [names[x] if y else "und" for x, y in zip(k.tolist(), some.tolist())]
                score = np.where(some, share[np.arange(len(k)), k] if names else 0.0, 0.0).clip(0, 1)
                langs = [[names[j] for j in np.flatnonzero(v > 0.01)] if y else [] for v, y in zip(share, some.tolist())]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in plain), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))],
                    [*plain, "lang_pred", "score", "langs"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in plain]).schema)
    return docs.select(*[f"`{c}`" for c in plain]).mapInArrow(run, f"{kept}, lang_pred string, score double, langs array<string>")

"""A deterministic embedder without a model: bags of hashed identifier parts."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.text import IDENTIFIER_PART

_PART = re.compile(IDENTIFIER_PART)


@lru_cache(100_000)
def bucket(token: str, dim: int) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little") % dim


def hash_vector(text: str, dim: int = 256) -> np.ndarray:
    at = [bucket(t.lower(), dim) for t in _PART.findall(text)]
    v = np.bincount(at, minlength=dim).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-12) if at else v


def hash_embed(text: Column, dim: int = 256) -> Column:
    """Texts are read from Arrow one at a time, and vectors written into one matrix for each batch."""

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dim), np.float32)
        for n, x in enumerate(texts):
            out[n] = hash_vector(x.as_py() or "", dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<float>")(text)


class HashingEmbedder:
    """An embedder has a model_id and columns for documents and queries."""

    def __init__(self, dim: int = 256) -> None:
        self.dim, self.model_id = dim, f"hashing-{dim}"

    def documents(self, text: Column) -> Column:
        return hash_embed(text, self.dim)

    def query(self, text: str) -> list[float]:
        return hash_vector(text, self.dim).tolist()


class ModelEmbedder:
    """Any sentence encoder: ``load`` gives a function from texts to vectors, called once for each Python worker."""

    def __init__(self, model_id: str, load, query_prefix: str = "", clean: str = "desc-io") -> None:
        self.model_id, self.load, self.query_prefix, self.clean = model_id, load, query_prefix, clean

    def documents(self, text: Column) -> Column:
        load = self.load

        def run(batches):
            encode = load()
            for batch in batches:
                yield pd.Series(list(encode(batch.fillna("").tolist())))

        from collections.abc import Iterator

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<float>")(text)

    def query(self, text: str) -> list[float]:
        from codestrata.functions.text import cleaned

        return list(map(float, self.load()([self.query_prefix + cleaned(text.strip(), self.clean)])[0]))

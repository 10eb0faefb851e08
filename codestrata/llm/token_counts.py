"""Token counts of the sections of documents, by the offsets of one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tokens import encoder, groups


def attribute(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section: the interval join of sorted token starts with sections that begin at sorted ``bounds``.

    The rule for a token that crosses a boundary: it belongs to the section that holds its first character.
    """
    edge = np.searchsorted(starts, bounds)
    return np.diff(np.append(edge, len(starts)))


def section_tokens(docs: DataFrame, tokenizer: str, separator: str = "\n") -> DataFrame:
    """(doc_id, section, start, length, n_tokens): the sections of each text, in characters, and the tokens of each.

    A section ends with ``separator``, which belongs to it, or with the text. Empty sections cannot occur but for the one of
    an empty text, which has no tokens; a null text has no section. The counts of a document's sections add up to the
    tokens of its whole text. Repeated rows are counted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer)
        for batch in batches:
            batch = batch.filter(batch.column("text").is_valid())
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, some in groups(texts):
                row, section, start, length, count = [], [], [], [], []
                for k, text in enumerate(some):
                    size = [len(x) + len(separator) for x in text.split(separator)]
                    size[-1] -= len(separator)
                    if not size[-1] and len(size) > 1:
                        size.pop()
                    bounds = np.concatenate([[0], np.cumsum(size)])[:-1]
                    row.append(np.full(len(size), a + k))
                    section.append(np.arange(len(size)))
                    start.append(bounds)
                    length.append(np.array(size))
                    count.append(attribute(own_encoder.starts(text), bounds))
                cols = [np.concatenate(x) for x in (row, section, start, length, count)]
                out = [ids.take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in cols[2:])]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "section", "start", "length", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, section int, start long, length long, n_tokens long")

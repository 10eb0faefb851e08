"""Exact token ids of a tokenizer file.

A file that is a plain byte-level BPE (ids in the order of the merges, no normaliser) is run by tiktoken's core, which is several
times as fast, over texts of characters that both libraries class alike; the ids are the same. Any other file or text is
encoded by tokenizers itself: so are texts that hold an added token of the file, and those whose long runs exceed what
tiktoken's regular expressions can hold.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# Fixed value: how a byte-level BPE cuts text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Anything but tab, line ends, printable ASCII and Latin letters and signs.
_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")


def _bytes_of(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)


def _byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _fast(path: str):
    """tiktoken's form of the file and the bytes of each id, or None if the file isn't a plain byte-level BPE."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocab.get(x) != 256 + k for k, x in enumerate(made)) or len(vocab) != 256 + len(made):
        return None
    table = _byte_table()
    ranks = {_bytes_of(k, table): v for k, v in vocab.items()}
    if len(ranks) != len(vocab) or any(len(k) != 1 for k, v in ranks.items() if v < 256):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


class Encoder:
    """Token ids of whole texts, as tokenizers gives them with add_special_tokens=False: an added token's string has that token's id."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        fast = _fast(path)
        self.core = fast[0] if fast else None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # texts that only tokenizers reads: with other characters, or with an added token
        self.other = re.compile("|".join([_OTHER.pattern, *map(re.escape, added)]))
        if fast:
            self.size = np.zeros(max(fast[1].values()) + 1, np.int64)
            for token, k in fast[1].items():
                self.size[k] = len(token)

    def _core_ids(self, text: str) -> np.ndarray | None:
        """Ids by tiktoken's core, or None where only tokenizers' own count."""
        if self.core is None or self.other.search(text):
            return None
        try:
            return self.core.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run of white space longer than its backtracking holds
            return None

    def ids(self, text: str) -> np.ndarray:
        got = self._core_ids(text)
        if got is None:
            got = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return got.astype("<u4", copy=False)

    def starts(self, text: str) -> np.ndarray:
        """The position of the first character of each token, or of the character that it is a part of."""
        ids = self._core_ids(text)
        if ids is None:
            return np.array([x for x, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)
        at = np.concatenate([[0], np.cumsum(self.size[ids])])[:-1].astype(np.int64)
        if text.isascii():
            return at
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(lead) - 1)[at]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def groups(texts: list[str], chars: int = 1 << 20):
    """(first, texts) of consecutive texts of about ``chars`` characters together."""
    a, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield a, texts[a : k + 1]
            a, n = k + 1, 0
    if a < len(texts):
        yield a, texts[a:]

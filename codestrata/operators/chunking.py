"""Files to chunks: functions, methods, classes and module blocks of Python, whole files otherwise."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import LANGUAGES, LINE_END, MAX_FILE_BYTES, SKIPPED, decoded, normalized
from codestrata.schemas import CHUNK

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _first_line(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


def _silent(node: ast.stmt) -> bool:
    """Statements that end a module block and belong to none."""
    text = isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
    return text or isinstance(node, ast.Import | ast.ImportFrom | ast.Pass)


def _of_class(node: ast.ClassDef, outer: tuple[str, ...]) -> Iterator[tuple[str, str, int, int]]:
    """A class up to its first inner definition, and its direct inner definitions."""
    names = (*outer, node.name)
    inner = [n for n in node.body if isinstance(n, (*_FUNCTIONS, ast.ClassDef))]
    until = max(node.lineno, _first_line(inner[0]) - 1) if inner else node.end_lineno
    yield ".".join(names), "class", _first_line(node), until
    for n in inner:
        if isinstance(n, ast.ClassDef):
            yield from _of_class(n, names)
        else:
            yield ".".join((*names, n.name)), "method", _first_line(n), n.end_lineno


def _of_module(tree: ast.Module) -> Iterator[tuple[str, str, int, int]]:
    block: list[ast.stmt] = []
    for node in [*tree.body, None]:
        plain = node is not None and not isinstance(node, (*_FUNCTIONS, ast.ClassDef)) and not _silent(node)
        if plain:
            block.append(node)
            continue
        if block:
            yield "<module>", "module", _first_line(block[0]), block[-1].end_lineno
            block = []
        if isinstance(node, _FUNCTIONS):
            yield node.name, "function", _first_line(node), node.end_lineno
        elif isinstance(node, ast.ClassDef):
            yield from _of_class(node, ())


def chunks_of(path: str, data: bytes) -> list[dict]:
    """The chunks of one file, none for files that are large, binary, blank or of a skipped type."""
    pure = PurePosixPath(path)
    kind = pure.suffix.lower()
    text = None if len(data) > MAX_FILE_BYTES or kind in SKIPPED else decoded(data)
    if text is None or not text.strip():
        return []
    language = LANGUAGES.get(kind, "text")
    lines = LINE_END.split(text)
    spans = None
    if language == "python":
        try:
            spans = list(_of_module(ast.parse(text)))
        except (SyntaxError, ValueError, RecursionError):
            spans = None
    if spans is None:
        spans = [(pure.name, "file", 1, len(LINE_END.split(text.rstrip("\r\n"))))]
    out = []
    for name, what, start, end in spans:
        code = normalized("\n".join(lines[start - 1 : end]))
        if code.strip():
            out.append({"path": path, "name": name, "kind": what, "start_line": start, "end_line": end, "code": code, "hash": hashlib.sha256(code.encode("utf-8", "replace")).hexdigest()[:32], "language": language})
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of a table of files (path string, data binary)."""
    columns = [c.split()[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([c for p, d in zip(batch["path"], batch["data"]) if p is not None and d is not None for c in chunks_of(p, bytes(d))], columns=columns)

    return files.select("path", F.col("data").cast("binary").alias("data")).mapInPandas(run, CHUNK)

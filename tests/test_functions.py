import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.functions.hashing import hash_embed, hash_vector
from codestrata.functions.vector import dot, l2_normalise
from codestrata.operators.chunking import chunks_of


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_tokens(spark):
    got = one(spark, [("max_value numRows HTTPServer x 12 the Привет_мир getX2",)], "t string", X.tokenize_code(F.col("t")))[0]
    assert got == ["max_value", "max", "value", "numrows", "num", "rows", "httpserver", "http", "server", "привет_мир", "привет", "мир", "get"]


def test_paths(spark):
    rows = [("src/a.py",), ("test_x.py",), ("a/test_x.py",), ("src",), (None,)]
    assert one(spark, rows, "p string", X.canonical_path(F.col("p"))) == ["a.py", "tests/test_x.py", "a/test_x.py", "src", None]
    rows = [("a.PY",), ("x/.py",), ("Makefile",), ("a.tar.go",)]
    assert one(spark, rows, "p string", X.language_of(F.col("p"))) == ["python", "text", "text", "go"]
    assert one(spark, [("a b/c:d",)], "p string", X.slug(F.col("p"))) == ["a_b_c_d"]


def test_normalised_code_has_one_hash(spark):
    assert X.normalized("  def f():\r\n    return 1  \r\n\r\n") == "def f():\n  return 1"
    got = one(spark, [("\tx = 1\n",), ("x = 1",), (None,)], "c string", X.normalize_code(F.col("c")))
    assert got == ["x = 1", "x = 1", None]


@pytest.mark.parametrize("dashes, header", [(6, False), (7, True)])
def test_rules_of_seven_dashes_are_headers(dashes, header):
    text = f"a\n{'-' * dashes}\nb"
    assert (X.cleaned(text, "desc") == "a") == header


def test_clean_query():
    text = "Say.\n-----Input-----\nn\n-----Examples-----\n1"
    assert X.cleaned(text, "desc") == "Say."
    assert X.cleaned(text, "desc-io") == "Say.\n\nInput:\nn"
    assert X.cleaned(text, "none") == text
    assert X.cleaned("Note:\nx", "desc") == "Note:\nx"
    with pytest.raises(ValueError):
        X.cleaned("x", "some")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(l2_normalise(F.col("a")), dot(F.col("a"), F.col("b"))).collect()
    assert np.allclose(got[0][0], [0.6, 0.8]) and got[0][1] == 11 and got[1][0] == [0, 0]


def test_hashing_embedder(spark):
    v = one(spark, [("parseLine parse_line",), ("",)], "t string", hash_embed(F.col("t")))
    assert np.isclose(np.linalg.norm(v[0]), 1) and not any(v[1])
    assert np.allclose(v[0], hash_vector("line parse"), atol=1e-6)


def test_chunks():
    names = lambda code: [(c["name"], c["kind"], c["start_line"], c["end_line"]) for c in chunks_of("a.py", code.encode())]
    assert names("import os\n") == []
    assert names("x = 1\nimport os\ny = 2\n") == [("<module>", "module", 1, 1), ("<module>", "module", 3, 3)]
    assert names("class A:\n    def f(self): pass\n    z = 1\n") == [("A", "class", 1, 1), ("A.f", "method", 2, 2)]
    assert names("if x:\n    def f(): pass\n") == [("<module>", "module", 1, 2)]
    assert names("\ufeffx = 1\n")[0][1] == "file"
    assert chunks_of("a.svg", b"<svg/>") == [] and chunks_of("a.txt", b"x" * 600_000) == [] and chunks_of("a.txt", b"\0") == [] and chunks_of("a.txt", b" \n") == []


def test_labels(spark):
    rows = [(["v1", "main"], "abc1234", "x.py", 3, 9), ([], "abc1234", "x.py", 3, 9)]
    df = spark.createDataFrame(rows, "refs array<string>, short string, path string, a int, b int")
    assert [r[0] for r in df.select(X.version_label(F.col("refs"), F.col("short"))).collect()] == ["v1, main · abc1234", "abc1234"]
    first = df.select(X.chunk_id(F.col("path"), F.lit("A.f"), F.col("a")), X.location(F.col("path"), F.col("a"), F.col("b")), X.github_url(F.lit("local"), F.lit("c"), F.col("path"), F.col("a"), F.col("b"))).first()
    assert tuple(first) == ("x.py#A.f@3", "x.py:3-9", None)
    assert one(spark, [(" a ",)], "t string", X.prefixed(F.col("t"), "q: ")) == ["q: a"]


def test_decoded_files():
    assert X.decoded(b"") == "" and X.decoded(b"a\0") is None and X.decoded("é".encode()) == "é"
    assert X.decoded(b"\xff" * 8) is not None and X.decoded(b"\xff" * 9) is None and X.decoded(b"x" * 2000 + b"\xff" * 15) is not None and X.decoded(b"x" * 500 + b"\xff" * 15) is None
    assert X.normalized("\t a\n\t\tb\n") == " a\n\tb" and X.normalized(" \n\n") == ""


def test_memory_of_hash_embedding(monkeypatch):
    """A batch's texts aren't all held again as Python's strings."""
    import tracemalloc

    import pyarrow as pa

    from codestrata.functions import hashing

    found = []
    monkeypatch.setattr(hashing.F, "pandas_udf", lambda f, kind: lambda text: None)
    monkeypatch.setattr(hashing.F, "arrow_udf", lambda f, kind: lambda text: found.append(f))
    hash_embed(None)
    texts = pa.array(["word " * 4000, None, *["word " * 4000] * 998])
    tracemalloc.start()
    got = found[0](texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 8 and [sum(x) for x in got.slice(0, 2).to_pylist()] == [1.0, 0.0]


def test_code_words_are_cut_as_tokenize_code_cuts_them(spark):
    """Every plain character and strange ones, alone and between letters of both cases, digits and underscores."""
    from codestrata.operators.search import term_counts

    plain = [chr(c) for c in range(0x250) if re.fullmatch(f"[{X.PLAIN}]", chr(c))]
    strange = [*"İªµºǅΣ١́कि漢‿‍", "\U0001d400", "İẋY"]
    words = [f for c in plain + strange for f in (c, f"a{c}", f"{c}{c}b", f"Ab{c}cD", f"AB{c}CDe", f"ab_{c}9_{c}{c}z", f"__{c}x1_")]
    texts = [" ".join(words[a::97]) for a in range(97)] + [" ".join(words), None, "", "The the THE_the a_b_ of_ _x__yy 12 x12 getX2 HTTPServer", "İ max été MAX"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = df.select("doc_id", X.tokenize_code(F.col("text")).alias("tokens")).collect()
    got = {r["doc_id"]: r for r in term_counts(df.select("doc_id", *X.code_words(F.col("text")))).collect()}
    for r in want:
        found = got[r["doc_id"]]
        assert dict(zip(found["terms"], found["tfs"], strict=True)) == Counter(r["tokens"] or [])
        assert found["len"] == len(r["tokens"] or [])


def test_code_words_cut_a_word_once_for_many_documents(spark, monkeypatch):
    """Of a batch of documents each different word is cut once, whatever its number."""
    import pyarrow as pa

    from codestrata.operators import search

    cut = []
    monkeypatch.setattr(search, "plain_tokens", lambda w: cut.append(w) or X.plain_tokens(w))
    none = pa.nulls(1, pa.list_(pa.struct([("word", pa.string()), ("tokens", pa.list_(pa.string()))])))
    code = pa.array(["fooBar", "x1", "foo", "fooBar"] * 500).dictionary_encode()
    terms, at, begin, times = search._expanded(code.dictionary, none)
    assert cut == ["fooBar", "x1"] and [[terms[int(i)].as_py() for i in at[b : b + n]] for b, n in zip(begin, times)] == [["foobar", "foo", "bar"], [], ["foo"]]

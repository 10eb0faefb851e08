"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def edited(rng, ws, p):
    return [f"e{rng.randrange(10**6)}" if rng.random() < p else w for w in ws]


# ---- line dedup


def lines_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone))
    return out


def test_line_dedup(spark):
    from codestrata.llm.line_dedup import dedup_lines

    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randrange(12)))) for i in range(150)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == lines_brute(rows)


def test_line_dedup_edges(spark):
    from codestrata.llm.line_dedup import dedup_lines

    rows = [(1, None, 7, "x"), (None, "a\nb\nc", 7, "x"), (2, "a\nb\nc", 7, "x"), (2, "a\nb\nc", 7, "x"), (3, "", 7, "x")]
    src = docs(spark, rows, "doc_id long, text string, n_lines int, starts string")
    got = dedup_lines(src)
    assert got.columns == ["doc_id", "text", "starts", "n_lines", "n_removed"]
    assert sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in got.collect() if r["text"] is not None) == [(0, "", 3), (2, "a\nb\nc", 0), (2, "a\nb\nc", 0), (3, "", 0)]
    clashing = src.withColumns({c: F.lit("z") for c in ("__id", "__th", "__lines", "__starts", "c0", "th", "pos", "w", "first")})
    again = dedup_lines(clashing)
    assert set(again.columns) == {*clashing.columns, "n_removed"} and sorted(map(str, again.select(*got.columns).collect())) == sorted(map(str, got.collect()))
    assert dedup_lines(src.limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", dedup_lines(src)._jdf.queryExecution().executedPlan().toString())


# ---- tokens


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    from codestrata.llm.tokens import Encoder

    own, theirs, rng = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(2)
    assert own.core is not None
    for _ in range(3000):
        text = "".join(rng.choice("abXY 019.,'\n\t\r  éßñ²ªÿĀ“漢🙂̀\x1c\x85 's't<|endoftext|>") for _ in range(rng.randrange(40)))
        e = theirs.encode(text, add_special_tokens=False)
        assert own.ids(text).tolist() == e.ids and own.starts(text).tolist() == [x for x, _ in e.offsets], repr(text)
    assert own.ids("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\r", "x"])
def test_encoder_takes_long_runs(run):
    from tokenizers import Tokenizer

    from codestrata.llm.tokens import Encoder

    text = "x" + run * 3_000_000 + "y"
    own, e = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False)
    assert own.ids(text).tolist() == e.ids and own.starts(text).tolist() == [x for x, _ in e.offsets]


def test_section_tokens(spark):
    from tokenizers import Tokenizer

    from codestrata.llm.token_counts import attribute, section_tokens

    rows = [(1, "one\ntwo words\n\n\nfour"), (2, None), (3, ""), (None, "x\n"), (1, "é" * 3000 + "\nz")]
    got = section_tokens(docs(spark, rows, "doc_id long, text string").withColumn("start", F.lit(1)), TOKENIZER).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    assert sum(r["n_tokens"] for r in got) == sum(len(tok.encode(t).ids) for _, t in rows if t)
    first = sorted((r["section"], r["start"], r["length"]) for r in got if r["doc_id"] == 1 and r["section"] > 1)
    assert first == [(2, 14, 1), (3, 15, 1), (4, 16, 4)]
    assert not [r for r in got if r["doc_id"] == 2] and [r["n_tokens"] for r in got if r["doc_id"] == 3] == [0]
    assert attribute(np.array([0, 3, 4, 8]), np.array([0, 4, 5])).tolist() == [2, 1, 1]
    assert section_tokens(docs(spark, []), TOKENIZER).count() == 0


def test_section_tokens_against_brute_force(spark):
    """Each token goes to the section that holds its first character, found token by token."""
    from tokenizers import Tokenizer

    from codestrata.llm.token_counts import section_tokens

    tok, rng = Tokenizer.from_file(TOKENIZER), random.Random(16)
    rows = [(i, "".join(rng.choice(["word ", "é", "\n", "\n\n", " 12", "漢", "<|endoftext|>", "x" * 30, "  "]) for _ in range(rng.randrange(30)))) for i in range(80)]
    want = {}
    for i, t in rows:
        cut = [0, *[k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)], len(t)]
        for n, (a, b) in enumerate(zip(cut, cut[1:])):
            want[i, n] = (a, b - a, 0)
        for a, _ in tok.encode(t, add_special_tokens=False).offsets:
            n = next(n for n, (x, y) in enumerate(zip(cut, cut[1:])) if x <= a < y)
            want[i, n] = (*want[i, n][:2], want[i, n][2] + 1)
    assert {(r["doc_id"], r["section"]): (r["start"], r["length"], r["n_tokens"]) for r in section_tokens(docs(spark, rows), TOKENIZER).collect()} == want


# ---- sharding


def test_shards(spark):
    from codestrata.llm.sharding import shards

    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(1000, "y" * 900), (None, None), (7, "same"), (7, "same")]
    got = shards(docs(spark, rows).withColumn("bits", F.lit(1)), 400).collect()
    assert len(got) == len(rows)
    size, n = {}, {}
    for r in got:
        k = (r["shard_bits"], r["shard"])
        size[k], n[k] = size.get(k, 0) + r["n_bytes"], n.get(k, 0) + 1
    assert all(v <= 400 for k, v in size.items() if k not in {(r["shard_bits"], r["shard"]) for r in got if r["oversized"]})
    assert [(r["doc_id"], r["n_bytes"]) for r in got if r["oversized"]] == [(1000, 900)]
    for d, p in size:  # no split without need: the two halves of a shard's parent don't fit together
        if d and not any(r["oversized"] for r in got if (r["shard_bits"], r["shard"]) == (d, p)):
            near = sum(v for (e, q), v in size.items() if e >= d and q >> (e - d + 1) == p >> 1)
            assert near > 400
    assert len({(r["shard_bits"], r["shard"]) for r in got if r["doc_id"] == 7 and r["n_bytes"] == 4}) == 1
    assert shards(docs(spark, []), 400).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    from codestrata.llm.sharding import write_shards

    rows = [(1, "a" * 300, 5), (1, "b" * 300, 6), (1, "a" * 300, 5), (1, "a" * 300, 7), (None, None, 8), (None, None, 8), (2, "", 9), *[(k, "x" * 50, k) for k in range(40)]]
    write_shards(docs(spark, rows, "doc_id long, text string, shard int"), str(tmp_path / "out"), 400)
    got = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.select("doc_id", "text").collect())) == sorted(map(key, [r[:2] for r in rows]))
    size = {(r[0], r[1]): r[2] for r in got.groupBy("shard_bits", "shard").agg(F.sum(F.length("text"))).collect()}
    assert len(size) > 5 and max(x or 0 for x in size.values()) == 900 and sorted(x or 0 for x in size.values())[-2] <= 400
    write_shards(docs(spark, []), str(tmp_path / "none"), 400)
    assert spark.read.schema("doc_id long").parquet(str(tmp_path / "none")).count() == 0


# ---- packing


def test_plan_fills_exactly_where_it_can():
    from codestrata.llm.packing import plan

    def sequences(counts):
        out = {}
        for length, first, per, n, seq, offset in plan(counts):
            for s in range(n):
                for k in range(per):
                    out.setdefault(seq + s, []).append((offset + k * length, length))
        for s in out.values():
            at = 0
            for x, y in sorted(s):
                assert x == at
                at += y
            assert at <= 1024
        return out

    assert len(sequences({1024: 3, 1000: 2, 24: 1, 12: 2})) == 5
    assert len(sequences({700: 1, 300: 1, 20: 1, 4: 1})) == 1
    assert len(sequences({1: 2048})) == 2 and sequences({}) == {}
    rng = random.Random(3)
    counts = {}
    for _ in range(5000):
        x = min(1024, int(rng.expovariate(1 / 250)) + 1)
        counts[x] = counts.get(x, 0) + 1
    made = sequences(counts)
    assert sum(len(s) for s in made.values()) == 5000
    assert len(made) <= -(-sum(k * v for k, v in counts.items()) // 1024) * 1.01 + 1


def fewest(lengths, capacity):
    """The fewest sequences, by search through all ways."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[k]:
                rest = list(bins)
                rest.remove(room)
                place(k + 1, [*rest, room - lengths[k]])
        place(k + 1, [*bins, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_plan_against_the_optimum():
    from codestrata.llm.packing import plan

    rng = random.Random(17)
    made, least = [], []
    for _ in range(300):
        capacity = rng.choice([7, 12, 20])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 10))]
        counts = {x: lengths.count(x) for x in lengths}
        made.append(sum({seq: n for _, _, _, n, seq, _ in plan(counts, capacity)}.values()))
        least.append(fewest(lengths, capacity))
    assert all(0 <= a - b <= 1 for a, b in zip(made, least)) and sum(made) <= 1.02 * sum(least)
    # four lengths for each sequence, one of them above half of it: all fill exactly
    counts = {}
    for _ in range(200):
        parts = [*sorted(rng.sample(range(1, 512), 2)), 512]
        for x in (1024 - parts[2], parts[0], parts[1] - parts[0], parts[2] - parts[1]):
            counts[x] = counts.get(x, 0) + 1
    assert sum({seq: n for _, _, _, n, seq, _ in plan(counts)}.values()) <= 202


def test_packing_splits_one_length(spark):
    """Repeated rows without an id, all of one length, in groups of at most five."""
    from codestrata.llm.packing import pack

    cut = docs(spark, [(None, 0, 300)] * 101 + [(3, 1, 424)] * 40, "doc_id long, piece int, length long").withColumn("salt", F.lit("clash"))
    place = {}
    for r in pack(cut, salt=5).collect():
        assert r["salt"] == "clash"
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, place.values())) == 141 and len(place) == 47
    for s in place.values():
        assert sorted(s)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:])) and sum(n for _, n in s) <= 1024


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    from codestrata.llm.packing import pack_documents

    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.choice([3, 50, 400, 1500])))) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (5, "again"), (5, "again"), (102, "x" + " " * 1_000_000 + "y")]
    got = pack_documents(docs(spark, rows).withColumn("rank", F.lit("clash")), TOKENIZER, with_ids=True).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for i, t in rows:
        if i != 5:
            own = sorted(by[i], key=lambda r: r["piece"])
            assert [x for r in own for x in r["ids"]] == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            assert all(r["length"] == 1024 for r in own[1:]) and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    place = {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in place.values():
        assert sum(n for _, n in s) <= 1024 and sorted(s)[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:]))
    assert pack_documents(docs(spark, []), TOKENIZER).count() == 0


# ---- language

TEXTS = {"en": "the and of with that from this have which their would there been", "xx": "der und nicht mit das von diese haben welche ihre würde dort gewesen"}


def speech(rng, lang, n):
    return " ".join(rng.choice(TEXTS[lang].split()) for _ in range(n))


def test_language(spark):
    from codestrata.llm.language_id import fit, identify

    rng = random.Random(5)
    rows = [(i, speech(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(["en", "xx"] * 100)]
    model = fit(docs(spark, [*rows, (900, "the", None), (None, "und", "en"), (901, None, "xx")], "doc_id long, text string, lang string"))
    assert model[0] == ["en", "xx"]
    test = [(1, speech(rng, "en", 30), 1.5), (2, speech(rng, "xx", 30), 1.5), (3, speech(rng, "en", 20) + " " + speech(rng, "xx", 40), 1.5), (4, None, 1.5), (5, "12 — !", 1.5), (6, "", 1.5)]
    got = {r["doc_id"]: r for r in identify(docs(spark, test, "doc_id long, text string, score double"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "xx", "xx", "und", "und", "und"]
    assert got[3]["langs"] == ["en", "xx"] and 0.5 < got[3]["score"] < 0.8 and got[1]["langs"] == ["en"] and got[4]["score"] == 0
    assert identify(docs(spark, test[:1], "doc_id long, text string, score double").limit(0), model).count() == 0
    assert [r["lang_pred"] for r in identify(docs(spark, [(1, "the")]), fit(docs(spark, [], "doc_id long, text string, lang string"))).collect()] == ["und"]


def test_language_sets_of_more_than_three():
    """Even mixtures of four and five languages: no language has a share of a third."""
    from codestrata.llm.language_id import BUCKETS, _grams, predict_slice

    words_of = ["the and with from", "der und nicht von", "les des pour dans", "los las para como", "och att inte som"]
    logp = []
    for text in words_of:
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.array([m.end() for m in re.finditer(r"\w+", text)])
        starts = np.array([m.start() for m in re.finditer(r"\w+", text)])
        counts = np.bincount(_grams(data, starts, ends)[0], minlength=BUCKETS) * 1000 + 0.5
        logp.append(np.log(counts / counts.sum()))
    texts = [" ".join(words_of[:k] * 20).encode() for k in (1, 4, 5)]
    share, _ = predict_slice(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array(logp, np.float32))
    assert [(v > 0.01).sum() for v in share] == [1, 4, 5] and share[0].max() > 0.99
    assert share[1].max() < 0.3 and share[2].max() < 0.25


def test_language_mixtures_against_plain_em():
    """Shares of language sets by loops over words: expectation maximisation, and the set of the best penalised likelihood."""
    import math

    from codestrata.llm import language_id as L

    rng = random.Random(18)
    vocabulary = [["the", "and", "with", "from"], ["der", "und", "nicht", "von"], ["les", "des", "pour", "dans"]]
    table = np.random.default_rng(18).normal(size=(3, L.BUCKETS)).astype(np.float32) - 9
    texts = [" ".join(rng.choice(rng.choice(vocabulary[: rng.randrange(1, 4)])) for _ in range(rng.randrange(1, 30))) for _ in range(40)]

    def gram_sum(word, k):
        data = np.frombuffer(word.encode(), np.uint8)
        return float(table[k][L._grams(data, np.array([0]), np.array([len(word)]))[0]].astype(np.float64).sum())

    def em(like, share, rounds):
        for _ in range(rounds):
            total = [0.0] * 3
            for w in like:
                z = sum(x * y for x, y in zip(share, w))
                total = [t + x * y / z for t, x, y in zip(total, share, w)]
            share = [t / len(like) for t in total]
        return share, sum(math.log(max(1e-30, sum(x * y for x, y in zip(share, w)))) for w in like)

    data = "\n".join(texts).encode()
    cuts = np.cumsum([0, *[len(t.encode()) + 1 for t in texts]])
    cuts[-1] -= 1
    for cells in (L.CELLS, 30):  # also a few texts at a time
        old, L.CELLS = L.CELLS, cells
        got, n = L.predict_slice(np.frombuffer(data, np.uint8), cuts, table)
        L.CELLS = old
        for t, own, count in zip(texts, got, n):
            ws = t.split()
            assert count == len(ws)
            like = []
            for w in ws:
                ll = [gram_sum(w, k) for k in range(3)]
                like.append([math.exp(x - max(ll)) for x in ll])
            share, _ = em(like, [1 / 3] * 3, L.ROUNDS)
            order = sorted(range(3), key=lambda k: (-share[k], k))
            best = (-math.inf, None)
            for m in (1, 2, 3):
                start = [share[k] + 1e-9 if k in order[:m] else 0.0 for k in range(3)]
                shares, fit = em(like, [x / sum(start) for x in start], 0 if m == 1 else 4)
                fit -= L.PENALTY * 0.5 * (m - 1) * math.log(max(2, len(ws)))
                best = max(best, (fit, shares), key=lambda x: x[0])
            assert np.allclose(own, best[1], atol=1e-3), t


def test_many_languages_and_ties(spark):
    """Eighty languages are all learned; under a model that can't tell two apart the first by name is named."""
    from codestrata.llm.language_id import fit, identify

    rng = random.Random(19)
    speak = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('xyz')}" for _ in range(12))
    rows = [(i, speak(i % 80), f"l{i % 80:02d}") for i in range(800)]
    model = fit(docs(spark, rows, "doc_id long, text string, lang string"))
    assert len(model[0]) == 80
    got = identify(docs(spark, [(k, speak(k), f"l{k:02d}") for k in range(80)], "doc_id long, text string, want string"), model).collect()
    assert np.mean([r["lang_pred"] == r["want"] for r in got]) > 0.95
    same = fit(docs(spark, [(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in identify(docs(spark, [(5, "abc abc")]), same).collect()] == ["a"]


# ---- decontamination


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[1:]


def test_myers():
    from codestrata.llm.decontamination import myers

    rng = random.Random(6)
    for _ in range(200):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 90))], [rng.randrange(4) for _ in range(rng.randrange(120))]
        assert myers(p, t) == distance(p, t)


def test_contaminated(spark):
    from codestrata.llm.decontamination import budget, contaminated, decontaminate

    rng = random.Random(7)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([3, 8, 20, 40, 80])] + [(5, None), (6, "")]
    rows = []
    for i in range(120):
        ws = words(rng, rng.randrange(5, 120))
        if i % 2:
            it = rng.choice(items[:5])[1].split()
            for _ in range(rng.randrange(0, budget(len(it)) + 3)):
                x = rng.randrange(len(it))
                it[x : x + 1] = rng.choice([[], ["new"], [it[x], "new"]])
                it = it or ["new"]
            at = rng.randrange(len(ws))
            ws[at:at] = it
        rows.append((i, ", ".join(ws).upper()))
    rows += [(500, None), (501, "")]
    want = {}
    for i, t in rows:
        for k, s in items:
            if s and t:
                d = min(distance(s.lower().split(), re.findall(r"\w+", t.lower())), default=99)
                if d <= budget(len(s.split())):
                    want[i, k] = d
    src = docs(spark, rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = docs(spark, items, "item_id long, text string")
    for block in (20_000, 2):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in contaminated(src, bench, block).collect()}
        assert got == want and want
    left = decontaminate(src, bench)
    assert left.columns == src.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate(src, bench.limit(0)).count() == len(rows) and contaminated(src.limit(0), bench).count() == 0


def spans_brute(items, texts):
    """(text, item): least distance, and the ends and beginnings of the first of the nearest parts."""
    from codestrata.llm.decontamination import budget

    out = {}
    for d, t in enumerate(texts):
        for k, s in items:
            p = s.split()
            scores = distance(p, t.split())
            if p and min(scores, default=99) <= budget(len(p)):
                least = min(scores)
                end = scores.index(least) + 1
                begin = max(b for b in range(end + 1) if ([len(p)] + distance(p[::-1], t.split()[b:end][::-1]))[-1] == least)
                out[d, k] = (least, begin, end)
    return out


def test_items_may_repeat(spark):
    from codestrata.llm.decontamination import contaminated

    item = "one two three four five six seven eight nine"
    bench = docs(spark, [(1, item), (1, item), (2, item), (None, item)], "item_id long, text string")
    rows = docs(spark, [(7, "two three four five six seven eight nine ten"), (None, f"x {item}")])
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["distance"]) for r in contaminated(rows, bench).collect())
    assert got == sorted([(d, i, k) for d, k in ((7, 1), (0, 0)) for i in (1, 1, 2, 0)])


def test_decontamination_of_few_words():
    """Two to five different words: windows meet, pieces hit everywhere, and rows stand in any order."""
    from codestrata.llm import kernel
    from codestrata.llm.decontamination import Items

    rng = random.Random(15)
    import pyarrow as pa

    for _ in range(60):
        vocabulary = [f"v{k}" for k in range(rng.randrange(2, 6))]
        say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        items = [(k, say(rng.choice([1, 3, 8, 12, 17, 25]))) for k in range(3)]
        texts = [say(rng.randrange(40)) for _ in range(6)]
        for k, s in items:
            ws = s.split()
            for _ in range(rng.randrange(4)):
                x = rng.randrange(len(ws))
                ws[x : x + 1] = rng.choice([[], [rng.choice(vocabulary)], [ws[x], rng.choice(vocabulary)]])
                ws = ws or ["v0"]
            texts.insert(rng.randrange(len(texts) + 1), " ".join([*texts[k].split()[: rng.randrange(5)], *ws]))
        for order in (texts, texts[::-1], [texts[-1]]):
            got = {}
            for _, _, data, bounds in kernel.slices(pa.array(order)):
                s, e, first = kernel.words(data, bounds, kernel.WORDY)
                got |= {(d, item): (least, a, b) for d, item, least, a, b in Items(items).find(kernel.hashes(data, s, e), first)}
            assert got == spans_brute(items, order)


# ---- neighbours


def test_nearest(spark):
    from codestrata.llm.ann import hilbert, nearest

    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    path = grid[np.argsort(hilbert(grid, 4))]
    assert len(set(map(tuple, path))) == 256 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)).round(1)
    x[100:130] = x[0]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(900, None, "z"), (920, [0.0] * 8, "z"), (940, [float("nan")] * 8, "z"), (960, [1.0, None] * 4, "z"), (None, [1.0] * 8, "z"), (980, [1.0], "z")]
    df = docs(spark, rows, "vec_id long, embedding array<double>, query_id string")
    exact = {q: [i for _, i in sorted((-(x[i] * x[q]).sum(), i) for i in range(600) if i != q)[:20]] for q in range(0, 600, 20)}
    got = {}
    for r in nearest(df, block=10_000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == exact  # one block: everything is compared
    found = {}
    for r in nearest(df, block=20, dims=3, curves=4).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & set(exact[q])) / 20 for q in exact]) >= 0.9
    assert nearest(df.limit(0)).count() == 0 and nearest(df.filter("vec_id in (0, 3)")).collect()[0]["vec_id"] == 3


def test_nearest_keeps_rows_of_one_id_apart(spark):
    from codestrata.llm.ann import nearest

    rows = [(20, [1.0, 2.0]), (20, [2.0, 1.0]), (5, [9.0, 9.0]), (5, [8.0, 8.0]), (6, [9.0, 9.0]), (40, [9.0, 9.0]), (7, [0.01, 0.06])]
    got = {}
    for r in nearest(docs(spark, rows, "vec_id long, embedding array<float>"), k=4).orderBy("query_id", "rank").collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], round(r["score"], 4)))
    assert [got[20, n] for n in (1, 2, 3, 4)] == [[(5, 27.0)] * 2, [(6, 27.0)] * 2, [(40, 27.0)] * 2, [(5, 24.0)] * 2]
    assert [got[40, n] for n in (1, 2, 3, 4)] == [[(5, 162.0)], [(6, 162.0)], [(5, 144.0)], [(20, 27.0)]]


def test_recall_with_production_parameters(spark):
    """20,000 vectors of random directions and as many in clusters, of which a third of all are one vector."""
    import pyarrow as pa

    from codestrata.llm import ann

    rng = np.random.default_rng(20)
    random_ones = rng.normal(size=(20_000, 64))
    middles = rng.normal(size=(200, 64))
    clusters = middles[rng.integers(0, 200, 20_000)] + 0.1 * rng.normal(size=(20_000, 64))
    clusters[rng.integers(0, 20_000, 7_000)] = middles[0]
    made, choose = [], ann._measure
    ann._measure = lambda *a: made.append(choose(*a)) or made[-1]
    try:
        for x in (random_ones, clusters):
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            got = {}
            df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), x.ravel())}))
            for r in ann.nearest(df).collect():
                got.setdefault(r["query_id"], set()).add(r["vec_id"])
            x = x.astype(np.float64)
            recall = []
            for q in range(0, 20_000, 400):
                s = (x * x[q]).sum(1)
                s[q] = -9
                recall.append(len(got[q] & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist())) / 20)
            assert np.mean(recall) >= 0.9 and len(got) == 1000
    finally:
        ann._measure = choose

    assert made[1][0] * made[1][1] < 2_000  # structure: small windows


# ---- toxicity


def test_toxicity(spark):
    from codestrata.llm.toxicity import fit, score

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        ws = [" ".join(words(rng, 8, 3000)).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(5)]
        toxic = i % 5 == 0
        if toxic:
            ws[2] += " " + rng.choice(["nasty", "vileone", "viletwo"])
        rows.append((i, ". ".join(ws)))
        labels.append((i, int(toxic), 1))
    src = docs(spark, rows)
    model = fit(src, docs(spark, [*labels[:1000], (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int"))
    got = {r["doc_id"]: r for r in score(src, model).collect()}
    right = [got[i]["predicted"] == t for i, t, _ in labels[1000:]]
    assert np.mean(right) > 0.97 and np.mean([got[i]["offending"] == [2] for i, t, _ in labels[1000:] if t and got[i]["predicted"]]) > 0.9
    edge = score(docs(spark, [(1, None), (2, ""), (3, "12 !"), (None, "nasty")]), model).collect()
    assert [r["score"] for r in edge[:3]] == [0, 0, 0] and 0 <= edge[3]["score"] <= 1
    assert score(src.limit(0), model).count() == 0
    assert score(src.limit(1), fit(src, docs(spark, [], "doc_id long, toxic int"))).first()["predicted"] == 0


def test_noisy_or_against_plain_derivatives():
    """The slope equals differences of a plainly written likelihood, and training lowers that."""
    import math

    from codestrata.llm.toxicity import START, slope, train

    rng = random.Random(21)
    for _ in range(20):
        n = rng.randrange(1, 6)
        sentences = [[[rng.randrange(n) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 4))] for _ in range(6)]
        y = np.array([float(any(0 in s for s in d)) for d in sentences])
        flat = [s for d in sentences for s in d]
        word = np.array([w for s in flat for w in s], np.int64)
        sentence = np.array([k for k, s in enumerate(flat) for _ in s], np.int64)
        at = np.cumsum([0, *map(len, sentences)])

        def loss(w, bias):
            total = 0.0
            for label, d in zip(y, sentences):  # noqa: B023
                clean = math.prod(1 - 1 / (1 + math.exp(-(bias + sum(w[x] for x in s)))) for s in d)
                total -= math.log(1 - clean if label else clean)
            return total / len(y)  # noqa: B023

        w, bias = np.array([rng.uniform(-1, 1) for _ in range(n)]), rng.uniform(-2, 0)
        gw, gb = slope(w, bias, y, word, sentence, at)
        for k in range(n):
            step = np.eye(n)[k] * 1e-6
            assert math.isclose(gw[k], (loss(w + step, bias) - loss(w - step, bias)) / 2e-6, abs_tol=1e-5)
        assert math.isclose(gb, (loss(w, bias + 1e-6) - loss(w, bias - 1e-6)) / 2e-6, abs_tol=1e-5)
        if 0 < y.mean() < 1:
            assert loss(*train(y, word, sentence, at, n)) < loss(np.zeros(n), START) / 2


def test_toxicity_of_repeated_rows(spark):
    """A document in many rows counts once, ties and sample bounds hold, and the model doesn't depend on the order of rows."""
    from codestrata.llm.toxicity import fit

    rows = [(i, f"calm words here. {'nastyone' if i % 3 == 0 else 'pleasant'} talk") for i in range(90)]
    labels = docs(spark, [(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    once, often = fit(docs(spark, rows), labels), fit(docs(spark, [*rows[::-1], *[rows[0]] * 50]).repartition(7), labels)
    assert once[1] == often[1] and (once[0] == often[0]).all() and once[0].any()
    small = fit(docs(spark, rows), labels, size=2_000)
    assert small[0].any() and (small[0] != once[0]).any()


# ---- html

PAGE = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a>Home</a></nav><div class="ad">Buy</div>{}<footer>f</footer></body></html>'


def test_blocks():
    from codestrata.llm.html_extraction import INSIDE, OUTSIDE, blocks

    got = blocks(PAGE.format("<article><header><h1>A &amp; B</h1></header><p><b>one\n  two<br><p>three</b></p><div class='comments'>c</div><ul><li>x<li>y</ul><form>q</form></article><aside>s</aside><p>z"))
    assert got == [("A & B", INSIDE), ("one two", INSIDE), ("three", INSIDE), ("x", INSIDE), ("y", INSIDE), ("z", OUTSIDE)]
    assert blocks("a<!-- b --> <i>c</i>d &lt;p&gt; <p hidden>e</p><p id=cookie-notice>n</p>") == [("a cd <p>", OUTSIDE)]
    named = "<article><p class='header'>a</p><p class='social-policy'>b</p><section id='legal'><h2 id='comments'>c</h2>d</section><div class='x ad'>no</div><div class='comment-list'>no</div></article>"
    assert [x for x, _ in blocks(named)] == ["a", "b", "c", "d"] and [x for x, _ in blocks(named, hints=False)] == ["a", "b", "c", "d", "no", "no"]
    assert blocks("<p>cut <a href='x") == [("cut", OUTSIDE)] and blocks("<script>x") == []


def test_shared():
    from codestrata.llm.html_extraction import shared

    rng = random.Random(10)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        got = sorted(shared(a, b))
        at = 0
        for i in got:
            at = b.index(a[i], at) + 1  # they are a subsequence of b
        assert len(got) == t[-1][-1]


def test_extract(spark):
    from codestrata.llm.html_extraction import extract

    plain = lambda s: f"<div><p>Site</p><p>Welcome</p><p>{s}</p><p>Imprint</p></div>"
    art = PAGE.format("<article><p>same</p></article>")
    rows = [(1, "http://h.org/a/1", plain("first")), (2, "https://h.org/a/2?x=1", plain("second")), (3, "http://h.org/a/3", plain("third")), (4, "http://g.org/1", art), (5, "http://g.org/2", art), (6, None, None), (7, "http://k.org/", ""), (4, "http://g.org/1", art)]
    src = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    for parts in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract(src).collect())
        assert got == [(1, "first", 5), (2, "second", 6), (3, "third", 5), (4, "same", 4), (4, "same", 4), (5, "same", 4), (6, "", 0), (7, "", 0)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert extract(src.limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_extract_copies_and_articles(spark, parts):
    from codestrata.llm.html_extraction import extract

    plain = lambda s: f"<div><p>Site</p><p>{s}</p><p>more {s}</p><p>Imprint</p></div>"
    art = lambda s: PAGE.format(f"<article><div>Notice</div><p>{s}</p><p>more {s}</p></article>")
    rows, want = [], []
    for host, page, copies in (("p.org", plain, 4), ("a.org", art, 4)):
        for k in range(6):
            for c in range(copies if k != 2 else 1):  # repeated rows, schemes, queries, fragments, other paths
                url = [f"http://{host}/{k}", f"https://{host}/{k}", f"http://{host}/{k}?utm_source=x#top", f"http://{host}/{k}/copy"][c]
                for _ in range(2):
                    rows.append((len(rows), url, page(f"{host} {k}")))
                    want.append(f"{host} {k}\nmore {host} {k}")
    # a line that all articles but one share is text
    for k in range(9):
        rows.append((len(rows), f"http://t.org/{k}", art(f"t {k}").replace("<div>Notice</div>", "<p>Refrain</p>" if k != 4 else "")))
        want.append(("" if k == 4 else "Refrain\n") + f"t {k}\nmore t {k}")
    # pages without an address are a host of their own, however often each is repeated
    for k in range(4):
        for _ in range(3):
            rows.append((len(rows), None, plain(f"nowhere {k}")))
            want.append(f"nowhere {k}\nmore nowhere {k}")
    # a near copy of an article, and the only two pages of a host
    rows += [(900, "http://n.org/1", PAGE.format("<article><p>a</p><p>b</p><p>c</p></article>")), (901, "http://n.org/2", PAGE.format("<article><p>a</p><p>b</p><p>d</p></article>"))]
    want += ["a\nb\nc", "a\nb\nd"]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = [r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


# ---- Jaccard join


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and top[a] != top[b]:
                x, y = top[a], top[b]
                top = [y if v == x else v for v in top]
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(top[k], []).append(i)
    return sorted((i is None, i or 0, len(sets[k]), min((x for x in ids[top[k]] if x is not None), default=None) or 0) for k, (i, _) in enumerate(rows))


def near_rows():
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([3, 8, 30, 120, 400]))
        for _ in range(rng.choice([1, 3, 25])):
            rows.append((len(rows) * 3 % 1000, rng.choice([" ", "\n\t"]).join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05])))))
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (None, "ONE"), (None, "alone"), (2003, "One")]


@pytest.mark.parametrize("hot, cell, rows_of_cell, long", [(1 << 17, 3_000_000, 10_000, 200_000), (0, 300, 10_000, 200_000), (1 << 17, 300, 5, 200_000), (0, 2_000, 4, 6)])
def test_jaccard(spark, hot, cell, rows_of_cell, long):
    from codestrata.llm.jaccard_join import jaccard_components

    rows = near_rows()
    random.Random(12).shuffle(rows)
    src = docs(spark, rows).withColumn("key", F.lit("clash"))
    got = jaccard_components(src, hot=hot, cell_shingles=cell, cell_rows=rows_of_cell, long=long).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == jaccard_brute(rows)


def test_near_across_widths(spark):
    """a and b have sketches of one width and c one of twice that; a~b and b~c, but c isn't near a."""
    import pyarrow as pa

    from codestrata.llm.jaccard_join import _near, _sketch, jaccard_components

    rng = random.Random(14)
    for size in (32, 64, 128, 256, 2048):
        base = np.array(rng.sample(range(1 << 62), 2 * size), np.uint64)
        cut = size // 6
        b = base[:size]
        sets = [b[cut:], b, base[: size + cut]]
        rows = {"pivot": [1] * 3, "one": [0] * 3, "two": [0] * 3, "asks": [True] * 3, "key": [1, 2, 3], "n": [len(s) for s in sets], "sketch": [_sketch(np.sort(s)) for s in sets]}
        assert len({len(x) for x in rows["sketch"]}) == 2
        assert sorted(k for out in _near([pa.RecordBatch.from_pydict(rows)]) for k in out.column("key").to_pylist()) == [1, 2, 3]
    rows = []
    for size in (36, 68, 132, 260):  # words: four more than shingles
        for _ in range(8):
            base = words(rng, size, 10**6)
            for _ in range(12):
                ws = edited(rng, base, rng.choice([0, 0, 0.5 / size, 1.5 / size]))
                at = rng.randrange(len(ws))
                ws[at:at] = words(rng, rng.choice([0, 0, 1, 2, size // 25]), 10**6)
                rows.append((len(rows), " ".join(ws)))
    got = jaccard_components(docs(spark, rows)).collect()
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_brute(rows)


def test_large_cells_are_joined_around_pivots(spark):
    """A chain of near copies, of which the ends aren't near, and unrelated texts around one long passage, in cells of many blocks."""
    from codestrata.llm.jaccard_join import jaccard_components

    rng = random.Random(22)
    rows = []
    for _ in range(2):
        base = words(rng, 90, 10**6)
        for _ in range(60):
            base = edited(rng, base, 0.01)
            rows.append((len(rows), " ".join(base)))
    passage = words(rng, 40, 10**6)
    for _ in range(60):
        rows.append((len(rows), " ".join([*words(rng, 20, 10**6), *passage])))
    rng.shuffle(rows)
    for options in ({}, {"cell_rows": 7, "cell_shingles": 500}, {"cell_rows": 7, "cell_shingles": 500, "hot": 0, "long": 20}):
        got = jaccard_components(docs(spark, rows), **options).collect()
        assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_brute(rows), options


def test_counts_in_bounded_memory():
    from codestrata.llm import jaccard_join as J

    old, J.COUNTED = J.COUNTED, 50
    counts = J._Counts()
    for k in range(40):
        counts.add(np.array([1, 2, 3] * 5 + list(range(1000 + 100 * k, 1100 + 100 * k)), np.uint64))
    J.COUNTED = old
    found = dict(zip(counts.token.tolist(), counts.count.tolist()))
    assert len(found) <= 100 and all(100 <= found[k] <= 200 for k in (1, 2, 3))


def test_keep_one(spark):
    from codestrata.llm.jaccard_join import jaccard_components, keep_one

    src = docs(spark, near_rows()).withColumn("group", F.lit(1))
    kept = keep_one(src)
    assert kept.columns == src.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    found = [r for r in jaccard_components(src).collect() if r["doc_id"] is not None]
    assert ids == sorted({r["component_id"] for r in found if r["n_shingles"]} | {r["doc_id"] for r in found if not r["n_shingles"]})
    assert keep_one(src.limit(0)).count() == 0 and jaccard_components(docs(spark, [])).count() == 0


# ---- pipeline


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as P

    for name, rows in (("none", []), ("blank", [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "123", None, "s", 3)])):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = P.run(spark, str(tmp_path / name))
        assert got.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(13)
    row = lambda i, t, lang="en": (i, t, lang, "s", len(t or ""))
    rows = [row(i, f"{speech(rng, 'en', 40)} u{i} " + " ".join(words(rng, 30, 10**6))) for i in range(30)] + [row(40, None), row(41, "123"), row(42, "")]
    rows += [row(50, rows[3][1]), row(51, "a\nb\nc and\nown line here with the words"), row(52, "x\na\nb\nc and")]
    item = " ".join(words(rng, 30, 10**6))
    rows.append(row(60, speech(rng, "en", 20) + " " + item))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in P.STAGES[:-1]:
        now = P.save(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == [c.split()[0] for c in DOCS.split(", ")]
        left.append({r["doc_id"]: r for r in now.collect()})
    everything = {r[0] for r in rows}
    assert set(left[0]) == everything - {40, 41, 42}
    assert left[1][52]["text"] == "x" and left[1][52]["n_chars"] == 1
    assert set(left[2]) == set(left[1]) - {50} and set(left[3]) == set(left[2]) - {60}
    got = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(left[3])

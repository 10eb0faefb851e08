"""HTML extraction by nearest-URL page differencing.

Each page is cut into blocks of text. Different pages of a host are sorted by path; each is compared with its neighbours, and the longest
common subsequence of their lines finds what they share: the site's template. Markup is evidence: lines outside of an article go if
two neighbours share them, lines in one only if all of them do.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import drop, save

#: Neighbours on either side; those with another article that must all share an article's line for it to go.
REACH, LEAST_AROUND = 4, 4
#: Rows at the ends of partitions that one task compares.
CHUNK = 256

# Elements of HTML by what they mean for the text, and names by which pages mark what isn't the article.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title select datalist textarea button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|paywall|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side-?bar|widget|footer|masthead|topbar|site-?header|page-?header|header|copyright|legal|"
    r"comments?|comment-?list|respond|disqus|replies|discussion|share|sharing|social|related|recommended|recirc|trending|login|signup|search)(?:$|[\s_-])"
)
# Names that mark what isn't the article even inside it.
MARKED_INSIDE = frozenset("ad ads advert adverts advertisement advertisements adsense adsbygoogle sponsored comments comment-list disqus cookie-notice cookie-banner newsletter-signup share-buttons social-share".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
OUTSIDE, INSIDE = 0, 1


def _marked(name: str, own: dict[str, str], zone: int) -> bool:
    """Whether class or id say that an element isn't the article's text. Outside of articles any part of a name counts; inside, where
    headings, paragraphs and sections have names of their own, only whole classes that can mean nothing else."""
    if zone == INSIDE:
        return name not in HEADINGS and not MARKED_INSIDE.isdisjoint(own.get("class", "").lower().split())
    if name in ("html", "body") or name in ARTICLE:
        return False
    marks = own.get("class", "") + (" " + own["id"] if name not in HEADINGS and "id" in own else "")
    return bool(marks) and MARKED.search(marks.lower()) is not None


def blocks(page: str, hints: bool = True) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with INSIDE if it stands in an article; parts that markup excludes are left out.

    Without ``hints`` only elements that hold no text are left out, and nothing stands in an article.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, excluded, zone
    excluded, zone, at = False, OUTSIDE, 0

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, zone))
            text.clear()

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not excluded:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE or stack[k][1] != excluded or stack[k][2] != zone:
                        flush()
                    excluded, zone = stack[k][1], stack[k][2]
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break  # a stray end tag
            continue
        if name not in INLINE:
            flush()
            while stack and name in ENDED_BY.get(stack[-1][0], ()):
                _, excluded, zone = stack.pop()
            if name != "br" and any(n in INLINE for n, _, _ in stack[-1:]) and name in ENDED_BY["p"]:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in INLINE:
                    k -= 1
                if k >= 0 and name in ENDED_BY.get(stack[k][0], ()):
                    _, excluded, zone = stack[k]
                    del stack[k:]
        if name in VOID:
            continue
        stack.append((name, excluded, zone))
        own = {x[1].lower(): (x[2] or x[3] or x[4] or "") for x in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        out_of_it = name in DROPPED or hints and (
            name in ASIDE or name == "header" and zone == OUTSIDE or "hidden" in own or own.get("aria-hidden", "").lower() == "true"
            or own.get("role", "").lower() in ROLES or _marked(name, own, zone)
        )
        if out_of_it and not excluded:
            flush()
            excluded = True
        if hints and (name in ARTICLE or own.get("role", "").lower() in ("main", "article")) and zone != INSIDE:
            flush()
            zone = INSIDE
        if name in RAW:
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            _, excluded, zone = stack.pop()
    if at < len(page) and not excluded:
        text.append(page[at:])
    flush()
    return out


def shared(a: list[int], b: list[int]) -> set[int]:
    """Indices in ``a`` of a longest common subsequence with ``b``: rows of the table as bits of integers, then traced back."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b or not set(a) & set(b):
        return found
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    mask = (1 << len(b)) - 1
    rows, v = [], mask
    for x in a:
        rows.append(v)
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & mask
    # a zero bit j of a row: the common length grows at b[j]
    j = len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        after = rows[i + 1] if i + 1 < len(a) else v
        while j >= 0 and after >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i] >> j & 1:  # this step came with line i
            found.add(head + i)
            j -= 1
    return found


def repeated(own: list[int], article: bool, around: list[list[int]]) -> list[int]:
    """Indices of a page's lines ``own`` that belong to the site, by the pages ``around`` it.

    Without an article: lines that two pages share, or the only one. In an article, where a line may be repeated and yet be its text:
    lines that all pages share, ``LEAST_AROUND`` at least. A page that shares more than half of an article's lines shows the same
    article, and has no say in it.
    """
    if not article:
        found = [shared(own, x) for x in around]
        least = min(2, len(found))
        return [k for k in range(len(own)) if least and sum(k in x for x in found) >= least]
    left, voices = set(range(len(own))), 0
    for page in around:
        if not left:
            return []
        both = shared(own, page)
        if 2 * len(both) <= len(own):
            left &= both
            voices += 1
    return sorted(left) if voices >= LEAST_AROUND else []


def _cut(hints: bool):
    """For each page the lines that may be its text (those in articles, if any), their hashes, a hash of all of them (null if there are
    none), whether it has an article, and then the hashes of all its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lines, own, key, article, hashes = [], [], [], [], []
                for page in part.column("html").to_pylist():
                    got = blocks(page, hints) if page else []
                    inside = [x for x, z in got if z == INSIDE]
                    lines.append(inside or [x for x, _ in got])
                    own.append([xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines[-1]])
                    key.append(xxhash.xxh64_intdigest(str(own[-1])) - (1 << 63) if got else None)
                    article.append(bool(inside))
                    hashes.append([xxhash.xxh64_intdigest(x) - (1 << 63) for x, _ in got] if len(inside) not in (0, len(got)) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(lines, pa.list_(pa.string())), pa.array(own, pa.list_(pa.int64())), pa.array(key, pa.int64()), pa.array(article, pa.bool_()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["page_id", "url", "lines", "own", "key", "article", "hashes"],
                )

    return run


def _decide(rows: Iterator[dict]) -> Iterator[tuple[dict, list[int]]]:
    """Each row, with the indices of its lines that go, as soon as ``REACH`` rows after it are known."""
    held: deque[dict] = deque()
    at = 0  # of the row in ``held`` that is decided next

    def decided(k: int) -> tuple[dict, list[int]]:
        row = held[k]
        # the nearest come first
        near = [held[j] for d in range(1, REACH + 1) for j in (k - d, k + d) if 0 <= j < len(held)]
        return row, repeated(row["own"], row["article"], [x["hashes"] or x["own"] for x in near if x["host"] == row["host"]])

    for row in rows:
        held.append(row)
        if len(held) > at + REACH:
            yield decided(at)
            at += 1
            if at > REACH:
                held.popleft()
                at -= 1
    while at < len(held):
        yield decided(at)
        at += 1


_ROW = "part int, at long, host string, key long, article boolean, own array<long>, hashes array<long>, gone array<int>"


def _rows(rows: list[dict]) -> pa.RecordBatch:
    names = ["part", "at", "host", "key", "article", "own", "hashes", "gone"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names)


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            yield from batch.slice(a, 500).to_pylist()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, gone) of sorted pages that lose lines. The first and the last 2 x ``REACH`` of each partition, which have neighbours
    beyond it or are such neighbours, are handed on whole, with their place."""
    from pyspark import TaskContext

    here = TaskContext.get().partitionId()
    last: deque[dict] = deque(maxlen=2 * REACH)
    n, out = 0, []

    def numbered() -> Iterator[dict]:
        nonlocal n
        for row in _dicts(batches):
            row |= {"part": here, "at": n}
            n += 1
            last.append(row)
            yield row

    for row, gone in _decide(numbered()):
        if row["at"] < 2 * REACH:
            out.append(row)
        if gone and REACH <= row["at"] and (n > row["at"] + REACH):
            out.append({"host": row["host"], "key": row["key"], "gone": gone})
        if len(out) >= 500:
            yield _rows(out)
            out = []
    yield _rows([*out, *[row for row in last if row["at"] >= 2 * REACH]])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, gone) of the rows with ``mine`` in groups of consecutive edge rows, which come sorted by (chunk, place)."""
    out = []
    for _, rows in groupby(_dicts(batches), key=lambda r: r["chunk"]):
        for row, gone in _decide(rows):
            if row["mine"] and gone:
                out.append({"host": row["host"], "key": row["key"], "gone": gone})
    yield _rows(out).select(["host", "key", "gone"])


def _beside(compared: DataFrame) -> DataFrame:
    """(host, key, gone) of the pages that have neighbours in other partitions, in chunks of edge rows that overlap."""
    edges = compared.filter("part is not null").drop("gone")
    # two numbers for each partition
    sizes = {r["part"]: (r["n"], r["last"]) for r in edges.groupBy("part").agg(F.count("*").alias("n"), F.max("at").alias("last")).collect()}
    first = dict(zip(sorted(sizes), accumulate((sizes[p][0] for p in sorted(sizes)), initial=0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, at = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            n, last = (np.array([sizes[p][k] for p in part.tolist()], np.int64) for k in (0, 1))
            # rows of the end follow those of the beginning; a neighbour lies across a gap only where the row isn't decided here
            nth = np.where(at < 2 * REACH, at, n - 1 - (last - at)) + np.array([first[p] for p in part.tolist()], np.int64)
            inner = (at >= REACH) & (last - at >= REACH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(~inner)], [*batch.schema.names, "nth", "open"])

    placed = edges.mapInArrow(place, _ROW.removesuffix(", gone array<int>") + ", nth long, open boolean")
    own = F.floor(F.col("nth") / CHUNK)
    near = F.array_distinct(F.array(own, F.floor((F.col("nth") - 2 * REACH) / CHUNK), F.floor((F.col("nth") + 2 * REACH) / CHUNK)))
    chunked = placed.withColumn("chunk", F.explode(near)).withColumn("mine", F.col("open") & (F.col("chunk") == own))
    return chunked.repartition("chunk").sortWithinPartitions("chunk", "nth").mapInArrow(_edges, "host string, key long, gone array<int>")


def extract(pages: DataFrame, hints: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page of ``pages`` (page_id, url, html).

    Blocks are joined by ``\\n``; white space within one is one space; a line break ends a block. Lines of a page are its blocks outside
    of navigation, footers, asides, forms, scripts, styles, notices, adverts and comments, as element names, roles, classes and ids
    tell, and only those in article elements if it has any; inside those only a few classes tell, see ``_marked``. ``hints`` false
    looks at no such mark. Pages of a host with the same lines are one page, which stands at the first of their addresses; its
    neighbours are the ``REACH`` pages before and after it by (path, url, page_id) on the host. Lines of a page without an article go if
    two neighbours share them, or the only one; an article's lines if all do, ``LEAST_AROUND`` at least, where one that shares more
    than half of them is no neighbour. A page alone on its host keeps all. Null or empty html gives an empty text; null urls are a
    host of their own. Repeated rows are pages each. Other columns play no part.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    cut = src.mapInArrow(_cut(hints), "page_id long, url string, lines array<string>, own array<long>, key long, article boolean, hashes array<long>")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(url, "^//([^/?#]*)", 1))
    path = F.regexp_extract(url, "^(?://[^/?#]*)?([^?#]*)", 1)
    stored = save(cut.withColumns({"host": host, "path": path}), "pages")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "url", "page_id", "key"]
    # hashes alone are sorted; lines stay where they are
    first = stored.filter("key is not null").groupBy("host", "key").agg(F.min(F.struct("path", "url", "page_id", "article", "own", "hashes")).alias("first"))
    sorted_pages = first.select("host", "key", "first.*").repartitionByRange(n, *order).sortWithinPartitions(*order)
    compared = save(sorted_pages.mapInArrow(_compared, _ROW), "compared")
    # written, so that Spark knows its size and chooses the join by it
    gone = save(compared.filter("part is null").select("host", "key", "gone").unionByName(_beside(compared)), "gone")
    drop(compared)
    left = F.filter("lines", lambda _, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
    both = stored.select("page_id", "url", "host", "key", "lines").join(gone, ["host", "key"], "left").select("page_id", "url", F.array_join(left, "\n").alias("text"))
    return both.withColumn("n_chars", F.length("text").cast("long"))

"""Line dedup: windows of three consecutive lines that occurred before are removed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import text_key

WINDOW = 3


def _hashed(lines: Column) -> Column:
    """128 bits for each line, and whether it is blank (spaces at most)."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), (F.trim(x) == "").alias("blank")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of repeated windows: its columns, with text cut, and n_lines and n_removed (both long).

    Lines end at ``\\n``. Every three consecutive lines are a window, unless all three are blank. Windows are ordered by
    doc_id (null last), hash of the text and position; each but the first of its kind, over all documents and within one,
    covers its lines, and covered lines go. What goes therefore stays at its first place. Documents of fewer than three
    lines have no window. A null text stays null with no lines; an empty text is one empty line; a text all of whose lines go
    becomes empty. Rows equal in doc_id and text are one document: they are treated alike. Other columns pass through, but
    for ones named n_lines or n_removed, which are replaced.
    """
    plain = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # columns go by number until the end, so that none clashes with a name used here
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(plain)], F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__th"))
    text = F.col(f"c{plain.index('text')}")
    lines = src.select("__id", "__th", F.split(text, "\n", -1).alias("lines")).filter(F.size("lines") >= WINDOW)
    hashed = lines.select("__id", "__th", _hashed(F.col("lines")).alias("h"), (F.size("lines") - (WINDOW - 1)).alias("n"))
    zipped = F.arrays_zip(*[F.slice("h", k + 1, F.col("n")).alias(f"l{k}") for k in range(WINDOW)])
    each = hashed.select("__id", "__th", F.posexplode(zipped).alias("pos", "w"))
    part = lambda f: [F.col(f"w.l{k}.{f}") for k in range(WINDOW)]
    at = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("pos").alias("pos"))
    windows = each.filter(~(part("blank")[0] & part("blank")[1] & part("blank")[2])).select(
        F.xxhash64(*part("a")).alias("a"), F.xxhash64(*part("b")).alias("b"), at.alias("at")
    )
    firsts = windows.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first <> last").select("a", "b", "first")
    later = windows.join(firsts, ["a", "b"]).filter("at > first").select("at.id", "at.th", "at.pos")
    covered = later.groupBy(F.col("id").alias("__covered_id"), F.col("th").alias("__covered_th")).agg(F.sort_array(F.collect_set("pos")).alias("__starts"))
    both = src.join(covered, F.col("__id").eqNullSafe(F.col("__covered_id")) & (F.col("__th") == F.col("__covered_th")), "left")
    far = lambda x, y: (y - x) > WINDOW
    s = F.col("__starts")
    begins = F.filter(s, lambda x, i: (i == 0) | far(F.get(s, i - 1), x))
    ends = F.transform(F.filter(s, lambda x, i: (i == F.size(s) - 1) | far(x, F.get(s, i + 1))), lambda x: x + WINDOW)
    cut = both.withColumn("__lines", F.split(text, "\n", -1)).withColumn("__begins", begins).withColumn("__ends", ends)
    cut = cut.withColumn("__from", F.concat(F.array(F.lit(0)), F.col("__ends"))).withColumn("__to", F.concat(F.col("__begins"), F.array(F.size("__lines"))))
    gaps = F.arrays_zip("__from", "__to")
    cut = cut.withColumn("__gaps", gaps)
    kept = F.flatten(F.transform("__gaps", lambda g: F.slice(F.col("__lines"), g["__from"] + 1, g["__to"] - g["__from"])))
    cut = cut.withColumn("__kept", F.when(s.isNotNull(), kept))
    out = {c: F.col(f"c{n}") for n, c in enumerate(plain)} | {"text": F.when(s.isNull(), text).otherwise(F.array_join("__kept", "\n"))}
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long")
    removed = F.when(s.isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size("__kept")).cast("long")
    return cut.select(*[out[c].alias(c) for c in plain], n.alias("n_lines"), removed.alias("n_removed"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS k FROM p
      WHERE trim(l[pos + 1]) <> '' OR trim(l[pos + 2]) <> '' OR trim(l[pos + 3]) <> ''),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM o WHERE nth > 1),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text
                      ELSE array_to_string([l[i + 1] FOR i IN range(0, len(l)) IF NOT list_contains(gone, i)], chr(10)) END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN g USING (doc_id)
"""

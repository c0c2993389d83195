"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Lines end at "\\n". A window is three consecutive lines of which at least one isn't blank. Of equal windows anywhere, the first by id and
position stays; the lines that any later one covers go, and what is covered by overlapping windows merges. Every removed line so has
an equal one that stays. Texts of fewer than three lines have no window and stay whole; they are not shuffled.

Null texts stay null; null ids come after the others. Repeated rows (equal id and text) are one document and get the same result.
Windows are told apart by 128 bits of hash. A very long text is one row with arrays of its lines and flags. The occurrences of the most frequent
windows are not brought together: their first place is broadcast (`spread_join`). Extra columns, whatever their names, are ignored by
`line_windows_removed` and kept by `without_repeats`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import spread_join, whole


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), k1 and k2 (hashes of id and text)."""
    return docs.select(whole(docs), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))


def _text() -> Column:
    return F.col("row").getField("text")


def _windows(docs: DataFrame) -> DataFrame:
    """One row for each window: its hash and its place."""
    keyed = _keyed(docs.select("doc_id", "text")).select("k1", "k2", F.col("row").getField("doc_id").alias("id"), _lines(_text()).alias("lines")).filter(F.size("lines") >= 3).select(
        "k1", "k2", "id", F.col("lines").alias("x"), F.slice("lines", 2, F.size("lines")).alias("y"), F.slice("lines", 3, F.size("lines")).alias("z")
    )
    each = keyed.select("k1", "k2", "id", F.posexplode(F.arrays_zip("x", "y", "z")).alias("pos", "w")).filter(F.col("w.z").isNotNull())
    each = each.filter(F.col("w.x").rlike(r"\S") | F.col("w.y").rlike(r"\S") | F.col("w.z").rlike(r"\S"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2", "pos")
    return each.select(F.xxhash64("w.x", "w.y", "w.z").alias("h1"), F.xxhash64("w.z", "w.x", "w.y", F.lit(1)).alias("h2"), place.alias("place"))


def _flags(docs: DataFrame) -> DataFrame:
    """f1, f2 (hashes of id and text) of each document that loses lines, and flags: an array that is true where a later window begins."""
    windows = _windows(docs)
    first, other = F.min("place").alias("first"), F.max("place").alias("other")
    repeated = windows.groupBy("h1", "h2").agg(first, other, F.count("*").alias("n")).filter("first <> other").drop("other")
    later = spread_join(windows, repeated, ["h1", "h2"], "n").filter("place <> first")
    starts = later.groupBy(F.col("place.k1").alias("f1"), F.col("place.k2").alias("f2")).agg(F.sort_array(F.collect_set("place.pos")).alias("starts"))
    gaps = F.transform("starts", lambda p, i: F.concat(F.array_repeat(F.lit(False), (p - F.coalesce(F.get("starts", i - 1), F.lit(-1)) - 1).cast("int")), F.array(F.lit(True))))
    return starts.select("f1", "f2", F.flatten(gaps).alias("flags"))


def _cut(docs: DataFrame) -> DataFrame:
    """row, id, text, lines, and kept: the lines that stay, null where all do. A text meets its flags as it is and becomes lines after that: it is
    shuffled and sorted once, not a second time as lines and, in a row, a third time."""
    keyed = _keyed(docs)
    few = (F.size(_lines(_text())) < 3) | _text().isNull()
    met = keyed.filter(~few).join(_flags(docs), (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left").select("row", "flags")
    parts = ("row", F.col("row").getField("doc_id").alias("id"), _text().alias("text"), _lines(_text()).alias("lines"))
    covered = lambda i: F.coalesce(F.get("flags", i), F.lit(False)) | F.coalesce(F.get("flags", i - 1), F.lit(False)) | F.coalesce(F.get("flags", i - 2), F.lit(False))
    kept = F.when(F.col("flags").isNotNull(), F.filter("lines", lambda x, i: ~covered(i)))
    out = ("row", "id", "text", "lines")
    return met.select(*parts, "flags").select(*out, kept.alias("kept")).unionByName(keyed.filter(few).select(*parts, F.lit(None).cast("array<string>").alias("kept")))


def line_windows_removed(docs: DataFrame) -> DataFrame:
    """doc_id, text without the removed lines, n_lines (of the whole text) and n_removed."""
    cut = _cut(docs.select("doc_id", "text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return cut.select(F.col("id").alias("doc_id"), text.alias("text"), n.cast("int").alias("n_lines"), F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept")).cast("int").alias("n_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the later windows' lines removed from text, and n_chars counted anew; a row of which no line is left goes."""
    cut = _cut(docs).filter(F.col("kept").isNull() | (F.size("kept") > 0))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        was = F.col("row").getField("n_chars")
        changed["n_chars"] = F.when(F.col("kept").isNull(), was).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM l),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM w WHERE c IS NOT NULL AND regexp_matches(a || b || c, '\S')),
r AS (SELECT DISTINCT doc_id, pos + k AS pos, true AS gone FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS k FROM o WHERE rn > 1)),
k AS (SELECT l.doc_id, string_agg(CASE WHEN r.gone IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept, count(*) AS n_lines, count(r.gone) AS n_removed
      FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.pos = r.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

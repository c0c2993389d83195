"""Splitters by separators as column expressions: a text becomes an array of pieces without a Python worker.

Both rules go from the coarsest separator to the finest and fold over the parts of a text that one separator leaves. The state of a fold is numbers (which
parts are held, and how many characters), so no text is copied until a piece is cut out.

* `filled_pieces`: parts are joined, with their separator, up to a size; what lies before a piece is put in front of it.
* `sliding_pieces`: a part keeps the separator that it begins with; pieces take whole parts up to a size, and a next piece begins with as many of the last
  parts as the overlap has room for. Pieces lose white space at their ends, blank ones go.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import strip

COARSE = ("\n\n", "\n", " ", "")
SENTENCES = ("\n\n", "\n", ". ", " ", "")
TEXTS = "array<string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also inside of other functions over arrays."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(text: Column, separator: str) -> Column:
    return F.split(text, re.escape(separator), -1)


def _held(out: Column, first: Column, count: Column) -> Column:
    """The pieces so far, and one more of `count` parts from `first` on, if there are any."""
    return F.concat(out, F.when(count > 0, F.array(F.struct(first.alias("first"), count.alias("count")))).otherwise(F.array().cast("array<struct<first:int,count:int>>")))


def _state(**of: Column) -> Column:
    return F.struct(*[c.cast("array<struct<first:int,count:int>>" if n == "out" else "array<int>" if n == "sizes" else "int").alias(n) for n, c in of.items()])


def _filled(text: Column, separator: str, size: int) -> Column:
    zero, wide = F.lit(0), len(separator)

    def step(s: Column, n: Column) -> Column:
        fresh = s["chars"] == 0  # nothing is held but empty parts, which go
        whole = F.when(fresh, n).otherwise(s["chars"] + wide + n)
        fits, long = whole <= size, n > size
        out = F.when(fits, s["out"]).otherwise(_held(_held(s["out"], s["first"], F.when(fresh, 0).otherwise(s["count"])), s["at"], long.cast("int")))
        again = fresh | ~fits
        return _state(out=out, first=F.when(again, s["at"]).otherwise(s["first"]), count=F.when(again, 1).otherwise(s["count"] + 1), chars=F.when(fits, whole).when(long, 0).otherwise(n), at=s["at"] + 1)

    def cut(parts: Column) -> Column:
        start = _state(out=F.array(), first=zero, count=zero, chars=zero, at=zero)
        pieces = F.aggregate(F.transform(parts, F.length), start, step, lambda s: _held(s["out"], s["first"], F.when(s["chars"] > 0, s["count"]).otherwise(0)))
        return F.transform(pieces, lambda p: F.array_join(F.slice(parts, p["first"] + 1, p["count"]), separator))

    return let(_parts(text, separator), cut)


def filled_pieces(text: Column, size: int = 800, overlap: int = 120, separators: tuple[str, ...] = COARSE) -> Column:
    """Pieces of at most `size` characters; each but the first after up to `overlap` characters of what comes before it. A part that no separator cuts is cut by length.
    Null and blank texts have no piece."""
    pieces = F.when(F.length(text) > size, F.array(text)).when(F.length(strip(text)) > 0, F.array(text)).otherwise(F.array().cast(TEXTS))
    by_length = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(size)), lambda i: F.substr(p, i + 1, F.lit(size)))
    for separator in separators:
        cut = partial(_filled, separator=separator, size=size) if separator else by_length
        pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p))))  # noqa: B023
    if overlap <= 0:
        return pieces

    def carried(made: Column) -> Column:
        def before(i: Column) -> Column:
            last = F.element_at(made, i)  # the piece before the (i + 1)th
            more = F.array_join(F.slice(made, F.greatest(i - overlap + 1, F.lit(1)), F.least(i, F.lit(overlap))), "")  # pieces have a character at least
            return F.right(F.when(F.length(last) >= overlap, last).otherwise(more), F.lit(overlap))

        return F.transform(made, lambda p, i: F.when(i == 0, p).otherwise(F.concat(before(F.greatest(i, F.lit(1))), p)))

    return let(pieces, carried)


def _slid(text: Column, separator: str, size: int, overlap: int) -> Column:
    """Pieces of one separator; parts of `size` or more stand alone, unchanged."""
    zero = F.lit(0)

    def step(s: Column, n: Column) -> Column:
        long, full = n >= size, s["chars"] + n > size
        room = F.least(F.lit(overlap), F.lit(size) - n)
        # The first of the held parts go until the rest has room beside the new one.
        drop = F.aggregate(s["sizes"], F.struct(s["chars"].alias("chars"), F.lit(0).alias("n")), lambda a, x: F.when(a["chars"] > room, F.struct((a["chars"] - x).alias("chars"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
        count = F.size(s["sizes"])

        def gone(k: Column) -> Column:
            kept = F.when(long, F.array().cast("array<int>")).otherwise(F.concat(F.slice(s["sizes"], k + 1, F.greatest(count - k, zero)), F.array(n)))
            out = F.when(long | full, _held(s["out"], s["at"] - count, count)).otherwise(s["out"])
            return _state(out=F.when(long, _held(out, s["at"], F.lit(1))).otherwise(out), sizes=kept, chars=F.aggregate(kept, F.lit(0), lambda a, x: a + x), at=s["at"] + 1)

        return let(F.when(full & ~long, drop).otherwise(0), gone)

    def cut(parts: Column) -> Column:
        start = _state(out=F.array(), sizes=F.array(), chars=zero, at=zero)
        pieces = F.aggregate(F.transform(parts, F.length), start, step, lambda s: _held(s["out"], s["at"] - F.size(s["sizes"]), F.size(s["sizes"])))
        return F.transform(pieces, lambda p: F.array_join(F.slice(parts, p["first"] + 1, p["count"]), ""))

    begun = F.transform(_parts(text, separator), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p)))
    return let(F.filter(begun, lambda p: p != ""), cut)


def sliding_pieces(text: Column, size: int = 1200, overlap: int = 200, separators: tuple[str, ...] = SENTENCES) -> Column:
    """Pieces of at most `size` characters, cut before the coarsest separator that a text has; parts that are still too long by the next one that they have, and by length in the end. Null and
    blank texts have no piece. overlap is smaller than size."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the size")
    # Beside a piece, whether it is to be cut further.
    mark = lambda pieces: F.transform(pieces, lambda p: F.struct(p.alias("text"), (F.length(p) >= size).alias("long")))
    made = F.array(F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.length(text) > size, F.lit(False)).alias("long")))
    def windows(text: Column) -> Column:
        last = F.greatest(F.ceil((F.length(text) - overlap) / (size - overlap)).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.substr(text, i * (size - overlap) + 1, F.lit(size)).alias("text"), F.lit(False).alias("long")))

    def finer(p: Column, separator: str) -> Column:
        if not separator:
            return F.when(p["long"], windows(p["text"])).otherwise(F.array(p))
        return F.when(p["long"] & F.contains(p["text"], F.lit(separator)), mark(_slid(p["text"], separator, size, overlap))).otherwise(F.array(p))

    for separator in separators:
        made = F.flatten(F.transform(made, lambda p: finer(p, separator)))  # noqa: B023
    return F.filter(F.transform(made, lambda p: strip(p["text"])), lambda p: p != "")


def pieces_of(docs: DataFrame, pieces: Column) -> DataFrame:
    """chunk_id, doc_id, order, text of docs(doc_id, text), by an expression of one of the splitters."""
    rows = docs.select("doc_id", F.posexplode(pieces).alias("order", "text"))
    return rows.select(F.format_string("%s::%04d", F.col("doc_id").cast("string"), "order").alias("chunk_id"), "doc_id", "order", "text")

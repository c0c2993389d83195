"""Evidence found again in documents: seeds of a few characters, joined on equality and chained along diagonals.

A seed is the run of `WIDTH` characters at a place (fewer, if shorter runs count), kept exactly in two numbers, so equal seeds are equal text. Where seeds of evidence and document
agree at the same distance of places (a diagonal) one after the other, they chain to a common run; the longest chain of a pair is its longest common run, in
lengths from the seed's width up. Which documents can hold a run is told by the evidence's rarest seeds: a run of w characters holds the rarest seed of one of the
windows of w characters, so these seeds find all documents with such a run, however frequent the other seeds are.

Documents are read by tasks that know, in a bit field of fixed size, which seeds are asked for, and give these alone; nothing is broadcast but that field. All joins
are on equality.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.cleaning import strip
from ..sources.tables import saved

WIDTH = 6
#: Bits of the field that tells which seeds are asked for: two million bytes, whatever the evidence.
FIELD = 24
#: So many seeds of some texts are held at once.
MOST = 1 << 17
#: So many characters on either side of a seed go with it where a longer piece is asked for.
AROUND = 16
#: Page numbers and rules, which match nothing. Fixed value.
NOISE = re.compile(r"\(?\s*\d+\s*쪽\s*\)?|-\s*\d+\s*-|\bp\.?\s*\d+\b|[-_=|]{4,}", re.IGNORECASE)
BLANK = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
DIGITS = np.array([c for c in range(0x110000) if chr(c).isdecimal()], np.uint32)


def kinds_of_noise() -> np.ndarray:
    """For each character 0 if no match of NOISE has it, 2 if each match has one of its kind (digits and rules), else 1."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[BLANK] = 1
    kinds[[ord(c) for c in "()쪽pP."]] = 1
    kinds[DIGITS] = 2
    kinds[[ord(c) for c in "-_=|"]] = 2
    return kinds


def noise_in(text: str, code: np.ndarray, noise: re.Pattern, kinds: np.ndarray) -> list[tuple[int, int]]:
    """The spans of noise in a text. Those of NOISE are searched only in stretches of its characters that have a digit or a rule: a match lies within one."""
    if noise != NOISE:
        return [m.span() for m in noise.finditer(text)]
    kind = kinds[code]
    telling = np.flatnonzero(kind == 2)
    if not len(telling):
        return []
    ends = np.concatenate([[-1], np.flatnonzero(kind == 0), [len(code)]])
    after = np.unique(np.searchsorted(ends, telling))
    begin, end = ends[after - 1] + 1, ends[after]
    long = end - begin > 1
    # One character more, which is in no match, tells where a word ends.
    return [m.span() for s, e in zip(begin[long].tolist(), end[long].tolist()) for m in noise.finditer(text, s, e + 1)]


def seeds_of(text: str, width: int, noise: re.Pattern | None, flat: bool, bits: np.ndarray | None = None, kinds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(a, b, place, first, last) of the seeds of a text: the characters in two numbers, the place (white space not counted if flat), and the places in the
    text of the first and last character. Seeds that touch noise are left out, and those that the bit field lacks if one is given."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(~np.isin(code, BLANK)) if flat else None
    c = (code if at is None else code[at]).astype(np.int64)
    n = len(c) - width + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    if width == 6:
        three = c[:-2] << 42
        three |= c[1:-1] << 21
        three |= c[2:]
        a, b = three[:n], three[3:]
    else:
        a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(width):
            x = a if k < 3 else b
            x <<= 21
            x |= c[k : k + n]
    place = np.arange(n) if bits is None else np.flatnonzero(bits[_bucket(a, b)])
    spoilt = noise_in(text, code, noise, kinds_of_noise() if kinds is None else kinds) if noise and len(place) else []
    if spoilt:
        edges = np.zeros(len(code) + 1, np.int64)
        for s, e in spoilt:
            edges[s] += 1
            edges[e] -= 1
        masked = np.cumsum(edges[:-1]) if at is None else np.cumsum(edges[:-1])[at]
        before = np.concatenate([[0], np.cumsum(masked)])
        place = place[before[place + width] == before[place]]
    first, last = (place, place + width - 1) if at is None else (at[place], at[place + width - 1])
    return a[place], b[place], place, first, last


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x += b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x >>= np.uint64(64 - FIELD)
    return x.view(np.int64)


def seeds(rows: DataFrame, keys: list[str], text: str, width: int = WIDTH, noise: re.Pattern | None = None, flat: bool = False, asked: np.ndarray | None = None, once: bool = False, around: bool = False) -> DataFrame:
    """The keys with a, b, place, first, last for each seed of a text column; only those that the bit field has, if one is given. once: each seed of a text
    one time, at its first place. around: also the texts left and right of it, of at most AROUND characters."""
    small_batches()
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", a long, b long, place long, first long, last long" + ", left string, right string" * around

    names = [*keys, "a", "b", "place", "first", "last", *["left", "right"] * around]

    def made(batch: pa.RecordBatch, held: list, of: list, pieces: list[tuple[str, str]]) -> pa.RecordBatch:
        at = pa.array(np.concatenate(of))
        columns = [*(batch.column(k).take(at) for k in range(len(keys))), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*held))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.string()) for x in zip(*pieces))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, kinds = np.unpackbits(asked).view(bool) if asked is not None else None, kinds_of_noise()
        for batch in batches:
            held, of, pieces, size = [], [], [], 0
            for row in range(batch.num_rows):
                value = batch.column(len(keys))[row].as_py()
                found = seeds_of(value, width, noise, flat, bits, kinds) if value else ()
                if len(found) and once:
                    order = np.lexsort((found[2], found[1], found[0]))
                    a, b = found[0][order], found[1][order]
                    order = order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(order)]]
                    found = tuple(x[order] for x in found)
                # A text's seeds go in parts too, so what is held is bounded however long the text is.
                for low in range(0, len(found[0]) if len(found) else 0, MOST):
                    part = tuple(x[low : low + MOST] for x in found)
                    if around:
                        pieces += [(value[max(s - AROUND, 0) : s], value[e + 1 : e + 1 + AROUND]) for s, e in zip(part[3].tolist(), part[4].tolist())]
                    held.append(part)
                    of.append(np.full(len(part[0]), row))
                    size += len(part[0])
                    if size >= MOST:
                        yield made(batch, held, of, pieces)
                        held, of, pieces, size = [], [], [], 0
            if held:
                yield made(batch, held, of, pieces)

    return rows.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def field_of(wanted: DataFrame) -> np.ndarray | None:
    """The bit field of seeds (a, b), made of the distinct places of the field that they have (2 ** FIELD at most); None of no seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bucket(batch.column("a").to_numpy(), batch.column("b").to_numpy())))], names=["bucket"])

    found = wanted.select("a", "b").mapInArrow(run, "bucket long").distinct().toArrow().column("bucket").to_numpy()
    if not len(found):
        return None
    bits = np.zeros(1 << FIELD, bool)
    bits[found] = True
    return np.packbits(bits)


def runs(candidates: DataFrame, evidence: DataFrame, docs: DataFrame, width: int = WIDTH, noise: re.Pattern | None = None, flat: bool = False, least: int = WIDTH) -> DataFrame:
    """item_id, doc_id, e_place, place, length, first, last: the common runs of `least` characters or more that nothing extends, of candidates(item_id, doc_id) of
    evidence(item_id, evidence) and docs(doc_id, text). first and last are the run's ends in the document's text. No pair comes twice."""
    candidates = saved(candidates.select("item_id", "doc_id"), "candidates")  # read four times, and made by a pass over all documents
    asked = evidence.join(candidates, "item_id", "left_semi")
    theirs = seeds(asked, ["item_id"], "evidence", width, noise, flat).select("item_id", "a", "b", F.col("place").alias("e_place"))
    field = field_of(theirs)
    if field is None:
        return candidates.sparkSession.createDataFrame([], f"item_id {evidence.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, e_place long, place long, length long, first long, last long")
    held = docs.join(candidates, "doc_id", "left_semi")
    own = seeds(held, ["doc_id"], "text", width, noise, flat, field)
    met = candidates.join(theirs, "item_id").join(own, ["doc_id", "a", "b"]).withColumn("diagonal", F.col("place") - F.col("e_place"))
    along = Window.partitionBy("item_id", "doc_id", "diagonal").orderBy("e_place")
    chained = met.withColumn("chain", F.col("e_place") - F.row_number().over(along)).groupBy("item_id", "doc_id", "diagonal", "chain")
    found = chained.agg(F.min("e_place").alias("e_place"), F.min("place").alias("place"), (F.count("*") + width - 1).alias("length"), F.min("first").alias("first"), F.max("last").alias("last"))
    return found.filter(F.col("length") >= least).select("item_id", "doc_id", "e_place", "place", "length", "first", "last")


def longest(candidates: DataFrame, evidence: DataFrame, docs: DataFrame, least: int = WIDTH, noise: re.Pattern | None = NOISE) -> DataFrame:
    """item_id, doc_id, run: of each candidate the longest common run of `least` characters or more, without white space around it; of several the first in the
    evidence, then in the document. No row where there is none, or white space alone."""
    found = runs(candidates, evidence, docs, min(least, WIDTH), noise, False, least)
    best = found.groupBy("item_id", "doc_id").agg(F.min(F.struct((-F.col("length")).alias("size"), "e_place", "place")).alias("best"))
    run = strip(F.substring("evidence", F.col("best.e_place").cast("int") + 1, -F.col("best.size").cast("int")))
    return best.join(evidence.select("item_id", "evidence"), "item_id").select("item_id", "doc_id", run.alias("run")).filter("run <> ''")


def frequencies(asked: DataFrame, docs: DataFrame, width: int, noise: re.Pattern | None = None) -> DataFrame:
    """a, b, n, some_doc: in how many documents each seed of asked(a, b) is, and the smallest of their ids. Seeds in none have no row."""
    field = field_of(asked)
    if field is None:
        return docs.sparkSession.createDataFrame([], f"a long, b long, n long, some_doc {docs.schema['doc_id'].dataType.simpleString()}")
    small_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, kinds = np.unpackbits(field).view(bool), kinds_of_noise()
        # Counts of a task are added up as long as they are few, else sent as they are.
        parts, rows = [], 0
        for batch in batches:
            # Documents by their rank in the batch, so that the least rank is the smallest id.
            order = pc.sort_indices(batch.column(0))
            held, of, size = [], [], 0
            for rank, row in enumerate(order.to_pylist()):
                value = batch.column(1)[row].as_py()
                if value:
                    a, b, *_ = seeds_of(value, width, noise, False, bits, kinds)
                    held.append((a, b))
                    of.append(np.full(len(a), rank))
                    size += len(a)
                if size >= MOST or size and rank == batch.num_rows - 1:
                    parts.append(counts(batch, order, *(np.concatenate(x) for x in zip(*held)), np.concatenate(of)))
                    rows += parts[-1].num_rows
                    held, of, size = [], [], 0
                if rows >= 2 * MOST:
                    parts = [added(parts)]
                    rows = parts[0].num_rows
                    if rows > MOST:
                        yield from parts[0].to_batches()
                        parts, rows = [], 0
        if parts:
            yield from added(parts).to_batches()

    def counts(batch: pa.RecordBatch, order: pa.Array, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> pa.Table:
        by = np.lexsort((b, a))  # stable: ranks rise within a seed
        a, b, rank = a[by], b[by], rank[by]
        seed = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        text = seed | np.concatenate([[True], rank[1:] != rank[:-1]])
        at = np.flatnonzero(seed)
        some = batch.column(0).take(order.take(pa.array(rank[at])))
        return pa.table([a[at], b[at], np.add.reduceat(text.astype(np.int64), at), some], names=["a", "b", "n", "some_doc"])

    def added(parts: list[pa.Table]) -> pa.Table:
        met = pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum"), ("some_doc", "min")])
        return met.select(["a", "b", "n_sum", "some_doc_min"]).rename_columns(["a", "b", "n", "some_doc"])

    theirs = docs.select("doc_id", "text").mapInArrow(run, f"a long, b long, n long, some_doc {docs.schema['doc_id'].dataType.simpleString()}")
    counted = theirs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("some_doc").alias("some_doc"))
    return counted.join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi")


def rarest(placed: DataFrame, width: int, window: Column) -> DataFrame:
    """item_id, a, b, place, begin, size: seeds of which every run of `window` characters holds one, of placed(item_id, place, a, b, n) with n null where no document has the seed. A run of
    that many characters has m seeds one after the other, and so all of some block of (m + 1) / 2 places; each block gives its rarest seed, of ties the first,
    with the block's first place and its number of places. Blocks with a seed that no document has, or that touches noise, are in no run."""
    block = F.greatest(F.floor((window - width + 2) / 2), F.lit(1)).cast("long")
    sized = placed.withColumn("size", block).withColumn("block", F.floor(F.col("place") / F.col("size")))
    best = sized.groupBy("item_id", "block", "size").agg(F.count("n").alias("known"), F.min(F.struct("n", "place", "a", "b")).alias("best"))
    return best.filter("known = size").select("item_id", "best.a", "best.b", "best.place", (F.col("block") * F.col("size")).alias("begin"), "size")


def holders(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id of needles(item_id, needle) of WIDTH characters or more that a document of docs(doc_id, text) contains. Documents are met by the rarest
    seed of each needle and then searched."""
    theirs = seeds(needles, ["item_id"], "needle")
    counted = theirs.join(frequencies(theirs, docs, WIDTH), ["a", "b"], "left")
    chosen = counted.groupBy("item_id").agg(F.min(F.struct("n", "place", "a", "b")).alias("best"), F.count("n").alias("known"), F.count("*").alias("all")).filter("known = all").select("item_id", "best.a", "best.b")
    chosen = saved(chosen, "seeds")
    field = field_of(chosen)
    if field is None:
        return docs.sparkSession.createDataFrame([], f"item_id {needles.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    # Made first, so that documents are moved only where these pairs are too many to be sent to them.
    pairs = saved(seeds(docs, ["doc_id"], "text", asked=field, once=True).join(chosen, ["a", "b"]).select("item_id", "doc_id"), "pairs")
    return pairs.join(needles.select("item_id", "needle"), "item_id").join(docs.select("doc_id", "text").join(pairs, "doc_id", "left_semi"), "doc_id").filter(F.contains("text", "needle")).select("item_id", "doc_id")


def best_elsewhere(evidence: DataFrame, docs: DataFrame, least: int = WIDTH, noise: re.Pattern | None = NOISE) -> DataFrame:
    """item_id, doc_id, run: over all documents the longest run that evidence(item_id, evidence) shares with one, by its length without white space around it; of
    several documents that with the smallest id. First documents that have the rarest seed of a stretch tell a length that is reached; then only documents that hold a
    block of a window of that length can have a longer one (`hits`), and of these only those where the text around the block agrees as far as the best of them."""
    width = min(least, WIDTH)
    theirs = seeds(evidence, ["item_id"], "evidence", width, noise).select("item_id", "place", "a", "b")
    placed = saved(theirs.join(frequencies(theirs, docs, width, noise), ["a", "b"], "left"), "seeds")
    stretch = F.floor(F.col("place") / AROUND).alias("stretch")
    some = placed.filter("n is not null").groupBy("item_id", stretch).agg(F.min(F.struct("n", "place", "some_doc")).alias("m")).select("item_id", F.col("m.some_doc").alias("doc_id")).distinct()
    reached = saved(longest(some, evidence, docs, least, noise).groupBy("item_id").agg(F.max(F.length("run")).alias("reached")), "reached")
    windows = placed.join(reached, "item_id", "left").withColumn("window", F.greatest(F.coalesce("reached", F.lit(0)), F.lit(least)))
    near = hits(rarest(windows, width, F.col("window")), evidence, docs, width, noise)
    if near is None:
        return docs.sparkSession.createDataFrame([], f"item_id {evidence.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, run string")
    near = saved(near, "hits")
    first = near.groupBy("item_id").agg(F.min(F.struct((-F.col("most")).alias("most"), "doc_id")).alias("m")).select("item_id", "m.doc_id")
    again = longest(first, evidence, docs, least, noise).select("item_id", F.length("run").alias("reached"))
    bound = reached.unionByName(again).groupBy("item_id").agg(F.max("reached").alias("reached"))
    candidates = near.join(bound, "item_id", "left").filter(F.col("reached").isNull() | (F.col("most") >= F.col("reached")))
    found = longest(candidates, evidence, docs, least, noise)
    best = found.groupBy("item_id").agg(F.min(F.struct((-F.length("run")).alias("size"), "doc_id", "run")).alias("best"))
    return best.select("item_id", "best.doc_id", "best.run")


def hits(blocks: DataFrame, evidence: DataFrame, docs: DataFrame, width: int, noise: re.Pattern | None = None) -> DataFrame | None:
    """item_id, doc_id, most: the documents that have a block of blocks(item_id, a, b, place, begin, size), as far as AROUND characters on either side of its rarest
    seed tell, and the length that no run with such a block passes (that of the longest text if it goes on beyond these characters). None without blocks."""
    at = F.col("place").cast("int")
    before, after = F.least(at, F.lit(AROUND)), F.col("begin") + F.col("size") - F.col("place") - 1
    own_left, own_right = F.substring("evidence", at - before + 1, before), F.substring("evidence", at + width + 1, F.lit(AROUND))
    chosen = blocks.join(evidence.select("item_id", "evidence"), "item_id").select(
        "item_id", "a", "b", own_left.alias("own_left"), own_right.alias("own_right"), F.least(F.col("place") - F.col("begin"), F.lit(AROUND)).alias("before"), F.least(after, F.lit(AROUND)).alias("after")
    )
    chosen = saved(chosen, "blocks")
    field = field_of(chosen)
    if field is None:
        return None
    met = seeds(docs, ["doc_id"], "text", width, noise, False, field, around=True).join(chosen, ["a", "b"])

    def same(x: str, y: str, end: Callable[[Column, Column], Column]) -> Column:
        shorter = F.least(F.length(x), F.length(y))
        return F.size(F.filter(F.sequence(F.lit(1), F.lit(AROUND)), lambda k: (k <= shorter) & (end(F.col(x), k) == end(F.col(y), k))))

    # The block first, which most lack, then how far the texts agree.
    met = met.filter((F.length("left") >= F.col("before")) & (F.length("right") >= F.col("after")))
    met = met.filter((F.right("left", F.col("before")) == F.right("own_left", F.col("before"))) & (F.left("right", F.col("after")) == F.left("own_right", F.col("after"))))
    met = met.withColumns({"to_left": same("left", "own_left", F.right), "to_right": same("right", "own_right", F.left)})
    most = F.when((F.col("to_left") < AROUND) & (F.col("to_right") < AROUND), F.col("to_left") + F.col("to_right") + width).otherwise((1 << 31) - 1)
    return met.groupBy("item_id", "doc_id").agg(F.max(most).alias("most"))


def best_spans(pairs: DataFrame, docs: DataFrame, least: int = 20, piece: int = 8) -> DataFrame:
    """item_id, span of pairs(item_id, doc_id, evidence, answer): of the runs of `least` characters or more, white space aside, that evidence and its document
    share, the one with most of the answer's pieces of `piece` characters (every half piece), then the longest, then the first of the evidence, as the document writes it. If
    no run is as long, the longest of WIDTH or more. Pairs without a run have no row."""
    candidates = pairs.select("item_id", "doc_id")
    found = runs(candidates, pairs.select("item_id", "evidence"), docs, WIDTH, None, True, WIDTH)
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    answer = flat(F.col("answer"))
    starts = F.sequence(F.lit(0), F.greatest(F.length(answer) - piece, F.lit(1)) - 1, F.lit(piece // 2))
    pieces = F.when(answer == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(answer, i + 1, piece)))
    texts = pairs.select("item_id", "doc_id", flat(F.col("evidence")).alias("own"), pieces.alias("pieces"))
    run = F.substring("own", F.col("e_place").cast("int") + 1, F.col("length").cast("int"))
    told = found.join(texts, ["item_id", "doc_id"]).withColumn("run", run)
    told = told.withColumn("told", F.size(F.filter("pieces", lambda p: F.contains(F.col("run"), p))))
    long = F.col("length") >= least
    order = F.struct((~long).alias("short"), F.when(long, -F.col("told")).otherwise(0).alias("told"), (-F.col("length")).alias("size"), "e_place", "place", "first", "last")
    best = told.groupBy("item_id", "doc_id").agg(F.min(order).alias("best")).select("item_id", "doc_id", "best.first", "best.last")
    return best.join(docs.select("doc_id", "text"), "doc_id").select("item_id", F.substring("text", F.col("first").cast("int") + 1, (F.col("last") - F.col("first")).cast("int") + 1).alias("span"))


def grounded(pairs: DataFrame, docs: DataFrame, least: int = WIDTH, telling: int = 8) -> DataFrame:
    """item_id, keyword, defect of pairs(item_id, doc_id, evidence): the longest run that the own document shares; one of `telling` characters or more that
    other documents have too is 공고특정불가; if only others have one, the longest of theirs is 라벨불일치; else 코퍼스에없음."""
    docs = docs.select("doc_id", "text")
    evidence = pairs.select("item_id", "evidence")
    own = saved(longest(pairs.select("item_id", "doc_id"), evidence, docs, least).select("item_id", F.col("run").alias("own")), "own-runs")
    shared = holders(own.filter(F.length("own") >= max(telling, WIDTH)).select("item_id", F.col("own").alias("needle")), docs).groupBy("item_id").agg(F.count("*").alias("owners"))
    lost = evidence.join(own, "item_id", "left_anti")
    other = best_elsewhere(lost, docs, least).select("item_id", F.col("run").alias("other"))
    met = pairs.join(own, "item_id", "left").join(shared, "item_id", "left").join(other, "item_id", "left")
    defect = F.when(F.col("own").isNotNull(), F.when(F.col("owners") > 1, "공고특정불가")).when(F.col("other").isNotNull(), "라벨불일치").otherwise("코퍼스에없음")
    return met.select("item_id", F.coalesce("own", "other", F.lit("")).alias("keyword"), defect.alias("defect"))

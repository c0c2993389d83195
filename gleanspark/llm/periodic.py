"""Periodic runs of words by the runs theorem, and texts without their repeated periods.

A run is a stretch of words with smallest period p (words p apart are equal), at least `power` periods and `least` words long, that no neighbouring word
extends keeping p. Every maximal repetition has, in one of the two orders of the words (one and its reverse), a Lyndon root that is the longest Lyndon word
at its place, so it is enough to extend these: the longest Lyndon word at i ends where the next smaller suffix begins, which the inverse suffix array gives
by next smaller values, and the extensions to the right and left are longest common prefixes of suffixes (of the reversed words, to the left), which are
minima of ranges of the LCP array. Documents of a slice are one sequence with an end of its own for each; no run holds an end, since it occurs once.

Words are what bytes.split() gives. A null text counts as empty and has no words; a document without runs has an empty list, a null best run and its words joined
by single spaces. Of runs with equal exponents the best is that with the smaller start, then period. A very long text is one sequence, never cut. Repeated rows
stay, with equal results. Extra columns, whatever their names, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, map_batches, text_bytes

BLOCK = 32


def suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """The inverse suffix array by doubling. A rank is the place of the first suffix of its group; only groups of several are sorted again."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    at = codes[order]
    rank = np.empty(n, np.int64)
    rank[order], left = _groups(np.concatenate([[True], at[1:] != at[:-1]]) if n else np.empty(0, bool), np.arange(n))
    left, k = order[left], 1
    while len(left):
        beyond = left + k
        key = rank[left] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        s, key = left[by_key], key[by_key]
        old = rank[s]
        index = np.arange(len(s))
        # Places within the old group, counted on from its rank.
        start = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), index, 0))
        rank[s], several = _groups(np.concatenate([[True], key[1:] != key[:-1]]), old + index - start)
        left, k = s[several], k * 2
    return rank


def _groups(first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows of which `first` begin a group: the place of each one's group, and which groups have several rows."""
    alone = first & np.append(first[1:], True) if len(first) else first
    return np.maximum.accumulate(np.where(first, place, -1)) if len(first) else place, ~alone


def common_prefixes(codes: list[int], order: list[int], rank: list[int]) -> np.ndarray:
    """lcp[r]: how many codes the suffixes of ranks r - 1 and r share; from one place to the next the length falls by one at most. The last code occurs once."""
    out, h = [0] * len(codes), 0
    for i, r in enumerate(rank):
        if r:
            j = order[r - 1]
            while codes[i + h] == codes[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return np.array(out, np.int32)


class Extensions:
    """Longest common prefixes of any two suffixes: a sparse table over minima of blocks of the LCP array, and minima from both ends of a block."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.rank = suffix_ranks(codes)
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        self.lcp = common_prefixes(codes.tolist(), order.tolist(), self.rank.tolist())
        blocks = np.append(self.lcp, np.full(-n % BLOCK, np.iinfo(np.int32).max, np.int32)).reshape(-1, BLOCK)
        self.from_start = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(axis=1)]
        width = 1
        while 2 * width <= len(self.table[0]):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes the suffixes at i and j (never the same) share."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self.to_end[low], self.from_start[high])
        inner = last - first - 1
        for level, row in enumerate(self.table):
            of = np.flatnonzero((inner >= 1 << level) & (inner < 2 << level))
            out[of] = np.minimum(out[of], np.minimum(row[first[of] + 1], row[last[of] - (1 << level)]))
        within = np.flatnonzero(first == last)
        least = self.lcp[low[within]]
        for step in range(1, BLOCK):
            least = np.minimum(least, self.lcp[np.minimum(low[within] + step, high[within])])
        out[within] = least
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value; the length if there is none."""
    out, waiting = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, np.int64)


def runs(documents: list[np.ndarray], least: int, power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, sorted, of documents as arrays of word codes."""
    lengths = np.array([len(d) for d in documents], np.int64)
    able = np.flatnonzero(lengths >= max(least, power))
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    if not len(able):
        return none
    codes, begins = _joined([documents[d] for d in able])
    forward = Extensions(codes)
    n = len(codes)
    found = []
    for values in (forward.rank, n - 1 - forward.rank):  # both orders
        i, j = np.arange(n), next_smaller(values.tolist())
        i, j = i[j < n], j[j < n]
        p, right = j - i, forward.shared(i, j)
        # The first root of a run begins within the run's first period.
        enough = (right > (power - 2) * p) & (right + 2 * p > least)
        found.append((i[enough], j[enough], right[enough]))
    i, j, right = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return none
    # To the left: the same in reversed words, of those documents alone that have a candidate.
    at = np.searchsorted(begins, i, side="right") - 1
    holders, place = np.unique(at, return_inverse=True)
    backward_codes, backward_begins = _joined([documents[d][::-1] for d in able[holders]])
    backward = Extensions(backward_codes)
    # Word w of a document of m words is word m - 1 - w of the reversed one; the word before the first is the reversed end.
    turned = backward_begins[place] + lengths[able[at]] + begins[at]
    left = backward.shared(turned - i, turned - j)
    start, period, length = i - left - begins[at], j - i, left + (j - i) + right
    keep = length >= np.maximum(least, power * period)
    rows = np.unique(np.stack([able[at], start, period, length])[:, keep], axis=1)
    return rows[0], rows[1], rows[3], rows[2]


def _joined(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one sequence, each with an end of its own, and where each begins. The codes of words are dense from 0."""
    words = max(int(d.max()) for d in documents) + 1
    codes = np.concatenate([np.append(d, words + k) for k, d in enumerate(documents)])
    return codes, np.cumsum([0, *(len(d) + 1 for d in documents[:-1])])


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by single spaces."""
    if not len(start):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()])


RUN = "struct<start: long, length: long, period: long>"


def detect(docs: DataFrame, least: int = 24, power: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (by start, then period), best (the run with the greatest exponent) and collapsed (the text without repeated periods)."""
    if power < 2 or least < 1:
        raise ValueError("a run has two periods at least, and a word")

    def run(part: pa.RecordBatch) -> dict:
        number: dict[bytes, int] = defaultdict(count().__next__)
        texts = [x.split() for x in text_bytes(part.column("text"))]
        coded = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
        of, start, length, period = runs(coded, least, power)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        out = {"key": part.column("key"), "n_words": [len(x) for x in texts], "runs": [], "best": [], "collapsed": []}
        for words, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
            rows = [{"start": s, "length": n, "period": p} for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())]
            out["runs"].append(rows)
            out["best"].append(min(rows, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None))
            out["collapsed"].append(collapsed(words, start[a:b], length[a:b], period[a:b]).decode())
        return out

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
    return map_batches(rows, run, schema).withColumnRenamed("key", key)


def planted(text: Column, doc_id: Column) -> Column:
    """The texts of the registered query: in one document of ten, chosen by its id, the words from one place on repeat a stretch of its own words."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)))
    return F.when((h % 10 == 0) & F.coalesce(text.rlike(WORD), F.lit(False)), F.array_join(F.slice(repeated, F.lit(1), n), " ")).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run, and digests of all runs and of the collapsed text."""
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

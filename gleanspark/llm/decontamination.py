"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's shingles are its distinct runs of five words, A to Z lower-cased; fewer words are one shingle of their own. A document
contains an item if it has at least `threshold` of its shingles. With `short`, as in the query and its SQL, an item of fewer than five words is held against the
document's runs of as many words, so it is found inside longer documents; without, only in documents that equal it. Items are partitioned by size (powers of two); a partition keeps
for each item its smallest shingle hashes, as many as a containing document cannot all miss: for q shingles of which r must occur,
q - r + 1. So a document that contains an item shares at least one of them (a band of one minimum each, with certainty instead of a chance),
however long the document is. A document meets the partitions of items that it has shingles enough for, and no others. Candidates are verified by the
shingles themselves.

Items are taken in blocks of about `block_bytes` of text, chosen by hash, one after the other: a block is sent to every task, what it finds is a table
before the next one is fetched, so driver and tasks hold one block whatever the benchmark's size. Documents are read once for each block and not shuffled.
Null and blank items have no shingle and match nothing; null and blank documents contain nothing. Equal (item_id, text) rows are one
item; repeated documents give repeated rows. A very long document is read whole. Extra columns, whatever their names, are ignored by `contained` and kept
by `uncontaminated`. Without documents or items nothing is found and all documents stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, bounded, chunks, dropped, mix64, shingles, text_bytes, written

WIDTH, THRESHOLD = 5, 0.8
OUT = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def needed(q: int, threshold: float) -> int:
    return max(1, math.ceil(q * threshold - 1e-9))


def hashes(words: list[bytes], width: int) -> np.ndarray:
    """A hash for each shingle, made from the hashes of its words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    last = max(n - width, 0) + 1
    out = np.zeros(last, np.uint64)
    for k in range(min(width, n)):
        out += mix64(w[k : k + last] + np.uint64(k))
    return mix64(out)


@dataclass
class Index:
    """least: how many shingles a document needs to contain the smallest item of each partition, ascending; minima and owners: of each partition, sorted
    by hash; sets: of each item; short: by number of words, the items that are held against runs of as many words."""

    width: int
    threshold: float
    ids: list[int | None]
    sets: list[frozenset]
    least: list[int]
    minima: list[np.ndarray]
    owners: list[np.ndarray]
    first: np.ndarray
    short: dict[int, dict[bytes, list[int]]]

    def candidates(self, h: np.ndarray) -> set[int]:
        n = len(h)  # the document's shingles, with repeats
        h = h[self.first[(h >> np.uint64(44)).astype(np.int64)]]
        found: set[int] = set()
        for least, minima, owners in zip(self.least, self.minima, self.owners):
            if least > n or not len(h):
                break
            low, high = np.searchsorted(minima, h), np.searchsorted(minima, h, side="right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
                found.update(owners[a:b].tolist())
        return found

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item, its shingles, how many the text has) of the items that it contains."""
        words = text.lower().split()
        found = self.candidates(hashes(words, self.width))
        within = [(i, 1, 1) for n, runs in self.short.items() for run in runs.keys() & set(shingles(words, n)) for i in runs[run]]
        if not found:
            return sorted(within)
        own = set(shingles(words, self.width))
        got = [(i, len(self.sets[i]), len(self.sets[i] & own)) for i in sorted(found)]
        return sorted(within + [x for x in got if x[2] >= needed(x[1], self.threshold)])


def build(items: list[tuple[int | None, bytes]], width: int = WIDTH, threshold: float = THRESHOLD, short: bool = False) -> Index:
    ids, sets, parts, runs = [], [], {}, {}
    for i, text in items:
        words = text.lower().split()
        own = shingles(words, width)
        if not own:
            continue
        if short and len(words) < width:
            runs.setdefault(len(words), {}).setdefault(own[0], []).append(len(ids))
        else:
            h = np.unique(hashes(words, width))
            q = len(set(own))
            parts.setdefault(q.bit_length(), []).append((q, len(ids), h[: q - needed(q, threshold) + 1]))
        ids.append(i)
        sets.append(frozenset(own))
    minima, owners, first = [], [], np.zeros(1 << 20, bool)
    for size in sorted(parts):
        h = np.concatenate([x for _, _, x in parts[size]])
        of = np.concatenate([np.full(len(x), i) for _, i, x in parts[size]])
        by = np.argsort(h, kind="stable")
        minima.append(h[by])
        owners.append(of[by])
        first[(h >> np.uint64(44)).astype(np.int64)] = True
    least = [needed(min(q for q, _, _ in parts[size]), threshold) for size in sorted(parts)]
    return Index(width, threshold, ids, sets, least, minima, owners, first, runs)


def indexes(bench: DataFrame, width: int, threshold: float, block_bytes: int, short: bool = False):
    """(whether it is the only one, index) of each block of items; a block is what the driver and a task hold at once."""
    bounded(bench.sparkSession)
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        rows = items.filter(F.pmod("hash", F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield blocks == 1, build([(r["item_id"], bytes(r["text"])) for r in rows], width, threshold, short)


def contained(docs: DataFrame, bench: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = 16 << 20, short: bool = False) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, n_item, n_shared, containment."""
    arrow = arrow_schema(docs.sparkSession, OUT)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for only, index in indexes(bench, width, threshold, block_bytes, short):
        def run(batches, index=index):
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = [(d, index.ids[i], q, n, n / q) for d, x in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text"))) for i, q, n in index.search(x)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(arrow), arrow)], schema=arrow)

        own = texts.mapInArrow(run, OUT)
        found.append(own if only else written(own, "contained"))
    return reduce(DataFrame.unionByName, found)


def uncontaminated(docs: DataFrame, bench: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = 16 << 20, short: bool = False) -> DataFrame:
    """The rows of docs that contain no item, whole."""
    before = None
    for only, index in indexes(bench, width, threshold, block_bytes, short):
        def run(batches, index=index):
            for batch in batches:
                for part in chunks(batch, "text"):
                    yield part.filter(pa.array([not index.search(x) for x in text_bytes(part.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = written(docs, "uncontaminated")
            if before is not None:
                dropped(before)
            before = docs
    return docs


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5)),
q AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id),
few AS (SELECT DISTINCT item_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM b WHERE len(w) BETWEEN 1 AND 4),
within AS (SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d WHERE len(w) > 0) AS whole JOIN few ON contains(whole.s, few.s))
SELECT m.doc_id, m.item_id, q.n_item, m.n_shared, CAST(m.n_shared AS DOUBLE) / q.n_item AS containment
FROM m JOIN q ON m.item_id = q.item_id WHERE m.n_shared >= ceil(q.n_item * 0.8 - 1e-9)
UNION ALL SELECT doc_id, item_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS DOUBLE) FROM within
"""

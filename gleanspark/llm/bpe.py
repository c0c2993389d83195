"""Byte-level BPE: texts to token ids and back, by the ranks of a vocabulary file.

Each match of a splitting pattern is encoded separately. Two tiers: a minimal perfect hash over the vocabulary (hash and displace) tells whether the whole
match is a token; what isn't is merged from its bytes, which form a linked list, by a heap of neighbours that together are a token: lowest rank first, of
equal ranks the leftmost. The hash is built on the driver once for a vocabulary, which is bounded (its file), and goes to the tasks with the function.

A null text counts as empty and has no tokens; an empty table gives an empty one. Very long texts are encoded whole, their matches one after the other.
There are no special tokens: their strings are ordinary text. Equal texts have equal ids, repeated rows stay. Extra columns, whatever their names, are ignored.
Ids that the vocabulary lacks can't be decoded: ValueError.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, mix64

STEP = 0x9E3779B97F4A7C15
EVERY = (1 << 64) - 1
#: Texts beyond so many characters give their matches one by one instead of in a list.
LONG = 1 << 22
#: So many merged pieces a task remembers.
REMEMBERED = 1 << 18


def load(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with one base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@dataclass(frozen=True)
class Codec:
    """A vocabulary as a minimal perfect hash: key i has a slot of its own, with its hash, bytes and id."""

    seed: int
    displacement: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    keys: list
    longest: int

    @staticmethod
    def build(ranks: dict[bytes, int]) -> Codec:
        """Buckets of two keys on average, largest first: each takes the first displacement that puts all its keys on free slots. Buckets of one key come last and
        name the slot itself (as -1 - slot)."""
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        if len(set(ranks.values())) < len(ranks):
            raise ValueError("two tokens share a rank")
        tokens, n = list(ranks), len(ranks)
        for seed in count():
            h = np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in tokens), np.uint64, n)
            if len(np.unique(h)) == n:
                break
        n_buckets = n // 2 + 1
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        starts = np.cumsum(sizes) - sizes
        displacement, slot_of, taken = np.zeros(n_buckets, np.int32), np.empty(n, np.int64), np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = by_bucket[starts[b] : starts[b] + sizes[b]]
            if len(members) < 2:
                break
            for base in count(0, 256):
                tried = np.arange(base, base + 256, dtype=np.uint64)
                slots = _slots(h[members][None, :], tried[:, None], n)
                ordered = np.sort(slots, axis=1)
                fits = np.flatnonzero(~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(fits):
                    displacement[b], slot_of[members] = base + fits[0], slots[fits[0]]
                    taken[slots[fits[0]]] = True
                    break
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        displacement[single], slot_of[by_bucket[starts[single]]] = -1 - free, free
        order = np.argsort(slot_of)
        ids = np.fromiter(ranks.values(), np.int64, n)
        return Codec(seed, displacement, h[order], ids[order], [tokens[i] for i in order], max(map(len, tokens)))

    def find(self, key: bytes) -> int:
        """The id of one token, -1 if the vocabulary lacks it."""
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = int(self.displacement[h % len(self.displacement)])
        if d < 0:
            slot = -1 - d
        else:
            x = h + d * STEP & EVERY
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & EVERY
            x = (x ^ x >> 27) * 0x94D049BB133111EB & EVERY
            slot = (x ^ x >> 31) % len(self.keys)
        return int(self.ids[slot]) if self.keys[slot] == key else -1

    def find_all(self, keys: list[bytes]) -> np.ndarray:
        """Ids of many, -1 for those that the vocabulary lacks."""
        h = np.fromiter((xxhash.xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
        d = self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        slot = np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0).astype(np.uint64), len(self.keys)))
        out = np.where(self.hashes[slot] == h, self.ids[slot], -1)
        for i in np.flatnonzero(out >= 0).tolist():  # equal hashes are no proof
            if self.keys[slot[i]] != keys[i]:
                out[i] = -1
        return out

    def by_id(self) -> dict[int, bytes]:
        return dict(zip(self.ids.tolist(), self.keys))


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix64(h + d * np.uint64(STEP)) % np.uint64(n)).astype(np.int64)


class Merger:
    """Merges pieces by the ranks of a codec, and remembers what it made of short ones: at most REMEMBERED, then it starts anew."""

    def __init__(self, codec: Codec):
        self.rank = dict(zip(codec.keys, codec.ids.tolist())).get
        self.single = [self.rank(bytes([b])) for b in range(256)]
        self.pair = [self.rank(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.longest = codec.longest
        self.known: dict[bytes, list[int]] = {}

    def ids(self, piece: bytes) -> list[int]:
        out = self.known.get(piece)
        if out is None:
            out = self.merged(piece)
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = out
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Node i begins at byte i, stands for token own[i] and ends at end[i], where the next one begins. now[i] is the rank of what it and the next one make up
        (-1: nothing, or the node is merged away). An entry rank * n + i of the heap holds as long as now[i] is that rank."""
        n, rank, longest, pair, single = len(piece), self.rank, self.longest, self.pair, self.single
        own, end, before = [single[b] for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        now = [pair[a << 8 | b] for a, b in zip(piece, piece[1:])]
        heap = [r * n + i for i, r in enumerate(now) if r >= 0]
        now.append(-1)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), n)
            if now[i] != r:
                continue
            j = end[i]
            stop = end[j]
            own[i], end[i], now[i], now[j] = r, stop, -1, -1
            if stop < n:
                before[stop] = i
                after = end[stop]
                if after - i <= longest:
                    now[i] = q = rank(piece[i:after], -1)
                    if q >= 0:
                        push(heap, q * n + i)
            k = before[i]
            if k >= 0:
                now[k] = q = rank(piece[k:stop], -1) if stop - k <= longest else -1
                if q >= 0:
                    push(heap, q * n + k)
        out, i = [], 0
        while i < n:
            out.append(own[i])
            i = end[i]
        return out


def encoded(texts: list[str], codec: Codec, pattern: regex.Pattern, merger: Merger) -> list[np.ndarray]:
    """Ids of each text, as unsigned 32-bit integers. A match is looked up once for all these texts."""
    number: dict[str, int] = defaultdict(count().__next__)
    matches = []
    for text in texts:
        found = pattern.findall(text) if len(text) <= LONG else (m.group() for m in pattern.finditer(text))
        matches.append(np.fromiter(map(number.__getitem__, found), np.int64))
    pieces = [p.encode() for p in number]
    whole = codec.find_all(pieces)
    sizes = np.ones(len(pieces), np.int64)
    parts = whole.tolist()
    for i in np.flatnonzero(whole < 0).tolist():
        parts[i] = merger.ids(pieces[i])
        sizes[i] = len(parts[i])
    pool = np.fromiter((x for p in parts for x in (p if isinstance(p, list) else (p,))), np.uint32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    out = []
    for at in matches:
        n = sizes[at]
        done = np.cumsum(n)
        out.append(pool[np.repeat(starts[at] - done + n, n) + np.arange(done[-1] if len(done) else 0)])
    return out


def encode(docs: DataFrame, codec: Codec, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids: the ids as little-endian unsigned 32-bit integers, which loaders of training data map into memory as they are."""
    split, merger = regex.compile(pattern), []

    def run(part: pa.RecordBatch) -> dict:
        if not merger:  # once a task
            merger.append(Merger(codec))
        made = encoded([x or "" for x in part.column("text").to_pylist()], codec, split, merger[0])
        return {"key": part.column("key"), "n_tokens": [len(x) for x in made], "ids": [x.astype("<u4").tobytes() for x in made]}

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return map_batches(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(rows: DataFrame, codec: Codec) -> DataFrame:
    """The rows of `encode` (any columns beside ids) with `decoded`: the bytes that their ids stand for. Null ids give null."""
    token, columns = codec.by_id(), rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"

    def text(ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        try:
            return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as e:
            raise ValueError(f"the vocabulary has no id {e.args[0]}") from e

    def run(part: pa.RecordBatch) -> dict:
        return {c: part.column(c) for c in columns} | {"decoded": [text(x) for x in part.column("ids").to_pylist()]}

    return map_batches(rows, run, schema, "ids")


def round_trip(docs: DataFrame, codec: Codec, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    both = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), codec, pattern), codec)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: the majority of each bit over the XXH64 of all word shingles, repeats included. Equal fingerprints are one node.
Nodes meet in blocks: of four parts of the fingerprint two must be equal within radius 2, so no link is lost. In a block the fingerprints are stored as bit planes, 64 to
a word; planes that differ are added by carry-save counters that overflow when a pair exceeds the radius, and words all of whose pairs
have overflowed are abandoned. A block of more than BLOCK nodes is dealt as pairs of parts to many tasks. What leaves a
block is a spanning forest of its links; components join them.

`one_of_each` (the pipeline's) differs: its nodes are the sets of distinct shingles, its fingerprints are made from them, its blocks are pairs of minima
of the shingles' hashes, and they only find candidates, whose sets are then brought to the blocks and compared; only links of enough exact Jaccard similarity leave a block.

Null and blank texts have fingerprint zero, or the empty set, and are linked like any other. Null ids take part but name no component.
Repeated rows are copies. A very long text is read whole; its shingles' hashes are held by one task. Extra columns, whatever their names, are ignored
by `near_duplicates` and kept by `one_of_each`. No rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_schema, dropped, map_batches, mix64, shingles, spread_join, text_bytes, whole, written
from .components import components

BLOCK = 16_384
BLOCK_BYTES = 64 << 20
NAME = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in shingles(text.lower().split(), width)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        count += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int, words: int = 1) -> bytes:
    """64 bits for each of `words`, big-endian; the hashes of the later words are mixed from those of the first."""
    return _fingerprint(shingle_hashes(text, width), words)


def _fingerprint(h: np.ndarray, words: int) -> bytes:
    out = majority(h).to_bytes(8, "big")
    for k in range(1, words):
        out += majority(mix64(h ^ mix64(np.array([k], np.uint64)))).to_bytes(8, "big")
    return out


def minhash_keys(h: np.ndarray, bands: int) -> list[int]:
    """One key for each band of two minima; a text without words has keys of its own."""
    if not len(h):
        return list(range(bands))
    least = [int(mix64(h + mix64(np.array([1000 + k], np.uint64))).min()) for k in range(2 * bands)]
    return [xxhash.xxh64_intdigest(b"%d %d %d" % (k, least[2 * k], least[2 * k + 1])) - (1 << 63) for k in range(bands)]


def pigeonhole_keys(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 6): for radius 2 two of four 16-bit parts are equal; the pair's number and the two parts."""
    parts = [fingerprints >> np.uint64(16 * k) & np.uint64(0xFFFF) for k in range(4)]
    return np.stack([(np.uint64(n) << np.uint64(32) | parts[i] << np.uint64(16) | parts[j]).astype(np.int64) for n, (i, j) in enumerate(combinations(range(4), 2))], axis=1)


def union(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each item's component, given links i to j; labels: from earlier links."""
    labels = np.arange(n) if labels is None else labels
    while True:
        a, b = labels[i], labels[j]
        on = a != b
        if not on.any():
            return labels
        i, j, a, b = i[on], j[on], a[on], b[on]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def bit_sliced(bits: np.ndarray, ends: np.ndarray, radius: int, tiles: int = 512, confirm=None) -> np.ndarray:
    """Labels of components of rows of `bits` (n, planes) that differ in at most `radius` places; only pairs up to ends[i], the end
    of i's block, need be compared. Words of 64 items against 64 queries, at growing distance between the words.
    confirm(i, j, labels): those of the pairs that are links."""
    n, n_planes = bits.shape
    width = -(-n // 64)
    full = np.zeros((width * 64, n_planes), np.uint8)
    full[:n] = bits
    planes = np.ascontiguousarray(np.packbits(full.T, axis=1, bitorder="little")).view("<u8")
    masks = np.negative(np.ascontiguousarray(full.T).view(np.int8)).reshape(n_planes, width, 64)  # 0 or -1, widened to a word where used
    last = (np.concatenate([ends, np.full(width * 64 - n, n)]).reshape(width, 64).max(axis=1) - 1) // 64
    labels = np.arange(n)
    size = max(1, int(radius).bit_length())
    if (1 << size) <= radius:
        size += 1
    start = (1 << size) - 1 - radius
    below = np.array([((1 << (q + 1)) - 1) & (2**64 - 1) for q in range(64)], np.uint64)
    absent = np.uint64(0) if n % 64 == 0 else ~np.uint64((1 << (n % 64)) - 1)
    for distance in range(width):
        here = np.nonzero(last >= np.arange(width) + distance)[0]
        here = here[here + distance < width]
        if not len(here):
            break
        for at in range(0, len(here), tiles):
            a = here[at : at + tiles]
            over = np.zeros((len(a), 64), np.uint64)
            if distance == 0:
                over |= below
            over[a + distance == width - 1] |= absent
            counter = [np.full((len(a), 64), ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
            for p in range(n_planes):
                carry = planes[p][a + distance][:, None] ^ masks[p][a].astype(np.int64).view(np.uint64)
                for k in range(size):
                    both = counter[k] & carry
                    counter[k] ^= carry
                    carry = both
                over |= carry
                if p % 8 == 7:
                    alive = (over != ALL).any(axis=1)
                    if not alive.all():
                        a, over, counter = a[alive], over[alive], [c[alive] for c in counter]
                        if not len(a):
                            break
            if len(a):
                tile, query, item = np.nonzero(np.unpackbits(np.ascontiguousarray(~over).view(np.uint8).reshape(len(a), 64, 8), axis=2, bitorder="little"))
                i, j = a[tile] * 64 + query, (a[tile] + distance) * 64 + item
                own = j < ends[i]  # neighbours of another block would be links too, but found by chance
                i, j = i[own], j[own]
                if confirm:
                    i, j = confirm(i, j, labels)
                labels = union(n, i, j, labels)
    return labels


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted arrays of distinct hashes have at least that Jaccard similarity; empty sets are equal."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return not len(b)
    if len(a) < threshold * len(b) - 1e-9:
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def _confirm(sets: list[np.ndarray], threshold: float):
    """For bit_sliced: links by exact similarity. Pairs that links have joined already are not compared."""

    def confirm(i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = labels[i], labels[j]
        on = a != b
        up, kept = {}, []

        def find(x: int) -> int:
            root = x
            while root in up:
                root = up[root]
            while x != root:
                up[x], x = root, up[x]
            return root

        for x, y, p, q in zip(a[on].tolist(), b[on].tolist(), i[on].tolist(), j[on].tolist()):
            x, y = find(x), find(y)
            if x != y and similar(sets[p], sets[q], threshold):
                up[max(x, y)] = min(x, y)
                kept.append((p, q))
        found = np.array(kept, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    return confirm


def _compare(radius: int, threshold: float | None = None, candidates: bool = False, most: int = 1 << 15, most_bytes: int = 128 << 20):
    """Blocks to spanning forests of their links. With `threshold`, node (a name of NAME bytes, then the fingerprint) comes with its set
    and links are confirmed by exact similarity; with `candidates`, what leaves a block is its rows that have a link."""

    def solve(key: np.ndarray, node: np.ndarray, place: list, sets: list) -> pa.RecordBatch:
        """key: numbers of blocks in order; node: (n, bytes)."""
        size = np.bincount(key - key[0])
        size = size[size > 0]
        ends = np.repeat(np.cumsum(size), size)
        named = candidates or threshold is not None
        confirm = _confirm([np.frombuffer(x, np.uint64) for x in sets], threshold) if threshold is not None else None
        labels = bit_sliced(np.unpackbits(node[:, NAME if named else 0 :], axis=1), ends, radius, confirm=confirm)
        child = np.nonzero(labels != np.arange(len(labels)))[0]
        if candidates:
            rows = np.union1d(child, labels[child])
            where = [pa.array(np.concatenate([x[k] for x in place])[rows]) for k in range(3)]
            return pa.RecordBatch.from_arrays([*where, pa.array([node[i, :NAME].tobytes() for i in rows], pa.binary())], names=["key", "low", "high", "name"])
        name = (lambda i: node[i, :NAME].tobytes()) if named else lambda i: node[i].tobytes()
        return pa.RecordBatch.from_pydict({"a": pa.array([name(i) for i in child], pa.binary()), "b": pa.array([name(i) for i in labels[child]], pa.binary())})

    def run(batches):
        keys, nodes, places, sets, held, number, size, previous = [], [], [], [], 0, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high")]
            new = np.zeros(batch.num_rows, bool)
            for x, first in zip(cols, previous or [None] * 3):
                new[1:] |= x[1:] != x[:-1]
                new[0] |= first is None or x[0] != first
            previous = [x[-1] for x in cols]
            ids = number + np.cumsum(new)
            number = int(ids[-1])
            keys.append(ids)
            nodes.append(np.frombuffer(b"".join(batch.column("node").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            places.append(cols if candidates else None)
            if threshold is not None:
                sets += batch.column("set").to_pylist()
                size += batch.column("set").nbytes
            held += batch.num_rows
            if held >= most or size >= most_bytes:
                key, node = np.concatenate(keys), np.concatenate(nodes)
                cut = int(np.searchsorted(key, key[-1]))
                place = [[np.concatenate([x[k] for x in places]) for k in range(3)]] if candidates else []
                if cut:
                    yield solve(key[:cut], node[:cut], [[x[:cut] for x in p] for p in place], sets[:cut])
                keys, nodes, places, sets, held = [key[cut:]], [node[cut:]], [[x[cut:] for x in p] for p in place], sets[cut:], len(key) - cut
                size = sum(map(len, sets))
        if held:
            yield solve(np.concatenate(keys), np.concatenate(nodes), places, sets)

    return run


def _dealt(keyed: DataFrame, weight=None) -> DataFrame:
    """keyed(key, node and others) in blocks (key, low, high). A block of more than BLOCK nodes, or of more than BLOCK_BYTES of `weight`, is dealt as pairs of parts."""
    parts = F.ceil(F.count("*") / BLOCK)
    if weight is not None:
        parts = F.greatest(parts, F.ceil(F.sum(weight) / BLOCK_BYTES))
    hot = keyed.groupBy("key").agg(parts.cast("int").alias("parts"), F.count("*").alias("rows")).filter("parts > 1")
    parted = spread_join(keyed, hot, ["key"], "rows", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = parted.select(*keyed.columns, part.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *[c for c in keyed.columns if c != "key"])


def links(keyed: DataFrame, radius: int) -> DataFrame:
    """keyed(key, node), distinct, to a spanning forest (a, b) of the links within each block."""
    return _blocks(_dealt(keyed.select("key", "node"))).mapInArrow(_compare(radius), "a binary, b binary")


def _blocks(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(F.col("key"), F.col("low"), F.col("high")).sortWithinPartitions("key", "low", "high", "node")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """id, node (the fingerprint)."""

    def run(part: pa.RecordBatch) -> dict:
        return {"id": part.column("id"), "node": [fingerprint(x, width) for x in text_bytes(part.column("text"))]}

    return written(map_batches(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), run, "id long, node binary"), "fingerprints")


def _pigeonhole(nodes: DataFrame) -> DataFrame:
    arrow = arrow_schema(nodes.sparkSession, "key long, node binary")

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_pylist()
            keys = pigeonhole_keys(np.frombuffer(b"".join(node), ">u8").astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array([x for x in node for _ in range(6)], pa.binary())], schema=arrow)

    return nodes.mapInArrow(run, "key long, node binary")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """node, n (rows that have it), component (the smallest id of its component, null if all are null)."""
    nodes = prints.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    found = components(links(_pigeonhole(nodes.select("node")), radius))
    roots = found.withColumnRenamed("node", "child")
    rooted = written(nodes.join(roots, F.col("node") == F.col("child"), "left").select("node", "n", "first", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    out = written(spread_join(rooted, named, ["root"], "size").select("node", "n", "component"), "classes")
    dropped(found, rooted)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: 64 bits, linked at `radius` (0 to 2) differing bits or fewer; a wider radius is refused, since
    four parts of a fingerprint find all links up to 2 alone."""
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0 to 2")
    prints = fingerprints(docs, width)
    return spread_join(prints, _classes(prints, radius), ["node"], "n").select(F.col("id").alias("doc_id"), F.lower(F.hex("node")).alias("fingerprint"), F.col("component").alias("component_id"))


def distinct_hashes(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_name(h: np.ndarray) -> bytes:
    """Names a set of hashes, sorted and distinct: equal for equal sets alone (128 bits)."""
    return xxhash.xxh3_128_digest(h.tobytes())


def set_fingerprints(docs: DataFrame, width: int, words: int, bands: int) -> DataFrame:
    """k1 and k2 (hashes of id and text), id, name (of the set of shingles), node (name and fingerprint of the set), n (its size), keys (of the bands)."""

    def run(part: pa.RecordBatch) -> dict:
        names, nodes, sizes, keys = [], [], [], []
        for x in text_bytes(part.column("text")):
            h = distinct_hashes(x, width)
            names.append(set_name(h))
            nodes.append(names[-1] + _fingerprint(h, words))
            sizes.append(len(h))
            keys.append(minhash_keys(h, bands))
        return {"id": part.column("id"), "k1": part.column("k1"), "k2": part.column("k2"), "name": names, "node": nodes, "n": sizes, "keys": keys}

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "text")
    return written(map_batches(rows, run, "id long, k1 long, k2 long, name binary, node binary, n long, keys array<bigint>"), "set-fingerprints")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """name, set (sorted hashes as bytes) of one document for each name of wanted(name, k1, k2)."""

    def run(part: pa.RecordBatch) -> dict:
        sets = [distinct_hashes(x, width) for x in text_bytes(part.column("text"))]
        return {"name": [set_name(h) for h in sets], "set": [h.tobytes() for h in sets]}

    rows = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "text")
    one = rows.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return written(map_batches(one.select("text"), run, "name binary, set binary"), "sets")


def similar_links(docs: DataFrame, nodes: DataFrame, width: int, radius: int, threshold: float) -> DataFrame:
    """node, root: components of the links between sets of at least that Jaccard similarity. Bands and bit planes find the candidates; what is linked in a
    block leaves it as a spanning forest."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n")
    blocks = _blocks(_dealt(keyed, F.col("n") * 8).select("key", "low", "high", "node"))
    near = written(blocks.mapInArrow(_compare(radius, candidates=True), "key long, low int, high int, name binary"), "candidates")
    wanted = near.select("name").distinct().join(nodes, "name").select("name", "node", F.col("kept.k1").alias("k1"), F.col("kept.k2").alias("k2"))
    sets = _sets(docs, wanted, width)
    found = near.join(nodes.select("name", "node"), "name").join(sets, "name").select("key", "low", "high", "node", "set")
    out = components(_blocks(found).mapInArrow(_compare(radius, threshold), "a binary, b binary"))
    dropped(near, sets)
    return out


def one_of_each(docs: DataFrame, width: int = 5, words: int = 8, radius: int = 144, bands: int = 12, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, one of each group of near copies: that with the smallest id. Near copies are links of a Jaccard similarity of
    `threshold` or more between the distinct `width`-word shingles, by their 64-bit hashes; equal sets are one node. Candidates share one of
    `bands` pairs of minima and have fingerprints (64 bits times `words`, over the distinct shingles) within `radius` bits."""
    prints = set_fingerprints(docs, width, words, bands)
    row = F.struct("id", "k1", "k2")
    least = [F.min(row).alias("kept"), F.min(F.when(F.col("id").isNotNull(), row)).alias("best")]
    nodes = written(prints.groupBy("name").agg(*[F.first(c).alias(c) for c in ("node", "n", "keys")], *least), "nodes")
    links = similar_links(docs, nodes, width, radius, threshold)
    roots = links.withColumnRenamed("node", "child")
    rooted = nodes.join(roots, F.col("name") == F.col("child"), "left").withColumn("root", F.coalesce("root", "name"))
    grouped = rooted.groupBy("root").agg(F.min("kept").alias("kept"), F.min("best").alias("best"))
    chosen = written(grouped.select(F.coalesce("best", "kept").alias("kept")).select(F.col("kept.k1").alias("k1"), F.col("kept.k2").alias("k2")), "chosen")
    dropped(prints, nodes, links)
    rows = docs.select(whole(docs), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))
    # Of rows that are equal in id and text one stays; the join has sorted by what the window needs.
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    return rows.join(chosen, ["k1", "k2"]).withColumn("n", first).filter("n = 1").select("row.*")

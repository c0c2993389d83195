"""Language-model scoring by prediction by partial matching (PPM): byte contexts, escapes by method D, symbol exclusion.

Texts are lower-cased (A to Z) and read as their words joined by single spaces, then one end symbol: which white space stands between two
words is not coded and costs nothing, as in the tokens that base_score counts. Training documents give counts
of every context of `order` symbols and what followed; each suffix of a context is a node of the trie, whose counts are the
sums over what extends it. A symbol is coded at the longest context seen in training; where it did not follow there, an escape is
paid and the symbols that did are excluded from the shorter contexts, down to equal chances for what was never seen at all. The
model is fixed before scoring, so the code length of a text does not hang on other scored texts.

1. Documents are packed where they are read into blocks of about `block_bytes`, one compressed row each; no text is sorted or shuffled by key.
2. Each block's contexts and words are counted, merged within the task and summed over all tasks.
3. The trie's orders follow from each other, the longer by masking its oldest symbol. What a context of order k pays below itself hangs on it
   and on its suffix of order k - 1 alone, so order k needs the rows of one suffix together: at most 257 * 257 + 257, whatever the corpus.
4. Log probabilities meet the blocks that need them by key. The HEAD most frequent keys, a constant number, go to every task instead,
   since nearly every block needs them. A task so holds its block, what that needs, and the head, never the vocabulary or the trie.

Null and blank texts are one end symbol. Null ids train. Repeated rows count as often as they occur. Extra columns are ignored. A very long text
is a block of its own and is read in pieces of PIECE bytes cut between words, with the context carried over. Without training rows every
symbol costs log10(257). An empty table gives an empty result. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, chunks, dropped, written

BITS, END = 9, 256
WORD_KIND, GRAM_KIND = 0, 1
END_KEY = -1  # of the end token among words
PIECE = 1 << 20  # bytes of a text that are read at once
MERGED = 1 << 20  # distinct keys that a task holds before it passes them on
ROWS = 1 << 17  # of a batch that leaves a task
HEAD = {WORD_KIND: 1 << 16, GRAM_KIND: 1 << 19}
SPACE = re.compile(rb"[\x20\x09-\x0D]")
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 1) >> 1  # from 0, so never END_KEY


def pieces(text: bytes, most: int = PIECE) -> Iterator[tuple[list[bytes], bool]]:
    """(words, whether they are the text's last) of runs of about `most` bytes."""
    start = 0
    while True:
        cut = SPACE.search(text, start + most)
        stop = cut.start() if cut else len(text)
        yield text[start:stop].lower().split(), cut is None
        if cut is None:
            return
        start = stop


@dataclass
class Grams:
    """Of pieces of texts, read together: text, the number of each piece's text, its words, and the keys of all their symbols: for each the `order`
    symbols before it and itself, 9 bits each, the oldest highest. at: where each piece's keys begin."""

    text: list[int]
    words: list[list[bytes]]
    keys: np.ndarray
    at: np.ndarray


def grams(texts: Iterable[bytes], order: int, most: int = PIECE) -> Iterator[Grams]:
    """Every symbol of the texts, pieces of about `most` bytes together."""
    numbers, split, parts, sizes, held = [], [], [], [], 0

    def made() -> Grams:
        x, n = np.concatenate(parts), np.array(sizes)
        key = np.zeros(len(x) - order, np.int64)
        for j in range(order + 1):
            key <<= BITS
            key |= x[j : j + len(key)]
        own = np.ones(len(x), bool)  # without the symbols that a piece only begins after
        for j in range(order):
            own[np.cumsum(np.append(0, n[:-1] + order)) + j] = False
        return Grams(numbers, split, key[own[order:]], np.cumsum(np.append(0, n[:-1])))

    end = np.array([END], np.int64)
    for number, text in enumerate(texts):
        before, begun = np.full(order, END, np.int64), False
        for words, last in pieces(text, most):
            line = np.frombuffer((b" " if begun and words else b"") + b" ".join(words), np.uint8)
            parts += [before, line, end] if last else [before, line]
            if not last:
                before, begun = np.concatenate([before, line])[-order:], begun or bool(words)
            if len(line) or last:
                numbers.append(number)
                split.append(words)
                sizes.append(len(line) + last)
                held += len(line) + 1
            else:
                del parts[-2:]
            if held >= most:
                yield made()
                numbers, split, parts, sizes, held = [], [], [], [], 0
    if sizes:
        yield made()


def _mask(order: int) -> int:
    """Of the keys of an order: that many symbols and the one that followed."""
    return (1 << BITS * (order + 1)) - 1


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; sorts in place."""
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    key, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    by = np.argsort(key)
    key = key[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(n[by], at)


def _pack(block_bytes: int):
    """Rows of (doc_id, held_out, text) to rows of (block, docs): an Arrow stream of about `block_bytes` of text, compressed."""

    def stream(held: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for x in held:
                writer.write_batch(x)
        return sink.getvalue().to_pybytes()

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in chunks(batch, "text", block_bytes):
                own = part.column("text").cast(pa.binary())
                bytes_ = sum(x or 0 for x in pa.compute.binary_length(own).to_pylist())
                if held and size + bytes_ > block_bytes:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "docs": pa.array([stream(held)], pa.binary())})
                    number, held, size = number + 1, [], 0
                held.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), own], names=["doc_id", "held_out", "text"]))
                size += bytes_
        if held:
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "docs": pa.array([stream(held)], pa.binary())})

    return run


def unpacked(docs: bytes) -> pa.Table:
    """doc_id, held_out and text (binary) of a block."""
    with pa.ipc.open_stream(docs) as reader:
        return reader.read_all()


def _texts(table: pa.Table) -> Iterator[bytes]:
    for batch in table.column("text").chunks:
        for x in batch:
            yield x.as_py() or b""


def _counted(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), ROWS):
        k = key[at : at + ROWS]
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(k), kind, np.int8)), "key": pa.array(k), "n": pa.array(n[at : at + ROWS])})


def _count(order: int):
    """Blocks to (kind, key, n), 0 for what only held-out texts have."""

    def run(batches):
        words: Counter = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0

        def passed(most: int) -> Iterator[pa.RecordBatch]:
            """What is held beyond `most` keys."""
            if sum(len(k) for k, _ in found) > 2 * most:
                found[:] = [merged(found)]
                if len(found[0][0]) > most:
                    yield from _counted(GRAM_KIND, *found.pop())
            if len(words) > most // 8:
                yield from _counted(WORD_KIND, np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
                words.clear()

        for batch in batches:
            for docs in batch.column("docs"):
                table = unpacked(docs.as_py())
                for out in (False, True):
                    some = table.filter(pa.compute.equal(table.column("held_out"), out))
                    ends += 0 if out else some.num_rows
                    for g in grams(_texts(some), order):
                        for split in g.words:
                            words.update(dict.fromkeys(split, 0) if out else split)
                        key, n = runs(g.keys)
                        found.append((key, np.zeros_like(n) if out else n))
                        yield from passed(MERGED)
        yield from passed(0)
        yield from _counted(WORD_KIND, np.array([END_KEY], np.int64), np.array([ends], np.int64))

    return run


def below(n: np.ndarray, at: np.ndarray, contexts: int, lower: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of an order: counts n of a symbol in context `at`, with what the next shorter context has for the same symbol (lower: n, t, q, d). Returns
    n, t and q (all counts and distinct symbols of the context), and d: log10 of the symbol's chance below this context, its symbols excluded."""
    seen = n > 0
    t, q = np.bincount(at, n, contexts), np.bincount(at, seen, contexts)
    lost = np.bincount(at, np.where(seen, lower["n"], 0), contexts)
    t_open, q_open = lower["t"] - lost[at], lower["q"] - q[at]
    met = ~seen & (lower["t"] > 0) & (t_open > 0)  # d is asked for symbols that this context has not seen
    hit = met & (lower["n"] > 0)
    escape = met & ~hit & (q_open > 0)
    d = np.where(hit, 0.0, lower["d"])
    d[hit] += np.log10((lower["n"][hit] - 0.5) / t_open[hit])
    d[escape] += np.log10(q_open[escape] / (2 * t_open[escape]))
    return {"n": n, "t": t[at], "q": q[at], "d": d}


def coded(rows: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each row's symbol, coded from this order on."""
    n, t, q = rows["n"], rows["t"], rows["q"]
    out = np.where(n > 0, 0.0, rows["d"])
    hit, escape = n > 0, (n <= 0) & (q > 0)
    out[hit] += np.log10((n[hit] - 0.5) / t[hit])
    out[escape] += np.log10(q[escape] / (2 * t[escape]))
    return out


def first_order(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of order 1 for all 257 * 257 pairs, from their counts."""
    single = pairs.sum(axis=0)
    nothing = np.full(257, -math.log10(max(257 - int((single > 0).sum()), 1)))
    zero = below(single, np.zeros(257, np.int64), 1, {"n": np.zeros(257), "t": np.zeros(257), "q": np.zeros(257), "d": nothing})
    previous, symbol = np.divmod(np.arange(257 * 257), 257)
    return below(pairs.reshape(-1), previous, 257, {k: v[symbol] for k, v in zero.items()})


LEVEL = "key long, n long, t double, q double, d double"
VALUE = "kind byte, key long, value double"


def _rows(key: np.ndarray, rows: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
    values = {"value": coded(rows)} if last else {"n": rows["n"].astype(np.int64), **{k: rows[k] for k in "tqd"}}
    for at in range(0, len(key), ROWS):
        k = key[at : at + ROWS]
        head = {"kind": pa.array(np.full(len(k), GRAM_KIND, np.int8))} if last else {}
        yield pa.RecordBatch.from_pydict(head | {"key": pa.array(k)} | {c: pa.array(v[at : at + ROWS]) for c, v in values.items()})


def _second(pairs: np.ndarray, last: bool):
    """Order 2 over rows (key, n) in order, contexts whole: order 1 comes along."""
    first = first_order(pairs)

    def solve(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, at = np.unique(key >> BITS, return_inverse=True)
        pair = (key >> BITS & 511) * 257 + (key & 511)
        yield from _rows(key, below(n.astype(float), at, int(at[-1]) + 1, {k: v[pair] for k, v in first.items()}), last)

    def run(batches):
        for key, n in _whole(batches, ("key", "n"), lambda x: x[0] >> BITS):
            yield from solve(key, n)

    return run


def _higher(order: int, last: bool):
    """Order `order` over rows (suffix, upper, key, n, t, q, d) in order of suffix: those of that order (upper) and of the next shorter one."""

    def solve(suffix, upper, key, n, t, q, d) -> Iterator[pa.RecordBatch]:
        low, high = ~upper, upper
        by = np.argsort(key[low])
        place = by[np.searchsorted(key[low], key[high] & _mask(order - 1), sorter=by)]
        _, at = np.unique(key[high] >> BITS, return_inverse=True)
        lower = {"n": n[low][place].astype(float), "t": t[low][place], "q": q[low][place], "d": d[low][place]}
        yield from _rows(key[high], below(n[high].astype(float), at, int(at.max(initial=-1)) + 1, lower), last)

    def run(batches):
        for columns in _whole(batches, ("suffix", "upper", "key", "n", "t", "q", "d"), lambda x: x[0]):
            yield from solve(*columns)

    return run


def _whole(batches, names: tuple[str, ...], group) -> Iterator[list[np.ndarray]]:
    """Columns of runs of rows that are cut between groups alone. Rows come in order of their group."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        size += batch.num_rows
        if size >= ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            of = group(columns)
            cut = int(np.searchsorted(of, of[-1]))
            if cut:
                yield [x[:cut] for x in columns]
            held = [[x[cut:] for x in columns]]
            size -= cut
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


class Lookup:
    """Values by key in open addressing, for arrays of keys from 0; what is not in it is `missing`."""

    def __init__(self, key: np.ndarray, value: np.ndarray, missing: float = math.nan):
        bits = max(4, int(2 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]  # of several for one slot the last stays
            placed = self.keys[at] == key
            self.values[at[placed]] = value[placed]
            key, value, at = key[~placed], value[~placed], (at[~placed] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        out, own = self.values[at], self.keys[at]
        rest = np.nonzero((own != key) & (own >= 0))[0]
        at, key = at[rest], key[rest]
        while len(rest):
            at = (at + 1) & self.mask
            own = self.keys[at]
            done = (own == key) | (own < 0)
            out[rest[done]] = self.values[at[done]]
            rest, at, key = rest[~done], at[~done], key[~done]
        return out


class Head:
    """The most frequent keys' values, in every task."""

    def __init__(self, rows: pa.Table):
        kind = rows.column("kind").to_numpy()
        arrays = {k: [rows.column(c).to_numpy()[kind == k] for c in ("key", "value")] for k in (WORD_KIND, GRAM_KIND)}
        self.arrays, self.found = arrays, {}

    def __getitem__(self, kind: int) -> Lookup:
        if kind not in self.found:
            self.found[kind] = Lookup(*self.arrays[kind])
        return self.found[kind]

    def __getstate__(self) -> dict:
        return {"arrays": self.arrays, "found": {}}  # the tables are made where they are used


def _needed(order: int, head: Head):
    """Blocks to (block, kind, key): what they need and the head has not."""

    def told(block: int, kind: int, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = key[np.isnan(head[kind][key])]
        for at in range(0, len(key), ROWS):
            k = key[at : at + ROWS]
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(k), block, np.int64)), "kind": pa.array(np.full(len(k), kind, np.int8)), "key": pa.array(k)})

    def run(batches):
        for batch in batches:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs")):
                words: set[bytes] = set()
                held: list[np.ndarray] = []
                for g in grams(_texts(unpacked(docs.as_py())), order):
                    words.update(*g.words)
                    held.append(runs(g.keys)[0])
                    if sum(map(len, held)) > 4 * PIECE:
                        held = [runs(np.concatenate(held))[0]]
                yield from told(block, GRAM_KIND, runs(np.concatenate(held))[0])
                yield from told(block, WORD_KIND, np.unique(np.fromiter(map(word_key, words), np.int64, len(words))))

    return run


def _score(order: int, tokens: int, distinct: int, ends: int, head: Head):
    base, end = math.log10(tokens + distinct + 1), math.log10(ends + 1)

    def run(blocks: pa.Table, values: pa.Table) -> pa.Table:
        kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
        own = {k: Lookup(key[kind == k], value[kind == k]) for k in (WORD_KIND, GRAM_KIND)}

        def get(kind: int, key: np.ndarray) -> np.ndarray:
            out = head[kind][key]
            rest = np.isnan(out)
            out[rest] = own[kind][key[rest]]
            return out

        cache: dict[bytes, float] = {}
        out = []
        for docs in blocks.column("docs"):
            table = unpacked(docs.as_py())
            rows = table.num_rows
            n, known, by_counts, total = np.ones(rows, np.int64), np.full(rows, int(ends > 0)), np.full(rows, end), np.zeros(rows)
            for g in grams(_texts(table), order):
                np.add.at(total, g.text, np.add.reduceat(get(GRAM_KIND, g.keys), g.at))
                new = list(set().union(*g.words).difference(cache))
                cache.update(zip(new, get(WORD_KIND, np.fromiter(map(word_key, new), np.int64, len(new))).tolist()))
                for i, words in zip(g.text, g.words):
                    got = list(map(cache.__getitem__, words))
                    n[i] += len(got)
                    known[i] += len(got) - got.count(0.0)
                    by_counts[i] += math.fsum(got)
            out.append(pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": n, "n_known": known, "train_tokens": np.full(rows, tokens), "base_score": by_counts - n * base, "score": total}))
        return pa.concat_tables(out)

    return run


def _solved(trie: DataFrame, order: int) -> DataFrame:
    """trie(key, n) of the longest order to (kind, key, value), order after order; each is a table in the shared folder until the next is done."""
    counts = {order: trie}
    for k in range(order - 1, 1, -1):
        counts[k] = written(counts[k + 1].groupBy(F.col("key").bitwiseAND(_mask(k)).alias("key")).agg(F.sum("n").alias("n")), "ppm-order")
    pairs = np.zeros((257, 257))
    for r in counts[2].groupBy(F.col("key").bitwiseAND(_mask(1)).alias("pair")).agg(F.sum("n").alias("n")).filter("n > 0").collect():  # 257 * 257 rows at most
        pairs[r["pair"] >> BITS, r["pair"] & 511] = r["n"]
    dealt = counts[2].repartition(F.shiftright("key", BITS)).sortWithinPartitions("key")
    solved = dealt.mapInArrow(_second(pairs, order == 2), VALUE if order == 2 else LEVEL)
    for k in range(3, order + 1):
        lower = solved.select(F.shiftright("key", BITS).alias("suffix"), F.lit(False).alias("upper"), "key", "n", "t", "q", "d")
        zero = F.lit(0.0)
        upper = counts[k].select(F.shiftright("key", BITS).bitwiseAND(_mask(k - 2)).alias("suffix"), F.lit(True).alias("upper"), "key", "n", zero.alias("t"), zero.alias("q"), zero.alias("d"))
        dealt = upper.unionByName(lower).repartition("suffix").sortWithinPartitions("suffix")
        solved = dealt.mapInArrow(_higher(k, k == order), VALUE if k == order else LEVEL)
    out = written(solved, "ppm-logs")
    dropped(*(counts[k] for k in range(2, order)))
    return out


def _head(summed: DataFrame) -> DataFrame:
    """kind, key of the most frequent keys, about HEAD of a kind: a histogram over classes of counts (a sixteenth of an octave each, so at most 1,025) tells from which class on
    all are taken, and of the next class a share by hash. Nothing is sorted or brought into one task; which keys they are doesn't change a score."""
    step = F.when(F.col("n") > 0, F.floor(F.log2(F.when(F.col("n") > 0, F.col("n")).otherwise(1)) * 16)).otherwise(-1).cast("int")
    sizes = summed.groupBy("kind", step.alias("step")).count().collect()
    found = F.lit(False)
    for kind, most in HEAD.items():
        held, above, cut, share = 0, 1 << 30, 0, 0.0
        for r in sorted((r for r in sizes if r["kind"] == kind), key=lambda r: -r["step"]):
            cut, share = r["step"], min(1.0, (most - held) / r["count"])
            if share < 1:
                break
            held, above = held + r["count"], r["step"]
        drawn = (step == cut) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
        found = found | ((F.col("kind") == kind) & ((step >= above) | drawn))
    return summed.filter(found).select("kind", "key")


def score(docs: DataFrame, held_out, order: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """held_out: a condition on docs; the other rows train. Returns the columns of OUT: scores are log10 probabilities, base_score that of
    the tokens by counts plus one. order: 2 to 6. The model is learned and the blocks are written when this is called."""
    if not 2 <= order <= 6:
        raise ValueError("order is 2 to 6")
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = written(rows.mapInArrow(_pack(block_bytes), "block long, docs binary"), "ppm-blocks", compression="none", maxRecordsPerFile="8")
    counted = blocks.select("docs").mapInArrow(_count(order), "kind byte, key long, n long")
    summed = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-sums", compression="zstd")
    words = summed.filter(F.col("kind") == WORD_KIND)
    tokens, distinct, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum(F.when(F.col("key") == END_KEY, F.col("n"))), F.lit(0))).first()
    logs = _solved(summed.filter(F.col("kind") == GRAM_KIND).select("key", "n"), order)
    values = logs.unionByName(words.filter(F.col("key") != END_KEY).select("kind", "key", F.log10(F.col("n") + 1).alias("value")))
    head = Head(values.join(_head(summed.filter(F.col("key") != END_KEY)), ["kind", "key"], "left_semi").toArrow())
    needed = blocks.mapInArrow(_needed(order, head), "block long, kind byte, key long")
    # As many parts as blocks at least, so that a task has a few blocks whatever the input (each task makes its own table of the frequent keys); what blocks need is dealt alike.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.select("block").distinct().count())
    joined = needed.join(values, ["kind", "key"]).repartition(parts, "block")
    return blocks.repartition(parts, "block").groupBy("block").cogroup(joined.groupBy("block")).applyInArrow(_score(order, tokens, distinct, ends, head), OUT)

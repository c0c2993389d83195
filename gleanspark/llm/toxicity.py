"""Toxicity: a linear classifier regularised by counterfactuals.

1. Hashed features of a text: its words and their beginnings of four to six letters; presence alone, so length does not matter. All labelled
   training rows are counted by feature and label, out of LABELS labels at most.
2. All features whose shares differ between the labels beyond chance, and by a ratio of two at least, are the model's inputs, however many they are (DIM at most);
   so are those of the terms of step 3.
3. Logistic regression on at most `sample` training rows, taken by hash. For texts that name a group, each identity term is swapped for
   another group's and the squared change of the score is added to the loss, so that naming a group by itself moves no score.

Terms for groups are a parameter. IDENTITY has some of four languages; `found_terms` adds those of the tables themselves: words that toxic rows name more often than
clean ones though most rows that name them are clean, which is what makes neutral mentions of a group look toxic. The model tells how many pairs entered its fit.

Texts meet labels where they are read: LABELS of them at most, taken by hash beyond that, go to every task.

Null and blank texts get the score of the intercept. Rows of null id have no label. Repeated rows count as often as they occur and are fitted once; a very
long text is read whole. Extra columns, whatever their names, are ignored. An empty table gives an empty result.
Without training rows, or with one label alone, every score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, bounded, chunks, dropped, map_batches, text_bytes, written

DIM = 1 << 20
#: So many labels are learned from at most: they go to every task, where texts are read, so no text is shuffled.
LABELS = 1 << 21
PUNCTUATION = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"
#: Terms for groups of people, by language; any of a row can stand for any other of it.
IDENTITY = tuple(tuple(x.encode() for x in row.split()) for row in (
    "women men girls boys", "woman man girl boy", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "gay lesbian straight bisexual transgender", "black white asian latino african european american", "immigrants refugees foreigners natives citizens", "mexican chinese indian german french spanish arab turkish",
    "old young elderly", "deaf blind disabled", "frauen männer mädchen jungen", "muslime christen juden", "schwarze weiße", "ausländer flüchtlinge einheimische",
    "femmes hommes filles garçons", "musulmans chrétiens juifs", "noirs blancs", "étrangers réfugiés", "mujeres hombres niñas niños", "musulmanes cristianos judíos", "negros blancos", "extranjeros refugiados",
))


def swaps(terms: tuple[tuple[bytes, ...], ...] = IDENTITY) -> dict[bytes, bytes]:
    """For each term the next one of its row; of a term in several rows the first counts."""
    out: dict[bytes, bytes] = {}
    for row in terms:
        for k, w in enumerate(row):
            out.setdefault(w, row[(k + 1) % len(row)])
    return out


SWAP = swaps()


def bare(text: bytes) -> list[bytes]:
    """Distinct words, A to Z lower-cased, without punctuation around them."""
    return [w for w in {x.strip(PUNCTUATION) for x in set(text.lower().split())} if w]


def slots(words: list[bytes]) -> set[int]:
    crc = zlib.crc32
    out = {crc(w) & (DIM - 1) for w in words}
    for k in (4, 5, 6):
        out.update({crc(w[:k], 7) & (DIM - 1) for w in words if len(w) > k})
    return out


def swapped(words: list[bytes], swap: dict[bytes, bytes] = SWAP) -> list[bytes] | None:
    """The words with each identity term replaced by another group's; None where there is none."""
    return [swap.get(w, w) for w in words] if any(w in swap for w in words) else None


@dataclass
class ToxicityModel:
    """weight by feature; bias; how many texts entered the fit with their swapped form."""

    bias: float
    weight: dict[int, float] = field(default_factory=dict)
    pairs: int = 0

    def score(self, text: bytes) -> float:
        get = self.weight.get
        z = self.bias + sum(get(x, 0.0) for x in slots(bare(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def select(feature: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Features whose shares among either label differ by over 3.5 standard errors, corrected for the counts' steps of one, and by a ratio of two at least:
    a feature as common in the other label is noise however significant."""
    p, q = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    pooled = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    steps = 1 / max(n_toxic, 1) + 1 / max(n_clean, 1)
    z = (np.abs(p - q) - steps / 2) / np.sqrt(pooled * (1 - pooled) * steps)
    return np.sort(feature[(z > 3.5) & (np.maximum(p / q, q / p) > 2)])


def train(rows: list[tuple[list[int], list[int] | None, int]], features: np.ndarray, rounds: int = 800, rate: float = 0.3, decay: float = 1e-5, fairness: float = 1.0) -> ToxicityModel:
    """rows: (features, features after the swap or None, label). Adagrad over all of them."""
    place = {int(f): k for k, f in enumerate(features)}
    d = len(place)

    def sparse(lists):
        own = [[place[x] for x in r if x in place] for r in lists]
        return np.array([x for r in own for x in r], np.int64), np.repeat(np.arange(len(own)), [len(r) for r in own])

    y = np.array([r[2] for r in rows], float)
    col, row = sparse([r[0] for r in rows])
    pairs = [r for r in rows if r[1] is not None]
    acol, arow = sparse([r[0] for r in pairs])
    bcol, brow = sparse([r[1] for r in pairs])
    prior = (y.sum() + 0.5) / (len(y) + 1)
    w, bias = np.zeros(d), float(np.log(prior / (1 - prior)))
    g2, b2 = np.full(d, 1e-6), 1e-6
    n, m = max(len(y), 1), max(len(pairs), 1)
    weight = np.where(y > 0, 0.5 / max(prior, 1e-3), 0.5 / max(1 - prior, 1e-3)) ** 0.5
    for _ in range(rounds):
        z = np.bincount(row, w[col], minlength=len(y)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(col, e[row], minlength=d) / n + decay * w
        gb = e.sum() / n
        if pairs:
            za, zb = np.bincount(arow, w[acol], minlength=len(pairs)) + bias, np.bincount(brow, w[bcol], minlength=len(pairs)) + bias
            sa, sb = 1 / (1 + np.exp(-np.clip(za, -30, 30))), 1 / (1 + np.exp(-np.clip(zb, -30, 30)))
            gap = 2 * fairness * (sa - sb) / m
            g += np.bincount(acol, (gap * sa * (1 - sa))[arow], minlength=d) - np.bincount(bcol, (gap * sb * (1 - sb))[brow], minlength=d)
            # and of the scores before the squashing, which does not vanish where both are near 0 or 1
            flat = 0.1 * fairness * (za - zb) / m
            g += np.bincount(acol, flat[arow], minlength=d) - np.bincount(bcol, flat[brow], minlength=d)
        g2 += g * g
        b2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        bias -= rate * gb / np.sqrt(b2)
    return ToxicityModel(bias, {int(f): float(w[k]) for f, k in place.items() if w[k]}, len(pairs))


def _labelled(docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """id, text, rank (hash of both), toxic of the training rows that have a label."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").distinct()
    share = min(1.0, 0.98 * LABELS / max(known.count(), 1))
    side = F.broadcast(known.filter(F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))))
    texts = docs.filter(training).select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id", "text").alias("rank"))
    return texts.join(side, F.col("id") == F.col("label_id")).select("id", "rank", "toxic", "text")


def _below(n: int, sample: int) -> int:
    """The rank up to which about 1.3 times `sample` of n rows lie."""
    share = min(1.0, 1.3 * sample / max(n, 1))
    return 2**63 - 1 if share == 1 else int(-(2**63) + share * (2**64 - 1))


def found_terms(docs: DataFrame, labels: DataFrame, training, most: int = 64, sample: int = 30_000) -> tuple[tuple[bytes, ...], ...]:
    """Rows of two terms, neighbours by how many rows name them, out of the `most` most frequent words that toxic rows name more often than clean ones, by a ratio of 1.1
    to two (beyond which a word is a model's input by itself), while most rows that name it are clean. Words of fewer than three letters are none, and there are no more
    terms than a quarter of the toxic rows (but two). Counted over about
    1.3 times `sample` labelled training rows at most, taken by hash."""
    bounded(docs.sparkSession)
    joined = _labelled(docs, labels, training)
    rows = joined.filter(F.col("rank") <= _below(joined.count(), sample)).dropDuplicates(["rank", "toxic"]).select("toxic", "text")
    arrow = arrow_schema(docs.sparkSession, schema := "word binary, toxic long, clean long")

    def run(batches):
        """Counts of a task's words; a null word counts the rows."""
        both = (Counter(), Counter())
        for batch in batches:
            for text, t in zip(text_bytes(batch.column("text")), batch.column("toxic").to_pylist()):
                both[t].update(w for w in bare(text) if len(w) > 2)
                both[t][None] += 1
        names = list(both[0].keys() | both[1].keys())
        for at in range(0, len(names), 1 << 16):
            part = names[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([both[1][w] for w in part], pa.int64()), pa.array([both[0][w] for w in part], pa.int64())], schema=arrow)

    counts = rows.mapInArrow(run, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts.filter("word is null or toxic >= 3 and clean > toxic"), "terms")
    total = counts.filter("word is null").first()
    found = []
    if total and total["toxic"] and total["clean"]:
        ratio = (F.col("toxic") / total["toxic"]) / (F.col("clean") / total["clean"])
        found = [bytes(r["word"]) for r in counts.filter(F.col("word").isNotNull() & (ratio > 1.1) & (ratio < 2)).orderBy((F.col("toxic") + F.col("clean")).desc(), "word").limit(min(most, max(2, total["toxic"] // 4))).collect()]
    dropped(counts)
    return tuple(tuple(found[k : k + 2]) for k in range(0, len(found) - 1, 2))


def fit(docs: DataFrame, labels: DataFrame, training, sample: int = 30_000, terms: tuple[tuple[bytes, ...], ...] = IDENTITY) -> ToxicityModel:
    """training: a condition on docs' doc_id. Counts cover all labelled training rows; the regression at most `sample` of them."""
    bounded(docs.sparkSession)
    joined = _labelled(docs, labels, training)
    n = joined.count()
    below, swap = _below(n, sample), swaps(terms)
    arrow = arrow_schema(docs.sparkSession, schema := "feature int, clean long, toxic long, rank long, label int, own array<int>, other array<int>")

    def run(batches):
        """Counts of a task's features (-1: of its rows), and the features of the rows that may be in the sample."""
        both = np.zeros((2, DIM), np.int64)
        rows = [0, 0]
        for batch in batches:
            for part in chunks(batch, "text"):
                drawn = []
                for x, t, r in zip(text_bytes(part.column("text")), part.column("toxic").to_pylist(), part.column("rank").to_pylist()):
                    words = bare(x)
                    own = slots(words)
                    both[t, np.fromiter(own, np.int64, len(own))] += 1
                    rows[t] += 1
                    if r <= below:
                        other = swapped(words, swap)
                        drawn.append((None, None, None, r, t, sorted(own), None if other is None else sorted(slots(other))))
                if drawn:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*drawn), arrow)], schema=arrow)
        on = np.nonzero(both.any(axis=0))[0]
        counts = [np.append(on, -1), np.append(both[0, on], rows[0]), np.append(both[1, on], rows[1])]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(counts, arrow)), *(pa.nulls(len(on) + 1, f.type) for f in list(arrow)[3:])], schema=arrow)

    made = written(joined.select("rank", "toxic", "text").mapInArrow(run, schema), "toxicity", compression="zstd")
    table = made.filter("feature is not null").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # DIM rows at most
    feature, clean, toxic = (table.column(c).to_numpy() for c in ("feature", "clean", "toxic"))
    total = feature == -1
    n_clean, n_toxic = (int(x[total].sum()) for x in (clean, toxic))
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    if not n_clean or not n_toxic:
        dropped(made)
        return ToxicityModel(float(np.log(prior / (1 - prior))))
    # Terms are inputs too: only then can naming a group move a score, and the penalty keep it from doing so.
    named = np.array(sorted(slots(sorted(swap))), np.int64)
    features = np.union1d(select(feature[~total], toxic[~total], clean[~total], n_toxic, n_clean), named[np.isin(named, feature)])

    def only(batches):
        """Of the sample's features, those that the model takes."""
        for batch in batches:
            kept = {c: [None if r is None else [x for x in r if x in chosen] for r in batch.column(c).to_pylist()] for c in ("own", "other")}
            yield pa.RecordBatch.from_pydict({"rank": batch.column("rank"), "label": batch.column("label")} | {c: pa.array(v, pa.list_(pa.int32())) for c, v in kept.items()})

    chosen = frozenset(features.tolist())
    drawn = made.filter("rank is not null").dropDuplicates(["rank", "label"]).select("rank", "label", "own", "other").mapInArrow(only, "rank long, label int, own array<int>, other array<int>")
    rows = drawn.orderBy("rank", "label").limit(sample).toArrow().to_pylist()
    dropped(made)
    return train([(r["own"], r["other"], r["label"]) for r in rows], features)


def gap(texts: list[bytes], model: ToxicityModel, terms: tuple[tuple[bytes, ...], ...] = IDENTITY) -> tuple[int, float]:
    """How many texts name a term, and the mean absolute change of their log odds when it is swapped."""
    swap, changes = swaps(terms), []
    for x in texts:
        words = bare(x)
        other = swapped(words, swap)
        if other is not None:
            changes.append(abs(sum(model.weight.get(f, 0.0) for f in slots(words)) - sum(model.weight.get(f, 0.0) for f in slots(other))))
    return len(changes), float(np.mean(changes)) if changes else 0.0


def score(docs: DataFrame, model: ToxicityModel, held_out, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(part: pa.RecordBatch) -> dict:
        got = [model.score(x) for x in text_bytes(part.column("text"))]
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": got, "predicted": [int(x >= threshold) for x in got]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")

"""Quality classifier: heuristic labellers, accuracies by expectation-maximisation, a hashed linear scorer.

1. Ten overlapping labellers vote good, bad or nothing on every document (symbols, capitals, separators, repetition ...).
2. The votes of all distinct texts are counted by pattern, at most 3^10 of them; EM over those counts estimates each labeller's
   accuracy in either class and from them the posterior of each pattern.
3. The posteriors are the soft labels of a logistic scorer over hashed features (word shapes, pairs of shapes, bucketed
   statistics). It is fitted on at most `sample` distinct texts, those with the smallest hash; everything else covers all of them.

A text counts once however many documents have it, so copies move neither the votes nor the fit. One pass over the texts makes votes and features.

Score: probability that a document is good. A null, empty or blank text has score 0 and is rejected. Repeated rows get equal
scores; a very long text is read whole. Extra columns, whatever their names, are ignored by `score` and kept by `keep`. An empty table gives an empty
result, and its model scores 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, bounded, chunks, dropped, text_bytes, written

ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "shouting", "capitals", "separators", "vocabulary", "lines", "top word", "word pairs", "letters", "stutter")
DIM = 1 << 12
#: Bytes to their classes: a for lower case and beyond ASCII, A for capitals, 0 for digits, white space as a space or a new line.
SHAPE = bytes(ord("\n") if c == 10 else 32 if c in range(9, 14) else ord("0") if 48 <= c <= 57 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256))
PLAIN = frozenset(b"aA0.,;:'\"-?!()")


@dataclass
class Statistics:
    """values: of the labellers in order; shapes: how often each word shape occurs."""

    n: int
    values: list[float | None]
    shapes: Counter
    pairs: Counter


def statistics(text: bytes) -> Statistics:
    words = text.split()
    n = len(words)
    if not n:
        return Statistics(0, [None] * len(LABELLERS), Counter(), Counter())
    classes = text.translate(SHAPE)
    array = np.frombuffer(classes, np.uint8)
    shaped = array[np.append(True, array[1:] != array[:-1])].tobytes().split()
    shapes = Counter(shaped)
    pairs = Counter(zip(shaped, shaped[1:]))
    letters, capitals = classes.count(b"a") + classes.count(b"A"), classes.count(b"A")
    solid = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = sum(c for s, c in shapes.items() if not PLAIN.issuperset(s) and len(s) > 1)
    bare = sum(c for s, c in shapes.items() if not any(x in b"aA0" for x in s))
    values = [
        odd / n,
        text.count(b"!!") / n,
        capitals / letters if letters >= 20 else None,
        bare / n,
        len(counts) / n if n >= 20 else None,
        len(set(lines)) / len(lines) if len(lines) >= 4 else None,
        max(counts.values()) / n if n >= 20 else None,
        len(set(zip(words, words[1:]))) / (n - 1) if n >= 20 else None,
        (letters + classes.count(b"0")) / solid,
        sum(map(bytes.__eq__, words, words[1:])) / n if n >= 20 else None,
    ]
    return Statistics(n, values, shapes, pairs)


#: (bad from, good to) where high values are bad; (good from, bad to) reversed where low values are bad.
LIMITS = ((0.10, 0.02), (0.10, 0.02), (0.30, 0.15), (0.08, 0.02), (0.35, 0.45), (0.50, 0.70), (0.25, 0.15), (0.50, 0.70), (0.75, 0.88), (0.20, 0.05))


def votes(values: list[float | None]) -> list[int]:
    out = []
    for x, (bad, good) in zip(values, LIMITS):
        if x is None:
            out.append(ABSTAIN)
        elif bad > good:
            out.append(BAD if x >= bad else GOOD if x <= good else ABSTAIN)
        else:
            out.append(BAD if x <= bad else GOOD if x >= good else ABSTAIN)
    return out


def pattern(values: list[float | None]) -> int:
    k = 0
    for v in votes(values):
        k = 3 * k + v
    return k


def unpack(patterns: np.ndarray) -> np.ndarray:
    """Patterns to a matrix of votes, one column for each labeller."""
    return np.stack([patterns // 3 ** (len(LABELLERS) - 1 - j) % 3 for j in range(len(LABELLERS))], axis=1)


@dataclass
class LabelModel:
    """accuracy[y, j]: how often labeller j, where it votes, is right on class y (0 bad, 1 good)."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, matrix: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        hit, miss = np.log(self.accuracy), np.log1p(-self.accuracy)
        says_bad, says_good = (matrix == BAD).astype(float), (matrix == GOOD).astype(float)
        good = np.log(self.prior) + says_good @ hit[1] + says_bad @ miss[1]
        bad = np.log1p(-self.prior) + says_bad @ hit[0] + says_good @ miss[0]
        return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))


def expectation_maximisation(matrix: np.ndarray, counts: np.ndarray, rounds: int = 100, least: float = 0.52, floor: float = 0.05, most: float = 0.999) -> LabelModel:
    """From vote patterns and how many documents have each. Starts at: any vote for bad makes bad likelier. least and floor: bounds below of a labeller's
    accuracy on good and on bad documents."""
    says_bad, says_good = (matrix == BAD).astype(float), (matrix == GOOD).astype(float)
    q = np.clip(0.9 - 0.4 * says_bad.sum(1), 0.05, 0.95)
    model = LabelModel(0.5, np.full((2, matrix.shape[1]), 0.7))
    for _ in range(rounds):
        good, bad = counts * q, counts * (1 - q)
        right = np.stack([bad @ says_bad, good @ says_good])
        cast = np.stack([bad @ (says_bad + says_good), good @ (says_bad + says_good)])
        accuracy = np.clip((right + 1) / (cast + 2), [[floor], [least]], most)
        model = LabelModel(float(np.clip(good.sum() / max(counts.sum(), 1), 0.02, 0.98)), accuracy)
        new = model.posterior(matrix)
        done = np.abs(new - q).max(initial=0) < 1e-7
        q = new
        if done:
            break
    return model


def slot(kind: bytes, x: bytes) -> int:
    return zlib.crc32(kind + x) & (DIM - 1)


def features(s: Statistics) -> tuple[list[int], list[float]]:
    """Hashed features: shares of shapes and of pairs of shapes, bucketed statistics, and a constant."""
    got: dict[int, float] = {slot(b"1", b""): 1.0}
    for x, c in s.shapes.items():
        k = slot(b"s", x)
        got[k] = got.get(k, 0.0) + c / s.n
    for (x, y), c in s.pairs.items():
        k = slot(b"p", x + b" " + y)
        got[k] = got.get(k, 0.0) + c / s.n
    for j, x in enumerate(s.values):
        k = slot(b"v%d" % j, b"-" if x is None else b"%d" % min(int(x * 20), 40))
        got[k] = got.get(k, 0.0) + 1.0
    return list(got), list(got.values())


def fit_linear(index: np.ndarray, value: np.ndarray, rows: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adagrad over all rows; index, value and rows are the entries of a sparse matrix."""
    w, g2 = np.zeros(DIM), np.full(DIM, 1e-6)
    n = max(len(target), 1)
    for _ in range(rounds):
        z = np.bincount(rows, value * w[index], minlength=len(target))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(index, value * e[rows], minlength=DIM) / n + decay * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    documents: int
    known: dict[int, float] = field(default_factory=dict)

    def posterior(self, k: int) -> float:
        """Of a pattern of votes; each is computed once."""
        if k not in self.known:
            self.known[k] = float(self.labels.posterior(unpack(np.array([k])))[0])
        return self.known[k]

    def score(self, text: bytes) -> tuple[float, float]:
        """(posterior of the label model, score)."""
        s = statistics(text)
        if not s.n:
            return 0.0, 0.0
        index, value = features(s)
        z = float(np.dot(self.weights[index], value))
        return self.posterior(pattern(s.values)), 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit(docs: DataFrame, sample: int = 20_000) -> QualityModel:
    """Votes of all distinct texts make the label model; the scorer sees at most `sample` of them, those of smallest hash."""
    bounded(docs.sparkSession)
    h1, h2 = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    texts = docs.filter(F.col("text").isNotNull()).select("text", h1.alias("h1"), h2.alias("h2"))
    about = texts.agg(F.approx_count_distinct("h1", 0.01)).first()[0]  # how many rows to make features of, nothing else
    share = min(1.0, 1.3 * sample / max(about, 1))
    below = 2**63 - 1 if share == 1 else int(-(2**63) + share * (2**64 - 1))
    arrow = arrow_schema(docs.sparkSession, schema := "h1 long, h2 long, pattern int, index array<int>, value array<float>")

    def prepare(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                made = []
                for x, p, q in zip(text_bytes(part.column("text")), part.column("h1").to_pylist(), part.column("h2").to_pylist()):
                    s = statistics(x)
                    if s.n:
                        made.append((p, q, pattern(s.values), *(features(s) if p <= below else (None, None))))
                cols = list(zip(*made)) if made else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

    each = texts.mapInArrow(prepare, schema).groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("pattern", "index", "value")])
    made = written(each, "votes")
    counted = made.groupBy("pattern").count().collect()  # 3^10 rows at most
    matrix, counts = unpack(np.array([r[0] for r in counted], np.int64)), np.array([r[1] for r in counted], float)
    labels = expectation_maximisation(matrix, counts, least=0.99, floor=0.3)  # the labellers' limits are such that good texts seldom pass them
    rows = made.filter("index is not null").orderBy("h1", "h2").limit(sample).select("pattern", "index", "value").toArrow()
    dropped(made)
    weights = np.zeros(DIM)
    if rows.num_rows:
        column = rows.column("index").combine_chunks()
        target = labels.posterior(unpack(rows.column("pattern").to_numpy()))
        entries = np.repeat(np.arange(rows.num_rows), np.diff(column.offsets.to_numpy()))
        weights = fit_linear(column.flatten().to_numpy().astype(np.int64), rows.column("value").combine_chunks().flatten().to_numpy().astype(float), entries, target)
    return QualityModel(labels, weights, int(counts.sum()))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, label_posterior, score, keep (1 where the score reaches the threshold)."""
    arrow = arrow_schema(docs.sparkSession, out := "doc_id long, label_posterior double, score double, keep int")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                got = [model.score(x) for x in text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.float64()), pa.array([int(x[1] >= threshold) for x in got], pa.int32())], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def keep(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, whatever their columns, that the scorer keeps."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield part.filter(pa.array([model.score(x)[1] >= threshold for x in text_bytes(part.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

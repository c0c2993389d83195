"""Model calls as vectorised functions, with deterministic stand-ins; a real model is any callable of the same shape."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .batches import small_batches

DIM = 256
#: Characters that are counted at once, or one text.
AT_ONCE = 1 << 18


def hashed_trigrams(texts: list[str], dim: int = DIM, dtype: type = np.float32) -> list[np.ndarray]:
    """Lower-cased character trigrams, each at the slot of its MD5's first four bytes; unit length. The distinct trigrams of some texts are hashed once, the others counted as
    numbers."""
    out: list[np.ndarray] = []
    slots: dict[int, int] = {}
    lowered = [(t or "").lower() for t in texts]
    first = 0
    while first < len(lowered):
        last, chars = first + 1, len(lowered[first])
        while last < len(lowered) and chars + len(lowered[last]) <= AT_ONCE:
            chars += len(lowered[last])
            last += 1
        out += _counted(lowered[first:last], dim, dtype, slots)
        first = last
    return out


def _counted(texts: list[str], dim: int, dtype: type, slots: dict[int, int]) -> list[np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    counts = np.zeros((len(texts), dim))
    if len(code) > 2:
        letters, number = np.unique(code, return_inverse=True) if code.max() >= 1 << 16 else _numbered(code)
        n = len(letters)
        gram = (number[:-2] * n + number[1:-1]) * n + number[2:]
        within = row[:-2] == row[2:]
        gram, row = gram[within], row[:-2][within]
        distinct, at = np.unique(gram, return_inverse=True) if n**3 > 1 << 22 else _numbered(gram)
        own = np.empty(len(distinct), np.int64)
        for k, (a, b, c) in enumerate(zip(*(letters[x].tolist() for x in (distinct // (n * n), distinct // n % n, distinct % n)))):
            key = (a << 21 | b) << 21 | c
            if key not in slots:
                slots[key] = int.from_bytes(hashlib.md5((chr(a) + chr(b) + chr(c)).encode()).digest()[:4], "little") % dim
            own[k] = slots[key]
        counts = np.bincount(row * dim + own[at], minlength=len(texts) * dim).reshape(len(texts), dim)
    out = []
    for v in counts.astype(dtype):
        n = float(np.linalg.norm(v))
        out.append(v / n if n else v)
    return out


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse of small numbers, without a sort."""
    seen = np.zeros(int(x.max(initial=0)) + 1, bool)
    seen[x] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[x]


def embed(text: Column, model: Callable[[list[str]], list[np.ndarray]] = hashed_trigrams) -> Column:
    small_batches()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float32) for v in model(texts.tolist())])

    return run(text)


def embed_exactly(text: Column) -> Column:
    """The stand-in in double precision, where ranks must not hang on rounding."""
    small_batches()

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_trigrams(texts.tolist(), dtype=np.float64)))

    return run(text)


def ask(prompt: Column, model: Callable[[list[str]], list[str]] | None = None) -> Column:
    """Answers of a language model; the stand-in repeats the prompt's last line."""
    small_batches()
    answer = model or (lambda prompts: [(p or "").strip().rpartition("\n")[2] for p in prompts])

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(answer(prompts.tolist()))

    return run(prompt)

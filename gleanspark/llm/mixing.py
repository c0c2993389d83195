"""Mixing sources to target weights by pivotal dependent rounding.

A source of S words with a target of T words wants T / S copies of each document: the whole part goes to every document, the
rest is a copy probability. Documents are paired and mass is moved from one to the other, at random in proportion, until one
of the two is integral; what is moved is weighed in words, so each transfer keeps the source's expected words exactly. A bucket
of documents ends with at most one fractional document; these meet in the next level of a reduction tree, until one is left
for each source and is rounded by its own chance, so every document's chance is what it started with. Within a bucket the longest come first: what is
left over is about as long as all shorter ones together, and by that much at most a source's words miss its target.

Repeated rows (equal id, source and text) are one unit and get equal copies. Null or blank texts have size 0 and none is taken.
A null source is a source of its own, after the others. Sources without words have the target 0. All randomness is a hash of seed,
id and text, so reruns agree. A very long text counts as many words as it has. Extra columns are ignored by `decisions` and kept by `mix`,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import mix64, n_words, whole, written

BUCKET, FAN = 1024, 64
EPS = 1e-12


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, n_rows, target: shares by weight (in turn over the sources by code point, null last), held to cap times each
    source's size; the excess goes to the others by weight until none is above. One row for each source, windowed together."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    # By cap for each unit of weight, those that are held to their cap come first; the level is what a unit of weight gets after them.
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    held = held.withColumn("total", F.sum("source_size").over(everything))
    held = held.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    held = held.withColumn("free", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), (-F.col("level")).alias("less")))).over(everything))
    level = -F.col("free").getField("less")
    return held.select("source", "source_size", "n_rows", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap")).alias("target"))


def settle(words: np.ndarray, p: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Pairs the units in the given order; (the probabilities, all integral but at most one; its place or -1)."""
    p = p.copy()
    p[words <= 0] = 0.0
    at = -1
    salt = int(mix64(np.array([seed], np.uint64))[0])
    draw = (mix64(key.astype(np.uint64) ^ np.uint64(salt)) >> np.uint64(11)).astype(float) / 2**53
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        if at < 0:
            at = i
            continue
        u, v = words[at], words[i]
        gain, loss = min((1 - p[at]) * u, p[i] * v), min(p[at] * u, (1 - p[i]) * v)
        moved = gain if draw[i] * (gain + loss) < loss else -loss
        p[at] += moved / u
        p[i] -= moved / v
        first, second = (x <= EPS * 1e3 or x >= 1 - EPS * 1e3 for x in (p[at], p[i]))
        if first:
            p[at] = round(p[at])
        if second:
            p[i] = round(p[i])
        at = -1 if first and second else i if first else at
    return p, at


def _level(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last = pdf["buckets"].iloc[0] == 1
        pdf = pdf.sort_values(["words", "key", "id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        words, start, key = pdf["words"].to_numpy(float), pdf["p"].to_numpy(float), pdf["key"].to_numpy(np.int64)
        p, at = settle(words, start, key, seed + level)
        if last and at >= 0:  # the root: the last unit is in by its own chance
            u = float(mix64(key[at : at + 1].astype(np.uint64) ^ np.uint64(seed + 7919))[0] >> np.uint64(11)) / 2**53
            p[at], at = float(u < p[at]), -1
        pdf["p"] = p
        pdf["open"] = np.arange(len(pdf)) == at
        return pdf

    return run


def decisions(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20) -> DataFrame:
    """One row for each distinct document: id, source, key (hash of id and text), n (equal rows), size, source_size, target, copies."""
    sized = docs.select(F.col("doc_id").cast("long").alias("id"), "source", F.xxhash64("doc_id", "text").alias("key"), n_words(F.col("text")).alias("size"))
    units = written(sized.groupBy("id", "source", "key", "size").agg(F.count("*").alias("n")), "mix-units")  # words are counted once
    per_source = targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap)
    joined = units.join(per_source, units["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    ready = joined.withColumn("ratio", ratio).withColumn("base", F.floor("ratio").cast("int")).withColumn("p", F.col("ratio") - F.col("base")).withColumn("words", (F.col("size") * F.col("n")).cast("double")).drop("ratio")
    # Each source has as many buckets as its documents need, so that one with a third of all rows is dealt out as well.
    ready = ready.withColumn("buckets", F.greatest(F.ceil(F.col("n_rows") / BUCKET), F.lit(1)).cast("int")).drop("n_rows")
    most = per_source.agg(F.max("n_rows")).first()[0] or 0
    buckets = max(1, math.ceil(most / BUCKET))
    level, state, settled = 0, ready.withColumn("bucket", F.pmod(F.col("key"), F.col("buckets")).cast("int")), []
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", open boolean"
    while True:
        done = state.groupBy("source", "bucket").applyInPandas(_level(level, seed), schema)
        if buckets == 1:
            settled.append(done)
            break
        done = written(done, "mix")
        settled.append(done.filter(~F.col("open")))
        buckets, level = math.ceil(buckets / FAN), level + 1
        state = done.filter("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("int")).withColumn("buckets", F.ceil(F.col("buckets") / FAN).cast("int"))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("id", "source", "key", "n", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base") + F.round("p")).otherwise(0).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20) -> DataFrame:
    """The documents the mix takes, with all their columns, and how often each is repeated: mix_copies, and its source's mix_target. (One row for each
    document.) Columns of these names that docs has are replaced."""
    chosen = decisions(docs, weights, cap, seed).filter("copies > 0").select("id", "source", "key", "copies", "target")
    rows = docs.select(whole(docs), F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("i"), F.col("source").alias("s"))
    same = (F.col("k") == F.col("key")) & F.col("i").eqNullSafe(F.col("id")) & F.col("s").eqNullSafe(F.col("source"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_copies", "mix_target")]
    return rows.join(chosen, same).select(*kept, F.col("copies").alias("mix_copies"), F.col("target").alias("mix_target"))

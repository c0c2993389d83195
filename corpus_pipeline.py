"""A training corpus from raw documents: five stages, each a Parquet table that the next one reads.

Every stage takes documents with any columns and returns them with the same columns (the last adds mix_copies and mix_target), whatever their names:

* quality: null, empty and blank texts go; equal texts fare alike, however many there are.
* line dedup: null and empty texts and those of fewer than three lines stay as they are; a document of which no line is left goes; null ids come last.
* near-dedup: null, empty and blank texts are copies of each other, of which one stays; of repeated rows one stays; documents with an id before those without.
* decontamination: null and empty texts contain nothing and stay; null and blank items are in nothing.
* mixing: documents without words are not taken; a null source is one of its own; repeated rows are taken equally often.

Ties are settled by ids and hashes, so reruns agree. Very long texts are read whole. An empty table gives an empty table with the same columns. A stage's table is
deleted when the next is written, the last when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanspark.llm import decontamination, lines, mixing, quality, simhash
from gleanspark.llm._common import dropped, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps."""
    return quality.keep(docs, quality.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows."""
    return lines.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with mix_copies."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the fitted scorer nor the fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if last is not None:
            dropped(last)
        last = docs
    return docs

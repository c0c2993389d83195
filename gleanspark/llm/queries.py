"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html, lines, media, mixing, periodic, ppm, quality, simhash, toxicity, warc, whitening
from ._common import table


def remainder(column, by: int):
    """crc32 of an id as text, modulo `by`; null ids as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.decisions(table(spark, sf_dir, "documents")).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return d.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 4) == 2
    terms = toxicity.IDENTITY + toxicity.found_terms(docs, labels, ~held_out)
    return toxicity.score(docs, toxicity.fit(docs, labels, ~held_out, terms=terms), held_out)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_windows_removed(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec.build(bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return bpe.round_trip(table(spark, sf_dir, "documents"), codec, public_tokenizers.PATTERN)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.digests(docs.select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_html, op4_warc, op5_ppm, op6_simhash, op7_toxicity, op8_media, op9_lines, op10_decontamination, op11_whitening, op12_bpe, op13_periodic)}


#: op4: the digest in base32 is made from the hex digest's bits, five at a time.
SQL_WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
k AS (SELECT hex, max(page_id) AS kept FROM s GROUP BY hex),
b AS (SELECT hex, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM k),
d AS (SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest FROM b)
SELECT s.page_id, s.payload_bytes, d.payload_digest, CASE WHEN s.page_id = k.kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN s.page_id = k.kept THEN NULL ELSE k.kept END AS refers_to
FROM s JOIN k ON s.hex = k.hex JOIN d ON s.hex = d.hex
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": SQL_WARC, "op9_lines": lines.SQL, "op10_decontamination": decontamination.SQL}

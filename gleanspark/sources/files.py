"""Extractors of binary files: HWPX (zip and XML) and HWP5 text records, in a vectorised Python function over (path, content)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EXTRACTED = "path string, extractor string, text string, tables_total int, error string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def grid(table: ElementTree.Element) -> list[list[str]]:
    """Rows of cell texts, padded on the right to the widest."""
    rows = [[" ".join(_text(c).split()) for c in row if _local(c.tag) == "tc"] for row in table.iter() if _local(row.tag) == "tr"]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def is_key_value(rows: list[list[str]]) -> bool:
    keys = [r[0] for r in rows if len(r) == 2 and r[0]]
    return bool(keys) and all(len(r) == 2 for r in rows) and sum(map(len, keys)) / len(keys) <= 20


def render(rows: list[list[str]]) -> str:
    """A grid as key: value lines, or as a Markdown table whose first row is the header."""
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    if is_key_value(rows):
        return "\n".join(f"{k}: {v}" if k else v for k, v in rows)
    cell = lambda x: x.replace("|", "\\|")
    lines = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]])


def hwpx(content: bytes) -> tuple[str, int]:
    """Text in order with tables in place, and how many tables. Text within a table is not told twice."""
    out, tables = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
            def walk(node: ElementTree.Element, line: list[str]) -> None:
                nonlocal tables
                for child in node:
                    kind = _local(child.tag)
                    if kind == "tbl":
                        if "".join(line).strip():
                            out.append("".join(line).strip())
                        line.clear()
                        out.append(render(grid(child)))
                        tables += 1
                    elif kind == "t":
                        line.append("".join(child.itertext()))
                    else:
                        walk(child, line)

            for paragraph in ElementTree.fromstring(z.read(name)):
                line: list[str] = []
                walk(paragraph, line)
                if "".join(line).strip():
                    out.append("".join(line).strip())
    return "\n".join(x for x in out if x), tables


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload) of an HWP5 stream: 10 bits each of tag and level, 12 of size; 4095 means a size of 32 bits follows."""
    at = 0
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4], "little")
        at += 4
        size = head >> 20
        if size == 0xFFF:
            size = int.from_bytes(data[at : at + 4], "little")
            at += 4
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def paragraph_text(payload: bytes) -> str:
    """UTF-16 text of a paragraph record: extended controls take 16 bytes, plain ones go, tabs and line ends stay."""
    out, at = bytearray(), 0
    while at + 2 <= len(payload):
        code = int.from_bytes(payload[at : at + 2], "little")
        if code >= 32 or code in (9, 10, 13):
            out += payload[at : at + 2]
        at += 16 if code < 32 and code not in (0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31) else 2
        if code == 9 and at > len(payload):
            break
    return out.decode("utf-16-le", "ignore")


def extract(files: DataFrame) -> DataFrame:
    """files(path, content) to EXTRACTED; a file that can't be read has its error, the others go on."""
    from .hwp import first_that_reads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kind = path.rpartition(".")[2].lower()
                try:
                    if kind == "hwpx":
                        text, tables = hwpx(bytes(content))
                        rows.append((path, "hwpx", text, tables, None))
                    elif kind == "hwp":
                        name, text, counts, failed = first_that_reads(bytes(content))
                        rows.append((path, name, text, counts.get("tables", 0), "; ".join(failed) or None))
                    elif kind in ("txt", "md", "csv"):
                        rows.append((path, "text", bytes(content).decode("utf-8", "replace"), 0, None))
                    else:
                        rows.append((path, "unsupported", "", 0, f"no extractor of .{kind}"))
                except Exception as e:  # one broken file must not end the scan
                    rows.append((path, "failed", "", 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    return files.mapInPandas(run, EXTRACTED)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

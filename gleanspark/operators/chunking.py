"""Row-generating splitters. Greedy buffers with overlap are sequential, so they run as a vectorised Python function over texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .markup import FAILED_TABLE, LABEL_COLON, ROW_TAG, RULE_ROW, TABLE_ROW

SEPARATORS = ("\n\n", "\n", " ", "")


def spans(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, stop) of pieces of at most `size` characters, in order: a span that is too long is cut at a separator, and what is still too long at the next. `splitting.filled_pieces`
    is the same rule on columns; this one is for splitters that measure as they go."""
    waiting, out = [(0, len(text), 0)] if len(text) > size or text.strip() else [], []
    while waiting:
        start, stop, level = waiting.pop()
        if stop - start <= size:
            out.append((start, stop))
            continue
        if not separators[level:] or not separators[level]:
            out += [(k, min(k + size, stop)) for k in range(start, stop, size)]
            continue
        mark, found, begin = separators[level], [], start
        first = last = start  # of the parts that are held
        while begin <= stop:
            end = text.find(mark, begin, stop)
            end = stop if end < 0 else end
            if first == last:
                first = begin
            elif end - first > size:
                found.append((first, last, level + 1))
                first = begin
            last = end
            begin = end + len(mark)
        found += [(first, last, level + 1)] if last > first else []
        waiting += reversed(found)
    return out


def split_text(text: str, size: int = 800, overlap: int = 120, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, each but the first after up to `overlap` characters of the pieces before it."""
    out, tail = [], ""
    for start, stop in spans(text, size, separators):
        piece = text[start:stop]
        out.append(tail + piece)
        tail = (tail + piece)[-overlap:] if overlap else ""
    return out


def chunked(docs: DataFrame, split: Callable[[str], list[str]] = split_text) -> DataFrame:
    """chunk_id, doc_id, order, text from docs(doc_id, text)."""
    small_batches()

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t) if t else [])

    rows = docs.select("doc_id", F.posexplode(cut("text")).alias("order", "text"))
    return rows.select(F.format_string("%s::%04d", F.col("doc_id").cast("string"), "order").alias("chunk_id"), "doc_id", "order", "text")


def table_runs(text: str) -> list[tuple[bool, str]]:
    """Runs of lines that are or are not of a table with pipes."""
    out: list[tuple[bool, list[str]]] = []
    for line in text.split("\n"):
        inside = line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1
        if not out or out[-1][0] != inside:
            out.append((inside, []))
        out[-1][1].append(line)
    return [(t, "\n".join(x)) for t, x in out]


def split_with_tables(text: str, size: int = 1500, overlap: int = 250) -> list[str]:
    """Tables stay whole; one of over three sizes is cut by rows with its two header lines repeated. No overlap follows a table."""
    out: list[str] = []
    for is_table, run in table_runs(text):
        if not is_table:
            out += split_text(run, size, overlap)
        elif len(run) <= 3 * size:
            out.append(run)
        else:
            lines = run.split("\n")
            head, held = lines[:2], []
            for line in lines[2:]:
                if held and len("\n".join([*head, *held, line])) > size:
                    out.append("\n".join([*head, *held]))
                    held = []
                held.append(line)
            out.append("\n".join([*head, *held]))
    return out


def _bars(line: str) -> list[str]:
    inner = re.sub(r"^\|", "", line.strip())
    inner = re.sub(r"(?<!\\)\|$", "", inner)
    return [re.sub(r"\\([|-])", r"\1", c).replace("<br>", " ").strip() for c in re.split(r"(?<!\\)\|", inner)]


def plain(text: str) -> str:
    """`markup.without_table_markup` of one text, where a splitter must measure pieces as it goes."""
    out: list[str] = []
    for table, group in groupby(re.sub(FAILED_TABLE, "", text).split("\n"), lambda x: bool(re.match(TABLE_ROW, x))):
        if not table:
            out += [re.sub(r"[ \t]{2,}", " ", re.sub(LABEL_COLON, "", re.sub(ROW_TAG, "", x))).strip() if re.search(ROW_TAG, x) else x.replace("<br>", "\n") for x in group]
            continue
        rows = [c for c in map(_bars, (x for x in group if not re.match(RULE_ROW, x))) if any(c)]
        if len(rows) == 1:
            out.append(" ".join(filter(None, rows[0])))
        for row in rows[1:]:
            out.append(" ".join(" ".join(filter(None, (dict(enumerate(rows[0])).get(i), v))) for i, v in enumerate(row) if v))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^[ \t]*$", "", "\n".join(out))).strip()


def _parts(text: str, size: int) -> list[tuple[str, bool]]:
    """(piece, whether it is of a table): tables whole, or by rows beyond three sizes with their two header lines repeated; the rest in pieces of `size`."""
    out: list[tuple[str, bool]] = []
    for table, group in groupby(text.split("\n"), lambda x: bool(re.match(TABLE_ROW, x) or re.search(ROW_TAG, x))):
        lines = list(group)
        whole = "\n".join(lines)
        if not table:
            out += [(whole[a:b], False) for a, b in spans(whole, size)]
        elif len(plain(whole)) <= 3 * size:
            out.append((whole, True))
        else:
            head = [] if re.search(ROW_TAG, lines[0]) else lines[:2]
            held: list[str] = []
            for line in lines[len(head) :]:
                if held and len(plain("\n".join([*head, *held, line]))) > size:
                    out.append(("\n".join([*head, *held]), True))
                    held = []
                held.append(line)
            out.append(("\n".join([*head, *held]) if held else whole, True))
    return out


def chunk_pairs(text: str, size: int = 1500, overlap: int = 250) -> list[tuple[str, str]]:
    """(search text, generation text): pieces are joined while the search text, without markup, has at most `size` characters. Each but the first begins with the end
    of the piece before it, unless that is of a table."""
    groups: list[list[tuple[str, bool]]] = []
    for part in _parts(text or "", size):
        if groups and len(plain("\n".join(p for p, _ in [*groups[-1], part]))) <= size:
            groups[-1].append(part)
        else:
            groups.append([part])
    out = []
    for n, group in enumerate(groups):
        last, table = groups[n - 1][-1] if n and overlap > 0 else ("", True)
        whole = "\n".join(p for p, _ in group)
        out.append(last[-overlap:] + "\n" + whole if not table and last else whole)
    return [(plain(x), x) for x in out]


def chunked_pairs(docs: DataFrame, size: int = 1500, overlap: int = 250) -> DataFrame:
    """chunk_id, doc_id, order, total, text, gen from docs(doc_id, text)."""
    small_batches()

    @F.pandas_udf("array<struct<text:string,gen:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": a, "gen": b} for a, b in chunk_pairs(t, size, overlap)])

    rows = docs.select("doc_id", cut("text").alias("made")).select("doc_id", F.size("made").alias("total"), F.posexplode("made").alias("order", "x"))
    return rows.select(F.format_string("%s::%04d", F.col("doc_id").cast("string"), "order").alias("chunk_id"), "doc_id", "order", "total", "x.text", "x.gen")

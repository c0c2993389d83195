"""HWP5 documents: the OLE container they come in, the records of their sections, and their tables as text. Standard library alone."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from .files import is_key_value, paragraph_text, records

# Fixed values of the container and of the records.
OLE, HWP = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"HWP Document File"
FREE = 0xFFFFFFFA  # sectors from here on name no sector
PARA_TEXT, CTRL, LIST, TABLE = 67, 71, 72, 77
MARKED = re.compile(r"^(?:[○◦□■※•▶▷]|\([0-9]+\)|[0-9]+\.|[가-힣]\.|[①-⑳])\s*")
FULL, PARTIAL = 0.95, 0.70


class BrokenFile(ValueError):
    """Not an OLE container, not an HWP document, encrypted, or cut."""


class Container:
    """Streams of an OLE container by path."""

    def __init__(self, data: bytes):
        if data[:8] != OLE or len(data) < 512:
            raise BrokenFile("not an OLE container")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini
        n_fat, first, _, self.cutoff, first_mini, _, difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        places = list(struct.unpack_from("<109I", data, 76))
        for _ in range(n_difat):
            sector = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            places += sector[:-1]
            difat = sector[-1]
        self.fat = [x for p in places[:n_fat] if p < FREE for x in struct.unpack(f"<{self.size // 4}I", self._sector(p))]
        self.mini_fat = [x for s in self._chain(first_mini, self.fat) for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        entries = b"".join(map(self._sector, self._chain(first, self.fat)))
        self.entries = [entries[i : i + 128] for i in range(0, len(entries), 128)]
        self.mini = b"".join(map(self._sector, self._chain(struct.unpack_from("<I", self.entries[0], 116)[0], self.fat)))
        self.streams: dict[str, int] = {}
        todo = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")]
        seen = set()
        while todo:  # siblings form a tree; a loop in a broken file ends
            i, folder = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<III", e, 68)
            path = folder + e[: max(length - 2, 0)].decode("utf-16-le", "replace")
            if kind == 2:
                self.streams[path] = i
            todo += [(left, folder), (right, folder), (child, path + "/")]

    def _sector(self, n: int) -> bytes:
        out = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if len(out) < self.size and n < FREE:
            out = out.ljust(self.size, b"\0")
        return out

    def _chain(self, at: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table)):
            if at >= min(FREE, len(table)):
                return
            yield at
            at = table[at]

    def read(self, path: str) -> bytes:
        if path not in self.streams:
            raise BrokenFile(f"no stream {path}")
        e = self.entries[self.streams[path]]
        start, size = struct.unpack_from("<II", e, 116)
        if size < self.cutoff:
            return b"".join(self.mini[s * self.mini_size : (s + 1) * self.mini_size] for s in self._chain(start, self.mini_fat))[:size]
        return b"".join(map(self._sector, self._chain(start, self.fat)))[:size]


# Tables


def cell_text(paragraphs: list[str]) -> str:
    """Paragraphs of a cell by lines; those that begin with a mark of a list become its items."""
    out = []
    for p in filter(None, (x.strip() for x in paragraphs)):
        mark = MARKED.match(p)
        out.append(f"- {p[mark.end() :].strip()}".rstrip() if mark else p)
    return "\n".join(out)


@dataclass
class Cell:
    row: int
    col: int
    rows: int
    cols: int
    lines: list[str] = field(default_factory=list)


def grid_of(rows: int, cols: int, cells: list[Cell]) -> list[list[str | None]]:
    """Cells by place; what spans several has its text in all, what none covers is null."""
    grid: list[list[str | None]] = [[None] * cols for _ in range(rows)]
    for c in cells:
        text = cell_text(c.lines)
        for r in range(c.row, min(c.row + c.rows, rows)):
            for k in range(c.col, min(c.col + c.cols, cols)):
                grid[r][k] = text
    return grid


def rendered(rows: int, cols: int, cells: list[Cell]) -> tuple[str, str]:
    """(text, success, partial or failed by the share of places that cells cover): keys and values by lines, rows with their headers where cells are
    merged, else bars."""
    if not rows or not cols:
        return "[표 복원 실패: TABLE 레코드 누락]", "failed"
    grid = grid_of(rows, cols, cells)
    share = sum(x is not None for r in grid for x in r) / (rows * cols)
    full = [["-" if x is None else x for x in r] for r in grid]
    if cols == 2 and is_key_value([[x or "" for x in r] for r in grid]):
        text = "\n".join(f"{k.strip()} {v.strip()}" for k, v in full)
    elif any(c.rows > 1 or c.cols > 1 for c in cells):
        made = [" ".join(f"{h.strip()}: {v.strip()}" for h, v in zip(full[0], r) if v.strip()) for r in full[1:]]
        text = "\n".join(f"[행 {n}] {x}" for n, x in enumerate(made, 1) if x)
    else:
        lines = ["|" + "|".join(x.strip().replace("|", "\\|").replace("\n", "<br>") for x in r) + "|" for r in full]
        text = "\n".join([lines[0], "|" + "|".join(["---"] * cols) + "|", *lines[1:]])
    if share >= FULL:
        return text, "success"
    state, tag = ("partial", "부분 복원") if share >= PARTIAL else ("failed", "복원 실패")
    return f"[표 {tag}: 채움비율 {share:.0%}]\n{text}", state


def told(rows: int, cols: int, cells: list[Cell], caption: str = "표", most: int = 20_000) -> str:
    """The other form: a box of one column as its texts, two columns as `key: value`, else every row with its headers after the caption, each line once.
    Tables whose cells have no place, or of more than `most` places, are listed."""
    texts = [cell_text(c.lines) for c in cells]
    if not any(texts):
        return ""
    once = lambda lines: "\n".join(dict.fromkeys(x for x in lines if x))
    if rows <= 0 or cols <= 0 or rows * cols > most or any(c.row >= rows or c.col >= cols for c in cells):
        return "\n".join([f"[{caption} · {rows}x{cols} 격자복원실패]", *(f"- {x}" for x in texts if x)])
    grid = [[x or "" for x in r] for r in grid_of(rows, cols, cells)]
    if cols == 1:
        return once(r[0] for r in grid)
    if cols == 2 and all(len(r[0]) <= 20 for r in grid):
        return once(f"{k}: {v}" for k, v in grid if k or v)
    head = " | ".join(dict.fromkeys(filter(None, grid[0])))
    pairs = (" · ".join(f"{h}={v}" for h, v in zip(grid[0], r) if v and h and h != v) for r in grid[1:])
    return once([f"[{caption}] {head}" if head else "", *(f"[{caption}] {p}" for p in pairs if p)]) or once(" | ".join(filter(None, r)) for r in grid)


def caption_of(lines: list[str]) -> str:
    """The line before a table, of three to 59 characters and none of a table that was rendered before, among the last four."""
    for part in reversed(lines[-4:]):
        line = part.strip().rpartition("\n")[2]
        if 2 < len(line) < 60 and not line.startswith("[") and "=" not in line and " | " not in line:
            return line
    return "표"


# Sections


@dataclass
class Frame:
    """An open table: the level of its control, its size, its cells, and where its text goes."""

    level: int
    out: list[str]
    rows: int = 0
    cols: int = 0
    cells: list[Cell] = field(default_factory=list)


def section_text(data: bytes, plain: bool = False) -> tuple[list[str], dict[str, int]]:
    """Paragraphs of a section with its tables in place, and how many tables were restored, partial and failed. A table is open while records lie below
    its control; a cell until the next list of the same level. plain: by `told` instead of `rendered`."""
    body: list[str] = []
    counts = {"tables": 0, "success": 0, "partial": 0, "failed": 0}
    open_: list[Frame] = []

    def close(level: int) -> None:
        while open_ and level <= open_[-1].level:
            t = open_.pop()
            text, state = (told(t.rows, t.cols, t.cells, caption_of(t.out)), "success") if plain else rendered(t.rows, t.cols, t.cells)
            counts["tables"] += 1
            counts[state] += 1
            if text:
                t.out.append(text)

    def place() -> list[str]:
        return open_[-1].cells[-1].lines if open_ and open_[-1].cells else open_[-1].out if open_ else body

    for tag, level, payload in records(data):
        close(level)
        if tag == CTRL and payload[:4] == b" lbt":
            open_.append(Frame(level, place()))
        elif tag == TABLE and open_ and level == open_[-1].level + 1 and len(payload) >= 8:
            open_[-1].rows, open_[-1].cols = struct.unpack_from("<HH", payload, 4)
        elif tag == LIST and open_ and level == open_[-1].level + 1 and len(payload) >= 16:
            col, row, cols, rows = struct.unpack_from("<4H", payload, 8)
            open_[-1].cells.append(Cell(row, col, max(rows, 1), max(cols, 1)))
        elif tag == PARA_TEXT:
            text = paragraph_text(payload).strip()
            if text:
                place().append(text)
    close(-1)
    return body, counts


def hwp(content: bytes, plain: bool = False) -> tuple[str, dict[str, int]]:
    """Text of an HWP5 document with its tables, and their counts."""
    box = Container(content)
    head = box.read("FileHeader")
    if not head.startswith(HWP):
        raise BrokenFile("not an HWP document")
    flags = struct.unpack_from("<I", head, 36)[0]
    if flags & 2:
        raise BrokenFile("the document is encrypted")
    out: list[str] = []
    total = {"tables": 0, "success": 0, "partial": 0, "failed": 0}
    for name in sorted((n for n in box.streams if re.fullmatch(r"BodyText/Section\d+", n)), key=lambda n: int(n[16:])):
        data = box.read(name)
        lines, counts = section_text(zlib.decompressobj(-15).decompress(data) if flags & 1 else data, plain)
        out += lines
        total = {k: v + counts[k] for k, v in total.items()}
    return "\n".join(out), total


def preview(content: bytes) -> str:
    """The preview that an HWP5 document carries of itself."""
    return Container(content).read("PrvText").decode("utf-16-le", "ignore").strip("\0").strip()


def hangul_share(text: str, head: int = 5000) -> float:
    return len(re.findall("[가-힣]", text[:head])) / max(len(text[:head]), 1)


def first_that_reads(content: bytes, chain=None, least: float = 0.15) -> tuple[str, str, dict[str, int], list[str]]:
    """(extractor, text, table counts, failed attempts) of the first of a chain of (name, function of bytes to (text, counts)) whose text has a share of
    Hangul letters of `least` in its first 5,000 characters, which is what the check reads. None: failed and an empty text."""
    chain = chain or (("hwp_raw", hwp), ("hwp_plain", lambda c: hwp(c, True)), ("prvtext", lambda c: (preview(c), {})))
    failed = []
    for name, read in chain:
        try:
            text, counts = read(content)
        except Exception as e:  # the next of the chain may read it
            failed.append(f"{name}: {type(e).__name__}: {e}")
            continue
        if hangul_share(text) >= least:
            return name, text, counts, failed
        failed.append(f"{name}: few Hangul letters")
    return "failed", "", {}, failed


# Pages of words (for readers of PDF, where a library gives words and boxes)


def inside_any(word: tuple[float, float, float, float], boxes: list[tuple[float, float, float, float]]) -> bool:
    """Whether a word's box (left, top, right, bottom) lies wholly in one of the boxes."""
    return any(b[0] <= word[0] and b[1] <= word[1] and word[2] <= b[2] and word[3] <= b[3] for b in boxes)


def fuller(a: list[list[list[str | None]]], b: list[list[list[str | None]]]) -> list[list[list[str | None]]]:
    """Of two readings of a page's tables the one with more filled cells, the first where they are equal."""
    filled = lambda tables: sum(bool((c or "").strip()) for t in tables for r in t for c in r)
    return b if filled(b) > filled(a) else a


def looks_scanned(pages: list[str], first: int = 5, least: float = 40) -> bool:
    """Whether the first pages have under `least` characters on average: the check reads no more."""
    head = pages[:first]
    return not head or sum(len((p or "").strip()) for p in head) / len(head) < least

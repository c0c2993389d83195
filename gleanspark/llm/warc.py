"""WARC archives of pages, and a capture index merged externally from locally sorted runs.

Writing: a WARC/1.1 record for each page, payload the html in UTF-8; of equal payloads the page with the largest id is the response and the others
revisit it (a record without payload that refers to it). Records go through Spark's text writer, so archives lie on any file system
that Spark writes to, gzipped, and are committed as one; no record is cut.

Reading: archives are read as binary files and parsed by their lengths; a response's digest and size are computed from the payload read.
Each archive is a run of captures, sorted by URL key and timestamp. Runs are written, dealt by ranges of (URL key, timestamp, page), and in each range
merged externally: what comes in order goes to a file of the task's own, at most FAN of them are open at once, each read a few rows at a time, and a
k-way loser tree merges them, first into longer runs, at last into the capture history in global order. A task so holds FAN * ROWS captures, whatever its
range has. (The files are the task's scratch, as Spark's own spills are: a task that is lost starts again.)

A null html is an empty payload; a null url is kept as null, after the others; null ids are kept. Equal (page_id, html) rows are all responses or all
revisits. Payloads of fewer than `least_bytes` are responses, however equal. A very long page is one record. Extra columns, whatever their names, are ignored;
no pages give no archive and no captures.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, bounded, map_batches, remove, scratch, spread_join, until_exit, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, timestamp string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host reversed, then path and query, lower-cased; without scheme, www, default port and fragment; parameters in order."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = "&".join(sorted(x for x in parts.query.split("&") if x))
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + query if query else ''}".lower()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record, with the blank lines that end it. Ids are urn:page:N; revisits keep the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Printable ASCII but "%"; everything else in a URL is escaped in the header and restored by the reader.
SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers by lower-case name, block) of an archive, gzipped in any number of members or plain. Raises ValueError where it is cut."""
    buffer, at, done = bytearray(), 0, 0
    source = _inflated(data) if data[:2] == b"\x1f\x8b" else iter([data])
    more = True

    def fill(to: int) -> bool:
        nonlocal more
        while len(buffer) - at < to and more:
            piece = next(source, None)
            if piece is None:
                more = False
            else:
                buffer.extend(piece)
        return len(buffer) - at >= to

    while fill(1):
        end = buffer.find(b"\r\n\r\n", at)
        while end < 0 and more:
            fill(len(buffer) - at + 1)
            end = buffer.find(b"\r\n\r\n", at)
        if end < 0 or buffer[at : at + 5] != b"WARC/":
            raise ValueError("not a WARC record")
        lines = bytes(buffer[at:end]).decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        size = end + 4 - at + n + 4
        if not fill(size):
            raise ValueError("a record is cut")
        yield done, headers, bytes(buffer[end + 4 : end + 4 + n])
        at += size
        done += size
        if at > 1 << 20:
            del buffer[:at]
            at = 0


def _inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    while data:
        z = zlib.decompressobj(31)
        out = z.decompress(data, piece)
        while out or not z.eof:
            if out:
                yield out
            if not z.eof and not z.unconsumed_tail and not out:
                raise ValueError("gzip data is cut")
            out = z.decompress(z.unconsumed_tail, piece)
        data = z.unused_data


class LoserTree:
    """Merges k sorted sequences, of which it holds the heads alone: inner nodes hold the loser of their match, so each output plays log2 k matches."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.rest = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.rest]
        self.losers = [-1] * max(len(self.rest), 1)
        self.winner = self._play(1) if self.rest else -1

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an exhausted run loses, equal heads go by the run's number."""
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, node: int) -> int:
        k = len(self.rest)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.rest)
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.rest[w], None)
            node = (w + k) // 2
            while node >= 1:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


FAN, ROWS = 64, 256


class Run:
    """A sorted run in a file of this task's: rows go in once, and come out in their order, ROWS at a time."""

    def __init__(self, schema: pa.Schema):
        self.file, self.schema, self.rows = tempfile.TemporaryFile(), schema, []
        self.writer = pa.ipc.new_stream(self.file, schema)

    def add(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) == ROWS:
            self.writer.write_batch(pa.RecordBatch.from_pylist(self.rows, self.schema))
            self.rows = []

    def closed(self) -> Run:
        if self.rows:
            self.writer.write_batch(pa.RecordBatch.from_pylist(self.rows, self.schema))
            self.rows = []
        self.writer.close()
        return self

    def __iter__(self) -> Iterator[tuple]:
        self.file.seek(0)
        for batch in pa.ipc.open_stream(self.file):
            for row in batch.to_pylist():
                yield _Keyed((_order(row), row))
        self.file.close()


class _Keyed(tuple):
    """(key, row), compared by the key alone."""

    def __lt__(self, other) -> bool:
        return self[0] < other[0]

    def __eq__(self, other) -> bool:
        return self[0] == other[0]

    __hash__ = None


def merged(rows: Iterable[dict], schema: pa.Schema, fan: int = FAN) -> Iterator[dict]:
    """Rows that come as runs in order, one after the other, in global order. tiers: closed runs by how often they were merged."""
    tiers: list[list[Run]] = [[]]
    run, last = None, None

    def close(run: Run, tier: int = 0) -> None:
        while True:
            if tier == len(tiers):
                tiers.append([])
            tiers[tier].append(run.closed())
            if len(tiers[tier]) < fan:
                return
            run, full = Run(schema), tiers[tier]
            tiers[tier] = []
            for _, row in LoserTree(full):
                run.add(row)
            tier += 1

    for row in rows:
        key = _order(row)
        if run is None or key < last:
            if run is not None:
                close(run)
            run = Run(schema)
        run.add(row)
        last = key
    if run is not None:
        close(run)
    while sum(map(len, tiers)) > fan:  # the shortest first
        shortest = [r for tier in tiers for r in tier][:fan]
        tiers = [[r for tier in tiers for r in tier][fan:]]
        longer = Run(schema)
        for _, row in LoserTree(shortest):
            longer.add(row)
        tiers.append([longer.closed()])
    for _, row in LoserTree([r for tier in tiers for r in tier]):
        yield row


def _order(row: dict) -> tuple:
    return (row["url_key"] is None, row["url_key"] or "", row["timestamp"], row["page_id"] is None, row["page_id"] or 0, row["archive"], row["place"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 24 << 20) -> None:
    """Archives of about `archive_bytes` of payload each, gzipped, under `path`."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("digest", F.sha1(payload)).withColumn("size", F.length(payload).cast("long"))
    narrow = rows.select("page_id", "digest", "size")
    # Of payloads that several pages have, the page that keeps it. Only rows of those pages meet it, without their html.
    shared = narrow.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and kept is not null").select("digest", "kept", "n")
    revisits = spread_join(narrow, shared, ["digest"], "n").filter(~F.col("page_id").eqNullSafe(F.col("kept"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "kept").distinct()
    typed = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    total, n = narrow.agg(F.sum("size"), F.count("*")).first()
    per_archive = max(1, archive_bytes * n // max(total or 0, 1))  # records, so that archives come to about archive_bytes

    def run(part: pa.RecordBatch) -> dict:
        made = []
        for p, u, h, kept, d in zip(*(part.column(c).to_pylist() for c in ("page_id", "url")), part.column("html").cast(pa.binary()).to_pylist(), part.column("kept").to_pylist(), part.column("d").to_pylist()):
            made.append(record(p, u, (h or b"").decode("utf-8", "replace").encode(), kept, d is not None)[:-1].decode())  # the writer ends it
        return {"value": made}

    archives = map_batches(typed.select("page_id", "url", "html", "kept", "d"), run, "value string", "html")
    archives.write.options(compression="gzip", maxRecordsPerFile=str(per_archive)).text(path)


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_runs(spark, path: str) -> DataFrame:
    """One sorted run of captures for each archive under `path`."""

    def run(part: pa.RecordBatch) -> dict:
        found = []
        for name, data in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
            own = []
            for place, headers, block in records(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = headers["warc-type"] == "revisit"
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if revisit:
                    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                else:
                    size, own_digest = len(payload), base32_sha1(payload)
                    if own_digest != digest:
                        raise ValueError(f"{name} at {place}: the payload does not have its digest")
                url = headers.get("warc-target-uri")
                url = None if url is None else unquote(url)
                own.append({"url_key": None if url is None else url_key(url), "timestamp": re.sub(r"\D", "", headers["warc-date"])[:14], "url": url, "page_id": _page(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to")), "archive": name.rsplit("/", 1)[-1], "place": place})
            found += sorted(own, key=_order)
        return {c.split()[0]: [x[c.split()[0]] for x in found] for c in CAPTURE.split(", ")}

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_batches(files, run, CAPTURE, "content")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures in global order: ranges of keys follow each other, and within one a loser tree merges the runs that fall into it."""
    bounded(runs.sparkSession)
    schema = arrow_schema(runs.sparkSession, CAPTURE)

    def merge(batches):
        out = []
        for row in merged((row for batch in batches for row in batch.to_pylist()), schema):
            out.append(row)
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = runs.repartitionByRange(F.col("url_key").asc_nulls_last(), F.col("timestamp"), F.col("page_id"))
    return dealt.mapInArrow(merge, CAPTURE)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder, reads them back, and returns the merged capture history."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least_bytes)
    until_exit(spark, path)
    runs = written(read_runs(spark, path), "captures")
    remove(spark, path)
    return merge_runs(runs)

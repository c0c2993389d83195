"""Stores of chunks and their vectors by name: tables made of Parquet parts, and stamps that say which parts a version has.

A stamp is a small file of its own for each version, made if absent and never changed or deleted by a writer; the version that counts is the highest whose stamp
can be read whole. So readers keep what they opened, at every moment there is a version to open, and a writer that dies anywhere leaves the one before. A writer first
claims the next version by a file that is made if absent, with a lease: another one waits for no one but refuses, until the lease has run out, and then takes over. What
adds chunks writes these alone, as one more part.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import corpus_signature, diff, doc_hashes, synced


class StoreError(RuntimeError):
    """A store that is missing, made by another model, or written by another writer."""


class Stores:
    """All stores under a folder of any Hadoop file system. model: the name of what embeds; embed: adds column v to chunks(chunk_id, doc_id, order, text)."""

    def __init__(self, spark: SparkSession, folder: str, model: str, embed, lease: float = 3600.0):
        self.spark, self.folder, self.model, self.embed, self.lease = spark, folder.rstrip("/"), model, embed, lease
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join((self.folder, *parts)))

    def _listed(self, name: str, kind: str) -> list[int]:
        """Numbers of the files kind-N.json of a store, descending."""
        root = self._path(name)
        names = [s.getPath().getName() for s in (self.fs.listStatus(root) if self.fs.exists(root) else [])]
        return sorted((int(n[len(kind) + 1 : -5]) for n in names if n.startswith(f"{kind}-") and n.endswith(".json") and n[len(kind) + 1 : -5].isdigit()), reverse=True)

    def _json(self, *parts: str) -> dict | None:
        """What a small file holds; None if it is not there or not whole."""
        path = self._path(*parts)
        try:
            size = self.fs.getFileStatus(path).getLen()
            source = self.fs.open(path)
            try:
                return json.loads(bytes(source.readNBytes(int(size)))) if size else None
            finally:
                source.close()
        except ValueError:
            return None
        except Exception as e:  # of the JVM
            if "FileNotFoundException" in str(e) or "ChecksumException" in str(e):
                return None
            raise

    def _put(self, name: str, file: str, what: dict) -> bool:
        """Makes a file that isn't there; False if it is."""
        try:
            out = self.fs.create(self._path(name, file), False)
        except Exception as e:  # of the JVM: FileAlreadyExistsException, or what a file system says instead
            if "xist" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
        out.close()
        return True

    def stamp(self, name: str) -> dict | None:
        """The stamp of the last whole version."""
        return next((found for n in self._listed(name, "stamp") if (found := self._json(name, f"stamp-{n}.json"))), None)

    def _claimed(self, name: str, number: int) -> str:
        """Claims a version and returns the claim's owner. A claim whose lease has run out is moved away, which only one of several can do."""
        owner, file = uuid.uuid4().hex, f"claim-{number}.json"
        claim = {"owner": owner, "until": time.time() + self.lease}
        if not self._put(name, file, claim):
            held = self._json(name, file)
            until = held["until"] if held else self.fs.getFileStatus(self._path(name, file)).getModificationTime() / 1000 + self.lease
            if until > time.time() or not self.fs.rename(self._path(name, file), self._path(name, f"expired-{owner}")) or not self._put(name, file, claim):
                raise StoreError(f"another writer is making version {number} of {name}")
        return owner

    def _step(self, name: str) -> None:
        """Called between the steps of a write, by their names."""

    def _next(self, name: str, new: DataFrame, signature: str, keep: list[str] | None = None) -> DataFrame:
        """Writes a part and the stamp of the version that has it, after the parts to keep. signature: of the whole."""
        number = (self.stamp(name) or {"version": 0})["version"] + 1
        # A stamp that its writer left unfinished keeps its number.
        number = max([number, *(n + 1 for n in self._listed(name, "stamp")[:1])])
        self._step("start")
        owner = self._claimed(name, number)
        try:
            self._step("claimed")
            part = f"part-{number}-{owner}"
            new.write.parquet(self._path(name, part).toString())
            self._step("written")
            if (self._json(name, f"claim-{number}.json") or {}).get("owner") != owner or not self._put(name, f"stamp-{number}.json", {"version": number, "model": self.model, "signature": signature, "parts": [*(keep or []), part]}):
                raise StoreError(f"another writer has taken over version {number} of {name}")
            self._step("stamped")
        except Exception:
            if (self._json(name, f"claim-{number}.json") or {}).get("owner") == owner:
                self.fs.delete(self._path(name, f"claim-{number}.json"), False)
            raise
        self.fs.delete(self._path(name, f"claim-{number}.json"), False)
        return self.read(name)

    def prune(self, name: str, keep: int = 2) -> list[str]:
        """Deletes the stamps before the last `keep` versions and the parts and claims that no stamp or running claim has; to be called when no reader holds an older one."""
        stamps = [n for n in self._listed(name, "stamp") if self._json(name, f"stamp-{n}.json")]
        for n in stamps[keep:]:
            self.fs.delete(self._path(name, f"stamp-{n}.json"), False)
        used = {p for n in stamps[:keep] for p in self._json(name, f"stamp-{n}.json")["parts"]}
        running = {c["owner"] for n in self._listed(name, "claim") if (c := self._json(name, f"claim-{n}.json")) and c["until"] > time.time()}
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(name))]
        ended = {f"claim-{n}.json" for n in self._listed(name, "claim") if (c := self._json(name, f"claim-{n}.json")) and c["owner"] not in running}
        gone = [n for n in names if n.startswith("expired-") or n in ended or n.startswith("part-") and n not in used and n.rpartition("-")[2] not in running]
        for n in gone:
            self.fs.delete(self._path(name, n), True)
        return gone

    def names(self) -> list[str]:
        """Stores that have a stamp, sorted."""
        root = self.hadoop.Path(self.folder)
        found = self.fs.listStatus(root) if self.fs.exists(root) else []
        return sorted(n for s in found if s.isDirectory() and self.stamp(n := s.getPath().getName()))

    def read(self, name: str, chunks: DataFrame | None = None) -> DataFrame:
        """The store's last version; it must have been made by this model, and of these chunks where they are given."""
        stamp = self.stamp(name)
        if stamp is None:
            raise StoreError(f"no store {name}; there are {self.names()}")
        if stamp["model"] != self.model:
            raise StoreError(f"{name} was made by {stamp['model']}, not {self.model}")
        if chunks is not None and stamp["signature"] != signature_of(chunks):
            raise StoreError(f"{name} was made of other chunks")
        return self.spark.read.parquet(*[self._path(name, p).toString() for p in stamp["parts"]])

    def build(self, name: str, chunks: DataFrame, force: bool = False) -> DataFrame:
        """Makes the whole store, unless it is there and not forced."""
        return self.read(name) if self.stamp(name) and not force else self._next(name, self.embed(chunks), signature_of(chunks))

    def add(self, name: str, chunks: DataFrame) -> DataFrame:
        """Adds chunks to a store of the same model: only these are embedded and written."""
        columns = self.read(name).columns
        stamp = self.stamp(name)
        return self._next(name, self.embed(chunks).select(*columns), joined_signature(stamp["signature"], signature_of(chunks)), stamp["parts"])

    def delete(self, name: str, doc_ids: list) -> tuple[int, int]:
        """(chunks before, chunks after) deleting documents; blank ids are ignored."""
        before = self.read(name)
        gone = [d for d in doc_ids if d is not None and str(d).strip()]
        kept = before.filter(~F.col("doc_id").isin(gone)) if gone else before
        n = before.count()
        after = self._next(name, kept, signature_of(kept)).count()
        return n, after

    def drop(self, name: str) -> None:
        """Deletes a store with its stamp; one that isn't there is ignored."""
        self.fs.delete(self._path(name), True)

    def sync(self, name: str, chunks: DataFrame) -> tuple[int, int, int]:
        """(added, gone, kept) documents of bringing a store to these chunks: only added and changed documents are embedded; a changed one is gone and added."""
        old = self.read(name)
        status = diff(doc_hashes(old), doc_hashes(chunks))
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        moved = chunks.join(status.filter("status in ('added', 'changed')"), "doc_id", "left_semi")
        self._next(name, synced(old, self.embed(moved), status), signature_of(chunks))
        changed = counts.get("changed", 0)
        return counts.get("added", 0) + changed, counts.get("gone", 0) + changed, counts.get("kept", 0)


def joined_signature(one: str, other: str) -> str:
    """The signature of two corpora together, from theirs: counts add up, hashes mix by exclusive or."""
    (n, a), (m, b) = (s.split("-", 1) for s in (one, other))
    return f"{int(n) + int(m)}-{int(a) ^ int(b)}"


def signature_of(chunks: DataFrame) -> str:
    row = corpus_signature(chunks).first()
    return f"{row['chunks']}-{row['mixed']}"

"""Media columns for telephony audio: G.711 mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

The container is RIFF/WAVE (format 7 mu-law, 6 A-law, 0x11 IMA ADPCM, 1 PCM). `expand` reads any of them to 16-bit PCM, `resample` interpolates
linearly between rates. Payloads of bytes are stored as 8-bit samples, one byte each, so reading back is lossless.

Nulls are empty texts; an empty text is a payload of 192 spaces, a very long one is stored whole. A broken container raises ValueError. Equal bytes give
equal forms, so repeated rows give repeated rows. Extra columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, map_batches, text_bytes, written

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
UNIT = 192


def _mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits; sign, three bits of segment, four of step; bias 132."""
    c = ~np.arange(256) & 0xFF
    x = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
    return np.where(c & 128, -x, x).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; the first segment is linear."""
    c = np.arange(256) ^ 0x55
    segment, step = c >> 4 & 7, (c & 15) << 4
    x = np.where(segment == 0, step + 8, step + 0x108 << np.maximum(segment - 1, 0))
    return np.where(c & 128, x, -x).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
ALAW_LEVELS = np.abs(ALAW_TABLE.astype(np.int32))
# Fixed values of the IMA ADPCM format.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    step, code = STEP_SIZES[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    return np.where(code & 8, -size, size).astype(np.int32).reshape(-1), np.clip(np.arange(len(STEP_SIZES))[:, None] + INDEX_STEPS[code], 0, 88).astype(np.int32).reshape(-1)


DIFFERENCES, NEXT_INDEX = _adpcm_tables()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, one channel: blocks of bytes (n, size) to samples (n, 1 + 2 (size - 4)). All blocks advance together, sample by sample."""
    n, size = blocks.shape
    level = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = level
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(1, len(out)):
        # Both tables by (index, code): the signed difference, and the next index.
        at = index << 4 | (columns[(k - 1) // 2] >> (4 * ((k - 1) % 2)) & 15)
        level += DIFFERENCES.take(at)
        np.clip(level, -32768, 32767, out=level)
        index = NEXT_INDEX.take(at)
        out[k] = level
    return out.T


def encode_adpcm(samples: np.ndarray, size: int = 256) -> bytes:
    """PCM to IMA ADPCM blocks of `size` bytes (the last is filled with its last sample); for tests and for stores."""
    per = 1 + 2 * (size - 4)
    n = max(1, -(-len(samples) // per))
    full = np.concatenate([samples, np.full(n * per - len(samples), samples[-1] if len(samples) else 0)]).reshape(n, per).astype(np.int32)
    out = np.zeros((n, size), np.uint8)
    level, index = full[:, 0].copy(), np.zeros(n, np.int32)
    out[:, 0], out[:, 1] = level & 255, level >> 8 & 255
    for k in range(1, per):
        step, gap = STEP_SIZES[index], full[:, k] - level
        code = np.where(gap < 0, 8, 0)
        rest, delta = np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = rest >= part
            code, rest, delta = code | np.where(on, bit, 0), rest - np.where(on, part, 0), delta + np.where(on, part, 0)
        level = np.clip(np.where(code & 8, level - delta, level + delta), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def wave(data: bytes, kind: int = MULAW, rate: int = 8000, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file around the bytes of `data`."""
    bits = {PCM: 16, ADPCM: 4}.get(kind, 8)
    block = 2 if kind == PCM else block
    per = 1 + 2 * (block - 4) if kind == ADPCM else 1
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per, block, bits)
    if kind != PCM:
        fmt += struct.pack("<HH", 2, per) if kind == ADPCM else struct.pack("<H", 0)
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, len(data) // block * per)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(file: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, block, bytes of the samples)."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, head = 12, None
    while at + 8 <= len(file):
        name, n = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", file, at + 8)
            head = (kind, rate, block)
            if channels != 1:
                raise ValueError("more than one channel")
        elif name == b"data":
            if head is None or at + 8 + n > len(file):
                break
            return *head, file[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no complete data chunk")


def expand(file: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and their rate. ADPCM: bytes beyond the last whole block are ignored."""
    kind, rate, block, data = read_wave(file)
    if kind in (MULAW, ALAW):
        return (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)], rate
    if kind == PCM:
        return np.frombuffer(data, "<i2"), rate
    if kind == ADPCM:
        n = len(data) // block
        return adpcm_blocks(np.frombuffer(data[: n * block], np.uint8).reshape(n, block)).reshape(-1), rate
    raise ValueError(f"format {kind}")


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers, so that results do not hang on the machine's rounding."""
    if rate == to or not len(samples):
        return samples
    if to % rate == 0:  # whole steps between samples
        times = to // rate
        x = samples.astype(np.int32)
        gap = np.append(x[1:], x[-1]) - x
        return (x[:, None] + gap[:, None] * np.arange(times, dtype=np.int32) // times).astype(np.int16).reshape(-1)
    place = np.arange(len(samples) * to // rate, dtype=np.int64) * rate
    low, part = place // to, place % to
    high = np.minimum(low + 1, len(samples) - 1)
    x, y = samples[low].astype(np.int64), samples[high].astype(np.int64)
    return (x + (y - x) * part // to).astype(np.int16)


def features(samples: np.ndarray) -> str:
    """Samples, root mean square, peak, changes of sign and checksum of the PCM."""
    x = samples.astype(np.int32)
    rms = int(np.sqrt(float((x * x).sum(dtype=np.int64)) / max(len(x), 1)))
    below = samples < 0
    peak = max(int(samples.max(initial=0)), -int(samples.min(initial=0)))
    return f"n={len(x)};rms={rms};peak={peak};zero={int(np.count_nonzero(below[1:] != below[:-1]))};crc={zlib.crc32(samples.astype('<i2').tobytes()):08x}"


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(docs: DataFrame, rate: int = 8000) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a mu-law file, one byte a sample."""

    def run(part: pa.RecordBatch) -> dict:
        texts = text_bytes(part.column("text"))
        return {"doc_id": part.column("doc_id"), "n_bytes": [len(x) for x in texts], "media": [wave(payload(x), MULAW, rate) for x in texts]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


def pcm_of(file: bytes, to: int) -> np.ndarray:
    """Any stored form as 16-bit samples at one rate."""
    return resample(*expand(file), to).astype("<i2")


def decode(media: DataFrame, to: int = 16000) -> DataFrame:
    """doc_id, rate, pcm: any stored form as 16-bit PCM at one rate. A null form gives null."""

    def run(part: pa.RecordBatch) -> dict:
        files = part.column("media").to_pylist()
        return {"doc_id": part.column("doc_id"), "rate": [to] * len(files), "pcm": [None if f is None else pcm_of(f, to).tobytes() for f in files]}

    return map_batches(media, run, "doc_id long, rate int, pcm binary", "media")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def sound(media: DataFrame, to: int = 16000) -> DataFrame:
    """What a stored table of `store` holds, read back: DIGESTS, alaw and adpcm (sums of levels of the same bytes read as A-law and as ADPCM blocks), and
    its PCM at one rate."""

    def run(part: pa.RecordBatch) -> dict:
        files = part.column("media").to_pylist()
        data = [read_wave(f)[3] for f in files]
        # ADPCM of all files of the slice at once; sizes are multiples of the block, so no block has bytes of two files.
        blocks = adpcm_blocks(np.frombuffer(b"".join(data), np.uint8).reshape(-1, UNIT // 2))
        level = np.zeros(len(blocks), np.int64)
        for k in range(blocks.shape[1]):
            level += np.abs(blocks[:, k].astype(np.int32))
        starts = np.cumsum([0, *(len(x) * 2 // UNIT for x in data[:-1])])
        return {
            "doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "payload_bytes": [len(x) for x in data], "payload_sha256": [hashlib.sha256(x).hexdigest() for x in data], "tail_crc32": [zlib.crc32(x[-16:]) for x in data],
            "media_bytes": [len(f) for f in files], "media_sha256": [hashlib.sha256(f).hexdigest() for f in files], "alaw": [int(ALAW_LEVELS.take(np.frombuffer(x, np.uint8)).sum(dtype=np.int64)) for x in data],
            "adpcm": (np.add.reduceat(level, starts) if files else level).tolist(), "pcm": [pcm_of(f, to).tobytes() for f in files],
        }

    return map_batches(media, run, DIGESTS + ", alaw long, adpcm long, pcm binary", "media")


def digests(sounds: DataFrame) -> DataFrame:
    """DIGESTS and feature: of the PCM that a stored table of `sound` holds."""

    def run(part: pa.RecordBatch) -> dict:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        rows = zip(part.column("pcm").to_pylist(), part.column("alaw").to_pylist(), part.column("adpcm").to_pylist())
        return {c: part.column(c) for c in names} | {"feature": [f"{features(np.frombuffer(x, '<i2'))};alaw={a};adpcm={b}" for x, a, b in rows]}

    return map_batches(sounds, run, DIGESTS + ", feature string", "pcm")


#: zstd at a higher level and over larger pages: PCM at twice the rate is four bytes for each of the payload.
DENSE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20), "parquet.block.size": str(32 << 20)}


def round_trip(docs: DataFrame, rate: int = 8000, to: int = 16000, parts: int = 2) -> DataFrame:
    """Stores the texts as a media table in the shared folder, reads it back, stores its PCM and reads that back. A part of the rows (by hash of id and
    text) goes after the other, and its media table is dropped once the PCM is stored."""
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    out = []
    for k in range(parts):
        media = written(store(docs.filter(share == k), rate), "media", compression="zstd")
        out.append(written(sound(media, to), "pcm", **DENSE))
        dropped(media)
    return digests(reduce(DataFrame.unionByName, out))

"""Operator 4: PNG images in binary columns, read back with checksum tests, and cosine-transform hashes.

A payload of 64 * h bytes is stored as an 8-bit grey PNG of width 64: IHDR, one IDAT (zlib) and IEND,
each with its checksum. Rows are filtered by the cheapest of None, Sub and Up (smallest sum of signed
byte sizes, first on ties). The reader tests the signature, every chunk's checksum and length, the
header and the zlib stream's checksum, and undoes all five row filters with numpy.

The feature is a perceptual hash: the picture averaged to 32 x 32, its two-dimensional cosine
transform, and one bit for each of the 64 lowest frequencies, set if above their median.

Defined results: null and empty texts give one row of zero bytes; equal texts give equal values; a
damaged stored form raises ``ValueError``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import read, slices

WIDTH = 64
#: Fixed value of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 4


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, a positive multiple of ``width`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    if not len(rows):
        raise ValueError("a picture needs one row at least")
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    ways = np.stack([rows, rows - left, rows - above])
    best = np.abs(ways.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    data = np.empty((len(rows), width + 1), np.uint8)
    data[:, 0] = best
    data[:, 1:] = ways[best, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(data.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if len(png) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            if at != len(png):
                raise ValueError("bytes after the end")
            return
    raise ValueError("no end chunk")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of a picture with one byte a pixel. Runs of rows that don't look across
    (None, Sub) or only up (Up) go at once; the other two filters go pixel by pixel."""
    out = np.empty_like(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):
        kind, above = kinds[a], out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(rows[a:b], 1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.concatenate([above[None], rows[a:b]]), 0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for r in range(a, b):
                up = (out[r - 1] if r else np.zeros(rows.shape[1], np.uint8)).tolist()
                line, left, corner = [], 0, 0
                for x, u in zip(rows[r].tolist(), up, strict=True):
                    if kind == 3:
                        guess = (left + u) // 2
                    else:
                        p = left + u - corner
                        guess = min((abs(p - left), 0, left), (abs(p - u), 1, u), (abs(p - corner), 2, corner))[2]
                    left = (x + guess) & 255
                    corner = u
                    line.append(left)
                out[r] = line
        else:
            raise ValueError(f"row filter {kind}")
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG as (rows, width)."""
    width = height = 0
    packed = []
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0] or not width or not height:
                raise ValueError("only 8-bit grey pictures without interlace are read")
        elif kind == b"IDAT":
            packed.append(body)
        elif not kind[0] & 32 and kind != b"IEND":
            raise ValueError(f"chunk {kind!r} isn't known")
    try:
        data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"zlib stream: {e}") from e
    if not width or len(data) != height * (width + 1):
        raise ValueError("the stream's size doesn't fit the header")
    data = data.reshape(height, width + 1)
    return unfilter(data[:, 0], data[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_LOW = _cosines(32, 8)


def _averages(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x averaged (or repeated, when there are fewer) to n rows."""
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0, dtype=np.float64)])
    low = np.arange(n) * len(x) // n
    high = np.maximum(low + 1, np.arange(1, n + 1) * len(x) // n)
    return (total[high] - total[low]) / (high - low)[:, None]


def picture_hash(samples: np.ndarray) -> str:
    """Perceptual hash of a grey picture as 16 hex digits."""
    small = _averages(_averages(samples.astype(np.float64), 32).T, 32).T
    low = np.round(_LOW @ small @ _LOW.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        media = [encode_png(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height")}
        for png in batch.column("media").to_pylist():
            samples = decode_png(png)
            payload = samples.tobytes()
            for c, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), picture_hash(samples), len(samples)), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {c: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for c, v in out.items()})


def texts_to_media(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes and the picture as a binary column, media."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read the pictures of texts_to_media back, with all tests, and describe them."""
    return media.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height long")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return media_features(texts_to_media(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")))

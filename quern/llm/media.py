"""Bytes as grey PNG images in binary columns, and hashes of what they show.

``encode_png`` writes one image a row: 8-bit samples, ``width`` to a line, each
line filtered by whichever of none, left and up leaves the smallest residuals.
``decode_png`` reads any 8-bit grey PNG without interlacing: it tests every
chunk's checksum, inflates the data chunks and undoes the filters in numpy.
``cosine_hash`` shrinks an image to 32 x 32 by block means, takes the cosine
transform and sets a bit for each of the 8 x 8 lowest frequencies above their
median.

Cases: a null payload is an empty one; an image has one line at least, padded
with zeros; filters that tie in cost are taken in the order named; a frequency
at the median gives no bit; repeated rows are alike; a very long payload is one
image, held by one task at a time; an empty table gives an empty result; extra
columns are ignored, whatever their names; a damaged image raises ``ValueError``
with the chunk's name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.shared import ship

MAGIC = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 6
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG whose samples are ``payload``, padded with zeros to whole lines."""
    lines = max(1, -(-len(payload) // width))
    x = np.zeros(lines * width, np.uint8)
    x[: len(payload)] = np.frombuffer(payload, np.uint8)
    x = x.reshape(lines, width)
    left, up = x.copy(), x.copy()
    left[:, 1:] -= x[:, :-1]
    up[1:] -= x[:-1]
    tried = np.stack([x, left, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((lines, width + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tried[best, np.arange(lines)]
    header = struct.pack(">IIBBBBB", width, lines, 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c


def _unfilter(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Undo the filters, whole runs of equal kind at once where lines don't wait for their left neighbour."""
    out = np.empty_like(x)
    zero = np.zeros(x.shape[1], np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(kinds)], strict=True):
        kind, prior = int(kinds[lo]), out[lo - 1] if lo else zero
        if kind == 0:
            out[lo:hi] = x[lo:hi]
        elif kind == 1:
            out[lo:hi] = np.cumsum(x[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[lo:hi] = np.cumsum(x[lo:hi], axis=0, dtype=np.uint8) + prior
        elif kind in (3, 4):
            for i in range(lo, hi):
                above, line, left, corner = (out[i - 1] if i else zero).tolist(), x[i].tolist(), 0, 0
                for j, b in enumerate(above):
                    left = (line[j] + ((left + b) // 2 if kind == 3 else _paeth(left, b, corner))) & 255
                    corner = b
                    line[j] = left
                out[i] = line
        else:
            raise ValueError(f"IDAT: no filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples, lines by width."""
    if data[:8] != MAGIC:
        raise ValueError("no PNG signature")
    at, header, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("chunk cut short")
        size = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"{kind.decode('latin-1')}: wrong checksum")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("no header or no end")
    width, lines, depth, colour, *rest = header
    if (depth, colour, rest) != (8, 0, [0, 0, 0]):
        raise ValueError("IHDR: only grey 8-bit samples without interlacing")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != lines * (width + 1):
        raise ValueError("IDAT: wrong size")
    raw = raw.reshape(lines, width + 1)
    return _unfilter(raw[:, 0], raw[:, 1:])


_k = np.arange(LOW)[:, None]
_BASIS = np.cos(np.pi * _k * (2 * np.arange(SIDE)[None, :] + 1) / (2 * SIDE))


def _shrunk(x: np.ndarray, axis: int) -> np.ndarray:
    """Means of SIDE blocks along an axis; a short axis repeats its samples."""
    n = x.shape[axis]
    if n < SIDE:
        return np.take(x, np.arange(SIDE) * n // SIDE, axis=axis)
    edges = np.arange(SIDE + 1) * n // SIDE
    return np.add.reduceat(x, edges[:-1], axis=axis) / np.diff(edges).reshape([-1 if i == axis else 1 for i in range(2)])


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the lowest frequencies lie above their median."""
    small = _shrunk(_shrunk(samples.astype(np.float64), 0), 1)
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes()


def padded(payload: bytes, width: int = WIDTH) -> bytes:
    return payload + bytes(width - len(payload) if not payload else -len(payload) % width)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """``id, n_bytes, media``: each text's UTF-8 bytes as a PNG in a binary column."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_png(padded(x, width), width, level) for x in raw], pa.binary())], names=["id", "n_bytes", "media"])

    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("payload"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(encode, f"id {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """``stored`` without the images, with what is read back from them: digests, checksum, ``feature`` (binary)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            rows = []
            for media in b.column(2).to_pylist():
                samples = decode_png(media)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    ship(stored.sparkSession)
    kind = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(read, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary")

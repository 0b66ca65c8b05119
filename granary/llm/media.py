"""Media columns: lossless 8-bit PNG in binary columns, read with checks, and cosine-transform hashes.

Only zlib and numpy are used. The writer makes one gray image 64 samples wide and picks each row's filter; the reader tests
the signature, the chunk order, every chunk's CRC and the inflated length, and undoes all five filters.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import clean, mapped, text_bytes

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by PNG colour type; palettes (3) aren't read.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64


class MediaError(ValueError):
    """The bytes aren't a PNG that this module reads, or are damaged."""


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """data and bytes 0 up to a positive multiple of `unit`."""
    return data + bytes(-len(data) % unit if data else unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A PNG of gray samples (rows x width, uint8). Of the filters None, Sub and Up a row gets the one whose
    signed residuals have the least sum of sizes, the first on a tie."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    tried = (samples, sub, up)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int32)).sum(1) for x in tried])
    pick = cost.argmin(0).astype(np.uint8)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = pick
    rows[:, 1:] = np.choose(pick[:, None], tried)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk, after its check sum was tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("cut within a chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data):
            raise MediaError("cut within a chunk")
        body = data[at + 8 : end - 4]
        if struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"wrong check sum of chunk {kind!r}")
        yield kind, body
        at = end
        if kind == b"IEND":
            if at != len(data):
                raise MediaError("bytes after the end")
            return
    raise MediaError("no end chunk")


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """The samples of filtered rows (filter byte first); step: bytes a pixel."""
    height, width = rows.shape[0], rows.shape[1] - 1
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if height and kinds.max() > 4:
        raise MediaError("unknown filter")
    at = 0
    while at < height:
        kind, end = kinds[at], at + 1
        while end < height and kinds[end] == kind:  # rows of one filter go together where they can
            end += 1
        run = out[at:end]
        above = out[at - 1] if at else np.zeros(width, np.uint8)
        if kind == 1:
            for k in range(step):
                run[:, k::step] = np.cumsum(run[:, k::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            run[0] += above
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        elif kind > 2:
            for row in run:
                x, b = row.astype(int).tolist(), above.astype(int).tolist()
                for i in range(width):
                    left, corner = (x[i - step], b[i - step]) if i >= step else (0, 0)
                    if kind == 3:
                        guess = (left + b[i]) >> 1
                    else:
                        p = left + b[i] - corner
                        guess = min((abs(p - left), 0, left), (abs(p - b[i]), 1, b[i]), (abs(p - corner), 2, corner))[2]
                    x[i] = (x[i] + guess) & 255
                row[:] = x
                above = row
        at = end
    return out


def decode_png(data: bytes) -> np.ndarray:
    """rows x (width * samples a pixel) of an 8-bit PNG without interlace; MediaError for anything else."""
    head, packed, done = None, [], False
    for kind, body in chunks(data):
        if (head is None) != (kind == b"IHDR"):
            raise MediaError("the header isn't the first chunk, or stands twice")
        if kind == b"IHDR":
            if len(body) != 13:
                raise MediaError("bad header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            if done:
                raise MediaError("image chunks apart")
            packed.append(body)
        elif packed:
            done = True
        if kind not in (b"IHDR", b"IDAT", b"IEND") and not kind[0] & 32:
            raise MediaError(f"unknown critical chunk {kind!r}")
    width, height, depth, colour, method, filters, interlace = head
    if depth != 8 or colour not in SAMPLES or method or filters or interlace or not width or not height:
        raise MediaError("only 8-bit PNG without palette and interlace")
    line = width * SAMPLES[colour] + 1
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(packed), line * height + 1)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != line * height or not inflate.eof or inflate.unused_data:
        raise MediaError("the image data doesn't fit the header")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, line), SAMPLES[colour])


_N = 32
_COS = np.cos(np.pi / _N * (np.arange(_N)[None] + 0.5) * np.arange(_N)[:, None])


def _cells(x: np.ndarray, axis: int) -> np.ndarray:
    """x averaged along an axis into 32 cells, or stretched to them."""
    n = x.shape[axis]
    if n < _N:
        return np.take(x, np.arange(_N) * n // _N, axis)
    starts = np.arange(_N) * n // _N
    width = np.diff(np.append(starts, n))
    return np.add.reduceat(x, starts, axis) / (width[:, None] if axis == 0 else width)


def dct_hash(samples: np.ndarray) -> str:
    """16 hex digits: the signs, against their median, of the 8 x 8 lowest frequencies of the image shrunk to
    32 x 32; the constant term counts as the median."""
    small = _cells(_cells(samples.astype(np.float64), 0), 1)
    low = np.round((_COS[:8] @ small @ _COS[:8].T).ravel(), 6)
    low[0] = np.median(low[1:])
    return f"{int(''.join('1' if v else '0' for v in low > np.median(low)), 2):016x}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as the samples of a PNG. A null text is empty."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        data = [text_bytes(t) for t in rows["text"]]
        media = [encode_png(np.frombuffer(padded(d), np.uint8).reshape(-1, WIDTH)) for d in data]
        return {"doc_id": rows["doc_id"], "n_bytes": [len(d) for d in data], "media": media}

    return mapped(clean(docs, "doc_id", "text"), lambda: run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, from the stored bytes read back, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (the cosine-transform hash). A damaged image raises MediaError; a null one gives
    nulls."""

    def of(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        samples = decode_png(data)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), dct_hash(samples)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(rows: dict[str, list]) -> dict[str, list]:
        read = [of(x) for x in rows["media"]]
        return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"]} | {c: [r[i] for r in read] for i, c in enumerate(names)}

    return mapped(clean(media, "doc_id", "n_bytes", "media"), lambda: run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

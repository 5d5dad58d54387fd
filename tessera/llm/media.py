"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

Decoders take the stored bytes only: binary P5 and P6 with 8-bit samples, and uncompressed BMP of 8 (grey palette ignored,
samples returned), 24 or 32 bits, bottom-up or top-down. Anything else gives null features, not an error. Null media give
nulls. Repeated rows repeat their results; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

ROW = 64  # pixels of three samples in a row of a stored text: 192 bytes


def write_ppm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def write_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, bottom-up, rows padded to four bytes."""
    h, w = pixels.shape[:2]
    pitch = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, pitch), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + h * pitch, 0, 0, 54, 40, w, h, 1, 24, 0, h * pitch, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray | None:
    """P5: (h, w); P6: (h, w, 3)."""
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1
            if not at:
                return None
            continue
        stop = at
        while stop < len(data) and data[stop : stop + 1].isdigit():
            stop += 1
        if stop == at:
            return None
        fields.append(int(data[at:stop]))
        at = stop
    w, h, most = fields
    deep = 3 if data[:2] == b"P6" else 1
    if not 0 < most < 256 or len(data) < at + 1 + w * h * deep or w * h == 0:
        return None
    flat = np.frombuffer(data, np.uint8, w * h * deep, at + 1)
    return flat.reshape(h, w, 3) if deep == 3 else flat.reshape(h, w)


def decode_bmp(data: bytes) -> np.ndarray | None:
    if len(data) < 54:
        return None
    begin, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    n, deep = abs(h), bits // 8
    pitch = (bits * w + 31) // 32 * 4
    if packed or bits not in (8, 24, 32) or w <= 0 or not n or len(data) < begin + n * pitch:
        return None
    rows = np.frombuffer(data, np.uint8, n * pitch, begin).reshape(n, pitch)[:, : w * deep]
    rows = rows[::-1] if h > 0 else rows
    return rows if deep == 1 else rows.reshape(n, w, deep)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    if data is None:
        return None
    return decode_netpbm(data) if data[:2] in (b"P5", b"P6") else decode_bmp(data) if data[:2] == b"BM" else None


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, by differences of an integral image read at fractional places."""
    plane = image.reshape(image.shape[0], image.shape[1], -1).astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = plane.shape[axis]
        total = np.concatenate([np.zeros_like(plane.take([0], axis)), plane.cumsum(axis)], axis)
        edges = np.arange(size + 1) * (n / size)
        low = np.minimum(edges.astype(np.int64), n - 1)
        shape = [1, 1, 1]
        shape[axis] = -1
        part = (edges - low).reshape(shape)
        at = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
        plane = np.diff(at, axis=axis) * (size / n)
    return plane if image.ndim == 3 else plane[:, :, 0]


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 grey cells is darker than its right neighbour."""
    cells = area_resize(grey(image), 8, 9)
    return np.packbits(cells[:, 1:] > cells[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The thumbnail of side x side as the bytes of an NPY file (uint8, rounded half up)."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(image, side, side) + 0.5 + 1e-9).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store_text(text: str) -> bytes:
    """The text's UTF-8 bytes, padded with blanks to a positive multiple of 192, as the samples of an image 64 pixels wide.

    An even number of rows makes a P6 file, an odd one a BMP.
    """
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // (3 * ROW))) * 3 * ROW
    pixels = np.frombuffer(raw.ljust(size, b" "), np.uint8).reshape(-1, ROW, 3)
    return write_bmp(pixels) if len(pixels) % 2 else write_ppm(pixels)


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary); null texts count as empty."""

    def start():
        return lambda cols: [cols[0], [len(t.encode("utf-8", "surrogatepass")) for t in cols[1]], list(map(store_text, cols[1]))]

    return map_batches(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t")), f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, media binary", start, 256)


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of `media` and: payload binary (the decoded samples), tile binary (NPY), dhash string; null where undecodable."""
    kept = [c for c in media.columns if c not in ("payload", "tile", "dhash")]
    at = kept.index(media_col)
    kinds = dict(media.dtypes)

    def start():
        def work(cols):
            images = list(map(decode, cols[at]))
            each = lambda f: [None if x is None else f(x) for x in images]
            return [*cols, each(lambda x: np.ascontiguousarray(x).tobytes()), each(npy_tile), each(difference_hash)]

        return work

    return map_batches(media.select(*kept), ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", payload binary, tile binary, dhash string", start, 128)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media, reads it back, and returns sizes, digests and a feature (difference hash and the tile's crc32)."""

    def start():
        def work(cols):
            out = [[] for _ in range(8)]
            for i, text in zip(*cols):
                media = store_text(text)
                image = decode(media)
                payload = np.ascontiguousarray(image).tobytes()
                row = (i, len(text.encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image)}:{zlib.crc32(npy_tile(image)):08x}")
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t")), schema, start, 256)

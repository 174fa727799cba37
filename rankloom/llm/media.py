"""Media columns: Netpbm and BMP images decoded to arrays, resized, tiled as NPY, hashed (operator 3).

decode() reads binary Netpbm (P4, P5, P6, with comments, 8 and 16 bit), plain Netpbm (P1, P2, P3) and
uncompressed BMP (1, 4, 8, 24, 32 bits a pixel, bottom-up and top-down) into numpy arrays. area_resize()
averages exact pixel areas through an integral image. tiles() cuts an array into tiles stored as NPY
bytes, which unpack() reads back losslessly. difference_hash() resizes to 9 x 8 and compares neighbours.

The query stores whole texts as 8-bit samples: payload -> PGM -> decoded array -> NPY, reads the NPY
bytes back and takes all digests from what it read.

Defined cases: null media give null results; bytes that aren't an image raise ValueError in decode() and
give a null array and an error message in decode_column(); samples below a Netpbm maximum other than 255 or 65535 are scaled
up to it; a BMP with bit fields is refused; a null or empty text is stored as 64 bytes of zero; a very long text is one array, and
resized by bands of rows, so that no more than a band is held in floating point; ties between neighbours in the difference
hash are 0; repeated rows give repeated results; empty tables give empty results; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.common import arrow_batches, batch, saved, slices, table, texts, values

WIDTH = 64
#: Rows that are summed in floating point at once.
BAND = 4096
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at = data[:2], 2
    fields = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise ValueError("short Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = *fields[:2], fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        found = [48 - x for x in body if x in b"01"] if kind == b"P1" else [int(x) for x in body.split()]
        pixels = np.array([x + 1 if kind == b"P1" else x for x in found[: w * h * channels]], dtype=np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        pixels = (1 - bits).astype(np.uint8)
    else:
        kind_ = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        pixels = np.frombuffer(data, kind_, w * h * channels, at + 1).astype(np.uint16 if top > 255 else np.uint8)
    if pixels.size < w * h * channels:
        raise ValueError("short Netpbm data")
    if top not in (1, 255, 65535) and kind not in (b"P1", b"P4"):
        most = 65535 if top > 255 else 255
        pixels = (np.minimum(pixels, top).astype(np.uint64) * most * 2 + top) // (2 * top)
        pixels = pixels.astype(np.uint16 if top > 255 else np.uint8)
    return pixels.reshape((h, w, 3) if channels == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    offset, head = struct.unpack_from("<II", data, 10)
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing != 0 or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits with compression {packing}")
    row, rows = (w * bits + 31) // 32 * 4, abs(h)
    raw = np.frombuffer(data, np.uint8, row * rows, offset).reshape(rows, row)
    raw = raw[::-1] if h > 0 else raw
    if bits >= 24:
        return raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1].copy()
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = raw[:, :w]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :w]
    else:
        index = np.unpackbits(raw, axis=1)[:, :w]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples; ValueError if data is no supported image. In P1 and P4 black is 0."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(m + 1) * (n / m)
    low = np.minimum(at.astype(np.int64), n)
    return low, np.minimum(low + 1, n), at - low


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over exact, possibly fractional, areas of a grey image, from its integral image."""
    h, w = pixels.shape
    rows, next_row, row_share = _edges(h, height)
    cols, next_col, col_share = _edges(w, width)
    whole = np.zeros((height + 1, w + 1))  # the integral image's rows at the targets' edges
    above = np.zeros(w + 1)  # the integral image's row before the band
    wanted: dict[int, np.ndarray] = {}
    needed = set(rows.tolist()) | set(next_row.tolist())
    for start in range(0, h, BAND):
        band = np.cumsum(np.cumsum(pixels[start : start + BAND], axis=0, dtype=np.float64), axis=1)
        for r in sorted(n for n in needed if start < n <= start + len(band)):
            wanted[r] = above + np.concatenate([[0.0], band[r - start - 1]])
        above = above + np.concatenate([[0.0], band[-1]])
    wanted[0] = np.zeros(w + 1)
    for k, (low, high, share) in enumerate(zip(rows.tolist(), next_row.tolist(), row_share.tolist(), strict=True)):
        whole[k] = wanted[low] * (1 - share) + wanted[high] * share
    part = whole[:, cols] * (1 - col_share) + whole[:, next_col] * col_share
    area = (h / height) * (w / width)
    return (part[1:, 1:] - part[:-1, 1:] - part[1:, :-1] + part[:-1, :-1]) / area


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, as 16 hex digits: whether each of 8 x 8 areas is darker than its right neighbour."""
    small = np.round(area_resize(grey(pixels), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def pack(pixels: np.ndarray) -> bytes:
    """The NPY file of an array."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def unpack(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(pixels: np.ndarray, side: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of the tiles of at most side x side samples."""
    for i in range(0, pixels.shape[0], side):
        for j in range(0, pixels.shape[1], side):
            yield i // side, j // side, pack(pixels[i : i + side, j : j + side])


def decode_column(df: DataFrame, id_col: str, media_col: str, side: int = 256) -> DataFrame:
    """A row a tile (id, height, width, channels, tile_row, tile_col, tile, dhash, error); undecodable media a row with error."""
    out = pa.schema([("id", pa.int64()), *((c, pa.int32()) for c in ("height", "width", "channels", "tile_row", "tile_col")), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def rows(key: int | None, data: bytes | None) -> Iterator[tuple]:
        try:
            pixels = decode(data) if data is not None else None
        except ValueError as e:
            yield (key, *[None] * 7, str(e))
            return
        if pixels is None or not pixels.size:
            yield (key, *[None] * 7, None if pixels is None else "no pixels")
            return
        shape = (*pixels.shape[:2], 1 if pixels.ndim == 2 else pixels.shape[2])
        for i, j, tile in tiles(pixels, side):
            yield (key, *shape, i, j, tile, difference_hash(pixels), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [r for k, d in zip(values(b.column(0)), values(b.column(1)), strict=True) for r in rows(k, d)]
            yield batch(out, list(zip(*found, strict=True)) if found else [[]] * len(out))

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("id"), df[media_col].alias("media")).mapInArrow(run, "id long, height int, width int, channels int, tile_row int, tile_col int, tile binary, dhash string, error string")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as the samples of one NPY tile."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, media = [], []
            for text in texts(b.column(1)):
                raw = text.encode()
                sizes.append(len(raw))
                raw += bytes(-len(raw) % WIDTH if raw else WIDTH)
                media.append(pack(decode(encode_pgm(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)))))
            yield batch(out, [b.column(0), sizes, media])

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and the difference hash of what stored media hold."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for media in values(b.column(2)):
                pixels = unpack(media)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels)))
            yield batch(out, [b.column(0), b.column(1), *(zip(*rows, strict=True) if rows else [[]] * 6)])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media_columns(spark, sf_dir):
    return read_back(saved(store_texts(table(spark, sf_dir, "documents")), "media"))

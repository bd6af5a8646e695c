"""Media columns: Netpbm and BMP images decoded to arrays, area-resized by integral images, kept as NPY tiles.

Netpbm P1 to P6 of up to 8 bits and uncompressed BMP of 8, 24 and 32 bits are read; anything else, null or cut-off data
gives null columns and a reason in `error`, never a failed job, and so do images of over `most_pixels` in `media_tiles`
(a header can promise more than its bytes hold). Every row stands alone: no shuffle, and a task holds one Arrow batch of
at most 64 MB. Equal images give equal tiles and hashes, equal neighbours in a hash are no brighter than each other. A
text of any length is one image: integral images are added up by bands of rows, so beside its bytes little is held. No
rows give no rows. Input columns that have the name of a result are kept with `_input` after their name; other columns
stay as they are.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from sorrel.llm.common import by_batch, documents, pieces, raw, stored

SIDE = 24  # 24 x 24 samples = 576 bytes a tile
MOST_PIXELS = 1 << 28  # of an image in `media_tiles`
BAND = 1 << 20  # pixels of an integral image that are held together


def encode_pgm(samples: bytes, width: int = SIDE) -> bytes:
    """Samples as a binary greyscale Netpbm image; their number must be a multiple of width."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(samples: bytes, width: int = SIDE) -> bytes:
    """Samples as an uncompressed 8-bit BMP with a grey palette; rows from the bottom up, as the format has them."""
    if not samples or len(samples) % width or width % 4:
        raise ValueError("samples must fill whole rows of four samples each or a multiple")
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    offset = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", (offset + len(samples)) & 0xFFFFFFFF, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, len(rows), 1, 8, 0, len(samples) & 0xFFFFFFFF, 0, 0, 256, 0)
    return head + palette.tobytes() + rows[::-1].tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def decode_netpbm(data: bytes, most_pixels: float = math.inf) -> np.ndarray:
    """Height x width (P1, P2, P4, P5) or height x width x 3 (P3, P6) array of uint8; bitmaps become 0 and 255."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap = kind in (b"P1", b"P4")
    for _ in range(2 if bitmap else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("header is cut off")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    top = 1 if bitmap else fields[2]
    if not width or not height or not 0 < top < 256:
        raise ValueError("unsupported size or depth")
    if width * height > most_pixels:
        raise ValueError("more pixels than are read")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    n = width * height * depth
    if kind in (b"P5", b"P6"):
        samples = np.frombuffer(data, np.uint8, n, at + 1)
    elif kind == b"P1":
        samples = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", data[at:])), np.uint8) - 48
    else:
        samples = np.array([min(int(x), 1 << 16) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]], np.int64)
    if len(samples) < n:
        raise ValueError("samples are cut off")
    samples = samples[:n]
    if kind in (b"P2", b"P3") and int(samples.max()) > top:
        raise ValueError("a sample is over the depth")
    if kind == b"P1":
        samples = 1 - samples
    if top != 255:
        samples = (samples.astype(np.uint32) * 255 + top // 2) // top
    return samples.astype(np.uint8).reshape((height, width, depth) if depth > 1 else (height, width))


def decode_bmp(data: bytes, most_pixels: float = math.inf) -> np.ndarray:
    """Height x width x 3 array of uint8, in the order red, green, blue; height x width if the palette is all grey."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    offset, head, width, height, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    if width * abs(height) > most_pixels:
        raise ValueError("more pixels than are read")
    step = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), offset).reshape(abs(height), step)[:, : width * bits // 8]
    if height > 0:
        rows = rows[::-1]
    if bits == 8:
        table = np.frombuffer(data, np.uint8, (offset - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        if len(table) == 256 and (table[:, :3] == table[:, :1]).all():
            return table[:, 0][rows]
        return table[rows][:, :, 2::-1].copy()
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def decode(data: bytes, most_pixels: float = math.inf) -> np.ndarray:
    return decode_bmp(data, most_pixels) if data[:2] == b"BM" else decode_netpbm(data, most_pixels)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the image over each cell of a height x width grid, parts of pixels counted by their area.

    The integral image is read at the grid's corners with linear interpolation, which is exact for a function that is
    constant on each pixel. Its rows are added up band by band, and those beside a row of corners alone are kept.
    """
    edges = np.linspace(0, image.shape[0], height + 1)
    low = np.minimum(edges.astype(np.int64), image.shape[0] - 1)
    need = np.unique(np.concatenate([low, low + 1]))
    rows, sums = np.zeros((len(need), image.shape[1] + 1)), np.zeros(image.shape[1])
    band = max(1, BAND // image.shape[1])
    for start in range(0, image.shape[0], band):
        part = sums + np.cumsum(image[start : start + band], axis=0, dtype=np.float64)
        own = (need > start) & (need <= start + len(part))
        rows[own, 1:] = part[need[own] - start - 1]
        sums = part[-1]
    np.cumsum(rows, axis=1, out=rows)

    def at(x: np.ndarray, first: np.ndarray, second: np.ndarray, part: np.ndarray) -> np.ndarray:
        return x[first] * (1 - part[:, None]) + x[second] * part[:, None]

    corners = at(rows, np.searchsorted(need, low), np.searchsorted(need, low + 1), edges - low)
    edges = np.linspace(0, image.shape[1], width + 1)
    low = np.minimum(edges.astype(np.int64), image.shape[1] - 1)
    corners = at(corners.T, low, low + 1, edges - low).T
    return np.diff(np.diff(corners, axis=0), axis=1) / (image.shape[0] * image.shape[1] / (height * width))


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side x side bits in hex: is a cell brighter than its left neighbour in the image reduced to side + 1 columns."""
    small = np.round(area_resize(grey(image), side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def reduced(image: np.ndarray, height: int = SIDE, width: int = SIDE) -> bytes:
    """The grey image resized to height x width, as an NPY file."""
    return to_npy(np.clip(np.rint(area_resize(grey(image), height, width)), 0, 255).astype(np.uint8))


def media_tiles(df: DataFrame, media: str = "media", height: int = SIDE, width: int = SIDE, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """Adds to each row of df: rows, cols, tile (NPY bytes of the grey image resized to height x width), dhash, error."""
    added = [StructField("rows", IntegerType()), StructField("cols", IntegerType()), StructField("tile", BinaryType()), StructField("dhash", StringType()), StructField("error", StringType())]
    taken = {f.name for f in added}
    own = [F.col(f"`{c}`").alias(f"{c}_input" if c in taken else c) for c in df.columns]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: list[list] = [[] for _ in added]
            for data in batch.column(1).to_pylist():
                row = (None, None, None, None, "null")
                if data is not None:
                    try:
                        image = decode(data, most_pixels)
                        row = (*image.shape[:2], reduced(image, height, width), difference_hash(image), None)
                    except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                        row = (None, None, None, None, str(e)[:200])
                for column, value in zip(new, row, strict=True):
                    column.append(value)
            results = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(new, kinds, strict=True)], names=[f.name for f in added])
            yield pa.RecordBatch.from_arrays([batch.column(0), results], names=["row", "result"])

    rows = df.select(F.struct(*own).alias("row"), F.col(f"`{media}`").cast("binary").alias("media"))
    done = rows.mapInArrow(work, StructType([StructField("row", rows.schema["row"].dataType), StructField("result", StructType(added))]))
    return done.select("row.*", "result.*")


def text_media(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_bytes and media, an NPY file of tiles 24 x 24 that hold its UTF-8 bytes.

    The bytes are padded with 255 to a positive multiple of 576 and made an image 24 samples wide, a BMP where their CRC
    is odd and Netpbm elsewhere; what decoding it gives is cut into tiles. Null and empty texts give one tile of 255;
    repeated rows stay.
    """

    def tiles(text: bytes) -> bytes:
        payload = text.ljust(max(1, -(-len(text) // SIDE**2)) * SIDE**2, b"\xff")
        image = encode_bmp(payload) if zlib.crc32(payload) % 2 else encode_pgm(payload)
        return to_npy(decode(image).reshape(-1, SIDE, SIDE))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (x for b in batches for x in pieces(b)):
            texts = raw(batch, "text")
            yield {"doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "media": [tiles(t) for t in texts]}

    return by_batch(documents(docs), work, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored tiles give back: the payload's size, hashes, the difference hash of the whole image and its hash when reduced to one tile."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")}
            for data in batch.column(2).to_pylist():
                payload = from_npy(data).reshape(-1, SIDE)
                flat = memoryview(payload).cast("B")
                digest = lambda x: hashlib.sha256(x).hexdigest()
                for k, v in zip(out, (len(flat), digest(flat), zlib.crc32(flat[-32:]), len(data), digest(data), difference_hash(payload), digest(reduced(payload))), strict=True):
                    out[k].append(v)
            yield out | {"doc_id": batch.column(0), "n_bytes": batch.column(1)}

    return by_batch(media.select("doc_id", "n_bytes", "media"), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")


def store_and_read(docs: DataFrame) -> DataFrame:
    """The features of every document, from tiles that were written to the shared folder and read again."""
    return media_features(stored(text_media(docs), "media"))

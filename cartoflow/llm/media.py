"""Media columns: Netpbm and BMP bytes, decoded to numpy, area-resized, kept as NPY tiles with difference hashes.

Null and empty text: a payload of 64 zero bytes.  Equal texts give equal
values.  A very long text is an image of its own; its integral image is made in
bands of rows, so memory stays near the image's.  Repeated rows each get their
row; ties (cells of equal brightness) give a 0 bit; columns other than the two
named are left out; an empty table gives an empty result.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, each, map_texts, new_folder, slices

WIDTH = 64
TILE = 16
_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
_MAXVAL = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8, (height, width) or (height, width, 3); bits become 0 and 255; 8-bit samples only."""
    head = _HEADER.match(data)
    if not head:
        raise ValueError("not a Netpbm image")
    kind, width, height = int(head[1]), int(head[2]), int(head[3])
    at, depth = head.end(), 3 if kind in (3, 6) else 1
    if kind in (2, 3, 5, 6):
        most = _MAXVAL.match(data, at)
        if not most or not 0 < int(most[1]) < 256:
            raise ValueError("8-bit samples only")
        at = most.end() if kind > 3 else most.end() - 1
    elif kind == 4:
        at += 1
    if kind > 4:
        pixels = np.frombuffer(data, np.uint8, width * height * depth, at)
    elif kind == 4:
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)[:, :width]
        pixels = (1 - bits) * np.uint8(255)
    else:
        plain = re.sub(rb"#[^\n]*", b"", data[at:])
        if kind == 1:
            pixels = (1 - np.frombuffer(re.sub(rb"\s", b"", plain)[: width * height], np.uint8) + 48).astype(np.uint8) * np.uint8(255)
        else:
            pixels = np.array(plain.split()[: width * height * depth], dtype=np.uint8)
    return pixels.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a grey palette, or 24 or 32 bits (as RGB)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    offset, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32):
        raise ValueError("uncompressed 8, 24 or 32 bits only")
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)[:, : width * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (offset - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)
        if (palette[:, 0] != palette[:, 1]).any() or (palette[:, 0] != palette[:, 2]).any():
            raise ValueError("grey palettes only")
        pixels = pixels if np.array_equal(palette[:, 0], np.arange(256)) else palette[:, 0][pixels]
    else:
        pixels = pixels.reshape(rows, width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8 bits, grey palette, rows from the bottom up, each padded to 4 bytes."""
    height, width = pixels.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    offset = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


#: Pixels whose integral image is held at once.
BAND = 1 << 20


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target pixel covers, exact at fractions: the integral image, interpolated at the cuts.

    Only the rows of the integral image next to a cut are kept, band by band.
    """
    h, w = pixels.shape[:2]
    at = np.arange(height + 1) * h / height
    low = np.minimum(at.astype(int), h - 1)
    needed = np.unique(np.concatenate([low, low + 1]))
    kept = np.zeros((len(needed), w + 1))
    above, step = np.zeros(w + 1), max(1, BAND // max(1, w))
    for start in range(0, h, step):
        band = pixels[start : start + step]
        grey = band if band.ndim == 2 else band.mean(axis=2)
        integral = np.zeros((len(grey) + 1, w + 1))
        np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
        integral += above
        a, b = np.searchsorted(needed, [start, start + len(grey) + 1])
        kept[a:b] = integral[needed[a:b] - start]
        above = integral[-1]
    part = (at - low)[:, None]
    rows = kept[np.searchsorted(needed, low)] * (1 - part) + kept[np.searchsorted(needed, low + 1)] * part
    at = np.arange(width + 1) * w / width
    low = np.minimum(at.astype(int), w - 1)
    part = at - low
    picked = rows[:, low] * (1 - part) + rows[:, low + 1] * part
    return np.diff(np.diff(picked, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: is a cell of the 8 x 9 reduction darker than its right neighbour?"""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def npy_tile(pixels: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(pixels, size, size) + 0.5).astype(np.uint8))
    return out.getvalue()


def store(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the image that holds them: WIDTH pixels a row; PGM for an even number of rows, else BMP."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // WIDTH))
    pixels = np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
    return len(raw), encode_bmp(pixels) if rows % 2 else encode_pgm(pixels)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and media (binary)."""
    return map_texts(df, each(store), "n_bytes long, media binary", id_col, text_col)


def describe(data: bytes) -> tuple:
    pixels = decode(data)
    payload = pixels.tobytes()
    tile = npy_tile(pixels)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(pixels):016x}:{zlib.crc32(tile):08x}", tile


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``id_col``, n_bytes, media: both columns, the payload's and the image's digests, feature (difference hash, CRC of the tile) and the NPY tile."""
    full = StructType.fromDDL(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, {FEATURES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            column = batch.column(2)
            for start, end in slices(pa.compute.binary_length(column).to_pylist()):
                made = zip(*(describe(x) for x in column.slice(start, end - start).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start).cast(arrow.field(i).type) for i in (0, 1)), *(pa.array(c, arrow.field(i + 2).type) for i, c in enumerate(made))], schema=arrow)

    return df.select(id_col, "n_bytes", "media").mapInArrow(run, full)


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Images below ``folder``/media, then, from what was stored, features and NPY tiles below ``folder``/tiles."""
    media = to_media(df, id_col, text_col)
    media.write.option("compression", "zstd").parquet(f"{folder}/media")
    stored = df.sparkSession.read.schema(media.schema).parquet(f"{folder}/media")
    features(stored, id_col).write.option("compression", "zstd").parquet(f"{folder}/tiles")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write`` stored; the CRC in feature is that of the NPY tile as read back."""
    crc = F.lower(F.lpad(F.hex(F.crc32("tile")), 8, "0"))
    return spark.read.parquet(f"{folder}/tiles").withColumn("feature", F.concat(F.substring_index("feature", ":", 1), F.lit(":"), crc))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media")
    write(documents(spark, sf_dir), folder)
    return read(spark, folder).drop("tile")


QUERIES = {"op7_media": op7_media}

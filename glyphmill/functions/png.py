"""PNG files of masks and grey or RGB images, written with zlib alone, and sizes of images from their headers; reading pixels is left to Spark's image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of an array of bytes, (h, w) grey or (h, w, 3) RGB; booleans become 0 and 255."""
    p = np.ascontiguousarray(pixels.astype(np.uint8) * 255 if pixels.dtype == bool else pixels.astype(np.uint8))
    h, w = p.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, -1)], axis=1)  # each row starts with its filter, none

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if p.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def size_of(head: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG or JPEG from its first bytes, None for what is neither."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(head) and head[at] == 0xFF:
        kind = head[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # fill bytes and marks without a length
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a start of frame
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


@pandas_udf(SIZE)
def image_size(head: pd.Series) -> pd.DataFrame:
    """Struct (width, height) of an image from its first bytes; nulls for what is no image."""
    found = [(None, None) if h is None else size_of(bytes(h)) or (None, None) for h in head]
    return pd.DataFrame({"width": pd.array([w for w, _ in found], "Int32"), "height": pd.array([h for _, h in found], "Int32")})

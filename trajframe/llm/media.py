"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

An image is decoded to a (height, width, channels) array of bytes, area-resized through its integral image (so that
the cost follows the pixels read, not the ratio), and kept as an NPY tile with a 64-bit difference hash. Documents
become images losslessly: their UTF-8 bytes, filled with 255 to a positive multiple of 576, are the samples of a 24
pixels wide grey Netpbm image.

Nulls: null text is an empty text's payload, null media a null row of results. Malformed media give nulls and a reason.
Equal bytes give equal results; repeated rows and ids give a row each.
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
from pyspark.sql import functions as F

from trajframe.llm.common import stored, utf8

UNIT, WIDTH, FILL = 576, 24, 255
TILE = 24

_NETPBM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary PGM or PPM of an array of bytes."""
    h, w, c = image.shape
    return b"P%d\n%d %d\n255\n" % ({1: 5, 3: 6}[c], w, h) + image.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    m = _NETPBM.match(data)
    if not m or int(m[4]) != 255:
        raise ValueError("not a binary 8-bit PGM or PPM")
    w, h, c = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
    if not w or not h:
        raise ValueError("an image without pixels")
    return np.frombuffer(data, np.uint8, h * w * c, m.end()).reshape(h, w, c)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom, blue first; grey is repeated over the channels."""
    h, w, _ = image.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = np.broadcast_to(image, (h, w, 3))[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24-bit BMP of either row order, as red, green, blue."""
    at, (w, h, _, depth, packing) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<iiHHI", data, 18)
    if data[:2] != b"BM" or depth != 24 or packing:
        raise ValueError("not an uncompressed 24-bit BMP")
    if w <= 0 or not h:
        raise ValueError("an image without pixels")
    stride = (w * 3 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * 3].reshape(abs(h), w, 3)
    return (rows[::-1] if h > 0 else rows)[:, :, ::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's (fractional) area, from differences of the integral image; floats."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def along(x: np.ndarray, n: int, to: int) -> np.ndarray:
        at = np.arange(to + 1) * (n / to)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low).reshape(-1, *[1] * (x.ndim - 1))
        return x[low] * (1 - part) + x[low + 1] * part

    rows = along(total, h, height)
    cells = along(rows.swapaxes(0, 1), w, width).swapaxes(0, 1)
    sums = cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]
    return sums / (h / height * w / width)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 grey cells is brighter than its right neighbour."""
    grey = np.round(area_resize(image, 8, 9).mean(axis=2), 6)
    return int(np.packbits(grey[:, :-1] > grey[:, 1:]).view(">u8")[0])


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image area-resized to a square of bytes, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(np.round(area_resize(image, size, size), 6)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_of(text: bytes) -> bytes:
    return text + bytes([FILL]) * (-len(text) % UNIT if text else UNIT)


def documents_to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a grey Netpbm image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                media, sizes = [], []
                for x in part.column(1):
                    text = x.as_buffer().to_pybytes()
                    sizes.append(len(text))
                    media.append(encode_netpbm(np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH, 1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Every row of ``media`` (a binary ``media`` and any columns) with its NPY tile, difference hash and digests.

    Columns of these names that ``media`` has are replaced. Media that cannot be decoded have a reason in media_fault,
    their own digest, and nulls for the rest.
    """
    added = "height int, width int, npy binary, dhash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media_fault string"
    empty = [None] * 10
    media = media.drop(*[x.split(" ")[0] for x in added.split(", ")])

    def of(data: bytes | None) -> list:
        if data is None:
            return empty
        own = [len(data), hashlib.sha256(data).hexdigest()]
        try:
            image = decode(data)
        except (ValueError, struct.error) as fault:
            return [None] * 7 + [*own, str(fault)]
        payload = image.tobytes()
        return [image.shape[0], image.shape[1], npy_tile(image), f"{difference_hash(image):016x}", len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [(n, kinds[k]) for n, k in (x.split(" ") for x in added.split(", "))]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                cols = list(zip(*[of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column("media")], strict=True))
                own = [n for n in part.schema.names if n != "media"]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in own] + [pa.array(c, kind) for c, (_, kind) in zip(cols, fields, strict=True)], own + [n for n, _ in fields])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    return media.mapInArrow(run, f"{own}, {added}")


def store_and_read_back(docs: DataFrame) -> DataFrame:
    """Write every document as media, and its NPY tile and features, to the shared folder; return what is read back of both."""
    read = stored(media_features(stored(documents_to_media(docs), "media")), "tiles")
    return read.withColumn("feature", F.concat_ws(":", "dhash", F.sha2("npy", 256))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

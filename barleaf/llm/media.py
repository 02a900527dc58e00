"""Images in binary columns: Netpbm and BMP decoding, area resizing, NPY tiles and difference hashes.

``decode`` reads P1 to P6 Netpbm images and uncompressed 8-, 24- and 32-bit
BMP images into uint8 arrays of shape (height, width, channels). ``resize``
averages over exact pixel areas, also fractional ones, from an integral image.
``dhash`` compares neighbours of a 9 x 8 and an 8 x 9 resize.

Images without pixels, with samples of no range or above it, and broken ones are
a ValueError for ``decode`` and nulls for ``features``.

``of_payloads`` keeps any bytes as gray images: a payload becomes the samples
of a binary PGM of width 24, written to a table in the shared folder and
decoded from what is read back. Defined results: a null text counts as empty
and its payload is one image of 576 bytes 255; equal texts get equal values;
null and repeated keys pass through; an empty table gives an empty result.
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

from barleaf.llm.common import materialize, pick

WIDTH, UNIT, TILE = 24, 576, 16
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"


def netpbm_header(data: bytes) -> tuple[str, list[int], int]:
    """(magic, numbers, offset of the raster): white space and # comments may stand between the numbers."""
    magic, numbers, at = data[:2].decode(), [], 2
    while len(numbers) < (2 if magic in ("P1", "P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    return magic, numbers, at + 1


def netpbm(data: bytes) -> np.ndarray:
    magic, (w, h, *rest), at = netpbm_header(data)
    most, channels = (rest or [1])[0], 3 if magic in ("P3", "P6") else 1
    if magic not in ("P1", "P2", "P3", "P4", "P5", "P6") or not w or not h or not 0 < most < 1 << 16:
        raise ValueError("no Netpbm image of one pixel or more")
    if magic == "P4":
        rows = np.frombuffer(data, "u1", h * (-(-w // 8)), at).reshape(h, -1)
        return (255 * (1 - np.unpackbits(rows, axis=1)[:, :w]))[..., None].astype("u1")
    if magic == "P1":
        bits = np.array([c == "1" for c in re.sub(r"#[^\n]*|\s", "", data[at - 1 :].decode())][: w * h])
        return (255 * (1 - bits.astype("u1"))).reshape(h, w, 1).astype("u1")
    if magic in ("P2", "P3"):
        values = np.array(data[at - 1 :].split(), "i8")[: w * h * channels]
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else "u1", w * h * channels, at)
    if values.size and int(values.max()) > most:
        raise ValueError("a sample above the largest value")
    if most != 255:
        values = (values.astype("i8") * 255 + most // 2) // most
    return values.astype("u1").reshape(h, w, channels)


def bmp(data: bytes) -> np.ndarray:
    at, header, w, h, _, depth, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed not in (0, 3) or depth not in (8, 24, 32) or w < 1 or not h:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits and one pixel or more")
    stride, rows = -(-w * depth // 32) * 4, abs(h)
    raster = np.frombuffer(data, "u1", stride * rows, at).reshape(rows, stride)[:, : w * depth // 8]
    raster = raster[::-1] if h > 0 else raster
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, "u1", used * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        return palette[raster]
    return raster.reshape(rows, w, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    try:
        return bmp(data) if data[:2] == b"BM" else netpbm(data)
    except (IndexError, UnicodeDecodeError, OverflowError, struct.error) as e:
        raise ValueError("broken image") from e


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and left, with a row and a column of zeros first."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), "f8")
    np.cumsum(np.cumsum(image, axis=0, dtype="f8"), axis=1, out=out[1:, 1:])
    return out


def at_edges(table: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of an integral image at fractional positions."""
    low = np.minimum(edges.astype("i8"), table.shape[0] - 2)
    part = (edges - low)[:, None]
    return table[low] * (1 - part) + table[low + 1] * part


def resize(table: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the areas of an h x w grid laid on the image of an integral image."""
    rows, cols = table.shape[0] - 1, table.shape[1] - 1
    sums = at_edges(at_edges(table, np.linspace(0, rows, h + 1)).T, np.linspace(0, cols, w + 1)).T
    return np.diff(np.diff(sums, axis=0), axis=1) * (h * w / (rows * cols))


def bits_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def dhash(table: np.ndarray) -> str:
    """64 bits of neighbours in rows, then 64 of neighbours in columns. Rounded, so equal areas compare equal."""
    across, down = np.round(resize(table, 8, 9), 6), np.round(resize(table, 9, 8), 6)
    return bits_hex(across[:, 1:] > across[:, :-1]) + bits_hex(down[1:] > down[:-1])


def npy(tile: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), tile)
    return out.getvalue()


def tile_and_hash(image: np.ndarray) -> tuple[bytes, str]:
    """The NPY bytes of a TILE x TILE gray tile and the difference hash."""
    gray = image[..., 0] if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])
    table = integral(gray)
    return npy(np.clip(np.rint(resize(table, TILE, TILE)), 0, 255).astype("u1")), dhash(table)


def features(media: DataFrame) -> DataFrame:
    """media (key columns, media binary) -> the key columns, tile_npy, feature; an unreadable image gets nulls."""
    keys = [c for c in media.columns if c != "media"]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in media.select(*keys).dtypes), "tile_npy binary", "feature string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, hashes = [], []
            for data in batch.column("media"):
                try:
                    tile, code = tile_and_hash(decode(data.as_py())) if data.is_valid else (None, None)
                except ValueError:
                    tile = code = None
                tiles.append(tile)
                hashes.append(code)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(tiles, pa.binary()), pa.array(hashes, pa.string())], [*keys, "tile_npy", "feature"])

    return media.select(*keys, "media").mapInArrow(run, schema)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PGM, in a table of the shared folder."""
    raw = pick(docs, doc_id="long", text="string").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    n = F.octet_length("raw")
    rows = F.greatest(F.ceil(n / UNIT), F.lit(1)) * (UNIT // WIDTH)
    header = F.encode(F.format_string(f"P5\n{WIDTH} %d\n255\n", rows), "UTF-8")
    padded = F.rpad("raw", (rows * WIDTH).cast("int"), F.unhex(F.lit("FF")))
    return materialize(raw.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(header, padded).alias("media")), "media")


def of_payloads(docs: DataFrame) -> DataFrame:
    """Digests and features of every text's payload, from the stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column("media"):
                data = item.as_py()
                image = decode(data)
                payload = image.tobytes()
                tile, code = tile_and_hash(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), code, tile))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy"])

    return stored(docs).mapInArrow(run, SCHEMA)

"""Media columns: Netpbm and BMP images in binary columns.

``decode`` turns a file's bytes into a numpy array (height x width, or height x width x 3, 8 or 16 bits): PBM, PGM, PPM in
plain and raw form (P1 to P6), PAM (P7) of 1 or 3 channels, and BMP of 1, 4, 8, 24 or 32 bits without compression.
``resize`` averages areas by an integral image: a target cell is the exact mean over its area, parts of pixels included.
``tile`` writes an array as NPY bytes; ``difference_hash`` compares neighbours of a resized grey image. All work is done image
by image in Arrow batches: nothing is shuffled.
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
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, slices

PAYLOAD_UNIT, SIDE = 576, 24
HASH_WIDTH, HASH_HEIGHT, TILE = 8, 8, 16
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


class MediaError(ValueError):
    """Bytes that are no complete image of a known form."""


def decode(raw: bytes) -> np.ndarray:
    if raw[:2] == b"BM":
        return _bmp(raw)
    if re.match(rb"P[1-7]\s", raw[:3]):
        return _pam(raw) if raw[1:2] == b"7" else _netpbm(raw)
    raise MediaError("neither Netpbm nor BMP")


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, head = int(raw[1:2]), 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(raw, at)
        if not m or not m[1].isdigit():
            raise MediaError("broken header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = (*head, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    if not (width > 0 and height > 0 and 0 < top < 65_536):
        raise MediaError("broken header")
    n = width * height * channels
    if kind == 1:
        bits = re.sub(rb"#[^\n\r]*|\s", b"", raw[at:])
        values = np.frombuffer(bits[:n], np.uint8) - 48
        values = (1 - values) * 255
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n\r]*", b"", raw[at:]).split()[:n], dtype=np.int64).astype(np.uint8 if top < 256 else np.uint16)
    elif kind == 4:
        row = -(-width // 8)
        data = np.frombuffer(raw, np.uint8, offset=at + 1)
        if len(data) < row * height:
            raise MediaError("too short")
        values = (1 - np.unpackbits(data[: row * height].reshape(height, row), axis=1)[:, :width]).reshape(-1) * 255
    else:
        values = np.frombuffer(raw[at + 1 : at + 1 + n * (1 + (top > 255))], np.uint8 if top < 256 else ">u2")
    if len(values) < n:
        raise MediaError("too short")
    values = values.astype(np.uint16 if top > 255 else np.uint8)
    return values[:n].reshape((height, width, 3) if channels == 3 else (height, width))


def _pam(raw: bytes) -> np.ndarray:
    head, end, data = raw.partition(b"ENDHDR\n")
    found = dict(x.split(None, 1) for x in head.split(b"\n")[1:] if x.strip() and not x.startswith(b"#") and len(x.split(None, 1)) == 2)
    try:
        width, height, depth, top = (int(found[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    except (KeyError, ValueError) as e:
        raise MediaError("broken header") from e
    n = width * height * depth
    values = np.frombuffer(data[: n * (1 + (top > 255))], np.uint8 if top < 256 else ">u2")
    if not end or depth not in (1, 3) or n <= 0 or len(values) < n:
        raise MediaError("too short, or channels that are not 1 or 3")
    return values.astype(np.uint16 if top > 255 else np.uint8).reshape((height, width, 3) if depth == 3 else (height, width))


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise MediaError("too short")
    offset, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    colours = struct.unpack_from("<I", raw, 46)[0]
    upright, height = height < 0, abs(height)
    row = (width * bits + 31) // 32 * 4
    if size < 40 or width <= 0 or not height or packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or (packed == 3 and bits != 32) or len(raw) < offset + row * height:
        raise MediaError("too short, or a form of BMP that is not read here")
    rows = np.frombuffer(raw, np.uint8, row * height, offset).reshape(height, row)
    if bits >= 24:
        image = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    else:
        n = colours or 1 << bits
        palette = np.zeros((256, 4), np.uint8)
        own = np.frombuffer(raw[14 + size : 14 + size + 4 * n], np.uint8).reshape(-1, 4)
        palette[: len(own)] = own[:256]
        index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], axis=2).reshape(height, -1)
        image = palette[index[:, :width]][:, :, 2::-1]
        if (image == image[:, :, :1]).all():
            image = image[:, :, 0]
    return np.ascontiguousarray(image if upright else image[::-1])


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey 8-bit image as raw PGM."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit grey or colour image as uncompressed BMP of 24 bits."""
    colour = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image
    height, width = colour.shape[:2]
    rows = np.zeros((height, (width * 24 + 31) // 32 * 4), np.uint8)
    rows[:, : 3 * width] = colour[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image, as doubles."""
    return image.astype(np.float64) if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def _integral(image: np.ndarray) -> np.ndarray:
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    total[1:, 1:] = image.astype(np.float64).cumsum(axis=0).cumsum(axis=1)
    return total


def _between(total: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
    """The integral image at fractional edges: linear inside a pixel, so sums stay exact."""
    low = np.minimum(edges.astype(np.int64), total.shape[axis] - 2)
    part = (edges - low).reshape([-1 if i == axis else 1 for i in range(total.ndim)])
    return np.take(total, low, axis) * (1 - part) + np.take(total, low + 1, axis) * part


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over the areas of a ``height`` x ``width`` grid, as doubles; any size from any size."""
    h, w = image.shape[:2]
    total = _between(_integral(image), np.linspace(0, h, height + 1), 0)
    total = _between(total, np.linspace(0, w, width + 1), 1)
    return np.diff(np.diff(total, axis=0), axis=1) / (h / height * w / width)


def difference_hash(image: np.ndarray, width: int = HASH_WIDTH, height: int = HASH_HEIGHT) -> int:
    """Bit by bit in reading order: whether a cell of the resized grey image is brighter than the next on its right. Means
    are rounded to nine places, so that sums' last bits decide nothing."""
    cells = resize(grey(image), width + 1, height).round(9)
    bits = (cells[:, :-1] > cells[:, 1:]).reshape(-1)
    return int.from_bytes(np.packbits(bits).tobytes(), "big") >> (-len(bits) % 8)


def tile(image: np.ndarray, width: int = TILE, height: int = TILE) -> bytes:
    """The image area-resized to ``height`` x ``width`` 8-bit samples, as NPY bytes."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize(image, width, height).round(9)), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else np.rint(resize(image, width, height).round(9)).astype(np.uint16), allow_pickle=False)
    return out.getvalue()


def _describe(names: list[str], width: int, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            rows = []
            for raw in batch.column(0).to_pylist():
                try:
                    image = decode(raw or b"")
                except MediaError as e:
                    rows.append((None, None, None, None, None, str(e)))
                    continue
                rows.append((image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, f"{difference_hash(image):016x}", tile(image, width, height), None))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return run


def describe(media: DataFrame, *, media_col: str = "media", to: str = "image", tile_width: int = TILE, tile_height: int = TILE) -> DataFrame:
    """``media`` with ``to`` = struct(width, height, channels, dhash, tile: NPY bytes, error) of a binary column. Null, empty and
    broken files have an error and nulls. All other columns stay, whatever their names."""
    rest = [c for c in media.columns if c != to]
    rows = media.select(F.col(media_col).cast("binary").alias("media"), F.struct(*[media[c] for c in rest]).alias("row"))
    own = {"width": "int", "height": "int", "channels": "int", "dhash": "string", "tile": "binary", "error": "string"}
    types = rows.limit(0).select("row", *[F.lit(None).cast(t).alias(k) for k, t in own.items()]).schema
    out = rows.mapInArrow(_describe(types.names, tile_width, tile_height), types)
    return out.select("row.*", F.struct(*own).alias(to))


# Texts as images, for media columns that are made of documents.


def text_image(raw: bytes) -> np.ndarray:
    """A text's bytes, with bytes 255 up to a positive multiple of ``PAYLOAD_UNIT``, as a grey image ``SIDE`` samples wide."""
    size = max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT
    return np.frombuffer(raw.ljust(size, b"\xff"), np.uint8).reshape(-1, SIDE)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        texts = as_bytes(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode_pgm(text_image(x)) for x in texts], pa.binary())], ["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text (null: empty) as a PGM file."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "id long, n_bytes long, media binary")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile"]
    for batch in slices(batches, 2048):
        rows = []
        for raw in as_bytes(batch.column(2)):
            image = decode(raw)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{difference_hash(image):016x}", tile(image)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)


def read_texts(stored: DataFrame) -> DataFrame:
    """Digests, difference hash and NPY tile of what ``store_texts`` stored, from the stored bytes."""
    return stored.mapInArrow(_read_back, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary")


def with_feature(described: DataFrame) -> DataFrame:
    """What ``read_texts`` gives, with ``feature`` in place of the hash and the tile: the difference hash and a digest of the tile."""
    feature = F.concat("dhash", F.lit("-"), F.substring(F.sha2("tile", 256), 1, 16))
    return described.select(*[c for c in described.columns if c not in ("dhash", "tile")], feature.alias("feature"))

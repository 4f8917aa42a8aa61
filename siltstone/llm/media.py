"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, stored as NPY tiles
with difference hashes.

Netpbm: P1 to P6 with comments, any maximum value (16-bit samples are big-endian). BMP: 1, 4, 8, 24 and 32 bits,
uncompressed (32 bits with masks of whole bytes, too), bottom-up or top-down. What can't be decoded gives null tiles
and a reason, never an error: sizes are held against the data before anything of that size is made.

Hashes and other features are computed from the stored tiles, read back, not from the image that they were made of.

Texts travel through the same path: `text_image` writes a payload as a binary PGM of 24 columns, padded with 255
to whole 24 x 24 tiles, so nothing of it is lost and reading the tiles back returns every byte.

Defined results: a null or empty text is one tile of 255; a null image gives nulls; equal inputs give equal
outputs, repeated rows repeat; an empty table gives no rows; extra columns are ignored. A very long text is one image
of many tiles. Memory is that of one image and STRIP rows of sums.
"""

from __future__ import annotations

import ast
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import arrow_map, arrow_schema, fields

SIDE = 24
PAD = 255
#: Rows of an image whose integral image is held at once.
STRIP = 4096
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """A Netpbm image as an array of rows x columns (x 3), uint8, or uint16 where the maximum is over 255."""
    if not re.match(rb"P[1-6]\s", data):
        raise ValueError("not Netpbm")
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("bad header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = *head[:2], head[2] if len(head) > 2 else 1
    if width < 1 or height < 1 or not 1 <= most <= 65535:
        raise ValueError("bad header")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if n > 8 * len(data):
        raise ValueError("short data")
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = re.findall(rb"[01]", body) if kind == 1 else body.split()
        if len(values) < n:
            raise ValueError("short data")
        if not all(v.isdigit() and len(v) < 10 for v in values[:n]):
            raise ValueError("bad sample")
        samples = np.array(values[:n], dtype=np.int64)
        if samples.max() > most:
            raise ValueError("sample over the maximum")
    else:
        at += 1
        if kind == 4:
            stride = (width + 7) // 8
            raw = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
            samples = np.unpackbits(raw, axis=1)[:, :width].ravel()
        else:
            samples = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at)
    if kind in (1, 4):
        samples = (1 - samples) * 255
    samples = samples.astype(np.uint16 if most > 255 else np.uint8)
    return samples.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP as rows x columns x 3 (RGB), or x columns alone where its palette is grey."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    word = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, head, width, height, bits = word(10), word(14), word(18, signed=True), word(22, signed=True), word(28, 2)
    if word(30) not in ((0, 3) if bits == 32 else (0,)) or bits not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise ValueError("kind of BMP not read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if start + stride * rows > len(data):
        raise ValueError("short data")
    # Where red, green and blue stand in a pixel.
    channels = [2, 1, 0]
    if word(30) == 3:
        masks = [word(at) for at in (54, 58, 62)]
        whole = {0xFF << 8 * i: i for i in range(4)}
        if len(data) < 66 or any(m not in whole for m in masks):
            raise ValueError("masks not read")
        channels = [whole[m] for m in masks]
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        image = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, channels]
    else:
        per = 8 // bits
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        index = ((raw[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(rows, stride * per)[:, :width]
        colours = np.frombuffer(data, np.uint8, 4 * (word(46) or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
        image = colours[index]
        if (colours == colours[:, :1]).all():
            image = image[:, :, 0]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return (image.astype(np.uint32) @ np.array([299, 587, 114], dtype=np.uint32) // 1000).astype(image.dtype)


def _between(sums: np.ndarray, parts: int) -> np.ndarray:
    """`parts` times the sums of `parts` equal cells along axis 0, from the sums of all rows before each; exact."""
    n = len(sums) - 1
    at = np.arange(parts + 1, dtype=np.int64) * n
    whole, over = at // parts, (at % parts).reshape(-1, *[1] * (sums.ndim - 1))
    low = sums[whole]
    return np.diff(low * parts + (sums[np.minimum(whole + 1, n)] - low) * over, axis=0)


def cell_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """height * width times the sums over equal cells, fractional edges weighed, as whole numbers. Integral images give
    each in four look-ups.

    The integral image of the whole would take 8 bytes a sample, so it is taken in strips of rows: across first,
    which leaves `width` columns, then down over those.
    """
    rows, columns = image.shape
    across = np.empty((rows, width), dtype=np.int64)
    for lo in range(0, rows, STRIP):
        strip = image[lo : lo + STRIP]
        integral = np.zeros((columns + 1, len(strip)), dtype=np.int64)
        np.cumsum(strip.T, axis=0, out=integral[1:])
        across[lo : lo + STRIP] = _between(integral, width).T
    down = np.zeros((rows + 1, width), dtype=np.int64)
    np.cumsum(across, axis=0, out=down[1:])
    return _between(down, height)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal cells, fractional edges weighed, as float64."""
    return cell_sums(image, height, width) / float(image.size)


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """size * size bits: is each cell brighter than its left neighbour? As hex digits. Sums are exact, so ties are 0."""
    small = cell_sums(grey(image), size, size + 1)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def to_tiles(image: np.ndarray, side: int = SIDE, fill: int = PAD) -> np.ndarray:
    """tiles x side x side (x 3), row by row, the rim filled."""
    rows, columns = image.shape[:2]
    down, right = -(-rows // side), -(-columns // side)
    if (down * side, right * side) != (rows, columns):
        padded = np.full((down * side, right * side, *image.shape[2:]), fill, dtype=image.dtype)
        padded[:rows, :columns] = image
        image = padded
    return np.ascontiguousarray(image.reshape(down, side, right, side, *image.shape[2:]).swapaxes(1, 2)).reshape(-1, side, side, *image.shape[2:])


def from_tiles(tiles: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image of `height` rows and `width` columns that `to_tiles` cut."""
    side, rest = tiles.shape[1], tiles.shape[3:]
    down, right = -(-height // side), -(-width // side)
    return tiles.reshape(down, right, side, side, *rest).swapaxes(1, 2).reshape(down * side, right * side, *rest)[:height, :width]


def npy_bytes(array: np.ndarray) -> bytes:
    """NPY 1.0, in C order."""
    head = repr({"descr": array.dtype.str, "fortran_order": False, "shape": array.shape}).encode()
    head += b" " * (-(len(head) + 11) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head + np.ascontiguousarray(array).tobytes()


def read_npy(data: bytes) -> np.ndarray:
    if data[:8] != b"\x93NUMPY\x01\x00":
        raise ValueError("not NPY 1.0")
    start = 10 + int.from_bytes(data[8:10], "little")
    head = ast.literal_eval(data[10:start].decode("latin-1"))
    array = np.frombuffer(data, np.dtype(head["descr"]), offset=start)
    return array.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def text_image(text: str | None, side: int = SIDE) -> bytes:
    """The text's UTF-8 as a binary PGM of `side` columns, padded to whole square tiles."""
    body = (text or "").encode()
    size = max(1, -(-len(body) // side**2)) * side**2
    return b"P5\n%d %d\n255\n" % (side, size // side) + body + bytes([PAD]) * (size - len(body))


TILES = fields("width int, height int, n_tiles int, npy binary, error string")


def tile_one(data: bytes | None, side: int = SIDE) -> dict:
    """One image as its row of TILES."""
    if data is None:
        return dict.fromkeys(TILES.fieldNames())
    try:
        image = decode(data)
    except (ValueError, IndexError, TypeError, OverflowError, MemoryError) as problem:
        return dict.fromkeys(TILES.fieldNames()) | {"error": str(problem)[:200] or "bad image"}
    tiles = to_tiles(image, side)
    return {"width": image.shape[1], "height": image.shape[0], "n_tiles": len(tiles), "npy": npy_bytes(tiles), "error": None}


def _mapped(df: DataFrame, key: str, value: str, schema: T.StructType, one) -> DataFrame:
    """key, then what `one` gives for each value. Rows go one by one within a batch, so few are decoded at once."""
    out = T.StructType([df.select(key).schema[0], *schema.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            rows, held, first = [], 0, 0
            for i, v in enumerate(batch.column(1)):
                rows.append(one(v.as_py()))
                held += len(rows[-1].get("npy") or b"")
                if held > 8 << 20 or i + 1 == batch.num_rows:
                    ids = batch.column(0).slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), *[pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:]]], schema=arrow)
                    rows, held, first = [], 0, i + 1

    return arrow_map(df.select(key, value), work, out)


def tile_images(df: DataFrame, key: str, image: str, side: int = SIDE) -> DataFrame:
    """Image files in a binary column to key, width, height, n_tiles, npy, error; `read_tiles` adds their hashes."""
    return _mapped(df, key, image, TILES, lambda v: tile_one(None if v is None else bytes(v), side))


def tile_texts(df: DataFrame, key: str = "doc_id", text: str = "text", side: int = SIDE) -> DataFrame:
    """Texts written as PGM images and tiled like any other image."""
    return _mapped(df, key, text, T.StructType([*TILES.fields, T.StructField("n_bytes", T.LongType())]), lambda v: tile_one(text_image(v, side), side) | {"n_bytes": len((v or "").encode())})


READ = fields("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, mean_grey double")


def read_one(npy: bytes, height: int, width: int) -> dict:
    """Digests and features of what the stored tiles hold, from the stored bytes and the image's size alone."""
    tiles = read_npy(npy)
    flat = tiles.tobytes()
    return {
        "payload_bytes": len(flat),
        "payload_sha256": hashlib.sha256(flat).hexdigest(),
        "tail_crc32": zlib.crc32(flat[-32:]),
        "media_bytes": len(npy),
        "media_sha256": hashlib.sha256(npy).hexdigest(),
        "dhash": difference_hash(from_tiles(tiles, height, width)),
        "mean_grey": round(float(tiles.mean()), 6),
    }


def read_tiles(tiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored tiles back: every column of `tiles` but the bytes themselves, and READ."""
    rest = [f for f in tiles.schema.fields if f.name not in (key, "npy")]
    out = T.StructType([tiles.select(key).schema[0], *rest, *READ.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            size = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("height", "width")]
            read = [read_one(v.as_py(), h, w) if v.is_valid else dict.fromkeys(READ.fieldNames()) for v, h, w in zip(batch.column(1), *size, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(arrow.field(i).type) for i, c in enumerate([batch.column(0), *batch.columns[2:]])] + [pa.array([r[f.name] for r in read], arrow.field(f.name).type) for f in READ.fields],
                schema=arrow,
            )

    return arrow_map(tiles.select(key, "npy", *[f.name for f in rest]), work, out)

"""PNG images as pixel tables, and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources import image_sink

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels of an image that are painted or unpacked at a time; taller images are painted in bands.
BLOCK = 1 << 18


def decode(content: bytes) -> np.ndarray:
    """(h, w, channels) of an 8- or 16-bit grey, grey-alpha, RGB or RGBA image without interlacing."""
    return np.concatenate(list(blocks(content)))


def blocks(content: bytes, size: int | None = None) -> Iterator[np.ndarray]:
    """The rows of :func:`decode` from top to bottom, as many at a time as have ``size`` pixels (BLOCK), one at least."""
    if content[:8] != _MAGIC:
        raise ValueError("not a PNG image")
    at, data, head, view = 8, [], b"", memoryview(content)
    while at < len(content):
        length, kind = struct.unpack(">I4s", view[at : at + 8])
        body = view[at + 8 : at + 8 + length]
        head = bytes(body) if kind == b"IHDR" else head
        data += [body] if kind == b"IDAT" else []
        at += 12 + length
    w, h, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if bits not in (8, 16) or colour not in _CHANNELS or interlace:
        raise ValueError("unsupported PNG layout")
    step, rows = _CHANNELS[colour] * bits // 8, max(1, (size or BLOCK) // max(w, 1))
    take = _inflated(data)
    above = np.zeros(w * step, dtype=np.uint8)
    for top in range(0, max(h, 1), rows):
        n = min(rows, h - top)
        raw = np.frombuffer(take(n * (1 + w * step)), dtype=np.uint8).reshape(n, 1 + w * step)
        image = _unfiltered(raw, above, step).reshape(n, w, step)
        above = image[-1].ravel() if n else above
        yield image if bits == 8 else image.reshape(n, w, -1, 2).view(">u2").reshape(n, w, -1).astype(np.uint16)
    if take(1):
        raise ValueError("more rows than the image has")


def _inflated(data: list[memoryview]) -> Callable[[int], bytes]:
    """A function that gives the next n bytes of a zlib stream in parts, all that are left if fewer."""
    unzip, parts = zlib.decompressobj(), (body[k : k + 65536] for body in data for k in range(0, len(body), 65536))

    def take(n: int) -> bytes:
        out = bytearray()
        while len(out) < n and not unzip.eof:
            got = unzip.decompress(unzip.unconsumed_tail, n - len(out))
            if not got and not unzip.unconsumed_tail and not unzip.eof:
                if (part := next(parts, None)) is None:
                    raise ValueError("the image data is cut off")
                got = unzip.decompress(part, n - len(out))
            out += got
        return bytes(out)

    return take


def _unfiltered(raw: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The bytes of rows whose first byte names their filter; ``above`` is the row before them."""
    if not raw[:, 0].any():
        return raw[:, 1:]
    out = np.zeros((len(raw), raw.shape[1] - 1), dtype=np.uint8)
    w = out.shape[1] // step
    for y in range(len(raw)):
        line, kind = raw[y, 1:].copy(), raw[y, 0]
        if kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            values, up = line.tolist(), above.tolist()
            for k in range(len(values)):
                a, b, c = (values[k - step] if k >= step else 0), up[k], (up[k - step] if k >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                values[k] = (values[k] + guess) & 255
            line = np.array(values, dtype=np.uint8)
        out[y] = above = line
    return out


def encode(image: np.ndarray) -> bytes:
    """A PNG of an (h, w[, 3 or 4]) array of 8-bit, or (h, w) of 16-bit, numbers."""
    image = image[..., None] if image.ndim == 2 else image
    h, w, channels = image.shape
    bits = 16 if image.dtype == np.uint16 else 8
    colour = {n: c for c, n in _CHANNELS.items()}[channels]
    rows = image.astype(">u2" if bits == 16 else np.uint8).reshape(h, -1).view(np.uint8).reshape(h, -1)
    body = zlib.compress(np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes())
    head = struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _band(image: np.ndarray) -> tuple[bytes, int, int]:
    """A chunk of the rows of an 8-bit (h, w, 3) array, compressed so that other rows may follow; the checksum and number
    of their bytes."""
    raw = np.hstack([np.zeros((len(image), 1), np.uint8), image.reshape(len(image), -1)]).tobytes()
    zipped = zlib.compressobj(wbits=-15)
    return _chunk(b"IDAT", zipped.compress(raw) + zipped.flush(zlib.Z_FULL_FLUSH)), zlib.adler32(raw), len(raw)


def _stacked(bands: Iterable[tuple[bytes, int, int]], height: int, width: int) -> bytes:
    """The PNG of an image whose bands are given from top to bottom."""
    chunks, low, high = [], 1, 0
    for chunk, checksum, n in bands:  # the checksum of bytes one after the other is that of their parts' sums
        chunks.append(chunk)
        low, high = (low + (checksum & 0xFFFF) - 1) % 65521, (high + (checksum >> 16) + n * (low - 1)) % 65521
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", b"\x78\x9c")
    return b"".join([_MAGIC, head, *chunks, _chunk(b"IDAT", b"\x03\x00" + struct.pack(">HH", high, low)), _chunk(b"IEND", b"")])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image, r, c, channel values: every pixel of PNG files, named by file stem."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*?)\.[^.]*$", 1).alias("image"), "content")

    return files.mapInArrow(unpacked, "image string, r int, c int, value array<int>")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """image, r, c, value of (image, content) rows, a block of an image at a time."""
    for batch in batches:
        for name, content in zip(batch["image"], batch["content"], strict=True):
            top = 0
            for pixels in blocks(content.as_py()):
                h, w, n = pixels.shape
                r, c = np.divmod(np.arange(h * w, dtype=np.int32), max(w, 1))
                value = pa.ListArray.from_arrays(np.arange(0, h * w * n + 1, n, dtype=np.int32), pixels.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.repeat(name, h * w), pa.array(r + np.int32(top)), pa.array(c), value], ["image", "r", "c", "value"])
                top += h


def images(pixels: DataFrame, image: str, height: int, width: int) -> DataFrame:
    """image, content: a PNG of each image's (r, c, red, green, blue) rows; other pixels are black.

    The pixels of one image are a group, or, of more than BLOCK, those of a band of its rows; a file's bands are compressed
    where they are painted and only then meet.
    """
    kind, rows = pixels.schema[image].dataType.simpleString(), max(1, BLOCK // max(width, 1))
    pixels = pixels.select(image, "r", "c", "red", "green", "blue")

    def canvas(found: pd.DataFrame, top: int, bottom: int) -> np.ndarray:
        painted = np.zeros((bottom - top, width, 3), dtype=np.uint8)
        painted[found["r"] - top, found["c"]] = found[["red", "green", "blue"]].to_numpy()
        return painted

    def paint(found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({image: [found[image].iloc[0]], "content": [encode(canvas(found, 0, height))]})

    if height <= rows:
        return pixels.groupBy(image).applyInPandas(paint, f"`{image}` {kind}, content binary")

    def paint_band(found: pd.DataFrame) -> pd.DataFrame:
        top = int(found["__band"].iloc[0]) * rows
        if not 0 <= top < height:
            raise IndexError(f"row {found['r'].iloc[0]} of an image of {height} rows")
        chunk, checksum, n = _band(canvas(found, top, min(top + rows, height)))
        return pd.DataFrame({image: [found[image].iloc[0]], "__band": [top // rows], "chunk": [chunk], "checksum": [checksum], "n": [n]})

    def stack(found: pd.DataFrame) -> pd.DataFrame:
        known = {b: rest for b, *rest in found[["__band", "chunk", "checksum", "n"]].itertuples(index=False)}
        black = {h: _band(np.zeros((h, width, 3), np.uint8)) for h in {min(rows, height - top) for top in range(0, height, rows)}}
        bands = (known.get(top // rows) or black[min(rows, height - top)] for top in range(0, height, rows))
        return pd.DataFrame({image: [found[image].iloc[0]], "content": [_stacked(bands, height, width)]})

    bands = pixels.withColumn("__band", F.floor(F.col("r") / rows)).groupBy(image, "__band").applyInPandas(paint_band, f"`{image}` {kind}, __band bigint, chunk binary, checksum bigint, n bigint")
    return bands.groupBy(image).applyInPandas(stack, f"`{image}` {kind}, content binary")


def write_images(painted: DataFrame, path: str, image: str, suffix: str = "", mode: str = "append") -> None:
    """Write each image to ``path``/<image><suffix>.png, from the tasks that hold them, in two steps."""
    image_sink.save(painted.select(F.concat(F.col(image).cast("string"), F.lit(f"{suffix}.png")).alias("name"), "content"), path, mode)


def coloured(labels: DataFrame, palette: DataFrame, index: str, blend: DataFrame | None = None, keys: tuple[str, ...] = ("pano", "r", "c")) -> DataFrame:
    """K6/K7: red, green, blue of labelled pixels by palette row; with ``blend`` (keys, red, green, blue)
    half of the picture shows through."""
    colours = palette.select(F.col("idx").alias(index), "r", "g", "b").withColumnsRenamed({"r": "red", "g": "green", "b": "blue"})
    painted = labels.join(colours, index)
    if blend is None:
        return painted
    under = blend.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("red", "green", "blue")])
    mixed = {c: F.floor((F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))) / 2).cast("int") for c in ("red", "green", "blue")}
    return painted.join(under, list(keys), "left").withColumns(mixed).drop(*[f"__{c}" for c in mixed])


def mask_images(masks: DataFrame, name: str, height: int, width: int) -> DataFrame:
    """Name, content: white-on-black PNGs of amodal masks (name, mask, r, c), named <name>_mask_<mask>.
    Only objects with both a visible and an occluded part are given."""
    both = masks.groupBy(name).agg(F.count_distinct("mask").alias("n")).where("n = 2").select(name)
    rows = masks.join(both, name, "left_semi").where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))
    white = {c: F.lit(255) for c in ("red", "green", "blue")}
    named = rows.select(F.concat_ws("_mask_", F.col(name).cast("string"), "mask").alias("name"), "r", "c").distinct().withColumns(white)
    return images(named, "name", height, width)

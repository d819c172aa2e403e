"""Media columns: texts as lossless WebP tiles, read back to pixels, with features.

The bytes of a text, padded by blanks to a positive multiple of 192, are rows of 192 grey pixels. A document is stored as WebP files of up to
``webp.TILE_ROWS`` rows, one after another. Whatever is reported of the payload is computed from the decoded pixels.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import bound_batches, column

#: Bytes that are encoded together, and decoded together (more tiles side by side); a larger document goes by itself.
ENCODE_BYTES, MOST_BYTES = 1_000_000, 8_000_000


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // webp.ROW_BYTES)) * webp.ROW_BYTES, b" ")


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    tile, out, a = webp.TILE_ROWS * webp.ROW_BYTES, [], 0
    held = 0
    for b in range(1, len(payloads) + 1):
        held += len(payloads[b - 1])
        if b < len(payloads) and held < ENCODE_BYTES:
            continue
        held = 0
        some = payloads[a:b]
        sizes = [[min(tile, len(p) - x) // webp.ROW_BYTES for x in range(0, len(p), tile)] for p in some]
        files, at = webp.encode_tiles(np.frombuffer(b"".join(some), np.uint8), np.array([r for s in sizes for r in s])), 0
        for s in sizes:
            out.append(b"".join(files[at : at + len(s)]))
            at += len(s)
        a = b
    return out


def load(stored: list[bytes]) -> list[np.ndarray]:
    """Grey pixels (rows, 192) of each stored form."""
    files = [webp.split_files(s) for s in stored]
    tiles, at, out = webp.decode_tiles([f for fs in files for f in fs]), 0, []
    for fs in files:
        out.append(np.frombuffer(b"".join(tiles[at : at + len(fs)]), np.uint8).reshape(-1, webp.WIDTH))
        at += len(fs)
    return out


def feature(pixels: np.ndarray) -> str:
    """64 bits (is each of 64 even stretches brighter than the image), mean and deviation of all samples."""
    flat = pixels.reshape(-1)
    edges = np.linspace(0, len(flat), 65).astype(np.int64)[:-1]
    sums = np.add.reduceat(flat, edges, dtype=np.int64)
    sizes = np.diff(np.r_[edges, len(flat)])
    total, squares = int(sums.sum()), int((np.bincount(flat, minlength=256) * np.arange(256) ** 2).sum())
    bright = np.packbits(sums * len(flat) > total * sizes).tobytes().hex()
    mean = total / len(flat)
    return f"{bright}:{mean:.3f}:{max(0.0, squares / len(flat) - mean * mean) ** 0.5:.3f}"


_FIELDS = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def described(texts: list, media: bool):
    """Rows of figures of each text, in order; with its stored form and pixels first if ``media``."""

    def done(held):
        stored = store([p for _, p in held])
        for (n, _), s, pixels in zip(held, stored, load(stored)):
            back = pixels.tobytes()
            row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(s), hashlib.sha256(s).hexdigest(), feature(pixels))
            yield (s, back, *row) if media else row

    held, size = [], 0
    for t in texts:
        if held and size + (len(t) if t else 0) > MOST_BYTES:
            yield from done(held)
            held, size = [], 0
        held.append(padded(t))
        size += len(held[-1][1])
    if held:
        yield from done(held)


def with_media(docs: DataFrame, media: bool = True) -> DataFrame:
    """doc_id, (media binary, pixels binary,) n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    pixels are the decoded grey samples, row by row of 192 pixels. Ids that are no numbers are refused by the cast to long. Null and empty texts are one row of blanks. Equal texts have equal values; repeated rows return
    a row each.
    """
    bound_batches(docs.sparkSession)
    fields = ((("media", pa.binary()), ("pixels", pa.binary())) if media else ()) + _FIELDS

    def run(batches):
        for b in batches:
            rows = list(described(column(b, "text"), media))
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, (_, k) in zip(cols, fields))], names=["doc_id", *(n for n, _ in fields)])

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(["doc_id long", *(f"{n} {names[k]}" for n, k in fields)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

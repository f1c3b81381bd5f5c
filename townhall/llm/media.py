"""Media columns: byte columns stored as lossless WebP images, and images read into pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townhall.llm import webp

ROW = 64  # bytes of a row of 16 pixels
# All transforms and the colour cache are written, so reading back inverts them; images of few colours have a palette too.
FORM = {"predictor": 1, "cross": 0x010203, "green": True, "cache_bits": 4}
COLOURS = 256
STRIP = 1 << 14  # rows of one image at most; longer payloads are stored as several images, one after another


def pad(raw: bytes) -> bytes:
    """Zeros are added up to a positive multiple of 64 bytes."""
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def store(payload: bytes) -> list[bytes]:
    """A payload of whole rows as images of at most 1 MiB; every byte is a sample, in the order red, green, blue, alpha."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 4, 4)
    strips = [samples[k : k + STRIP] for k in range(0, len(samples), STRIP)]
    return [webp.encode(x, palette=len(np.unique(x.view(np.uint32))) <= COLOURS, **FORM) for x in strips]


def load(images: list[bytes]) -> bytes:
    return b"".join(webp.decode(x).tobytes() for x in images)


def feature(images: list[bytes], payload: bytes) -> str:
    """A line about the pixels that were read: images, rows, mean of each channel, entropy of the samples in bits."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    share = share[share > 0]
    means = ",".join(f"{m:.3f}" for m in samples.mean(axis=0))
    return f"images={len(images)};rows={len(payload) // ROW};mean={means};entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the images of every whole text (null: empty). Repeated rows give repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b["text"].to_pylist()]
            media = pa.array([store(pad(t)) for t in texts], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_bytes long, media array<binary>")


def described(media: DataFrame) -> DataFrame:
    """Reads the stored images back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The stored form's digest is that of its images, one after another.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n, images in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist(), strict=True):
                payload, form = load(images), b"".join(images)
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(form), hashlib.sha256(form).hexdigest(), feature(images, payload)))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, schema, strict=True)], schema=schema)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pixels(media: DataFrame, column: str) -> DataFrame:
    """Decodes a column of lossless WebP files: adds width, height and pixels (red, green, blue, alpha bytes by row).

    Null, and what is no lossless WebP file, gives nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for data in b[column].to_pylist():
                try:
                    found.append(None if data is None else webp.decode(data))
                except (ValueError, IndexError, struct.error):
                    found.append(None)
            added = [pa.array([None if x is None else x.shape[k] for x in found], pa.int32()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added, pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], [*b.schema.names, "width", "height", "pixels"])

    return media.mapInArrow(run, T.StructType([*media.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())]))

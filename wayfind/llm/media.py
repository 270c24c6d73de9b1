"""Media columns: documents as progressive JPEG images and full-resolution RGB tensors.

A text's bytes, padded with spaces to a positive multiple of 192, are the coefficients
of an image: byte minus 32, block by block in zigzag order, first all luma blocks, then
both chromas; two runs of 192 fill one unit of 16 by 16 pixels. Coefficients are the
unit of this format that is stored without loss, since its pixels are not. The files are
read again scan by scan into coefficient arrays, from which come the payload, the pixels
(inverse transform in numpy, chroma repeated to full resolution) and the features.

Defined results: a null text is an empty one, whose payload is 192 spaces; a null doc_id
stays null; equal texts have equal files and features, so repeated rows have too; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.progressive_jpeg import Decoded, decode, encode, rgb, samples
from wayfind.llm.textops import text_slices

RUN = 192
PAD = 32
#: Bytes of text that are turned into images at once (one text at least).
SLICE = 1_000_000


def to_files(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """A progressive file of each text, and the size of each padded payload."""
    size = np.diff(offsets)
    payload = np.maximum(1, -(-size // RUN)) * RUN
    units = -(-payload // (2 * RUN))
    wide = np.ceil(np.sqrt(units)).astype(np.int64)
    high = -(-units // wide)
    room = wide * high * 2 * RUN
    begin = np.cumsum(room) - room
    flat = np.full(int(room.sum()), PAD, np.int16)
    if len(buf):
        flat[np.arange(len(buf)) + np.repeat(begin - offsets[:-1], size)] = buf
    flat -= PAD
    grid = flat.reshape(-1, 64)
    count = wide * high
    image = np.repeat(np.arange(len(size)), count * 6)
    own = np.arange(len(grid)) - np.repeat(begin // 64, count * 6)
    part = np.where(own < 4 * count[image], 0, np.where(own < 5 * count[image], 1, 2))
    notes = [b"payload=%d" % n for n in payload.tolist()]
    return encode([grid[part == c] for c in range(3)], wide, high, notes), payload


def payload_of(image: Decoded) -> bytes:
    """The bytes that an image's coefficients hold."""
    size = int(image.note.partition(b"=")[2])
    return (np.concatenate(image.coefficients).ravel()[:size] + PAD).astype(np.uint8).tobytes()


def feature_of(pixels: np.ndarray) -> str:
    """Mean red, green and blue, and whether each cell of an 8 by 8 grid is brighter than the mean."""
    height, width, _ = pixels.shape
    means = pixels.sum(axis=(0, 1), dtype=np.int64) // (height * width)
    grey = pixels.sum(axis=2, dtype=np.int64)[: height // 8 * 8, : width // 8 * 8]
    cells = grey.reshape(8, height // 8, 8, width // 8).sum(axis=(1, 3)).ravel()
    bits = np.packbits(cells * 64 > cells.sum()).tobytes().hex()
    return "-".join(map(str, means)) + f"-{bits}"


def _images(files: list[bytes]) -> list[tuple[Decoded, np.ndarray]]:
    """Images read from files with their pixels; blocks of all images are transformed together."""
    read = decode(files)
    blocks: list[list[np.ndarray]] = [[] for _ in read]
    for c in range(3):
        done = samples(np.concatenate([x.coefficients[c] for x in read]), read[0].quant[c])
        edges = np.cumsum([0] + [len(x.coefficients[c]) for x in read])
        for k, mine in enumerate(blocks):
            mine.append(done[edges[k] : edges[k + 1]])
    return [(x, rgb(x, mine)) for x, mine in zip(read, blocks, strict=True)]


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, jpeg: the stored form of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch.column(1), SLICE):
                files, _ = to_files(buf, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "jpeg"])

    return _narrow(docs).mapInArrow(run, "doc_id long, n_bytes long, jpeg binary")


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb: full-resolution pixels (row by row, three bytes each) of stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch.column(1), 2 * SLICE):
                raw = buf.tobytes()
                found = [p for _, p in _images([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([p.shape[0] for p in found], pa.int32()), pa.array([p.shape[1] for p in found], pa.int32()), pa.array([p.tobytes() for p in found], pa.binary())],
                    names=["doc_id", "height", "width", "rgb"],
                )

    return stored.select("doc_id", "jpeg").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def report(docs: DataFrame) -> DataFrame:
    """One row a document: what its file holds when it is read back, and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in REPORT.split(", ")]
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch.column(1), SLICE):
                files, _ = to_files(buf, offsets)
                rows = []
                for size, file, (image, pixels) in zip(np.diff(offsets).tolist(), files, _images(files), strict=True):
                    back = payload_of(image)
                    rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(pixels)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, zip(*rows, strict=True))], names=names)

    return _narrow(docs).mapInArrow(run, REPORT)

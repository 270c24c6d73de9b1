"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let executors drop the shuffle files of plans that are no longer referred to.

    They stay until the driver's garbage is collected, which in a small driver heap may
    be long after a phase whose shuffles are as large as its input.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder that the cluster names and go on from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "wayfind-checkpoints")  # one process: its folder is shared by all its tasks
        context.setCheckpointDir(folder)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def packed_texts(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text): doc_id and packed, each text compressed by itself, which holds less than the shuffle's own codec makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(t.as_buffer() or b"") if t.is_valid else None for t in batch.column(1)], pa.binary())], names=["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def unpacked(value: pa.Scalar) -> bytes:
    """The bytes of one packed text; null: none."""
    return zstandard.ZstdDecompressor().decompress(value.as_py()) if value.is_valid else b""


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

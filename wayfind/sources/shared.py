"""Folders that all executors see: the one that spark.checkpoint.dir names, or a temporary one where a single process runs everything."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    """One folder a process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="wayfind-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def base(spark: SparkSession) -> str:
    """The shared folder; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_folder()


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{base(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that a lost executor costs no more than the work since."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(base(spark))
    return df.checkpoint()

"""Embedding near-dedup by cross-polytope hashing.

Vectors are turned by pseudo-random rotations (signs and fast Hadamard transforms, three
times); the hash is the axis, with its sign, that is nearest, and several rotations make
a bucket of one table. Each vector is filed under its own bucket and looks into others
too in which one axis is the second nearest. Pairs that meet are verified by cosine in
double precision, so no link is below the threshold; a test measures the recall.

Equal vectors of a label are one class from the start and never expanded into pairs.
The number of rotations a table follows the number of classes of the largest label, and
the number of tables follows the number of rotations. Labels may be of any type. Jobs run
while the plan is built (each `cut`).

Defined results: a null label, or a vector that is null, zero or holds null or
non-finite components, links with nothing, as do vectors of different lengths; a null
vec_id takes the component of its equal vectors, else null; repeated rows count as
vectors of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import cut
from wayfind.llm.components import components

COSINE = 0.93
#: Tables by the number of rotations in each (more: TABLES_MORE times as many for each).
TABLES = {1: 6, 2: 12}
TABLES_MORE = 2
CHUNK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; its length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / math.sqrt(d)


def nearest_axes(x: np.ndarray, seed: int) -> np.ndarray:
    """The nearest and second nearest axis, with sign, after one rotation."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for row in signs:
        x = hadamard(x * row)
    size = np.abs(x)
    first = size.argmax(axis=1)
    at = np.arange(len(x))
    size[at, first] = -1
    both = np.stack([first, size.argmax(axis=1)], axis=1)
    return both * 2 + (np.take_along_axis(x, both, axis=1) > 0)


def _files(rotations: int, tables: int):
    """Per vector and table its own bucket (own: true) and the others that it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                length = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                for d in np.unique(length):
                    rows = np.flatnonzero(length == d)
                    flat = batch.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)
                    x = np.zeros((len(rows), 1 << max(1, int(d - 1).bit_length())))
                    x[:, :d] = flat / np.abs(flat).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    ids, labels = batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))
                    for t in range(tables):
                        axes = [nearest_axes(x, 1000 * t + k) for k in range(rotations)]
                        base = 2 * x.shape[1]

                        def bucket(changed, axes=axes, base=base):
                            code = np.full(len(rows), d, np.int64)
                            for k, a in enumerate(axes):
                                code = code * base + a[:, int(k == changed)]
                            return code

                        for changed in range(-1, rotations):
                            yield pa.RecordBatch.from_arrays(
                                [ids, labels, pa.array(np.full(len(rows), t, np.int32)), pa.array(bucket(changed)), pa.array(np.full(len(rows), changed < 0))],
                                names=["rep", "label", "table_no", "bucket", "own"],
                            )

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(length)])[:-1]
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))
            x, y = (v / np.repeat(np.maximum.reduceat(np.abs(v), edges), length) for v in (x, y))
            dot, xx, yy = (np.add.reduceat(v, edges) for v in (x * y, x * x, y * y))
            hit = pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", usable.alias("usable"))
    given = given.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    keyed = given.select("vec_id", "label", "h1", "h2", "usable")
    grouped = given.filter("usable").groupBy("label", "h1", "h2")
    classes = cut(grouped.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    known = classes.filter("rep is not null")
    most = known.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).agg(F.max("n"), F.max("d")).first()
    axes = 2 << max(1, ((most[1] or 2) - 1).bit_length())
    rotations = max(1, math.ceil(math.log(max(2, most[0] or 2)) / math.log(axes)))
    tables = TABLES.get(rotations) or TABLES[2] * TABLES_MORE ** (rotations - 2)
    filed = cut(known.select("rep", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(_files(rotations, tables), "rep long, label string, table_no int, bucket long, own boolean"))
    place = ["label", "table_no", "bucket"]
    own = filed.filter("own").select(*place, F.col("rep").alias("x"))
    looks = filed.select(*place, F.col("rep").alias("y"))
    pairs = own.join(looks, place).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left = known.select(F.col("rep").alias("a"), F.col("embedding").alias("va"))
    right = known.select(F.col("rep").alias("b"), F.col("embedding").alias("vb"))
    links = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_similar(threshold), "a long, b long"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(known.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    placed = components(links).select(F.col("node").alias("rep"), "component")
    facts = classes.select("label", "h1", "h2", "rep", "copies").join(others, "rep", "left").join(placed, "rep", "left")
    facts = facts.select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    joined = keyed.join(facts, ["label", "h1", "h2"], "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(F.col("usable"), F.col("links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )

"""Samples that come out the same every time: a seeded shuffle, and five rows that show a pool's breadth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.text import bare_name

# The hash that turns a seed's letters into a number, and the generator's constants.
HASH_START, HASH_FACTOR = 2166136261, 16777619
STEP, ODD = 0x6D2B79F5, 61
LEAVES = 40  # halvings of a pool: more than any pool has


def seed_number(seed: str) -> int:
    """32 bits of the UTF-16 units of a seed."""
    h = HASH_START
    units = np.frombuffer(seed.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    for unit in units.tolist():
        h = ((h ^ unit) * HASH_FACTOR) & 0xFFFFFFFF
    return h


def draws(seed: str, n: int) -> np.ndarray:
    """The generator's first n numbers in [0, 1), worked out side by side: the state after k steps is the seed plus k times the step, modulo 2^32."""
    u = np.uint32
    with np.errstate(over="ignore"):
        h = u(seed_number(seed)) + np.arange(1, n + 1, dtype=u) * u(STEP)
        t = (h ^ (h >> u(15))) * (h | u(1))
        t ^= t + (t ^ (t >> u(7))) * (t | u(ODD))
        return (t ^ (t >> u(14))).astype(np.float64) / 4294967296.0


def shuffle_order(seed: str, n: int) -> np.ndarray:
    """The rows' numbers in shuffled order: from the last place down, each place changes with one not after it."""
    out, picks = list(range(n)), np.floor(draws(seed, max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    for i, j in zip(range(n - 1, 0, -1), picks, strict=True):
        out[i], out[j] = out[j], out[i]
    return np.array(out, dtype=np.int64)


def shuffled(rows: DataFrame, group: str, order: str, prefix: str = "") -> DataFrame:
    """The columns group and order with `place`, from 0, where each group's rows lie after a shuffle seeded with prefix and the group's name.

    A shuffle changes places in turn, so a group's order keys (one long a row, nothing
    else) meet in one task; groups are shuffled side by side. A null group is one, seeded
    with the prefix alone.
    """
    kind = rows.schema[group].dataType.simpleString()

    def run(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by(order)
        name = table.column(group)[0].as_py()
        order_ = shuffle_order(prefix + ("" if name is None else str(name)), len(table))
        yield from table.take(pa.array(order_)).append_column("place", pa.array(np.arange(len(table)))).to_batches()

    narrow = rows.select(group, F.col(order).cast("long").alias(order))
    return narrow.groupBy(group).applyInArrow(run, f"{group} {kind}, {order} long, place long")


def halving_key(place: Column, n: Column) -> Column:
    """Where a row stands when a list of n is walked by halves: the first, then the middle, then the middles of both halves; what no halving meets comes last, in order."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.call_function("shiftright", at["low"] + at["high"], F.lit(1))
        met, stop = place == middle, at["high"] - at["low"] < 2
        go_left = place < middle
        open_ = ~at["done"] & ~stop
        return F.struct(
            F.when(open_ & ~met & ~go_left, middle).otherwise(at["low"]).alias("low"), F.when(open_ & ~met & go_left, middle).otherwise(at["high"]).alias("high"),
            F.when(open_ & ~met, at["level"] + 1).when(~at["done"] & stop, F.lit(LEAVES + 1)).otherwise(at["level"]).alias("level"),
            F.when(open_ & ~met, at["path"] * 2 + F.when(go_left, 0).otherwise(1)).when(~at["done"] & stop, place).otherwise(at["path"]).alias("path"), (at["done"] | met | stop).alias("done"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("low"), (n - 1).cast("long").alias("high"), F.lit(1).alias("level"), zero.alias("path"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(LEAVES)), start, halve)
    first = F.struct(F.lit(0).alias("level"), place.cast("long").alias("path"))
    return F.when((place == 0) | (n <= 2), first).otherwise(F.struct(end["level"].alias("level"), end["path"].alias("path")))


def spread_sample(rows: DataFrame, pool: str, most: int = 5) -> DataFrame:
    """At most `most` rows a pool of rows(pool, id, name, town, site), with `rank` from 1: one a name, new towns first, rows with a site before others.

    The list of a pool (its rows by site and name, numbered in one task a pool) is walked
    by halves. Of each name the first row met stands; of those, the first of each town
    come before the rest. All but the numbering is grouping, and a bounded rank that Spark
    cuts before its shuffle.
    """
    readable = F.when(F.coalesce(F.col("site"), F.lit("")) != "", 0).otherwise(1)
    listed = rows.withColumn("_at", (F.row_number().over(Window.partitionBy(pool).orderBy(readable, "name", "id")) - 1).cast("long"))
    sized = listed.withColumn("_n", F.count("*").over(Window.partitionBy(pool)))
    keyed = sized.withColumns({"_key": halving_key(F.col("_at"), F.col("_n")), "_name": bare_name(F.col("name"))}).filter("_name != ''")
    held = F.struct("id", "name", F.when(F.length(F.trim("town")) > 1, F.trim("town")).alias("town"), "site")
    one_a_name = keyed.groupBy(pool, "_name").agg(F.min_by(held, "_key").alias("r"), F.min("_key").alias("_key"))
    first_of_town = one_a_name.filter("r.town is not null").groupBy(pool, F.col("r.town").alias("_town")).agg(F.min("_key").alias("_key")).select(pool, "_key", F.lit(0).alias("_later"))
    placed = one_a_name.join(first_of_town, [pool, "_key"], "left").withColumn("_later", F.coalesce("_later", F.lit(1)))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(pool).orderBy("_later", "_key"))).filter(F.col("rank") <= most)
    return ranked.select(pool, "rank", "r.*")

"""The tiled snapshot: writing it, its tile index, pruned reads and the gate before promotion."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions.geo import box, cell
from wayfind.sources.shared import cut

CELL_DEGREES = 2.0
ROWS_PER_TILE = 100_000
REQUIRED = ("id", "name", "cat", "site", "lat", "lon")
#: How far a canary count may move from the last snapshot's, and the least share of known categories.
MOVE, KNOWN_SHARE = 0.15, 0.98


def hilbert(lat: Column, lon: Column, bits: int = 8) -> Column:
    """A place's number on the Hilbert curve inside its cell: from the highest bit on, each quadrant turned as the curve enters it."""
    y, x = (F.floor((c / CELL_DEGREES - F.floor(c / CELL_DEGREES)) * (1 << bits)).cast("long") for c in (lat, lon))
    last = (1 << bits) - 1

    def step(at: Column, b: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), b)
        right, up = at["x"].bitwiseAND(bit) != 0, at["y"].bitwiseAND(bit) != 0
        quadrant = F.when(~right & ~up, 0).when(~right & up, 1).when(right & up, 2).otherwise(3).cast("long")
        flipped = ~up & right
        fx, fy = F.when(flipped, last - at["x"]).otherwise(at["x"]), F.when(flipped, last - at["y"]).otherwise(at["y"])
        return F.struct(F.when(up, at["x"]).otherwise(fy).alias("x"), F.when(up, at["y"]).otherwise(fx).alias("y"), (at["d"] * 4 + quadrant).alias("d"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d")), step)["d"]


def tiles(places: DataFrame, rows: int = ROWS_PER_TILE) -> DataFrame:
    """Places with cell, chunk within the cell along the curve, and tile.

    Places are sorted over all tasks by cell and curve, and written; a place's number in its
    cell is that in its part plus the cell's places in the parts before, so a metropolis,
    all of it one cell, is numbered by as many tasks as its places fill.
    """
    placed = places.withColumn("cell", cell(F.col("lat"), F.col("lon"), CELL_DEGREES)).withColumn("_curve", hilbert(F.col("lat"), F.col("lon")))
    parted = cut(placed.repartitionByRange("cell", "_curve", "id").withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy("cell", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("cell", "_part", (F.sum("_n").over(Window.partitionBy("cell").orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a cell and part
    within = F.row_number().over(Window.partitionBy("cell", "_part").orderBy("_curve", "id")) - 1
    numbered = parted.withColumn("_at", within).join(before, ["cell", "_part"])
    chunk = F.floor((F.col("_before") + F.col("_at")) / rows).cast("int")
    return numbered.withColumn("chunk", chunk).withColumn("tile", F.concat_ws("-", "cell", F.col("chunk").cast("string"))).select(*places.columns, "cell", "chunk", "tile")


def tile_index(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy("tile").agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.count("*").alias("n"))


def write(places: DataFrame, to: str, rows: int = ROWS_PER_TILE) -> None:
    """The tiles, sorted along the curve, and then the index beside them."""
    tiled = tiles(places, rows)
    tiled.repartition("tile").sortWithinPartitions("tile", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("tile").parquet(f"{to}/tiles")
    spark = places.sparkSession
    tile_index(spark.read.parquet(f"{to}/tiles")).coalesce(1).write.mode("overwrite").parquet(f"{to}/index")


def overlapping(index: DataFrame, centres: list[tuple[float, float]], miles: float) -> DataFrame:
    """Tiles whose box meets the box of any circle."""
    hit = F.lit(False)
    for centre in centres:
        south, north, west, east = box(*centre, miles)
        hit = hit | ((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    return index.filter(hit)


def read(spark: SparkSession, at: str, centres: list[tuple[float, float]], miles: float) -> DataFrame:
    """Places in the tiles that can hold hits: partition pruning by a semi-join with the small index."""
    places = spark.read.parquet(f"{at}/tiles")
    wanted = overlapping(spark.read.parquet(f"{at}/index"), centres, miles).select("tile")
    return places.join(wanted, "tile", "left_semi")


def gate(new: DataFrame, vocabulary: DataFrame, canaries: DataFrame, previous: DataFrame, most: float = MOVE) -> DataFrame:
    """Failed checks (check, detail) before promotion; none: promote.

    canaries and previous: (canary, n). New categories must be known to KNOWN_SHARE, and
    each canary's count must be above zero and within `most` (a share) of the previous one.
    """
    missing = [c for c in REQUIRED if c not in new.columns]
    spark = new.sparkSession
    columns = spark.createDataFrame([("columns", c) for c in missing], "check string, detail string")
    known = new.select("cat").join(vocabulary.select("cat", F.lit(1).alias("known")).distinct(), "cat", "left").agg((F.count("known") / F.nullif(F.count("*"), F.lit(0))).alias("share"))
    words = known.filter(F.coalesce(F.col("share") < KNOWN_SHARE, F.lit(True))).select(F.lit("vocabulary").alias("check"), F.coalesce(F.col("share").cast("string"), F.lit("no rows")).alias("detail"))
    moved = canaries.join(previous.withColumnRenamed("n", "before"), "canary", "left")
    bad = moved.filter((F.col("n") == 0) | (F.abs(F.col("n") - F.col("before")) / F.col("before") > most)).select(F.lit("canary").alias("check"), F.col("canary").alias("detail"))
    return columns.union(words).union(bad)


MANIFEST = "version long, release string, dir string, rows long, with_site long, tiles long, canaries string, previous string"


def manifests(spark: SparkSession, root: str) -> list[dict]:
    """All manifests, the live one last; each is one small row."""
    try:
        return [r.asDict() for r in spark.read.schema(MANIFEST).json(f"{root}/manifests").orderBy("version").collect()]
    except AnalysisException:  # nothing published yet
        return []


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The live manifest. A reader asks once and keeps to it, so a later switch changes nothing under its feet."""
    known = manifests(spark, root)
    return known[-1] if known else None


def publish(places: DataFrame, root: str, release: str, vocabulary: DataFrame, canary: str = "cat", move: float = MOVE, rows: int = ROWS_PER_TILE) -> DataFrame:
    """Write a release beside the live one, gate what was written, and switch; failed checks (check, detail), none if it is live now.

    The order is what keeps readers safe: tiles, then their index, then the gate over the
    written copy, and last one manifest file, which appears whole or not at all. A copy
    whose gate fails is emptied and never named. After the switch, copies older than the
    one before are emptied. A release that is live already is not written again.
    """
    spark = places.sparkSession
    known = manifests(spark, root)
    live = known[-1] if known else None
    no_checks = spark.createDataFrame([], "check string, detail string")
    if live and live["release"] == release:
        return no_checks
    version = (live["version"] if live else 0) + 1
    to = f"copies/{release}.{version}"
    write(places, f"{root}/{to}", rows)
    new = spark.read.parquet(f"{root}/{to}/tiles")
    counts = {r[0]: r.n for r in new.groupBy(canary).agg(F.count("*").alias("n")).collect()}  # a vocabulary of kinds
    before = json.loads(live["canaries"]) if live else {}
    now = {k: counts.get(k, 0) for k in {*counts, *before}}
    as_rows = lambda d: spark.createDataFrame([(str(k), int(n)) for k, n in d.items()], "canary string, n long")
    failed = gate(new, vocabulary, as_rows(now), as_rows(before), move).collect()  # a few checks
    if failed:
        _emptied(spark, f"{root}/{to}")
        return spark.createDataFrame([tuple(r) for r in failed], "check string, detail string")
    total = new.agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("site")) > 3).alias("with_site")).first()
    row = (version, release, to, total.n, total.with_site, spark.read.parquet(f"{root}/{to}/index").count(), json.dumps({k: n for k, n in counts.items()}), live["dir"] if live else None)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifests")
    for old in known[:-1]:
        _emptied(spark, f"{root}/{old['dir']}")
    return no_checks


def _emptied(spark: SparkSession, copy: str) -> None:
    """Replace a copy's files by ones without rows, through Spark's own writer, so that it works on any store."""
    for part in ("tiles", "index"):
        spark.createDataFrame([], "id string").write.mode("overwrite").parquet(f"{copy}/{part}")


def read_box(spark: SparkSession, root: str, of: dict, south: float, north: float, west: float, east: float) -> DataFrame:
    """Places in a box, of the copy that a manifest names, from the tiles that meet it."""
    index = spark.read.parquet(f"{root}/{of['dir']}/index")
    wanted = index.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).select("tile")
    held = spark.read.parquet(f"{root}/{of['dir']}/tiles").join(wanted, "tile", "left_semi")
    return held.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))

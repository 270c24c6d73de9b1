"""Finding places: filters, exclusions, counts, samples and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.geo import EARTH_METRES, haversine, within_any
from wayfind.functions.text import bare_name, edit_distance, edit_variants, is_street_address, readable, similarity

CHAIN_NAMES = 3
METRES_PER_DEGREE = 111_320.0


def search(places: DataFrame, categories: list[str], centres: list[tuple[float, float]], miles: float) -> DataFrame:
    """Places of some categories within any circle; no category: none, without a scan."""
    if not categories:
        return places.limit(0)
    return places.filter(F.col("cat").isin(categories) & within_any(F.col("lat"), F.col("lon"), centres, miles))


def readable_places(places: DataFrame) -> DataFrame:
    return places.filter(readable(F.col("site")) & ~is_street_address(F.col("name")))


def counts(found: DataFrame) -> DataFrame:
    """listings and with_site in one pass."""
    return found.agg(F.count("*").alias("listings"), F.count_if(readable(F.col("site"))).alias("with_site"))


def stable_sample(found: DataFrame, n: int, given: DataFrame | None = None) -> DataFrame:
    """The first n by a hash of the id, of those not given already."""
    fresh = found if given is None else found.join(given.select("id"), "id", "left_anti")
    return fresh.orderBy(F.md5("id"), "id").limit(n)


def in_niche(places: DataFrame, main: list[str], rescue: list[str], pattern: str) -> DataFrame:
    """Places of the main categories, or of rescue categories with a telling name."""
    return places.filter(F.col("cat").isin(main) | (F.col("cat").isin(rescue) & F.col("name").rlike(pattern)))


def vocabulary(places: DataFrame, least: int = 50) -> DataFrame:
    return places.groupBy("cat").agg(F.count("*").alias("n"), F.count_if(readable(F.col("site"))).alias("with_site")).filter(F.col("n") >= least)


def apply_rules(pool: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The pool with first_fail: the first rule that is false for a row; null: kept.

    A rule that cannot be settled (null) keeps its row. The names in rules may use the
    column same_name: how many rows of the pool share the bare name (0: no name).
    """
    bare = bare_name(F.col("name"))
    bared = pool.withColumn("_bare", bare)
    named = bared.filter("_bare <> ''").withColumn("same_name", F.count("*").over(Window.partitionBy("_bare")))
    named = named.unionByName(bared.filter("_bare is null or _bare = ''").withColumn("same_name", F.lit(0).cast("long")))
    first = F.coalesce(*[F.when(~test, F.lit(name)) for name, test in rules])
    return named.withColumn("first_fail", first).drop("_bare")


def near_pairs(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """left and right rows (lat, lon; structs l and r) within a distance, by cells and their neighbours.

    Cells are as high as the distance. A degree of longitude narrows to the poles, so a
    cell's width follows its row of cells and neighbours are looked up row by row.
    """
    high = metres / METRES_PER_DEGREE
    row = F.floor(F.col("p.lat") / high).cast("long")
    wide = lambda y: high / F.greatest(F.cos(F.radians((F.abs(y) + 1) * high)), F.lit(0.01))
    own = right.select(F.struct("*").alias("p")).withColumn("_y", row).withColumn("_x", F.floor(F.col("p.lon") / wide(F.col("_y"))).cast("long")).withColumnRenamed("p", "r")
    looks = left.select(F.struct("*").alias("p")).withColumn("_y0", row).withColumn("_y", F.explode(F.array(*[F.col("_y0") + d for d in (-1, 0, 1)])))
    looks = looks.withColumn("_x0", F.floor(F.col("p.lon") / wide(F.col("_y"))).cast("long")).withColumn("_x", F.explode(F.array(*[F.col("_x0") + d for d in (-1, 0, 1)]))).withColumnRenamed("p", "l")
    distance = haversine(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"), EARTH_METRES)
    return looks.select("l", "_y", "_x").join(own.select("r", "_y", "_x"), ["_y", "_x"]).select("l", "r", distance.alias("metres")).filter(F.col("metres") <= metres)


def fuzzy_matches(left: DataFrame, right: DataFrame, metres: float, least: float = 0.6) -> DataFrame:
    """Each left id's best right id by name within a distance: id, match_id, score, occupied.

    Ties go to the lower ordinal of the right side; occupied: something is within the distance.
    """
    scored = near_pairs(left, right, metres).withColumn("score", similarity(F.col("l.name"), F.col("r.name")))
    best = F.min(F.when(F.col("score") >= least, F.struct((-F.col("score")).alias("less"), F.col("r.ordinal").alias("ordinal"), F.col("r.id").alias("id"))))
    found = scored.groupBy(F.col("l.id").alias("id")).agg(best.alias("b"))
    return left.select("id").join(found.withColumn("_near", F.lit(True)), "id", "left").select(
        "id", F.col("b.id").alias("match_id"), (-F.col("b.less")).alias("score"), F.coalesce("_near", F.lit(False)).alias("occupied")
    )


def suggestions(typed: DataFrame, vocabulary: DataFrame, shortest: int = 4, long: int = 7) -> DataFrame:
    """typed, word, distance: each typed word's nearest known word, within one edit, or two for a word of `long` letters; ties: the more common, then by name.

    typed(typed), vocabulary(word, n). A typed word below `shortest` letters has none. Words
    meet by the words that deletions leave of both, as many as edits are allowed, so no
    pair is looked at that shares none; short words, whose remains many share, are only
    indexed for one edit.
    """
    able = typed.select("typed").distinct().filter(F.length("typed") >= shortest).withColumn("cap", F.when(F.length("typed") >= long, 2).otherwise(1))
    variants = lambda c: F.when(F.col("cap") == 2, edit_variants(c, 2)).otherwise(edit_variants(c, 1))
    left = able.select("typed", "cap", F.explode(variants(F.col("typed"))).alias("v"))
    known = vocabulary.withColumn("cap", F.explode(F.when(F.length("word") >= long - 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    right = known.select("word", "n", "cap", F.explode(variants(F.col("word"))).alias("v"))
    pairs = left.join(right, ["cap", "v"]).select("typed", "word", "n", "cap").distinct()
    near = pairs.withColumn("distance", F.when(F.col("cap") == 2, edit_distance(F.col("typed"), F.col("word"), 2)).otherwise(edit_distance(F.col("typed"), F.col("word"), 1))).filter("distance is not null")
    best = near.groupBy("typed").agg(F.min(F.struct("distance", (-F.col("n")).alias("less"), "word")).alias("b"))
    return best.select("typed", F.col("b.word").alias("word"), F.col("b.distance").alias("distance"))


def market_documents(places: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """market, ordinal, id, document: a JSON document of each place with its verdicts, in place of one of a whole market.

    A market of any size stays many rows, which `write_markets` lays down by market and in
    order; counts of a market are an aggregation of their own.
    """
    verdicts = facts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("criterion_id", "verdict"))).alias("verdicts"))
    document = F.to_json(F.struct("id", "name", "cat", "ordinal", "verdicts"))
    return places.join(verdicts, "id", "left").select(F.col(by).alias("market"), "ordinal", "id", document.alias("document"))


def write_markets(documents: DataFrame, to: str) -> None:
    """One folder a market, JSON lines in order; a large market is several files."""
    documents.repartitionByRange("market", "ordinal").sortWithinPartitions("market", "ordinal").select("market", F.col("document").alias("value")).write.partitionBy("market").text(to)


def families(taxonomy: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor, cat of taxonomy(cat, path) and anchors(anchor): the anchor's own category, and all that have it above them in their path.

    A path's last step is the category itself and is no ancestor. Paths are a few steps,
    so a category meets few anchors; null paths have no ancestors.
    """
    above = F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1)).otherwise(F.array().cast("array<string>"))
    steps = taxonomy.select("cat", F.explode(F.array_distinct(F.concat(F.array("cat"), F.coalesce(above, F.array().cast("array<string>"))))).alias("anchor"))
    return steps.join(anchors.select("anchor").distinct(), "anchor").select("anchor", "cat").distinct()


def family_counts(places: DataFrame, taxonomy: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor, categories, places: every anchor's family and how many places(cat) are of it; places are counted by category before they meet the families."""
    held = places.groupBy("cat").agg(F.count("*").alias("n"))
    joined = families(taxonomy, anchors).join(held, "cat", "left").groupBy("anchor").agg(F.count("*").alias("categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"))
    return anchors.select("anchor").distinct().join(joined, "anchor", "left").na.fill(0, ["categories", "places"])

"""Queries over where places are: towns, boundaries, grids, tiles written and read back, and counts of pages about them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import geo, stats, text
from wayfind.operators import geometry, measure, regions, supply
from wayfind.plans.over_places import CATEGORIES, CITIES, FOUND_SQL, HOST_SQL, MILES, READABLE_SQL, _distance_sql
from wayfind.plans.registry import query
from wayfind.sources import shared, snapshot
from wayfind.sources.places import PLACES_SQL, places_of

TOWNS_SQL = "towns AS (SELECT town, count(*) AS n, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM places GROUP BY town)"


def _towns(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    return regions.gazetteer(places_of(spark, sf_dir), "town", least)


@query("gazetteer", f"WITH {PLACES_SQL}, {TOWNS_SQL} SELECT town, n, round((south + north) / 2, 9) AS lat, round((west + east) / 2, 9) AS lon FROM towns WHERE n >= 50")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _towns(spark, sf_dir, 50).select("town", "n", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("division_lookup", f"""WITH {PLACES_SQL}, d AS (SELECT town || '-' || (ordinal % 3) AS id, CASE WHEN ordinal % 3 = 0 THEN lower(town) ELSE town END AS name, CASE WHEN ordinal % 3 = 2 THEN 'county' ELSE 'locality' END AS kind, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM places GROUP BY 1, 2, 3),
a AS (SELECT *, (north - south) * (east - west) * cos(radians((south + north) / 2)) * 4761.0 AS area FROM d), w AS (SELECT n_name AS name, 'locality' AS kind FROM nation)
SELECT name, kind, id, round(area, 6) AS area FROM (SELECT w.name, w.kind, a.id, a.area, row_number() OVER (PARTITION BY w.name, w.kind ORDER BY a.area DESC, a.id DESC) AS rn FROM w JOIN a ON lower(a.name) = lower(w.name) AND a.kind = w.kind) WHERE rn = 1""")
def division_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three divisions a town, of which two are localities; names differ in case."""
    k = F.col("ordinal") % 3
    parts = places_of(spark, sf_dir).withColumns({"id": F.concat_ws("-", "town", k.cast("string")), "name": F.when(k == 0, F.lower("town")).otherwise(F.col("town")), "kind": F.when(k == 2, "county").otherwise("locality")})
    known = parts.groupBy("id", "name", "kind").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    wanted = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.lit("locality").alias("kind"))
    return regions.divisions(known, wanted)


@query("geojson_boxes", f"WITH {PLACES_SQL}, {TOWNS_SQL} SELECT town, round(west, 6) AS west, round(east, 6) AS east, round(south, 6) AS south, round(north, 6) AS north FROM towns")
def geojson_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of towns written as GeoJSON of all three kinds and read back."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), polygon.alias("geometry"))
    k = F.col("n") % 3
    written = F.when(k == 0, F.to_json(polygon)).when(k == 1, F.to_json(feature)).otherwise(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))))
    read = _towns(spark, sf_dir).select("town", written.alias("document")).select("town", regions.geojson_box(F.col("document")).alias("b"))
    return read.select("town", *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "east", "south", "north")])


@query("boundary_members", f"""WITH {PLACES_SQL}, {TOWNS_SQL}, b AS (SELECT town AS boundary, (south + north) / 2 AS y, (west + east) / 2 AS x, (north - south) / 8 AS h, (east - west) / 8 AS w FROM towns WHERE n >= 5)
SELECT boundary, count(*) AS members FROM b JOIN places ON abs(lat - y) < h AND abs(lon - x) < w * (1 - abs(lat - y) / h) GROUP BY boundary""")
def boundary_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a lozenge around the middle of each town."""
    mid = _towns(spark, sf_dir, 5).withColumns({"h": (F.col("north") - F.col("south")) / 8, "w": (F.col("east") - F.col("west")) / 8})
    point = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    y, x, h, w = (F.col(c) for c in ("lat", "lon", "h", "w"))
    rings = mid.select(F.col("town").alias("boundary"), F.array(point(y - h, x), point(y, x + w), point(y + h, x), point(y, x - w)).alias("ring"))
    return regions.within_rings(places_of(spark, sf_dir), rings).groupBy("boundary").agg(F.count("*").alias("members"))


@query("grid_cells", f"""WITH {PLACES_SQL}, {TOWNS_SQL}, c AS (SELECT town AS name, (south + north) / 2 AS lat0, (west + east) / 2 AS lon0 FROM towns WHERE n >= 5),
g AS (SELECT name, lat0, lon0, r.r AS row, k.k AS col, lat0 + r.r * (2 * 4000 / 111320.0::DOUBLE) AS lat, lon0 + k.k * ((2 * 4000 / 111320.0::DOUBLE) / greatest(cos(radians(lat0)), 0.01)) AS lon FROM c, (SELECT unnest(range(-5, 6)) AS r) r, (SELECT unnest(range(-5, 6)) AS k) k)
SELECT name, count(*) AS cells, min(row)::INTEGER AS first_row, max(col)::INTEGER AS last_column FROM g WHERE 2 * 3958.8 * asin(sqrt(pow(sin(radians(lat0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat0)) * pow(sin(radians(lon0 - lon) / 2), 2))) <= 20 GROUP BY name""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = regions.grid(_towns(spark, sf_dir, 5).select(F.col("town").alias("name"), "lat", "lon"), 20.0, 4000.0)
    return cells.groupBy("name").agg(F.count("*").alias("cells"), F.min("row").alias("first_row"), F.max("column").alias("last_column"))


@query("region_sizes", f"WITH {PLACES_SQL}, {TOWNS_SQL} SELECT town, round(pi() * (n % 40) * (n % 40), 6) AS circle, round((north - south) * (east - west) * cos(radians((south + north) / 2)) * 4761.0, 6) AS box, 97 AS points FROM towns")
def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square miles of a circle and of a box around each town, and how many points the circle's closed ring has."""
    miles = (F.col("n") % 40).cast("double")
    ring = F.get_json_object(regions.ring_json(F.col("lat"), F.col("lon"), miles), "$.coordinates[0]")
    points = F.size(F.from_json(ring, "array<array<double>>"))
    return _towns(spark, sf_dir).select("town", F.round(geo.circle_area(miles), 6).alias("circle"), F.round(geo.box_area(F.col("south"), F.col("north"), F.col("west"), F.col("east")), 6).alias("box"), points.alias("points"))


@query("pruned_search", f"WITH {PLACES_SQL}, {FOUND_SQL} SELECT id, cat, town FROM found")
def pruned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over a written snapshot: only tiles whose box meets a circle are opened."""
    at = shared.scratch(spark)
    snapshot.write(places_of(spark, sf_dir), at, rows=2000)
    return supply.search(snapshot.read(spark, at, CITIES, MILES), CATEGORIES, CITIES, MILES).select("id", "cat", "town")


@query("market_extract", f"WITH {PLACES_SQL}, {FOUND_SQL} SELECT cat, count(*) AS candidates, count(*) FILTER (cat = 'building') AS main, count(*) FILTER ({READABLE_SQL}) AS with_site, round(min({_distance_sql(*CITIES[0])}), 6) AS nearest FROM found GROUP BY cat")
def market_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found near some cities, written as an extract, main categories first and then by distance, and counted from there."""
    at = shared.scratch(spark)
    found = supply.search(places_of(spark, sf_dir), CATEGORIES, CITIES, MILES).withColumn("miles", geo.haversine(F.col("lat"), F.col("lon"), *CITIES[0])).withColumn("main", F.col("cat") == "building")
    found.sortWithinPartitions(F.desc("main"), "miles", "id").write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at).groupBy("cat").agg(F.count("*").alias("candidates"), F.count_if("main").alias("main"), F.count_if(text.readable(F.col("site"))).alias("with_site"), F.round(F.min("miles"), 6).alias("nearest"))


@query("city_slot", "WITH c AS (SELECT n_name AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, n_name) - 1 AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name), t AS (SELECT (floor(epoch(max(ts)) / 14400)::BIGINT % 50) % (SELECT least(50, count(*)) FROM c) AS slot FROM events) SELECT name FROM c, t WHERE k = slot")
def city_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose turn it was at the last event."""
    cities = _towns(spark, sf_dir).select(F.col("town").alias("name"), "n")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp").alias("at"))
    ranked = cities.orderBy(F.desc("n"), "name").limit(50).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "name"))).alias("ranked"))
    return ranked.crossJoin(last).select(regions.turn(F.col("ranked.name"), F.col("at")).alias("name"))  # one row each


SIZED_SQL = f"{PLACES_SQL}, c AS (SELECT town, count(*) AS n, count(*) FILTER ({READABLE_SQL}) AS with_site FROM places GROUP BY town)"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places_of(spark, sf_dir).groupBy("town").agg(F.count("*").alias("n"), F.count_if(text.readable(F.col("site"))).alias("with_site"))


@query("live_sites", f"""WITH {SIZED_SQL}, k AS (SELECT *, CASE WHEN n % 3 = 0 THEN with_site ELSE least(with_site, 20) END AS checked FROM c), d AS (SELECT *, least(checked, n % 7) AS dead FROM k)
SELECT town, checked >= with_site AS exact, CASE WHEN checked >= with_site THEN greatest(0, with_site - dead) WHEN dead < checked THEN greatest(1, floor(with_site * (1 - dead / checked::DOUBLE) + 0.5)) ELSE 0 END::BIGINT AS live FROM d WHERE checked > 0 AND with_site > 0""")
def live_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _sized(spark, sf_dir).withColumn("checked", F.when(F.col("n") % 3 == 0, F.col("with_site")).otherwise(F.least("with_site", F.lit(20)))).withColumn("dead", F.least("checked", F.col("n") % 7))
    return measure.live_sites(sized).select("town", "exact", "live")


@query("read_costs", f"""WITH {SIZED_SQL}, k AS (SELECT town, n, n % 90 AS read FROM c) SELECT town, greatest(n - read, 0) AS unread, round(greatest(n - read, 0) * 0.01 + read * 0.002, 6) AS cold, round(n * 0.002, 6) AS warm, round(read / n::DOUBLE, 6) AS warm_share, n > 5000 AS over_budget, round(n * (3.4 * 1.5 + 1.2) / 12, 6) AS seconds FROM k""")
def read_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _sized(spark, sf_dir).select("town", F.col("n").alias("candidates"), (F.col("n") % 90).alias("read"))
    return measure.read_costs(asked)


@query("pool_claims", f"""WITH {SIZED_SQL} SELECT town, CASE WHEN n = 0 THEN 'nothing' WHEN with_site = 0 THEN 'no site' WHEN with_site < 25 THEN 'thin' ELSE 'enough' END AS claim, floor(n / (n * 40)::DOUBLE * 100000 + 0.5) / 10.0::DOUBLE AS per_ten_thousand, floor(100.0 * with_site / n + 0.5)::BIGINT AS share FROM c""")
def pool_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, w = F.col("n"), F.col("with_site")
    claim = F.when(n == 0, "nothing").when(w == 0, "no site").when(w < 25, "thin").otherwise("enough")
    return _sized(spark, sf_dir).select("town", claim.alias("claim"), (stats.half_up(n / (n * 40) * 100_000) / 10).alias("per_ten_thousand"), stats.half_up(100.0 * w / n).alias("share"))


@query("count_pages", rf"""WITH {PLACES_SQL}, c AS (SELECT town, cat, count(*) AS listings FROM places GROUP BY town, cat HAVING count(*) >= 20)
SELECT cat || '-in-' || regexp_replace(regexp_replace(lower(town), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, listings FROM c""")
def count_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of counts, those with too few listings left out."""
    counted = places_of(spark, sf_dir).groupBy("town", "cat").agg(F.count("*").alias("listings")).filter("listings >= 20")
    return counted.select(F.concat(F.col("cat"), F.lit("-in-"), text.slug(F.col("town"))).alias("slug"), "listings")


@query("page_parts", rf"""WITH {PLACES_SQL}, c AS (SELECT DISTINCT cat || '-in-' || regexp_replace(regexp_replace(lower(town), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || substr('cotxaznm', (ordinal % 4 * 2 + 1)::INTEGER, 2) AS slug FROM places)
SELECT slug, regexp_extract(slug, '^([a-z]+)-in-(.+)-([a-z]{{2}})$', 1) AS trade, regexp_extract(slug, '^([a-z]+)-in-(.+)-([a-z]{{2}})$', 2) AS city, upper(regexp_extract(slug, '^([a-z]+)-in-(.+)-([a-z]{{2}})$', 3)) AS state FROM c""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of pages and what they say, by the trades that are known."""
    places = places_of(spark, sf_dir)
    state = F.substring(F.lit("cotxaznm"), (F.col("ordinal") % 4 * 2 + 1).cast("int"), F.lit(2))
    slugs = places.select(F.concat(F.col("cat"), F.lit("-in-"), text.slug(F.col("town")), F.lit("-"), state).alias("slug")).distinct()
    trades = places.select(F.col("cat").alias("trade")).distinct()
    return measure.slug_parts(slugs, trades)


@query("dns_sample", f"WITH {PLACES_SQL}, h AS (SELECT DISTINCT {HOST_SQL} AS host FROM places) SELECT host FROM h WHERE host IS NOT NULL ORDER BY md5('liveness:' || host), host LIMIT 40")
def dns_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty hosts by hash, each host once."""
    hosts = places_of(spark, sf_dir).select(text.host_of(F.col("site")).alias("host")).filter("host is not null").distinct()
    return hosts.orderBy(F.md5(F.concat(F.lit("liveness:"), F.col("host"))), "host").limit(40)


@query("shared_domain_stats", f"WITH {PLACES_SQL}, h AS (SELECT {HOST_SQL} AS host FROM places), c AS (SELECT host, count(*) AS n FROM h WHERE host IS NOT NULL GROUP BY host) SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS shared_rows, count(*) FILTER (n > 1) AS shared_hosts, max(n) AS worst, min(host) FILTER (n = (SELECT max(n) FROM c)) AS worst_host FROM c")
def shared_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings share a domain, and the domain that most do."""
    counted = places_of(spark, sf_dir).select(text.host_of(F.col("site")).alias("host")).filter("host is not null").groupBy("host").agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return counted.agg(F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("shared_rows"), F.count_if(many).alias("shared_hosts"), F.max("n").alias("worst"), F.min(F.struct((-F.col("n")).alias("less"), "host")).alias("w")).select("shared_rows", "shared_hosts", "worst", F.col("w.host").alias("worst_host"))


@query("duplicate_counts", f"WITH {PLACES_SQL}, k AS (SELECT town, coalesce({HOST_SQL}, 'id:' || id) AS key FROM places) SELECT town, count(*) AS listings, count(*) - count(DISTINCT key) AS duplicates FROM k GROUP BY town")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = places_of(spark, sf_dir).select("town", text.billing_key(F.col("site"), F.col("id")).alias("key"))
    return keyed.groupBy("town").agg(F.count("*").alias("listings"), (F.count("*") - F.countDistinct("key")).alias("duplicates"))


@query("name_agreement", f"""WITH {PLACES_SQL}, p AS (SELECT DISTINCT lower(n_name) AS a, cat AS b FROM places JOIN nation ON n_name = town), k AS (SELECT a, b, (SELECT count(*) FROM range(1, least(length(a), length(b)) + 1) t(i) WHERE left(a, i::INTEGER) = left(b, i::INTEGER)) AS shared FROM p) SELECT a, b, round(shared / greatest(length(a), length(b))::DOUBLE, 6) AS agreement FROM k""")
def name_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = places_of(spark, sf_dir).select(F.lower("town").alias("a"), F.col("cat").alias("b")).distinct()
    return pairs.select("a", "b", F.round(text.agreement(F.col("a"), F.col("b")), 6).alias("agreement"))


@query("enriched_sample", f"""WITH {PLACES_SQL}, p AS (SELECT id, rating >= 4.5 AS hit FROM places), f AS (SELECT id FROM p WHERE hit IS NOT TRUE ORDER BY md5(id), id LIMIT 50)
SELECT id, 'positive' AS kind, false AS valid_for_recall FROM p WHERE hit UNION ALL SELECT id, 'filler', false FROM f""")
def enriched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the engine called a match, with some of the rest: good for precision, not for recall."""
    judged = places_of(spark, sf_dir).select("id", F.coalesce(F.col("rating") >= 4.5, F.lit(False)).alias("hit"))
    return measure.enriched(judged, 50)


AREA_SQL = f"""{PLACES_SQL}, {TOWNS_SQL}, b AS (SELECT town AS area, (south + north) / 2 AS y, (west + east) / 2 AS x, (north - south) / 3 AS h, (east - west) / 3 AS w FROM towns WHERE n >= 2)"""


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area, geometry: of each town, a lozenge with a square hole and a far triangle, as well-known binary; and y, x, h, w that it is drawn from."""
    mid = _towns(spark, sf_dir, 2).select(F.col("town").alias("area"), F.col("lat").alias("y"), F.col("lon").alias("x"), ((F.col("north") - F.col("south")) / 3).alias("h"), ((F.col("east") - F.col("west")) / 3).alias("w"))

    def run(batches):
        for batch in batches:
            out = []
            for x, y, h, w in zip(*[batch.column(k).to_pylist() for k in (2, 1, 3, 4)], strict=True):
                lozenge, hole = [(x, y - h), (x + w, y), (x, y + h), (x - w, y)], [(x - w / 4, y - h / 4), (x + w / 4, y - h / 4), (x + w / 4, y + h / 4), (x - w / 4, y + h / 4)]
                triangle = [(x + w, y + h), (x + 1.5 * w, y + h), (x + 1.5 * w, y + 1.5 * h)]
                out.append(geometry.to_wkb([[np.array(r + r[:1]) for r in (lozenge, hole)], [np.array(triangle + triangle[:1])]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *(batch.column(k) for k in (1, 2, 3, 4))], names=["area", "geometry", "y", "x", "h", "w"])

    return mid.mapInArrow(run, "area string, geometry binary, y double, x double, h double, w double")


def _drawn_around(lat: Column, lon: Column, drawn: Column) -> Column:
    """Whether a point is in the shape drawn from y, x, h and w, step by step as in SQL, so that points on its lines fall as they do there."""
    y, x, h, w = (drawn[c] for c in ("y", "x", "h", "w"))
    north, east = F.abs(lat - y), F.abs(lon - x)
    lozenge = (north < h) & (east < w * (1 - F.try_divide(north, h))) & ~((north < h / 4) & (east < w / 4))
    triangle = (lon < x + 1.5 * w) & (lat > y + h) & (F.try_divide(lon - x - w, w) > F.try_divide(lat - y - h, h))
    return lozenge | triangle


@query("area_members", f"""WITH {AREA_SQL} SELECT area, count(*) AS members, min(id) AS first_id FROM b JOIN places ON (abs(lat - y) < h AND abs(lon - x) < w * (1 - abs(lat - y) / h) AND NOT (abs(lat - y) < h / 4 AND abs(lon - x) < w / 4)) OR (lon < x + 1.5 * w AND lat > y + h AND (lon - x - w) / w > (lat - y - h) / h) GROUP BY area""")
def area_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places inside multipolygons with a hole, read from binary; those so close to a line that rounding decides, by the numbers that the line was drawn from."""
    areas = _areas(spark, sf_dir).select(F.struct("area", "y", "x", "h", "w").alias("area"), "geometry")
    found = geometry.located(places_of(spark, sf_dir), areas)
    held = found.filter(F.when(F.col("close"), _drawn_around(F.col("lat"), F.col("lon"), F.col("area"))).otherwise(F.col("inside")))
    return held.groupBy(F.col("area.area").alias("area")).agg(F.count("*").alias("members"), F.min("id").alias("first_id"))


@query("area_measures", f"""WITH {AREA_SQL} SELECT area, 2 AS polygons, 3 AS rings, round(x - w, 6) AS west, round(x + 1.5 * w, 6) AS east, round(y - h, 6) AS south, round(y + 1.5 * h, 6) AS north, round(2 * h * w - h * w / 4 + h * w / 8, 3) AS square_degrees,
  round((2 * h * w - h * w / 4 + h * w / 8) * cos(radians(y + h / 4)) * 4761.0, 1) AS square_miles FROM b""")
def area_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.measures(_areas(spark, sf_dir))
    return found.select("area", "polygons", "rings", *[F.round(c, 6).alias(c) for c in ("west", "east", "south", "north")], F.round("square_degrees", 3).alias("square_degrees"), F.round("square_miles", 1).alias("square_miles"))


@query("snapshot_versions", f"""WITH {PLACES_SQL} SELECT 'spring' AS release, count(*) AS found FROM places WHERE lat BETWEEN 35 AND 40 AND lon BETWEEN -110 AND -100 AND ordinal % 5 <> 0
UNION ALL SELECT 'summer', count(*) FROM places WHERE lat BETWEEN 35 AND 40 AND lon BETWEEN -110 AND -100 AND ordinal % 50 <> 0""")
def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three releases offered in turn: the first two pass and are read by the manifest that was live then, the third fails its gate and changes nothing."""
    root, places, boxes = shared.scratch(spark), places_of(spark, sf_dir), (35.0, 40.0, -110.0, -100.0)
    words = places.select("cat").distinct()
    shown = []
    for release, offered in (("spring", places.filter("ordinal % 5 <> 0")), ("summer", places.filter("ordinal % 50 <> 0")), ("broken", places.filter("cat <> 'building'"))):
        snapshot.publish(offered, root, release, words, move=0.6, rows=2000)
        live = snapshot.manifest(spark, root)
        if release != "broken":
            shown.append(live)
        elif live["release"] != "summer":
            raise ValueError("a failed gate changed the live copy")
    found = [snapshot.read_box(spark, root, m, *boxes).agg(F.count("*").alias("found")).select(F.lit(m["release"]).alias("release"), "found") for m in shown]
    return found[0].union(found[1])

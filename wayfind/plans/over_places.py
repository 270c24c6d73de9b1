"""Queries over places made of the driver's customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import geo, stats, text
from wayfind.operators import measure, resolve, supply
from wayfind.plans.registry import query
from wayfind.sources import snapshot
from wayfind.sources.places import PLACES_SQL, places_of

CITIES = [(39.74, -104.99), (33.45, -112.07), (32.78, -96.80)]
CATEGORIES = ["building", "machinery"]
RING = [(30.0, -110.0), (42.0, -112.0), (45.0, -98.0), (36.0, -92.0), (29.0, -99.0)]
MILES = 400.0


def _distance_sql(lat: float, lon: float, radius: float = 3958.8) -> str:
    return f"2 * {radius} * asin(sqrt(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2)))"


READABLE_SQL = "coalesce(length(trim(site)) > 3, false)"
FOUND_SQL = f"found AS (SELECT * FROM places WHERE cat IN ('building', 'machinery') AND ({' OR '.join(f'{_distance_sql(*c)} <= {MILES}' for c in CITIES)}))"
HOST_SQL = "CASE WHEN contains(regexp_extract(regexp_replace(regexp_replace(lower(trim(site)), '^https?://', ''), '^www\\.', ''), '^([^/?#]*)', 1), '.') THEN regexp_extract(regexp_replace(regexp_replace(lower(trim(site)), '^https?://', ''), '^www\\.', ''), '^([^/?#]*)', 1) END"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.search(places_of(spark, sf_dir), CATEGORIES, CITIES, MILES)


@query("flagship_market_report", f"WITH {PLACES_SQL}, {FOUND_SQL} SELECT cat, count(*) AS listings, count(*) FILTER ({READABLE_SQL}) AS with_site, count(DISTINCT {HOST_SQL}) AS hosts FROM found GROUP BY cat")
def market_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found near some cities, by category."""
    found = _found(spark, sf_dir)
    return found.groupBy("cat").agg(F.count("*").alias("listings"), F.count_if(text.readable(F.col("site"))).alias("with_site"), F.countDistinct(text.host_of(F.col("site"))).alias("hosts"))


@query("supply_count", f"WITH {PLACES_SQL}, {FOUND_SQL} SELECT count(*) AS listings, count(*) FILTER ({READABLE_SQL}) AS with_site FROM found")
def supply_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.counts(_found(spark, sf_dir))


@query("supply_sample", f"WITH {PLACES_SQL}, {FOUND_SQL} SELECT id, name FROM found WHERE {READABLE_SQL} AND ordinal % 5 <> 0 ORDER BY md5(id), id LIMIT 20")
def supply_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 by hash of those that were not given before (here: every fifth was)."""
    given = places_of(spark, sf_dir).filter("ordinal % 5 = 0")
    return supply.stable_sample(supply.readable_places(_found(spark, sf_dir)), 20, given).select("id", "name")


@query("nearest_city", f"WITH {PLACES_SQL} SELECT id, city, round(miles, 6) AS miles FROM (SELECT id, {', '.join(f'{_distance_sql(*c)} AS d{i}' for i, c in enumerate(CITIES))} FROM places) t, LATERAL (SELECT CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS city, least(d0, d1, d2) AS miles) u WHERE miles <= {MILES}")
def nearest_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = places_of(spark, sf_dir)
    near = F.array_min(F.array(*[F.struct(geo.haversine(F.col("lat"), F.col("lon"), *c).alias("miles"), F.lit(i).alias("city")) for i, c in enumerate(CITIES)]))
    return places.select("id", near.alias("n")).filter(F.col("n.miles") <= MILES).select("id", "n.city", F.round("n.miles", 6).alias("miles"))


def _ring_sql() -> str:
    edges = [f"CASE WHEN (lat < {y1}) <> (lat < {y2}) AND lon < {x1} + (lat - {y1}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END" for (y1, x1), (y2, x2) in zip(RING, [*RING[1:], RING[0]], strict=True) if y1 != y2]
    return f"({' + '.join(edges)}) % 2 = 1"


@query("polygon_search", f"WITH {PLACES_SQL} SELECT id, lat, lon FROM places WHERE {_ring_sql()}")
def polygon_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places_of(spark, sf_dir).filter(geo.in_ring(F.col("lat"), F.col("lon"), RING)).select("id", "lat", "lon")


@query("category_vocabulary", f"WITH {PLACES_SQL} SELECT cat, count(*) AS n, count(*) FILTER ({READABLE_SQL}) AS with_site FROM places GROUP BY cat HAVING count(*) >= 50")
def category_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.vocabulary(places_of(spark, sf_dir))


@query("niche_scope", f"WITH {PLACES_SQL} SELECT id, cat FROM places WHERE cat = 'building' OR (cat IN ('furniture', 'household') AND regexp_matches(name, '7[0-9]*$'))")
def niche_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.in_niche(places_of(spark, sf_dir), ["building"], ["furniture", "household"], r"7[0-9]*$").select("id", "cat")


@query("listing_rules", f"""WITH {PLACES_SQL}, named AS (SELECT *, count(*) OVER (PARTITION BY town) AS same_town FROM places)
SELECT coalesce(CASE WHEN rating < 3.0 THEN 'rating' WHEN reviews < 40 THEN 'reviews' WHEN NOT {READABLE_SQL} THEN 'website' END, 'kept') AS outcome, count(*) AS n FROM named GROUP BY 1""")
def listing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first rule that they fail; a missing rating or review count fails none."""
    rules = [("rating", F.col("rating") >= 3.0), ("reviews", F.col("reviews") >= 40), ("website", text.readable(F.col("site"))), ("independent", F.col("same_name") < supply.CHAIN_NAMES)]
    return supply.apply_rules(places_of(spark, sf_dir), rules).groupBy(F.coalesce("first_fail", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


WORK_SQL = f"""work AS (SELECT id, ordinal, {HOST_SQL} AS site_key FROM places), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY site_key) AS n, row_number() OVER (PARTITION BY site_key ORDER BY ordinal) AS rn FROM work)"""


@query("work_list", f"WITH {PLACES_SQL}, {WORK_SQL} SELECT id, site_key, CASE WHEN site_key IS NOT NULL AND n >= 5 THEN 'chain' WHEN site_key IS NOT NULL AND rn > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM ranked")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.work_list(places_of(spark, sf_dir)).select("id", "site_key", "status")


@query("billing_groups", f"""WITH RECURSIVE {PLACES_SQL}, k AS (SELECT *, {HOST_SQL} AS host FROM places), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ordinal) AS n FROM k WHERE host IS NOT NULL),
step(host, n, held) AS (SELECT host, n, [{{'id': id, 'lat': lat, 'lon': lon, 'c': 0}}] FROM r WHERE n = 1 UNION ALL
  SELECT r.host, r.n, list_append(held, {{'id': id, 'lat': r.lat, 'lon': r.lon, 'c': coalesce(list_min(list_transform(list_filter(held, lambda m: 2 * 6371000 * asin(sqrt(pow(sin(radians(r.lat - m.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(m.lat)) * pow(sin(radians(r.lon - m.lon) / 2), 2))) <= 200), lambda m: m.c)), list_max(list_transform(held, lambda m: m.c)) + 1)}})
  FROM step JOIN r ON r.host = step.host AND r.n = step.n + 1),
done AS (SELECT host, unnest(held) AS m FROM (SELECT host, arg_max(held, n) AS held FROM step GROUP BY host)), c AS (SELECT r.*, m.c AS c FROM done JOIN r ON r.id = m.id),
l AS (SELECT host, c, arg_min(id, struct_pack(less := -((CASE WHEN phone IS NOT NULL THEN 1000 ELSE 0 END) + length(coalesce(addr, '')) + length(coalesce(name, '')) / 100.0::DOUBLE), o := ordinal)) AS lead FROM c GROUP BY host, c), z AS (SELECT host, max(c) AS most FROM c GROUP BY host)
SELECT id, CASE WHEN most > 0 THEN host || '#' || c ELSE host END AS group_key, lead FROM c JOIN l USING (host, c) JOIN z USING (host) UNION ALL SELECT id, 'id:' || id, id FROM k WHERE host IS NULL""")
def billing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent clusters by host; the SQL walks each host's rows one by one."""
    return resolve.billing_groups(places_of(spark, sf_dir))


@query("shared_hosts", f"""WITH {PLACES_SQL}, h AS (SELECT *, {HOST_SQL} AS host FROM places), f AS (SELECT host, arg_min(lat, ordinal) AS lat0, arg_min(lon, ordinal) AS lon0, count(*) AS places FROM h WHERE host IS NOT NULL GROUP BY host)
SELECT DISTINCT host, f.places FROM h JOIN f USING (host) WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat)) * cos(radians(lat0)) * pow(sin(radians(lon - lon0) / 2), 2))) > 200""")
def shared_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.shared_hosts(places_of(spark, sf_dir))


@query("removal_claims", f"""WITH {PLACES_SQL}, known AS (SELECT id, {HOST_SQL} AS host, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS tel FROM places),
asked AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 2 = 0 THEN 'site' || (s_suppkey * 3) || '.example.com' END AS host, '303555' || lpad((s_suppkey * 5)::VARCHAR, 4, '0') AS tel FROM supplier),
by_host AS (SELECT request_id, id FROM asked JOIN known USING (host))
SELECT request_id, id, 'domain' AS how FROM by_host UNION ALL SELECT a.request_id, k.id, 'phone' FROM asked a JOIN known k USING (tel) WHERE NOT EXISTS (SELECT 1 FROM by_host b WHERE b.request_id = a.request_id AND b.id = k.id)""")
def removal_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of suppliers: half by domain, all by phone."""
    s = F.col("s_suppkey")
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        s.alias("request_id"), F.when(s % 2 == 0, F.concat(F.lit("http://site"), (s * 3).cast("string"), F.lit(".example.com/"))).alias("site"),
        F.concat(F.lit("+1 (303) 555-"), F.lpad((s * 5).cast("string"), 4, "0")).alias("phone"),
    )
    return resolve.claims(places_of(spark, sf_dir), asked)


@query("tile_index", f"""WITH {PLACES_SQL}, c AS (SELECT *, floor(lat / 2.0)::BIGINT || '_' || floor(lon / 2.0)::BIGINT AS cell FROM places)
SELECT cell || '-0' AS tile, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, count(*) AS n FROM c GROUP BY cell""")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.tile_index(snapshot.tiles(places_of(spark, sf_dir)))


def _overlap_sql() -> str:
    boxes = [geo.box(*c, MILES) for c in CITIES]
    return " OR ".join(f"(west <= {e!r} AND east >= {w!r} AND south <= {n!r} AND north >= {s!r})" for s, n, w, e in boxes)


@query("tiles_to_open", f"""WITH {PLACES_SQL}, c AS (SELECT *, floor(lat / 2.0)::BIGINT || '_' || floor(lon / 2.0)::BIGINT || '-0' AS tile FROM places), i AS (SELECT tile, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, count(*) AS n FROM c GROUP BY tile)
SELECT tile, n FROM i WHERE {_overlap_sql()}""")
def tiles_to_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = snapshot.tile_index(snapshot.tiles(places_of(spark, sf_dir)))
    return snapshot.overlapping(index, CITIES, MILES).select("tile", "n")


@query("fuzzy_matches", f"""WITH {PLACES_SQL}, other AS (SELECT 's' || s_suppkey AS id, 'Customer#' || lpad((s_suppkey * 7)::VARCHAR, 9, '0') AS name, 25 + (s_suppkey * 7 * 7919 % 24000) / 1000.0::DOUBLE + 0.002 AS lat, -120 + (s_suppkey * 7 * 104729 % 50000) / 1000.0::DOUBLE AS lon, s_suppkey AS ordinal FROM supplier),
words AS (SELECT id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w, lat, lon, ordinal FROM (SELECT id, name, lat, lon, ordinal FROM places UNION ALL SELECT * FROM other)),
near AS (SELECT l.id AS lid, r.id AS rid, r.ordinal, len(list_intersect(l.w, r.w)) AS b, len(l.w) AS nl, len(r.w) AS nr FROM words l JOIN words r ON l.id LIKE 's%' AND r.id LIKE 'c%' AND abs(l.lat - r.lat) < 0.01
  WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))) <= 400),
scored AS (SELECT *, CASE WHEN least(nl, nr) = 0 THEN 0 WHEN b = least(nl, nr) THEN 1 ELSE b / (nl + nr - b)::DOUBLE END AS score FROM near),
best AS (SELECT lid, rid, score, row_number() OVER (PARTITION BY lid ORDER BY score DESC, ordinal) AS rn FROM scored WHERE score >= 0.6)
SELECT o.id, b.rid AS match_id, b.score::DOUBLE AS score, o.id IN (SELECT lid FROM scored) AS occupied FROM other o LEFT JOIN best b ON b.lid = o.id AND b.rn = 1""")
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, placed near some customers and named like them, against places."""
    s = F.col("s_suppkey")
    other = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("s"), s.cast("string")).alias("id"), F.concat(F.lit("Customer#"), F.lpad((s * 7).cast("string"), 9, "0")).alias("name"),
        (25 + (s * 7 * 7919 % 24000) / 1000.0 + 0.002).alias("lat"), (-120 + (s * 7 * 104729 % 50000) / 1000.0).alias("lon"), s.alias("ordinal"),
    )
    return supply.fuzzy_matches(other, places_of(spark, sf_dir).select("id", "name", "lat", "lon", "ordinal"), 400.0)


@query("stratified_draw", f"WITH {PLACES_SQL}, r AS (SELECT id, cat, row_number() OVER (PARTITION BY cat ORDER BY md5(id), id) AS n FROM places) SELECT id, cat FROM r WHERE n <= CASE cat WHEN 'building' THEN 10 WHEN 'machinery' THEN 5 ELSE 0 END")
def stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.draw(places_of(spark, sf_dir), "cat", {"building": 10, "machinery": 5}).select("id", "cat")


@query("commonest_trade", f"WITH {PLACES_SQL}, c AS (SELECT town, cat, count(*) AS n, min(ordinal) AS o FROM places GROUP BY town, cat) SELECT town, cat, n FROM (SELECT *, row_number() OVER (PARTITION BY town ORDER BY n DESC, o) AS rn FROM c) WHERE rn = 1")
def commonest_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.commonest(places_of(spark, sf_dir), "town", "cat", "ordinal")


def _corrected_sql(n: str, k: str) -> str:
    p, q, d = f"({k} / {n}::DOUBLE)", f"(1 - {k} / {n}::DOUBLE)", f"(2 * ({n} + 3.8416))"
    lo = f"CASE WHEN {k} = 0 THEN 0 ELSE greatest(0, (2 * {n} * {p} + 3.8416 - 1 - 1.96 * sqrt(3.8416 - 2 - 1 / {n}::DOUBLE + 4 * {p} * ({n} * {q} + 1))) / {d}) END"
    hi = f"CASE WHEN {k} = {n} THEN 1 ELSE least(1, (2 * {n} * {p} + 3.8416 + 1 + 1.96 * sqrt(3.8416 + 2 - 1 / {n}::DOUBLE + 4 * {p} * ({n} * {q} - 1))) / {d}) END"
    return f"floor({lo} * frame)::BIGINT AS low, ceil({hi} * frame)::BIGINT AS high"


@query("free_count", f"""WITH {PLACES_SQL}, r AS (SELECT cat, rating IS NOT NULL AND rating >= 3.5 AS hit, row_number() OVER (PARTITION BY cat ORDER BY md5(id), id) AS n, count(*) OVER (PARTITION BY cat) AS f FROM places),
s AS (SELECT cat, max(f) AS frame, count(*) AS sampled, count(*) FILTER (hit) AS matched FROM r WHERE n <= 25 GROUP BY cat) SELECT cat, frame, sampled, matched, {_corrected_sql('sampled', 'matched')} FROM s""")
def free_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = places_of(spark, sf_dir).select("cat", "id", F.coalesce(F.col("rating") >= 3.5, F.lit(False)).alias("matched"))
    return measure.free_count(frame, "cat")


@query("price_bands", f"""WITH {PLACES_SQL}, c AS (SELECT town, count(*) AS n, count(*) FILTER (rating >= 4.5) AS k FROM places GROUP BY town),
w AS (SELECT *, greatest(0, (k / n::DOUBLE + 0.7056 / (2 * n)) / (1 + 0.7056 / n) - 0.84 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 0.7056 / (4 * n * n)) / (1 + 0.7056 / n)) AS lo FROM c)
SELECT town, n, k, round(lo, 6) AS rate_bound, CASE WHEN lo >= 0.15 THEN 1 WHEN lo >= 0.06 THEN 4 ELSE 5 END AS credits FROM w""")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits quoted by town from the lower bound of the share that a criterion matches."""
    counted = places_of(spark, sf_dir).groupBy("town").agg(F.count("*").alias("n"), F.count_if(F.col("rating") >= 4.5).alias("k"))
    lo, _ = stats.wilson(F.col("k"), F.col("n"), stats.QUOTE_Z)
    return counted.select("town", "n", "k", F.round(lo, 6).alias("rate_bound"), stats.band_credits(lo).alias("credits"))


@query("city_trade_sweep", f"""WITH {PLACES_SQL}, big AS (SELECT town FROM places GROUP BY town ORDER BY count(*) DESC, town LIMIT 10), trades AS (SELECT DISTINCT cat FROM places), fresh AS (SELECT DISTINCT town, cat FROM places WHERE ordinal % 3 = 0 AND rating > 4.0)
SELECT town, cat FROM big, trades WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.town = big.town AND f.cat = trades.cat)""")
def city_trade_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the ten largest towns and the trades have no fresh count yet."""
    places = places_of(spark, sf_dir)
    big = places.groupBy("town").count().orderBy(F.desc("count"), "town").limit(10).select("town")
    trades = places.select("cat").distinct()
    fresh = places.filter("ordinal % 3 = 0 and rating > 4.0").select("town", "cat")
    return big.crossJoin(F.broadcast(trades)).join(fresh, ["town", "cat"], "left_anti")  # ten rows on one side


TYPED_SQL = """words AS (SELECT lower(n_name) AS word, 1 AS n FROM nation UNION ALL SELECT lower(p_brand), count(*) FROM part GROUP BY 1),
asked AS (SELECT DISTINCT lower(CASE n_nationkey % 4 WHEN 0 THEN substr(n_name, 2) WHEN 1 THEN substr(n_name, 1, 2) || substr(n_name, 4, 1) || substr(n_name, 3, 1) || substr(n_name, 5) WHEN 2 THEN 'x' || n_name ELSE n_name || 'qq' END) AS typed FROM nation)"""


@query("typo_suggestions", f"WITH {TYPED_SQL}, d AS (SELECT typed, word, n, damerau_levenshtein(typed, word) AS distance FROM asked, words) SELECT typed, word, distance FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY distance, n DESC, word) AS rn FROM d WHERE length(typed) >= 4 AND distance <= CASE WHEN length(typed) >= 7 THEN 2 ELSE 1 END) WHERE rn = 1")
def typo_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt nation names against names and brands; some take two edits."""
    nation, part = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    n, k = F.col("n_name"), F.col("n_nationkey") % 4
    swapped = F.concat(F.substring(n, 1, 2), F.substring(n, 4, 1), F.substring(n, 3, 1), F.substring(n, 5, 100))
    wrong = F.when(k == 0, F.substring(n, 2, 100)).when(k == 1, swapped).when(k == 2, F.concat(F.lit("x"), n)).otherwise(F.concat(n, F.lit("qq")))
    words = nation.select(F.lower(n).alias("word"), F.lit(1).cast("long").alias("n")).union(part.groupBy(F.lower("p_brand")).count())
    return supply.suggestions(nation.select(F.lower(wrong).alias("typed")), words)


@query("market_documents", f"""WITH {PLACES_SQL} SELECT town AS market, ordinal, id, to_json({{'id': id, 'name': name, 'cat': cat, 'ordinal': ordinal, 'verdicts': [{{'criterion_id': 'rated', 'verdict': CASE WHEN rating >= 3.5 THEN 'match' WHEN rating IS NOT NULL THEN 'no_match' ELSE 'unread' END}}]}})::VARCHAR AS document FROM places""")
def market_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document of each place, by town."""
    places = places_of(spark, sf_dir)
    facts = places.select("id", F.lit("rated").alias("criterion_id"), F.when(F.col("rating") >= 3.5, "match").when(F.col("rating").isNotNull(), "no_match").otherwise("unread").alias("verdict"))
    return supply.market_documents(places, facts, "town")


@query("work_list_chains", f"""WITH {PLACES_SQL}, w AS (SELECT id, ordinal, CASE WHEN ordinal % 4 = 0 THEN NULL WHEN ordinal % 4 = 1 THEN 'chain' || (ordinal % 3) || '.com' ELSE 'own' || (ordinal // 8) || '.com' END AS site_key FROM places),
r AS (SELECT *, count(*) OVER (PARTITION BY site_key) AS n, row_number() OVER (PARTITION BY site_key ORDER BY ordinal) AS rn FROM w) SELECT CASE WHEN site_key IS NULL THEN 'kept' WHEN n >= 5 THEN 'chain' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS status, count(*) AS n, min(id) AS first_id FROM r GROUP BY 1""")
def work_list_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work list in which a few sites have many listings, some have several and a quarter have none."""
    k = F.col("ordinal")
    site = F.when(k % 4 == 1, F.concat(F.lit("https://chain"), (k % 3).cast("string"), F.lit(".com/"))).when(k % 4 != 0, F.concat(F.lit("http://www.own"), F.expr("ordinal div 8").cast("string"), F.lit(".com")))
    return resolve.work_list(places_of(spark, sf_dir).withColumn("site", site)).groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("chain_rule", f"""WITH {PLACES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY ordinal % 500) AS same FROM places WHERE ordinal % 6 <> 0), a AS (SELECT rating, same FROM n UNION ALL SELECT rating, 0 FROM places WHERE ordinal % 6 = 0)
SELECT coalesce(CASE WHEN rating < 3.0 THEN 'rating' WHEN same >= 3 THEN 'independent' END, 'kept') AS outcome, count(*) AS n FROM a GROUP BY 1""")
def chain_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over places of which some share a name, written in different ways, and some have none."""
    k = F.col("ordinal")
    name = F.when(k % 6 == 0, "---").otherwise(F.concat(F.lit("Acme "), (k % 500).cast("string"), F.when(k % 2 == 0, " - North, LLC").otherwise(" Inc.")))
    rules = [("rating", F.col("rating") >= 3.0), ("independent", F.col("same_name") < supply.CHAIN_NAMES)]
    return supply.apply_rules(places_of(spark, sf_dir).withColumn("name", name), rules).groupBy(F.coalesce("first_fail", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query("tile_chunks", f"""WITH {PLACES_SQL}, c AS (SELECT floor(lat / 2.0)::BIGINT || '_' || floor(lon / 2.0)::BIGINT AS cell, row_number() OVER (PARTITION BY floor(lat / 2.0), floor(lon / 2.0)) AS k FROM places) SELECT cell || '-' || ((k - 1) // 5) AS tile, count(*) AS n FROM c GROUP BY 1""")
def tile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of five places at most, so that a cell has several."""
    return snapshot.tiles(places_of(spark, sf_dir), 5).groupBy("tile").agg(F.count("*").alias("n"))

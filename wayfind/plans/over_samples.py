"""Queries over samples that repeat exactly, links worth following, uploads told by content, and hosts' places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import linking, resolve, samples
from wayfind.plans.over_pages import _table
from wayfind.plans.registry import query

from wayfind.sources import uploads
from wayfind.sources.places import PLACES_SQL, places_of
from wayfind.streaming import leases


def _times(a: str, b: str) -> str:
    return f"((({a})::HUGEINT * ({b})::HUGEINT) & 4294967295)::BIGINT"


@query("seeded_order", f"""WITH RECURSIVE {PLACES_SQL}, g AS (SELECT town, list(ordinal ORDER BY ordinal) AS l, count(*) AS n FROM places GROUP BY town),
s AS (SELECT town, l, n, n AS i, list_reduce(list_prepend(2166136261, [unicode(c) FOR c IN string_split('count:' || town, '')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::BIGINT AS h FROM g
UNION ALL SELECT town, [CASE WHEN k = i THEN l[j] WHEN k = j THEN l[i] ELSE l[k] END FOR k IN range(1, n + 1)], n, i - 1, h FROM (
  SELECT town, l, n, i, h, floor(xor(t, t >> 14) / 4294967296::DOUBLE * i)::BIGINT + 1 AS j FROM (
    SELECT town, l, n, i, h, xor(t, (t + {_times('xor(t, t >> 7)', 't | 61')}) & 4294967295)::BIGINT AS t FROM (
      SELECT town, l, n, i, h, {_times('xor(h, h >> 15)', 'h | 1')} AS t FROM (SELECT town, l, n, i, ((h + 1831565813) & 4294967295)::BIGINT AS h FROM s WHERE i > 1)))))
SELECT town, l[k] AS ordinal, k - 1 AS place FROM s, unnest(range(1, n + 1)) u(k) WHERE i = 1""")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.shuffled(places_of(spark, sf_dir), "town", "ordinal", "count:")


SHOP_SQL = "shops AS (SELECT cat, id, 'Shop ' || right(phone, 2) || ' - ' || town AS name, CASE WHEN rating IS NULL THEN ' ' ELSE town END AS town, trim(site) AS site FROM places WHERE phone IS NOT NULL)"


@query("spread_rows", f"""WITH RECURSIVE {PLACES_SQL}, {SHOP_SQL}, listed AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY CASE WHEN coalesce(site, '') <> '' THEN 0 ELSE 1 END, name, id) - 1 AS pos FROM shops),
r AS (SELECT cat, 0::BIGINT AS lo, max(pos)::BIGINT AS hi, 1 AS level, 0::BIGINT AS path FROM listed GROUP BY cat UNION ALL
  SELECT cat, CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END, level + 1, path * 2 + side FROM r, (VALUES (0), (1)) v(side) WHERE hi - lo >= 2),
k AS (SELECT l.*, CASE WHEN l.pos = 0 THEN 0 WHEN r.cat IS NULL THEN 99 ELSE r.level END AS level, coalesce(CASE WHEN l.pos > 0 THEN r.path END, l.pos) AS path FROM listed l LEFT JOIN r ON r.cat = l.cat AND r.hi - r.lo >= 2 AND (r.lo + r.hi) // 2 = l.pos),
n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(lower(name), '^([^-–—,(|]*)', 1), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS bare, CASE WHEN length(trim(town)) > 1 THEN trim(town) END AS place FROM k),
o AS (SELECT * FROM n WHERE bare <> '' QUALIFY row_number() OVER (PARTITION BY cat, bare ORDER BY level, path) = 1),
f AS (SELECT *, CASE WHEN place IS NOT NULL AND row_number() OVER (PARTITION BY cat, place ORDER BY level, path) = 1 THEN 0 ELSE 1 END AS later FROM o)
SELECT cat, row_number() OVER (PARTITION BY cat ORDER BY later, level, path)::INTEGER AS rank, id, name, place AS town, site FROM f QUALIFY rank <= 5""")
def spread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = places_of(spark, sf_dir).filter("phone is not null")
    town = F.when(F.col("rating").isNull(), " ").otherwise(F.col("town"))
    named = F.concat(F.lit("Shop "), F.right("phone", F.lit(2)), F.lit(" - "), "town")
    return samples.spread_sample(shops.select("cat", "id", named.alias("name"), town.alias("town"), F.trim("site").alias("site")), "cat")


WORDS = (("the", 5), ("in", 4), ("en", 2), ("tion", 1))


@query("ranked_links", r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>[^<]*', 1) AS href, regexp_extract_all(html, '(?is)<a\b[^>]*href=["''][^"'']+["''][^>]*>([^<]*)', 1) AS said FROM pages),
l AS (SELECT page_id, url, trim(href[i]) AS href, lower(said[i]) AS said, i FROM a, unnest(range(1, len(href) + 1)) u(i)),
b AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM l WHERE starts_with(href, '/') AND NOT starts_with(href, '//')),
c AS (SELECT page_id, url, i, scheme || '://' || host || regexp_extract(href, '^([^?#]*)', 1) AS link, lower(regexp_extract(href, '^([^?#]*)', 1)) || ' ' || trim(said) AS words FROM b),
s AS (SELECT page_id, link, max(CASE WHEN contains(words, 'the') THEN 5 ELSE 0 END + CASE WHEN contains(words, 'in') THEN 4 ELSE 0 END + CASE WHEN contains(words, 'en') THEN 2 ELSE 0 END + CASE WHEN contains(words, 'tion') THEN 1 ELSE 0 END)::INTEGER AS score, min(i) AS i FROM c WHERE rtrim(link, '/') <> rtrim(url, '/') GROUP BY page_id, link)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(link), i)::INTEGER AS rank, link, score FROM s WHERE score > 0 QUALIFY rank <= 4""")
def ranked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four links of each page that the words of its language recommend; every link of these pages is a path of its own host."""
    return linking.ranked_links(_table(spark, sf_dir, "pages"), WORDS, 4)


def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, _c0 to _c3: places as an upload without known headers, under a title line; some lines lack a website or have words in its place."""
    k = F.col("ordinal")
    link = F.when(k % 9 == 4, "ask us").when(k % 10 == 3, F.concat(F.lit("HTTP://WWW.Site"), (k % 50).cast("string"), F.lit(".example.com?x=1"))).otherwise(F.col("site"))
    body = places_of(spark, sf_dir).select((k + 2).alias("line"), F.concat(F.lit("note "), k.cast("string")).alias("_c0"), link.alias("_c1"), F.col("name").alias("_c2"), F.col("phone").alias("_c3"))
    top = spark.createDataFrame([(1, "exported in spring", None, None, None), (2, "Remark", "Their page", "Account", "Mobile")], body.schema)
    return top.union(body)


@query("upload_lines", rf"""WITH {PLACES_SQL}, u AS (SELECT ordinal + 2 AS line, CASE WHEN ordinal % 9 = 4 THEN 'ask us' WHEN ordinal % 10 = 3 THEN 'HTTP://WWW.Site' || (ordinal % 50) || '.example.com?x=1' ELSE nullif(trim(site), '') END AS raw, name, phone FROM places
UNION ALL SELECT 2, 'Their page', 'Account', 'Mobile'),
s AS (SELECT *, CASE WHEN regexp_matches(raw, '(?i)^(https?://)?[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+)+(/|$|\?|#)') THEN 'https://' || regexp_replace(regexp_extract(regexp_replace(lower(raw), '^https?://', ''), '^([^/?#]*)', 1), '^www\.', '') END AS site FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY line) AS rn FROM s), t AS (SELECT max(line) AS last FROM (SELECT line FROM r WHERE site IS NOT NULL AND rn = 1 ORDER BY line LIMIT 50))
SELECT line, site, NULL::VARCHAR AS name, NULL::VARCHAR AS phone, CASE WHEN raw IS NULL THEN 'no website in this row' WHEN site IS NULL THEN '"' || left(raw, 40) || '" is not a website we can open' WHEN rn > 1 THEN 'the same website as an earlier line' WHEN line > last THEN 'beyond the limit' END AS why FROM r, t""")
def upload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No line of the first five names a website's column, so the first line stands for headers and the column is told by its content."""
    return uploads.read_upload(upload_rows(spark, sf_dir), "line", 50)


@query("host_places")
def host_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that stand for each host, 60 km apart at least; a test holds the greedy choice against a plain loop."""
    return resolve.representatives(places_of(spark, sf_dir), 60_000.0)


@query("lease_outcomes")
def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a job's requests, whose sites the properties name; no twin, since a fold in order decides. A test holds the fold against its stream."""
    kind = F.col("event_type")
    said = F.when(kind == "signup", "add").when(kind == "view", "take").when(kind == "purchase", "done").when(kind == "error", "release").otherwise("add")
    site = F.concat(F.lit("s"), F.get_json_object("props", "$.k"))
    requests = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), said.alias("kind"), site.alias("site"), (F.col("event_id") % 3 + 1).alias("n")
    )
    return leases.outcomes(leases.table(requests, "2024-02-15", seconds=86_400))

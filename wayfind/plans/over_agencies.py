"""Queries over sites as agencies: the trades they serve and the one to write about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import niches, outreach
from wayfind.plans.over_pages import READS_SQL, _reads, _table
from wayfind.plans.registry import query

#: Words of the invented pages, and what an agency would say in their place.
SAID = (
    (" with ", " marketing for dental practices "), (" was ", " law firms and attorneys "), (" that ", " clients "), (" by ", " attorneys’ fees "), (" are ", " HVAC "), (" this ", " roofing "), (" an ", " plumbers "),
    (" from ", " restaurants "), (" at ", " search ads "), (" as ", " hair salons "), (" be ", " realtors "), (" und ", " landscapers "), (" des ", " web&#115;ites "), (" les ", " veterinarians&#x2019; "),
)


def _agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    def said(c):
        for a, b in SAID:
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    part = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return _reads(spark, sf_dir).select(F.coalesce(text.host_of(F.col("url")), F.lit("")).alias("id"), F.col("page_id").alias("ordinal"), said(F.concat_ws(" ", part("title"), part("h1"))).alias("headline"), said(F.col("text")).alias("text"))


def _said_sql(c: str) -> str:
    for a, b in SAID:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _read_sql(c: str) -> str:
    """Only the references that the words above hold."""
    return f"replace(replace(replace({c}, '&#115;', 's'), '&#x2019;', '’'), '&amp;', '&')"


#: Fees of attorneys are no attorneys: the look ahead is a mark of equal length here.
_LEGAL_SQL = r"regexp_replace({}, '(?i)\battorne(ys?[’'']? fees)', 'attorn_\1', 'g')"
_TRADES_SQL = ", ".join(f"({n}, '{k}', '{p.replace('(?![’' + chr(39) + ']? fees)', '')}', {str(only).lower()})" for n, (k, p, only) in enumerate(niches.TRADES))
SERVED_SQL = rf"""{READS_SQL}, a AS (SELECT coalesce(CASE WHEN contains(h, '.') THEN h END, '') AS id, page_id, {_read_sql(_said_sql("concat_ws(' ', t1, t2)"))} AS headline, {_read_sql(_said_sql('text'))} AS text FROM (SELECT *, regexp_extract(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '^([^/?#]*)', 1) AS h,
  regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t1, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS t2 FROM reads)),
p AS (SELECT id, page_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\s*[\n•|]+\s*') AS parts FROM a),
s AS (SELECT id, page_id, n, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM (SELECT id, page_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS n FROM p)),
t(ordinal, niche, pattern, only_led) AS (VALUES {_TRADES_SQL}),
m AS (SELECT id, page_id, n, niche, ordinal, only_led, s, length(regexp_extract({_LEGAL_SQL.format('s')}, '(?is)^(.*?)\b(?:' || pattern || ')\b', 1)) AS pos, list_filter(regexp_split_to_array(s, '\s+'), lambda x: regexp_matches(x, '[A-Za-z]')) AS words FROM s, t
  WHERE length(s) >= 12 AND regexp_matches(s, '(?i)\b({niches.CUE})\b') AND regexp_matches({_LEGAL_SQL.format('s')}, '(?i)\b(?:' || pattern || ')\b')),
q AS (SELECT *, row_number() OVER (PARTITION BY id, niche ORDER BY length(s) < 25, length(s), page_id, n) AS rn FROM m WHERE len(words) >= 5 AND len(list_filter(words, lambda x: regexp_matches(x, '^[a-z]'))) / len(words)::DOUBLE >= 0.4),
h AS (SELECT DISTINCT id, niche FROM a, t WHERE regexp_matches({_LEGAL_SQL.format('headline')}, '(?i)\b(?:' || pattern || ')\b')),
c AS (SELECT id, niche, ordinal, only_led, count(DISTINCT lower(s)) AS mentions FROM m GROUP BY ALL),
cut AS (SELECT *, greatest(pos - 80, 0) AS b, least(pos + 80, length(s)) AS e FROM q WHERE rn = 1),
served AS (SELECT c.id, c.niche, c.ordinal, mentions, h.id IS NOT NULL AS leads, h.id IS NOT NULL OR mentions >= 3 AS strong, CASE WHEN length(s) <= 180 THEN s ELSE
  CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(CASE WHEN b > 0 THEN regexp_replace(substr(s, b + 1, e - b), '^\S*\s', '') ELSE substr(s, b + 1, e - b) END, CASE WHEN e < length(s) THEN '\s\S*$' ELSE '$' END, '') || CASE WHEN e < length(s) THEN '…' ELSE '' END END AS quote
  FROM c JOIN cut USING (id, niche) LEFT JOIN h ON h.id = c.id AND h.niche = c.niche WHERE h.id IS NOT NULL OR NOT c.only_led)"""


@query("trades_served", f"WITH {SERVED_SQL} SELECT id, niche, mentions, leads, strong, quote FROM served")
def trades_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades each site says it serves over all its pages, with the sentence that proves each."""
    return niches.served(_agencies(spark, sf_dir), outreach.reads_like_prose).drop("ordinal")


@query("primary_trade", f"WITH {SERVED_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY id) AS trades, row_number() OVER (PARTITION BY id ORDER BY strong DESC, leads DESC, mentions DESC, ordinal) AS rn FROM served) SELECT id, niche, quote FROM r WHERE rn = 1 AND strong AND (trades <= 5 OR leads)")
def primary_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade to write about; generalists have none."""
    return niches.primary(niches.served(_agencies(spark, sf_dir), outreach.reads_like_prose))


_IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


@query("public_urls", rf"""WITH a AS (SELECT url AS raw FROM pages UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM pages UNION ALL SELECT regexp_replace(url, '^https?', 'ftp') FROM pages UNION ALL SELECT regexp_replace(url, '\.(com|net|org|info)([/?#]|$)', '.INTERNAL:8080\2') FROM pages
  UNION ALL SELECT unnest(regexp_extract_all(text, '{_IP}')) FROM documents UNION ALL SELECT 'http://' || unnest(regexp_extract_all(text, '{_IP}')) || ':80/admin' FROM documents UNION ALL SELECT 'http://user@' || unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', 1)) FROM documents),
h AS (SELECT raw, CASE WHEN contains(raw, '://') THEN lower(split_part(raw, '://', 1)) ELSE '' END AS scheme, lower(regexp_extract(raw, '^(?:[a-z]+://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM a),
o AS (SELECT raw, host, scheme, scheme IN ('', 'http', 'https') AND NOT regexp_matches(host, '(^|\.)localhost$|\.(local|internal)$') AND NOT regexp_matches(host, '(^|\.)[0-9]+$') AS open FROM h)
SELECT host, scheme, count(*) AS n, count(*) FILTER (open) AS opened, count(*) FILTER (open AND scheme <> 'http' AND contains(host, '.')) AS secure FROM o GROUP BY host, scheme""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a stranger may make us open: urls of pages, written in several ways, and the addresses and mail hosts that documents print."""
    url, docs = F.col("url"), _table(spark, sf_dir, "documents")
    ways = F.array(url, F.regexp_replace(url, "^https?://", ""), F.regexp_replace(url, "^https?", "ftp"), F.regexp_replace(url, r"\.(com|net|org|info)([/?#]|$)", ".INTERNAL:8080$2"))
    found = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    ips = found(_IP, 0)
    named = F.concat(ips, F.transform(ips, lambda x: F.concat(F.lit("http://"), x, F.lit(":80/admin"))), F.transform(found(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1), lambda x: F.concat(F.lit("http://user@"), x)))
    asked = _table(spark, sf_dir, "pages").select(F.explode(ways).alias("raw")).unionAll(docs.select(F.explode(named)))
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract("raw", r"^(?:[a-z]+://)?([^/?#]*)", 1), "^[^@]*@", ""), ":[0-9]+$", ""))
    return asked.groupBy(host.alias("host"), F.lower(F.regexp_extract("raw", "^([a-z]+)://", 1)).alias("scheme")).agg(
        F.count("*").alias("n"), F.count(outreach.public_url(F.col("raw"))).alias("opened"), F.count(outreach.public_url(F.col("raw"), secure=True)).alias("secure")
    )

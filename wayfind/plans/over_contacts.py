"""Queries over what pages print of people, phones and addresses, and over the signals of whole sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import contacts, detect, evidence
from wayfind.plans.over_pages import _marks_sql, _table
from wayfind.plans.registry import query

HOST = r"regexp_extract(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '^([^/?#]*)', 1)"


def business_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, page_no, text: documents as pages of their sources, where some sentences have their first two words as a name beside a role or credential, by the sentence's own checksum."""

    def told(s):
        words = F.split(s, " ")
        name = F.initcap(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))))
        kind = F.pmod(F.crc32(F.encode(s, "UTF-8")), F.lit(30))
        rest = F.array_join(F.slice(words, F.lit(3), F.size(words)), " ")
        return (
            F.when(kind == 0, F.concat(name, F.lit(", Owner "), rest)).when(kind == 1, F.concat(name, F.lit(" is the founder "), rest))
            .when(kind == 2, F.concat(F.lit("Dr. "), name, F.lit(", MD "), rest)).when(kind == 3, F.concat(F.lit("office manager: "), name, F.lit("; "), rest)).otherwise(s)
        )

    pages = _table(spark, sf_dir, "documents")
    return pages.select(F.col("source").alias("site"), F.col("doc_id").alias("page_no"), F.array_join(F.transform(F.split("text", r"[.!?] "), told), ". ").alias("text"))


@query("people_on_pages")
def people_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No twin: the rules look around a match, which DuckDB's expressions can't; a test holds the rows against plain Python."""
    return contacts.people(business_pages(spark, sf_dir))


def phone_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their sources, with a cue for some short words."""
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page_no"), F.regexp_replace("text", " (the|la|der|le) ", " call ").alias("text"))


@query("said_phones", rf"""WITH p AS (SELECT source AS site, doc_id AS page_no, regexp_replace(text, ' (the|la|der|le) ', ' call ', 'g') AS text FROM documents),
m AS (SELECT *, regexp_extract_all(text, '{contacts.PHONE}') AS m, regexp_split_to_array(text, '{contacts.PHONE}') AS seg FROM p),
k AS (SELECT site, right(regexp_replace(arg_min(m[-1], page_no), '[^0-9]', '', 'g'), 10) AS listed FROM m WHERE len(m) > 0 GROUP BY site),
e AS (SELECT site, page_no, text, right(regexp_replace(m[i], '[^0-9]', '', 'g'), 10) AS n, 1 + list_sum([length(x) FOR x IN seg[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS pos FROM m, unnest(range(1, len(m) + 1)) u(i)),
j AS (SELECT e.*, listed, substr(text, greatest(1, pos - 60)::BIGINT, (pos - greatest(1, pos - 60))::BIGINT) AS before FROM e JOIN k USING (site)),
h AS (SELECT *, CASE WHEN n = listed THEN '{contacts.LISTED}' WHEN regexp_matches(before, '{contacts.CUE}') AND left(n, 3) = left(listed, 3) THEN '{contacts.CUED}' END AS how FROM j WHERE left(n, 3) NOT IN ('000', '111', '555', '123') AND left(n, 1) NOT IN ('0', '1'))
SELECT site, '(' || left(n, 3) || ') ' || n[4:6] || '-' || n[7:] AS value, arg_min(how, page_no) AS how, min(page_no) AS page_no FROM h WHERE how IS NOT NULL GROUP BY site, n""")
def said_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is listed with the last number of its first document that has one."""
    pages = phone_pages(spark, sf_dir)
    last = F.element_at(F.regexp_extract_all("text", F.lit(contacts.PHONE), F.lit(0)), -1)
    listings = pages.filter(F.col("text").rlike(contacts.PHONE)).groupBy("site").agg(F.min_by(last, "page_no").alias("phone"))
    return contacts.phones(pages, listings)


@query("site_contacts")
def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's contacts from its documents, with the pages' links; held against plain Python by a test, as people_on_pages."""
    pages = business_pages(spark, sf_dir)
    web = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_no"), "url", text.links(F.col("html")).alias("links"))
    joined = pages.join(web, "page_no", "left").select("site", "page_no", "url", "text", "links")
    listings = pages.filter(F.col("text").rlike(contacts.PHONE)).groupBy("site").agg(F.min_by(F.regexp_extract("text", contacts.PHONE, 0), "page_no").alias("phone"))
    return contacts.assembled(joined, listings)


SITES_SQL = rf"""p AS (SELECT page_id, {HOST} AS site FROM pages), s AS ({_marks_sql()}), m AS (SELECT site, family, name, vendor, count(*) AS n FROM s JOIN p USING (page_id) GROUP BY ALL)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return detect.site_signals(pages.select("page_id", F.coalesce(text.host_of(F.col("url")), F.lit("")).alias("site")), detect.signals(pages))


@query("site_signals", rf"""WITH {SITES_SQL}, v AS (SELECT site, family, string_agg(name, ',' ORDER BY name) AS names FROM m WHERE vendor GROUP BY ALL),
a AS (SELECT site, string_agg(family || '=' || names, ';' ORDER BY family) AS vendors FROM v GROUP BY site), g AS (SELECT site, string_agg(DISTINCT family, ',' ORDER BY family) AS generic FROM m WHERE NOT vendor GROUP BY site),
w AS (SELECT site, string_agg(family || '=' || n, ';' ORDER BY family) AS most FROM (SELECT site, family, max(n) AS n FROM m GROUP BY ALL) GROUP BY site)
SELECT site, pages, coalesce(vendors, '') AS vendors, coalesce(generic, '') AS generic, coalesce(most, '') AS most FROM (SELECT site, count(*) AS pages FROM p GROUP BY site) LEFT JOIN a USING (site) LEFT JOIN g USING (site) LEFT JOIN w USING (site)""")
def site_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c, value: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ";")
    return _sites(spark, sf_dir).select(
        "site", "pages", listed("vendors", lambda v: F.array_join(v, ",")).alias("vendors"), F.array_join("generic", ",").alias("generic"),
        listed("pages_by_family", lambda n: n.cast("string")).alias("most"),
    )


SITE_FAMILIES = (("ads", r"(?i)\badvert"), ("pixel", r"(?i)\btrack"), ("booking", r"(?i)\bbook"))
SITE_CRITERIA = (("no_ads", "absence", "carries no adverts"), ("no_tracking", "absence", "does not track its readers"), ("booking", "presence", "can be booked"), ("no_booking", "absence", "cannot be booked"))


@query("site_verdicts", rf"""WITH {SITES_SQL}, c(criterion_id, family) AS (VALUES ('no_ads', 'ads'), ('no_tracking', 'pixel'), ('no_booking', 'booking'))
SELECT site AS id, criterion_id, 'no_match' AS verdict, min(name) FILTER (vendor) AS source FROM m JOIN c USING (family) GROUP BY site, criterion_id""")
def site_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector verdicts of whole sites, from all their pages' marks."""
    criteria = spark.createDataFrame(SITE_CRITERIA, "criterion_id string, type string, text string")
    return evidence.detector(criteria, detect.as_signals(_sites(spark, sf_dir)), settle_on_generic=True, families=SITE_FAMILIES)

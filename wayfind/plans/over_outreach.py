"""Queries over documents, pages and places that find contacts, prospects and what may be sent to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import contacts, outreach, resolve
from wayfind.plans.over_pages import READS_SQL, _reads, _table
from wayfind.plans.over_places import HOST_SQL
from wayfind.plans.registry import query
from wayfind.sources.places import PLACES_SQL, places_of

EMAILS_SQL = f"e AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{text.EMAIL}'), lambda x: lower(x)) AS found FROM documents)"


GIVEN_SQL = ", ".join(f"'{n}'" for n in contacts.GIVEN_NAMES)


@query("kept_emails", rf"""WITH {EMAILS_SQL}, k AS (SELECT DISTINCT doc_id, x AS email, regexp_replace(split_part(x, '@', 1), '[0-9]+$', '') AS local FROM e, unnest(found) u(x) WHERE NOT regexp_matches(x, '{outreach.NOISE}'))
SELECT doc_id, email, CASE WHEN regexp_matches(local, '{outreach.ROLE_MAILBOX}') THEN 'role' WHEN regexp_matches(local, '^[a-z]{{2,}}[._][a-z]{{2,}}$') OR (regexp_split_to_array(local, '[._-]')[1] IN ({GIVEN_SQL}) AND len(regexp_split_to_array(local, '[._-]')) <= 2) THEN 'person' ELSE 'other' END AS tier FROM k""")
def kept_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(outreach.kept_emails(text.emails(F.col("text")))).alias("email"))
    return found.select("doc_id", "email", contacts.email_tier(F.col("email"), F.array().cast("array<string>")).alias("tier"))


@query("chosen_emails", rf"""WITH {EMAILS_SQL}, p AS (SELECT doc_id, list_concat(found, ['info@site' || doc_id || '.org', 'jobs@site' || doc_id || '.org'], CASE WHEN doc_id % 3 = 0 THEN ['ann.lee@mail.site' || doc_id || '.org'] ELSE [] END) AS all_, 'site' || doc_id || '.org' AS domain FROM e WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, found, 'site' || doc_id || '.org' FROM e WHERE doc_id % 4 = 0),
o AS (SELECT doc_id, list_filter(list_transform(all_, lambda x: lower(trim(x))), lambda x: (ends_with(x, '@' || domain) OR ends_with(x, '.' || domain)) AND NOT regexp_matches(x, '{outreach.NEVER}')) AS own FROM p)
SELECT doc_id, coalesce(list_filter(own, lambda x: NOT regexp_matches(x, '{outreach.ROLE}'))[1], own[1]) AS email FROM o""")
def chosen_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that documents hold, with some of each document's own domain besides."""
    i = F.col("doc_id").cast("string")
    domain = F.concat(F.lit("site"), i, F.lit(".org"))
    desks = F.array(F.concat(F.lit("info@"), domain), F.concat(F.lit("jobs@"), domain))
    person = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("ann.lee@mail."), domain))).otherwise(F.array().cast("array<string>"))
    found = text.emails(F.col("text"))
    listed = F.when(F.col("doc_id") % 4 != 0, F.concat(found, desks, person)).otherwise(found)
    return _table(spark, sf_dir, "documents").select("doc_id", outreach.chosen_email(listed, domain).alias("email"))


@query("page_owners", rf"""WITH {PLACES_SQL}, k AS (SELECT id, CASE ordinal % 3 WHEN 0 THEN 'Bright Dental Care' WHEN 1 THEN 'The Family Clinic' ELSE name END AS name, '1 Main Street, ' || town || ', CO' AS addr, {HOST_SQL} AS host, CASE ordinal % 5 WHEN 0 THEN 'welcome to BRIGHT' WHEN 1 THEN 'we serve ' || town ELSE 'hello' END AS page FROM places),
w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(name), '[a-z]{{4,}}')), lambda x: NOT list_contains([{', '.join(f"'{x}'" for x in outreach.COMMON_WORDS)}], x)) AS words, lower(split_part(addr, ', ', 2)) AS town FROM k)
SELECT id, CASE WHEN len(list_filter(words, lambda x: contains(lower(page), x) OR contains(replace(coalesce(host, ''), '-', ''), x))) > 0 THEN 'named' WHEN contains(replace(lower(page), ' ', ''), replace(town, ' ', '')) OR contains(replace(coalesce(host, ''), '-', ''), replace(town, ' ', '')) THEN 'town-only' END AS attribution FROM w""")
def page_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages can be put down to the places that list them."""
    k, m = F.col("ordinal") % 3, F.col("ordinal") % 5
    name = F.when(k == 0, "Bright Dental Care").when(k == 1, "The Family Clinic").otherwise(F.col("name"))
    page = F.when(m == 0, "welcome to BRIGHT").when(m == 1, F.concat(F.lit("we serve "), "town")).otherwise("hello")
    addr = F.concat(F.lit("1 Main Street, "), "town", F.lit(", CO"))
    return places_of(spark, sf_dir).select("id", outreach.attribution(name, addr, text.host_of(F.col("site")), page).alias("attribution"))


@query("own_looks", rf"""WITH {PLACES_SQL}, k AS (SELECT id, CASE WHEN ordinal % 2 = 0 THEN 'Site' || (ordinal * 7 % 400) || ' & Sons' ELSE name END AS name, {HOST_SQL} AS host, ordinal FROM places), n AS (SELECT *, count(*) OVER (PARTITION BY host) AS shared FROM k WHERE host IS NOT NULL)
SELECT id, len(list_filter(regexp_extract_all(lower(name), '[a-z0-9]{{4,}}'), lambda x: contains(replace(split_part(host, '.', 1), '-', ''), x))) > 0 AND shared = 1 AS own FROM n""")
def own_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that look like a business's own: a word of its name in the host, and nobody else on it."""
    i = F.col("ordinal")
    name = F.when(i % 2 == 0, F.concat(F.lit("Site"), (i * 7 % 400).cast("string"), F.lit(" & Sons"))).otherwise(F.col("name"))
    hosted = places_of(spark, sf_dir).select("id", name.alias("name"), text.host_of(F.col("site")).alias("host")).filter("host is not null")
    shared = hosted.groupBy("host").agg(F.count("*").alias("shared"))
    return hosted.join(shared, "host").select("id", (outreach.looks_own(F.col("name"), F.col("host")) & (F.col("shared") == 1)).alias("own"))


@query("prose_sentences", r"""WITH s AS (SELECT lang, trim(unnest(regexp_split_to_array(text, '[.!?\n|]|•'))) AS s FROM documents), w AS (SELECT lang, s, list_filter(regexp_split_to_array(s, '\s+'), lambda x: regexp_matches(x, '[A-Za-z]')) AS words FROM s WHERE length(s) >= 12)
SELECT lang, len(words) >= 5 AND len(list_filter(words, lambda x: regexp_matches(x, '^[a-z]'))) / nullif(len(words), 0)::DOUBLE >= 0.4 AS prose, count(*) AS n FROM w GROUP BY 1, 2""")
def prose_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _table(spark, sf_dir, "documents").select("lang", F.explode(text.sentences(F.col("text"))).alias("s"))
    return split.select("lang", outreach.reads_like_prose(F.col("s")).alias("prose")).groupBy("lang", "prose").agg(F.count("*").alias("n"))


NICHES = [("and", r"\band\b"), ("the", r"\bthe\b"), ("free", r"\bfree\b"), ("site", r"\bsite\b")]
CUE = r"\b(of|online|click|on)\b"


@query("niche_mentions", rf"""WITH s AS (SELECT DISTINCT doc_id AS id, left(text, 60) AS headline, lower(trim(unnest(regexp_split_to_array(text, '[.!?\n|]|•')))) AS s FROM documents), n(niche, pattern) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in NICHES)}),
m AS (SELECT id, niche, count(*) AS mentions, bool_or(regexp_matches(lower(headline), pattern)) AS leads FROM s, n WHERE length(s) >= 12 AND regexp_matches(s, '{CUE}') AND regexp_matches(s, pattern) GROUP BY id, niche) SELECT *, leads OR mentions >= 3 AS strong FROM m""")
def niche_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("headline"), text.sentences(F.col("text"), blanks=text.BLANKS).alias("sentences"))
    return outreach.mentions(pages, NICHES, CUE)


@query("scrubbed_props", """WITH p AS (SELECT event_id, event_type, props->>'$.k' AS k FROM events) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN k IS NULL THEN -1 ELSE 0 END AS kept, CASE event_id % 4 WHEN 0 THEN 'Phone,email' WHEN 1 THEN 'email' ELSE '' END AS dropped FROM p""")
def scrubbed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, some with what must not be kept."""
    i = F.col("event_id")
    extra = F.when(i % 3 == 0, F.create_map(F.lit("plan"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    named = F.when(i % 4 == 0, F.create_map(F.lit("email"), F.lit("a@b.c"), F.lit("Phone"), F.lit("1"))).when(i % 4 == 1, F.create_map(F.lit("email"), F.lit("a@b.c"))).otherwise(F.create_map().cast("map<string,string>"))
    props = F.map_concat(F.from_json("props", "map<string,string>"), extra, named)
    kept, dropped = outreach.scrubbed(F.col("all"))
    return _table(spark, sf_dir, "events").select(i, props.alias("all")).select("event_id", F.size(kept).alias("kept"), dropped.alias("dropped"))


@query("suppression_split", rf"""WITH v AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'u' || user_id || '@Example.com' ELSE 'Site' || user_id || '.com' END AS value FROM events), s AS (SELECT lower(value) AS value, contains(value, '@') AS mail FROM v),
a AS (SELECT c_custkey AS id, 'u' || c_custkey || '@example.com' AS email, 'site' || (c_custkey * 3) || '.com' AS domain FROM customer)
SELECT id, email IN (SELECT value FROM s WHERE mail) AS by_email, domain IN (SELECT value FROM s WHERE NOT mail) AS by_domain FROM a""")
def suppression_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of what must not be written to, told apart into addresses and domains."""
    u = F.col("user_id").cast("string")
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), u, F.lit("@Example.com"))).otherwise(F.concat(F.lit("Site"), u, F.lit(".com")))
    listed = _table(spark, sf_dir, "events").select(F.lower(value).alias("value")).distinct()
    mail = listed.filter(F.contains("value", F.lit("@"))).select(F.col("value").alias("email"), F.lit(True).alias("_m"))
    domain = listed.filter(~F.contains("value", F.lit("@"))).select(F.col("value").alias("domain"), F.lit(True).alias("_d"))
    k = F.col("c_custkey")
    people = _table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"), F.concat(F.lit("site"), (k * 3).cast("string"), F.lit(".com")).alias("domain"))
    return people.join(mail, "email", "left").join(domain, "domain", "left").select("id", F.coalesce("_m", F.lit(False)).alias("by_email"), F.coalesce("_d", F.lit(False)).alias("by_domain"))


ERRORS_SQL = "CASE page_id % 12 WHEN 0 THEN 'robots_blocked' WHEN 1 THEN 'proxy_error: x' WHEN 2 THEN 'timeout' WHEN 3 THEN 'http_403' WHEN 4 THEN 'http_500' WHEN 5 THEN 'connect_error: y' WHEN 6 THEN 'odd' WHEN 7 THEN 'http_x' ELSE '' END"
HOSTS_SQL = "CASE WHEN page_id % 17 = 0 THEN 'www.facebook.com' WHEN page_id % 17 = 1 THEN 'shop.x.com' ELSE regexp_extract(lower(url), '://([^/?#]*)', 1) END"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    error = F.lit("")
    for k, e in enumerate(("robots_blocked", "proxy_error: x", "timeout", "http_403", "http_500", "connect_error: y", "odd", "http_x")):
        error = F.when(i % 12 == k, e).otherwise(error)
    host = F.when(i % 17 == 0, "www.facebook.com").when(i % 17 == 1, "shop.x.com").otherwise(F.regexp_extract(F.lower("url"), "://([^/?#]*)", 1))
    return _reads(spark, sf_dir).withColumns({"host": host, "error": error}).select("page_id", "host", outreach.site_outcome(F.col("host"), F.col("error"), F.length("text"), F.col("scripts")).alias("outcome"))


OUT_SQL = f"""{READS_SQL}, o AS (SELECT page_id, {HOSTS_SQL} AS host, {ERRORS_SQL} AS error, length(text) AS chars, scripts FROM reads), c AS (SELECT page_id, host, CASE WHEN host IN ('www.facebook.com', 'shop.x.com') THEN 'social_only' WHEN error = 'robots_blocked' THEN error WHEN starts_with(error, 'proxy_error') THEN 'probe_error' WHEN error = 'timeout' THEN error WHEN error = 'http_403' THEN 'blocked' WHEN starts_with(error, 'http_') THEN 'http_error' WHEN error <> '' THEN 'dead' WHEN chars < 250 AND scripts >= 3 THEN 'js_shell' WHEN chars < 400 THEN 'thin' ELSE 'ok' END AS outcome FROM o)"""


@query("site_outcomes", f"WITH {OUT_SQL} SELECT page_id, outcome FROM c")
def site_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("page_id", "outcome")


@query("blocked_hosts", f"WITH {OUT_SQL} SELECT host, min(page_id) AS page_id FROM c WHERE outcome IN ('blocked', 'robots_blocked') GROUP BY host")
def blocked_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that refused to be read, each with the first page that met it."""
    return _outcomes(spark, sf_dir).filter("outcome in ('blocked', 'robots_blocked')").groupBy("host").agg(F.min("page_id").alias("page_id"))


@query("recovery_table", f"WITH {OUT_SQL}, s AS (SELECT CASE page_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'browser' ELSE 'slow' END AS strategy, outcome FROM c) SELECT strategy, outcome, count(*) AS n, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END)::BIGINT AS recovered FROM s GROUP BY strategy, outcome")
def recovery_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.when(F.col("page_id") % 3 == 0, "plain").when(F.col("page_id") % 3 == 1, "browser").otherwise("slow")
    return _outcomes(spark, sf_dir).groupBy(strategy.alias("strategy"), "outcome").agg(F.count("*").alias("n"), F.sum((F.col("outcome") == "ok").cast("long")).alias("recovered"))


@query("probe_summary", f"WITH {OUT_SQL}, s AS (SELECT page_id % 4 AS market, outcome, chars, scripts FROM c JOIN o USING (page_id)) SELECT market, count(*) FILTER (outcome NOT IN ('timeout', 'probe_error')) AS scored, count(*) FILTER (outcome IN ('timeout', 'probe_error')) AS ours, round(100.0 * count(*) FILTER (outcome = 'ok') / nullif(count(*) FILTER (outcome NOT IN ('timeout', 'probe_error')), 0), 1)::DOUBLE AS ok_pct, round(avg(chars) FILTER (outcome = 'ok'), 3) AS mean_chars FROM s GROUP BY market")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by market: our own failures are left out of what others are measured by."""
    chars = _reads(spark, sf_dir).select("page_id", F.length("text").alias("chars"))
    joined = _outcomes(spark, sf_dir).join(chars, "page_id")
    ours, ok = F.col("outcome").isin("timeout", "probe_error"), F.col("outcome") == "ok"
    return joined.groupBy((F.col("page_id") % 4).alias("market")).agg(F.count_if(~ours).alias("scored"), F.count_if(ours).alias("ours"), F.round(F.try_divide(100.0 * F.count_if(ok), F.count_if(~ours)), 1).alias("ok_pct"), F.round(F.avg(F.when(ok, F.col("chars"))), 3).alias("mean_chars"))


@query("link_contacts", """WITH l AS (SELECT c_custkey AS id, ['mailto:Info' || c_custkey || '@Site.org?subject=x', CASE WHEN c_custkey % 2 = 0 THEN 'https://www.facebook.com/p' ELSE 'https://a.yelp.com/b' END, CASE WHEN c_custkey % 3 = 0 THEN 'mailto:not an address' ELSE 'tel:303' END] AS links FROM customer)
SELECT id, 'info' || id || '@site.org' AS emails, CASE WHEN id % 2 = 0 THEN 'facebook.com' ELSE 'yelp.com' END AS socials FROM l""")
def link_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    links = F.array(F.concat(F.lit("mailto:Info"), k.cast("string"), F.lit("@Site.org?subject=x")), F.when(k % 2 == 0, "https://www.facebook.com/p").otherwise("https://a.yelp.com/b"), F.when(k % 3 == 0, "mailto:not an address").otherwise("tel:303"))
    emails, socials = outreach.link_contacts(F.col("links"))
    return _table(spark, sf_dir, "customer").select(k.alias("id"), links.alias("links")).select("id", F.array_join(emails, ",").alias("emails"), F.array_join(socials, ",").alias("socials"))


@query("link_recovery", """WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) > 0 AS printed, doc_id % 4 = 0 AS linked FROM documents) SELECT count(*) AS sites, count(*) FILTER (printed) AS printed, count(*) FILTER (linked) AS linked, count(*) FILTER (linked AND NOT printed) AS recovered, round(100.0 * count(*) FILTER (linked AND NOT printed) / nullif(count(*) FILTER (printed), 0), 1)::DOUBLE AS lift FROM t""")
def link_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links add to the addresses that texts print."""
    t = _table(spark, sf_dir, "documents").select((F.size(text.emails(F.col("text"))) > 0).alias("printed"), (F.col("doc_id") % 4 == 0).alias("linked"))
    more = F.count_if(F.col("linked") & ~F.col("printed"))
    return t.agg(F.count("*").alias("sites"), F.count_if("printed").alias("printed"), F.count_if("linked").alias("linked"), more.alias("recovered"), F.round(F.try_divide(100.0 * more, F.count_if("printed")), 1).alias("lift"))


@query("mail_domains", """SELECT s_suppkey AS id, array_to_string(list_filter([CASE s_suppkey % 4 WHEN 0 THEN 'no spf' WHEN 1 THEN 'several spf' WHEN 2 THEN 'spf allows none' END, CASE s_suppkey % 3 WHEN 0 THEN 'no dmarc' WHEN 1 THEN 'several dmarc' END, CASE WHEN s_suppkey % 5 = 1 THEN 'no dkim' END], lambda x: x IS NOT NULL), ',') AS problems FROM supplier""")
def mail_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of mail domains of every kind of fault."""
    k = F.col("s_suppkey")
    good, none = F.lit("V=SPF1 include:x ~all"), F.array().cast("array<string>")
    root = F.when(k % 4 == 0, F.array(F.lit("other"))).when(k % 4 == 1, F.array(good, good)).when(k % 4 == 2, F.array(F.lit("v=spf1 -xll"))).otherwise(F.array(good, F.lit("v=spf10")))
    policy = F.lit("v=DMARC1; p=none")
    dmarc = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(policy, policy)).otherwise(F.array(policy))
    dkim = F.when(k % 5 == 1, F.array(F.lit("x=1"))).when(k % 5 != 0, F.array(F.lit("k=rsa; p=abc")))
    return _table(spark, sf_dir, "supplier").select(k.alias("id"), F.array_join(outreach.mail_problems(root, dmarc, dkim), ",").alias("problems"))


@query("normalised_urls", r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN ' ' || url || '?a=b#c ' WHEN 2 THEN 'localhost/x' WHEN 3 THEN '' ELSE url END AS raw FROM pages), f AS (SELECT page_id, CASE WHEN regexp_matches(trim(raw), '^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END AS full_, trim(raw) AS raw FROM u),
p AS (SELECT *, regexp_extract(full_, '^https?://([^/?#]*)', 1) AS host, regexp_extract(full_, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM f) SELECT page_id, CASE WHEN raw <> '' AND contains(host, '.') THEN regexp_extract(full_, '^(https?://)', 1) || host || CASE WHEN path = '' THEN '/' ELSE path END END AS url FROM p""")
def normalised_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.regexp_replace("url", "^https?://", "")).when(k == 1, F.concat(F.lit(" "), "url", F.lit("?a=b#c "))).when(k == 2, "localhost/x").when(k == 3, "").otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", outreach.normalised_url(raw).alias("url"))


@query("cached_reads", "WITH c AS (SELECT regexp_replace(url, '^https?://', '') AS k, min(page_id) AS read_id FROM pages WHERE page_id % 3 <> 0 GROUP BY 1) SELECT p.page_id AS id, c.read_id FROM pages p JOIN c ON c.k = regexp_replace(p.url, '^https?://', '')")
def cached_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that the cache holds under either scheme."""
    pages = _table(spark, sf_dir, "pages")
    asked = pages.select(F.col("page_id").alias("id"), F.regexp_replace("url", "^https:", "http:").alias("url"))
    return outreach.matched_cache(asked, pages.filter("page_id % 3 <> 0").select("url", F.col("page_id").alias("read_id"))).filter("read_id is not null")


OFFERS = [("metal", 1, "steel|tin|copper", "absence"), ("metal_shown", 2, "steel|brass", "presence"), ("plated", 3, "plated", "absence"), ("any", 4, ".", "presence")]


@query("offer_criteria", f"""WITH c AS (SELECT DISTINCT p_type AS text, CASE WHEN length(p_type) % 2 = 0 THEN 'absence' ELSE 'presence' END AS type FROM part), o(proposal, ordinal, pattern, type) AS (VALUES {', '.join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in OFFERS)})
SELECT text AS criterion_id, arg_min(proposal, ordinal) AS proposal FROM c JOIN o ON o.type = c.type AND regexp_matches(lower(c.text), o.pattern) GROUP BY text""")
def offer_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = _table(spark, sf_dir, "part").select(F.col("p_type").alias("criterion_id"), F.col("p_type").alias("text"), F.when(F.length("p_type") % 2 == 0, "absence").otherwise("presence").alias("type")).distinct()
    return outreach.first_offers(criteria, spark.createDataFrame(OFFERS, "proposal string, ordinal int, pattern string, type string"))


@query("merged_prospects", f"""WITH {PLACES_SQL}, r AS (SELECT {HOST_SQL} AS domain, name, phone, ordinal FROM places), u AS (SELECT domain, name, phone, ordinal AS seen FROM r WHERE ordinal % 2 = 0 UNION ALL SELECT domain, NULL, phone, ordinal + 1000000 FROM r WHERE ordinal % 2 = 1)
SELECT domain, max(seen) AS seen, arg_max(name, seen) FILTER (name IS NOT NULL) AS name, arg_max(phone, seen) FILTER (phone IS NOT NULL) AS phone FROM u WHERE domain IS NOT NULL GROUP BY domain""")
def merged_prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known prospects and new rows with other columns, merged by domain: the latest value that is there."""
    rows = places_of(spark, sf_dir).select(text.host_of(F.col("site")).alias("domain"), "name", "phone", "ordinal").filter("domain is not null")
    known = rows.filter("ordinal % 2 = 0").select("domain", "name", "phone", F.col("ordinal").alias("seen"))
    new = rows.filter("ordinal % 2 = 1").select("domain", "phone", (F.col("ordinal") + 1_000_000).alias("seen"))
    return resolve.merged(known, new, ["domain"], "seen")

"""Queries that measure: scores under a sampling design, sites read again, families of categories, jobs as markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import accounts, change, detect, judge, measure, supply
from wayfind.plans.over_outreach import OUT_SQL, _outcomes
from wayfind.plans.over_pages import READS_SQL, _marks_sql, _reads, _table
from wayfind.plans.registry import query

_JUNK = "[#$%&*!]{2}"


def _wilson_sql(name: str, whole: str, target: float, shown: str = "true") -> str:
    p, z2 = f"(tp / {whole}::DOUBLE)", 3.8416
    mid, half = f"({p} + {z2} / (2 * {whole})) / (1 + {z2} / {whole})", f"1.96 * sqrt({p} * (1 - {p}) / {whole} + {z2} / (4 * {whole} * {whole})) / (1 + {z2} / {whole})"
    lo, hi = f"greatest(0, {mid} - {half})", f"least(1, {mid} + {half})"
    when = lambda x: f"CASE WHEN {shown} AND {whole} > 0 THEN {x} END"
    return f"{when(f'round({p}, 6)')} AS {name}, {when(f'round({lo}, 6)::DOUBLE')} AS {name}_low, {when(f'round({hi}, 6)::DOUBLE')} AS {name}_high, {when(f'''CASE WHEN {lo} >= {target} THEN 'passes' WHEN {hi} < {target} THEN 'fails' ELSE 'undecided' END''')} AS {name}_gate"


@query("design_scores", rf"""WITH d AS (SELECT lang AS set_, doc_id AS id, text, n_chars, quality, toxic, lang IN ('en', 'fr') AS enriched FROM documents JOIN labels USING (doc_id)),
v AS (SELECT set_, id, n_chars, CASE WHEN n_chars < 300 THEN 'couldnt_tell' WHEN regexp_matches(text, '{_JUNK}') THEN 'no_match' ELSE 'match' END AS good, CASE WHEN set_ = 'de' THEN 'unread' WHEN contains(text, '@') THEN 'needs_model' ELSE 'match' END AS clean FROM d WHERE n_chars >= 100),
l AS (SELECT set_, id, 'presence' AS kind, CASE WHEN n_chars > 5000 THEN 'wrong_site' WHEN quality = 1 THEN 'match' WHEN quality = 0 THEN 'no_match' ELSE 'couldnt_tell' END AS label, good AS said, v.id IS NOT NULL AS judged FROM d LEFT JOIN v USING (set_, id, n_chars)
  UNION ALL SELECT set_, id, 'absence', CASE toxic WHEN 0 THEN 'match' WHEN 1 THEN 'no_match' ELSE 'couldnt_tell' END, clean, v.id IS NOT NULL FROM d LEFT JOIN v USING (set_, id, n_chars)),
k AS (SELECT *, kind AS shown FROM l UNION ALL SELECT *, 'all' FROM l),
c AS (SELECT set_, shown AS kind, count(*) FILTER (judged) AS pairs, {', '.join(f"count(*) FILTER (judged AND said = '{s}' AND label = '{y}') AS {n}" for n, s, y in (('tp', 'match', 'match'), ('fp', 'match', 'no_match'), ('fn', 'no_match', 'match'), ('tn', 'no_match', 'no_match')))},
  count(*) FILTER (judged AND said = 'couldnt_tell' AND label IN ('match', 'no_match')) AS abstained, count(*) FILTER (judged AND said = 'couldnt_tell' AND label = 'match') AS abstained_on_match, count(DISTINCT id) FILTER (NOT judged AND shown = 'all') AS not_judged,
  count(*) FILTER (judged AND label = 'wrong_site') AS wrong_site, count(*) FILTER (judged AND label = 'couldnt_tell') AS unsettled_label, count(*) FILTER (judged AND label IN ('match', 'no_match') AND said IN ('unread', 'needs_model')) AS unsettled_verdict FROM k GROUP BY set_, shown),
kept AS (SELECT set_, count(*) FILTER (good = 'match' AND clean = 'match') / count(*)::DOUBLE AS kept FROM d LEFT JOIN v USING (set_, id, n_chars) WHERE enriched AND n_chars >= 60 AND NOT regexp_matches(substr(text, 1, 200), '{_JUNK}') GROUP BY set_)
SELECT set_ AS "set", kind, pairs, tp, fp, fn, tn, abstained, abstained_on_match, not_judged, wrong_site, unsettled_label, unsettled_verdict, set_ IN ('en', 'fr') AS enriched, round(kept, 6) AS kept, {_wilson_sql('precision', '(tp + fp)', measure.PRECISION)}, {_wilson_sql('recall', '(tp + fn + abstained_on_match)', measure.RECALL, "set_ NOT IN ('en', 'fr')")},
  CASE WHEN set_ NOT IN ('en', 'fr') AND tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) END AS recall_decided FROM c LEFT JOIN kept USING (set_) WHERE pairs > 0 OR not_judged > 0""")
def design_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules of thumb against the labels, by language; two languages count as drawn among an older rule's positives."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").withColumns({"set": F.col("lang"), "id": F.col("doc_id")})
    quality = F.when(F.col("n_chars") > 5000, "wrong_site").when(F.col("quality") == 1, "match").when(F.col("quality") == 0, "no_match").otherwise("couldnt_tell")
    toxic = F.when(F.col("toxic") == 0, "match").when(F.col("toxic") == 1, "no_match").otherwise("couldnt_tell")
    row = lambda name, kind, label: F.struct(F.lit(name).alias("criterion_id"), F.lit(kind).alias("kind"), label.alias("label"))
    labels = docs.select("set", "id", F.inline(F.array(row("good", "presence", quality), row("clean", "absence", toxic))))
    good = F.when(F.col("n_chars") < 300, "couldnt_tell").when(F.col("text").rlike(_JUNK), "no_match").otherwise("match")
    clean = F.when(F.col("set") == "de", F.lit(None)).when(F.contains("text", F.lit("@")), "needs_model").otherwise("match")
    verdict = lambda name, said: F.struct(F.lit(name).alias("criterion_id"), said.alias("said"))
    verdicts = docs.filter("n_chars >= 100").select("set", "id", F.inline(F.array(verdict("good", good), verdict("clean", clean))))
    enriched = docs.filter(F.col("lang").isin("en", "fr"))
    drawn = enriched.filter((F.col("n_chars") >= 60) & ~F.substring("text", 1, 200).rlike(_JUNK)).select("set", "id")
    designs = docs.select("set", F.when(F.col("lang").isin("en", "fr"), measure.ENRICHED).otherwise("complete_slice").alias("sampling")).distinct()
    return measure.scored(labels, verdicts, designs, drawn)


_HOST_SQL = r"regexp_extract(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '^([^/?#]*)', 1)"


def _site_sums_sql(of: str, name: str) -> str:
    total = lambda *c: f"sum(('0x' || substr(sha256(concat_ws(chr(31), {', '.join(c)})), 1, 15))::BIGINT)"
    return f"""{name} AS (SELECT site, {total('url', 'html')} AS raw, {total('url', 'text')} AS text, {total('url', 'plain')} AS normalised FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '(?i)\\b[0-9]{{1,2}}:[0-9]{{2}}\\s*(a\\.?m\\.?|p\\.?m\\.?)?', 'TIME', 'g'), '\\b[0-9]+\\b', 'N', 'g'), '\\s+', ' ', 'g')) AS plain FROM {of}) GROUP BY site),
{name}_m AS (SELECT site, {total('family', 'name')} AS signals FROM (SELECT DISTINCT site, family, name FROM {of} JOIN marks USING (page_id) WHERE {'true' if name == 'x' else "name <> 'inline' OR NOT contains(url, '?')"}) GROUP BY site)"""


@query("site_rereads", rf"""WITH {READS_SQL}, marks AS ({_marks_sql()}), b AS (SELECT page_id, url, html, text, {_HOST_SQL} AS site FROM reads WHERE contains({_HOST_SQL}, '.')),
a AS (SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html, CASE WHEN contains(url, '#') THEN text || ' 12:30 pm' WHEN contains(url, '?') THEN text || ' new' ELSE regexp_replace(text, '[0-9]', '7', 'g') END AS text, site FROM b WHERE length(text) >= 400),
{_site_sums_sql('b', 'x')}, {_site_sums_sql('a', 'y')},
j AS (SELECT x.site AS s0, y.site AS s1, x.raw <> y.raw AS raw, x.text <> y.text AS text, x.normalised <> y.normalised AS normalised, coalesce(x_m.signals, 0) <> coalesce(y_m.signals, 0) AS signals FROM x FULL JOIN y ON x.site = y.site LEFT JOIN x_m ON x_m.site = x.site LEFT JOIN y_m ON y_m.site = y.site),
n AS (SELECT count(*) FILTER (s1 IS NULL) AS gone, count(*) FILTER (s0 IS NULL) AS new, count(*) FILTER (s0 IS NOT NULL AND s1 IS NOT NULL) AS shared, {', '.join(f"count(*) FILTER (s0 IS NOT NULL AND s1 IS NOT NULL AND {c}) AS {c}" for c in change.LEVELS)} FROM j),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS level, gone, new, shared, {c} AS tp FROM n" for c in change.LEVELS)})
SELECT level, gone, new, shared, true AS comparable, changed, rate, low, high FROM (SELECT level, gone, new, shared, tp AS changed, round(tp / nullif(shared, 0)::DOUBLE, 4) AS rate, {_wilson_sql('w', 'shared', 0)}, w_low AS low, w_high AS high FROM u)""")
def site_rereads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sites changed between two readings of their pages, level by level: comments go, clocks and counts move, some pages are gone."""
    pages = _reads(spark, sf_dir).withColumn("site", text.host_of(F.col("url"))).filter("site is not null")
    now = F.when(F.contains("url", F.lit("#")), F.concat("text", F.lit(" 12:30 pm"))).when(F.contains("url", F.lit("?")), F.concat("text", F.lit(" new"))).otherwise(F.regexp_replace("text", "[0-9]", "7"))
    later = pages.filter(F.length("text") >= 400).withColumns({"html": F.regexp_replace("html", "(?s)<!--.*?-->", ""), "text": now})
    marks = detect.signals(_table(spark, sf_dir, "pages")).select("page_id", "family", "name")
    found = lambda of: of.select("page_id", "site", "url").join(marks, "page_id")
    lost = (F.col("name") != "inline") | ~F.contains("url", F.lit("?"))
    return change.reread(change.site_levels(pages, found(pages)), change.site_levels(later, found(later).filter(lost)))


@query("family_counts", """WITH t AS (SELECT lower(r_name) AS anchor, 'region' AS level, r_regionkey FROM region), a AS (SELECT lower(r_name) AS anchor FROM region UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT 'nowhere'),
p AS (SELECT lower(n_name) AS nation, lower(r_name) AS region, lower(n_name) || '/' || lower(c_mktsegment) AS trade, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
s AS (SELECT DISTINCT lower(c_mktsegment) AS segment FROM customer), f AS (SELECT lower(n_name) AS anchor, count(*) * 1 + 1 AS categories FROM nation, s GROUP BY n_name UNION ALL SELECT lower(r_name), count(*) + count(DISTINCT n_name) + 1 FROM region JOIN nation ON n_regionkey = r_regionkey, s GROUP BY r_name),
c AS (SELECT nation AS anchor, sum(n)::BIGINT AS places FROM p GROUP BY nation UNION ALL SELECT region, sum(n)::BIGINT FROM p GROUP BY region)
SELECT DISTINCT anchor, coalesce(categories, 0) AS categories, coalesce(places, 0) AS places FROM a LEFT JOIN f USING (anchor) LEFT JOIN c USING (anchor)""")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by family of a taxonomy of regions, nations and trades in them."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"))
    customers = _table(spark, sf_dir, "customer")
    segments = customers.select(F.lower("c_mktsegment").alias("segment")).distinct()
    trade = F.concat_ws("/", "nation", "segment")
    leaves = nations.crossJoin(segments).select(trade.alias("cat"), F.array("region", "nation", trade).alias("path"))  # two vocabularies of a few rows
    taxonomy = leaves.union(nations.select("nation", F.array("region", "nation"))).union(nations.select("region", F.array("region")).distinct())
    anchors = nations.select(F.explode(F.array("region", "nation", F.lit("nowhere"))).alias("anchor"))
    places = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "nation", F.lower("c_mktsegment")).alias("cat"))
    return supply.family_counts(places, taxonomy, anchors)


@query("job_markets", """WITH r AS (SELECT 'job:' || l_orderkey AS market, l_linestatus = 'F' AS done, CASE l_returnflag WHEN 'A' THEN 'match' WHEN 'N' THEN 'no_match' ELSE 'returned' END AS verdict, l_quantity > 25 AS proof FROM lineitem),
v AS (SELECT *, CASE WHEN done AND verdict <> 'returned' THEN verdict ELSE 'unread' END AS v FROM r)
SELECT market, count(*) AS businesses, count(*) FILTER (done) AS read, count(*) FILTER (proof) AS proofs, count(*) FILTER (v = 'match') AS match, count(*) FILTER (v = 'no_match') AS no_match, 0::BIGINT AS couldnt_tell, 0::BIGINT AS blocked, 0::BIGINT AS needs_model, count(*) FILTER (v = 'unread') AS unread FROM v GROUP BY market""")
def job_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs and their lines as the sites read: flags that no reader writes count as unread."""
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("business_id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("https://part"), F.col("l_partkey").cast("string"), F.lit(".example.com")).alias("site"),
        F.when(F.col("l_linestatus") == "F", "done").otherwise("queued").alias("state"), F.when(F.col("l_returnflag") == "A", "match").when(F.col("l_returnflag") == "N", "no_match").otherwise("returned").alias("verdict"),
        F.lit(None).cast("string").alias("read_outcome"), F.col("l_quantity").cast("int").alias("pages"), F.when(F.col("l_quantity") > 25, "as printed").otherwise("").alias("proof"),
    )
    return judge.job_markets(judge.job_rows(lines))


#: Links of the invented pages, and the services that stand for them.
SERVICES = (('href="/de"', 'href="https://calendly.com/x"'), ('href="/and"', 'href="https://app.acuityscheduling.com/y"'), ('href="/of"', 'href="https://www.zocdoc.com/z"'), ('href="/to"', 'src="https://widget.intercom.io/w"'), ('href="/la"', 'href="/request-a-quote">Request a quote</a><a href="#"'))


def _served_html(html):
    for a, b in SERVICES:
        html = F.replace(html, F.lit(a), F.lit(b))
    return html


def _market_marks_sql() -> str:
    html = "html"
    for a, b in SERVICES:
        html = f"replace({html}, '{a}', '{b}')"
    known = [(f, v, m, "true") for f, v, m in detect.CATALOGUE if f in ("booking", "chat", "quote_form")] + [(f, "generic", m, "false") for f, m in detect.GENERIC if f in ("booking", "chat", "quote_form")]
    found = " UNION ALL ".join(f"SELECT page_id, '{f}' AS family, '{v}' AS name, {k} AS vendor FROM made WHERE regexp_matches(low, '{m}')" for f, v, m, k in known)
    return f"made AS (SELECT page_id, lower({html}) AS low FROM pages), marks AS ({found})"


def _pct_sql(part: str, whole: str) -> str:
    return f"coalesce(round(100.0 * ({part}) / nullif({whole}, 0), 1), 0)::DOUBLE"


@query("market_probes", f"""WITH {OUT_SQL}, {_market_marks_sql()}, hs AS (SELECT page_id, coalesce(CASE WHEN contains({_HOST_SQL}, '.') THEN {_HOST_SQL} END, '') AS site FROM pages), f AS (SELECT site, min(page_id) AS home FROM hs GROUP BY site),
s AS (SELECT regexp_extract(f.site, '([^.]*)$', 1) AS market, f.site, outcome, home FROM f JOIN c ON c.page_id = home),
m AS (SELECT DISTINCT f.site, family, name, vendor, hs.page_id = home AS at_home FROM marks JOIN hs USING (page_id) JOIN f ON f.site = hs.site),
k AS (SELECT s.*, outcome IN ('ok', 'thin') AS readable, site IN (SELECT site FROM m WHERE family = 'booking') AS shows, site IN (SELECT site FROM m WHERE family = 'booking' AND at_home) AS here, site IN (SELECT site FROM m WHERE family = 'quote_form') AS q, site IN (SELECT site FROM m WHERE family = 'chat') AS t FROM s),
n AS (SELECT market, count(*) AS sampled, count(*) FILTER (outcome NOT IN ('timeout', 'probe_error')) AS scored, count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER (outcome = 'probe_error') AS probe_error, count(*) FILTER (outcome = 'ok') AS okay, count(*) FILTER (readable) AS considered,
  count(*) FILTER (readable AND shows) AS found, count(*) FILTER (readable AND shows AND NOT here) AS beyond, count(*) FILTER (readable AND q) AS quotes, count(*) FILTER (readable AND t) AS chats FROM k GROUP BY market),
v AS (SELECT market, name, count(DISTINCT k.site) AS n, min(home) AS o FROM m JOIN k ON k.site = m.site WHERE readable AND family = 'booking' AND vendor GROUP BY market, name), r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY n DESC, o, name) AS rn FROM v),
l AS (SELECT market, string_agg(name || '=' || n, ',' ORDER BY rn) AS vendors FROM r WHERE rn <= 10 GROUP BY market)
SELECT market, sampled, scored, timeout + probe_error AS excluded, {_pct_sql('timeout + probe_error', 'sampled')} AS excluded_pct, timeout, probe_error, {_pct_sql('okay', 'scored')} AS judgeable_pct, {_pct_sql('scored - okay', 'scored')} AS floor_pct, considered, found, {_pct_sql('found', 'considered')} AS found_pct, beyond, {_pct_sql('beyond', 'considered')} AS beyond_pct,
  {_pct_sql('quotes', 'considered')} AS quote_form_pct, {_pct_sql('chats', 'considered')} AS chat_pct, coalesce(vendors, '') AS vendors FROM n LEFT JOIN l USING (market)""")
def market_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the sites of each suffix came to, and how many can be booked, by which services and whether their home pages show it."""
    pages = _table(spark, sf_dir, "pages").withColumn("site", F.coalesce(text.host_of(F.col("url")), F.lit("")))
    homes = pages.groupBy("site").agg(F.min("page_id").alias("ordinal"))
    outcomes = _outcomes(spark, sf_dir).select(F.col("page_id").alias("ordinal"), "outcome")
    sites = homes.join(outcomes, "ordinal").select(F.substring_index("site", ".", -1).alias("market"), "site", "outcome", "ordinal")
    marks = detect.signals(pages.select("page_id", _served_html(F.col("html")).alias("html"))).join(pages.select("page_id", "site"), "page_id").join(homes, "site")
    out = measure.market_summary(sites, marks.select("site", "family", "name", "vendor", (F.col("page_id") == F.col("ordinal")).alias("home")), "booking", ("quote_form", "chat"))
    return out.withColumn("vendors", F.array_join("vendors", ","))


@query("marks_standing", """WITH l AS (SELECT user_id AS account_id, (value * 100)::BIGINT % 40 AS business_id, event_id AS seq, event_type <> 'error' AS marked, CASE event_type WHEN 'view' THEN '  ' ELSE event_type END AS channel FROM events WHERE event_type <> 'purchase'),
u AS (SELECT *, count(*) FILTER (NOT marked) OVER (PARTITION BY account_id, business_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS undone FROM l)
SELECT account_id, business_id, min(seq) AS at, nullif(arg_min(trim(channel), seq), '') AS channel FROM u WHERE undone = 0 GROUP BY account_id, business_id""")
def marks_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks and unmarks of businesses: whom each account has contacted, since when and how."""
    kind = F.col("event_type")
    log = _table(spark, sf_dir, "events").filter(kind != "purchase").select(
        F.col("user_id").alias("account_id"), (F.round(F.col("value") * 100).cast("long") % 40).alias("business_id"), F.col("event_id").alias("at"), (kind != "error").alias("marked"), F.when(kind == "view", "  ").otherwise(kind).alias("channel")
    )
    return accounts.contacted(log)


@query("match_feedback", """SELECT (value * 100)::BIGINT % 40 AS business_id, CASE event_type WHEN 'error' THEN 'wrong_business' WHEN 'click' THEN 'bad_contact' ELSE 'not_a_fit' END AS kind, count(*) AS n, count(DISTINCT user_id) AS accounts, max(event_id) AS latest FROM events GROUP BY 1, 2""")
def match_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what customers say about matches."""
    kind = F.when(F.col("event_type") == "error", "wrong_business").when(F.col("event_type") == "click", "bad_contact").when(F.col("event_type") == "view", " ")
    return accounts.feedback(_table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), (F.round(F.col("value") * 100).cast("long") % 40).alias("business_id"), F.col("event_id").alias("at"), kind.alias("kind")))

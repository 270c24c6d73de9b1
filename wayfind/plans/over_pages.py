"""Queries over pages, documents, labels and conversations: signals, verdicts, measurement, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import stats, text
from wayfind.operators import change, detect, judge, measure
from wayfind.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXT_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), "
    "'(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
)
SCRIPTS_SQL = "((length(html) - length(replace(lower(html), '<script', ''))) / 7)::INTEGER"
READS_SQL = f"reads AS (SELECT page_id, url, html, {TEXT_SQL} AS text, {SCRIPTS_SQL} AS scripts FROM pages)"
OUTCOME_SQL = "CASE WHEN length(text) < 250 AND scripts >= 3 THEN 'js_shell' WHEN length(text) < 400 THEN 'thin' ELSE 'ok' END"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", "url", "html", text.visible_text(html).alias("text"), text.script_count(html).alias("scripts"))


@query("visible_text", f"WITH {READS_SQL} SELECT page_id, md5(text) AS text_md5, length(text) AS chars FROM reads")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


@query("page_outcomes", f"WITH {READS_SQL} SELECT page_id, scripts, {OUTCOME_SQL} AS outcome FROM reads")
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("page_id", "scripts", text.emptiness(F.length("text"), F.col("scripts")).alias("outcome"))


@query("page_links", r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]+href="([^"]*)"', 1)) AS link FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


@query("page_hosts", r"""WITH h AS (SELECT regexp_extract(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '^([^/?#]*)', 1) AS host FROM pages)
SELECT host, count(*) AS pages FROM h WHERE contains(host, '.') GROUP BY host""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(text.host_of(F.col("url")).alias("host")).filter("host is not null").groupBy("host").agg(F.count("*").alias("pages"))


@query("contact_details", rf"""SELECT DISTINCT doc_id, 'email' AS kind, lower(unnest(regexp_extract_all(text, '{text.EMAIL}'))) AS value FROM documents
UNION ALL SELECT DISTINCT doc_id, 'phone', regexp_replace(unnest(regexp_extract_all(text, '{text.PHONE}')), '[^0-9]', '', 'g') FROM documents""")
def contact_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = F.concat(
        F.transform(text.emails(F.col("text")), lambda v: F.struct(F.lit("email").alias("kind"), v.alias("value"))),
        F.transform(text.phones(F.col("text")), lambda v: F.struct(F.lit("phone").alias("kind"), v.alias("value"))),
    )
    return docs.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


def _marks_sql() -> str:
    vendors = " UNION ALL ".join(f"SELECT page_id, '{f}' AS family, '{v}' AS name, true AS vendor FROM pages WHERE regexp_matches(lower(html), '{m}')" for f, v, m in detect.CATALOGUE)
    generic = " UNION ALL ".join(f"SELECT page_id, '{f}', 'generic', false FROM pages WHERE regexp_matches(lower(html), '{m}')" for f, m in detect.GENERIC)
    return f"{vendors} UNION ALL {generic}"


@query("tech_signals", _marks_sql())
def tech_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.signals(_table(spark, sf_dir, "pages"))


@query("vendor_summary", f"SELECT family, name, count(*) AS pages, round(100.0 * count(*) / (SELECT count(*) FROM pages), 1)::DOUBLE AS share FROM ({_marks_sql()}) GROUP BY family, name ORDER BY pages DESC, family, name LIMIT 10")
def vendor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    counted = detect.signals(pages).groupBy("family", "name").agg(F.count("*").alias("pages"))
    whole = pages.agg(F.count("*").alias("whole"))
    return counted.crossJoin(F.broadcast(whole)).select("family", "name", "pages", stats.share(F.col("pages"), F.col("whole")).alias("share")).orderBy(F.desc("pages"), "family", "name").limit(10)  # one row


EVIDENCE_SQL = f"""{READS_SQL}, evidence AS (SELECT page_id, {OUTCOME_SQL} AS outcome, contains(lower(html), 'class="ad"') AS positive,
  CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS model_positive, page_id % 5 = 0 AS whole_site, page_id % 6 AS pages_read, page_id % 3 AS targeted, page_id % 7 = 0 AS abstained, page_id % 2 = 0 AS covered FROM reads)"""
ABSENCE_SQL = """CASE WHEN outcome IN ('js_shell', 'thin') THEN 'couldnt_tell' WHEN positive OR coalesce(model_positive, false) THEN 'no_match'
  WHEN NOT whole_site AND (pages_read < 2 OR targeted < 1) THEN 'couldnt_tell' WHEN whole_site AND pages_read < 1 THEN 'couldnt_tell' WHEN abstained THEN 'couldnt_tell'
  WHEN NOT covered AND model_positive IS NULL THEN 'couldnt_tell' ELSE 'match' END"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    model = F.when(i % 4 == 0, True).when(i % 4 != 1, False)
    return _reads(spark, sf_dir).select(
        "page_id", text.emptiness(F.length("text"), F.col("scripts")).alias("outcome"), F.contains(F.lower("html"), F.lit('class="ad"')).alias("positive"),
        model.alias("model_positive"), (i % 5 == 0).alias("whole_site"), (i % 6).alias("pages_read"), (i % 3).alias("targeted"), (i % 7 == 0).alias("abstained"), (i % 2 == 0).alias("covered"),
    )


def _absence() -> Column:
    return judge.absence(*[F.col(c) for c in ("outcome", "positive", "model_positive", "whole_site", "pages_read", "targeted", "abstained", "covered")])


@query("absence_verdicts", f"WITH {EVIDENCE_SQL} SELECT page_id, {ABSENCE_SQL} AS verdict FROM evidence")
def absence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("page_id", _absence().alias("verdict"))


FACTS_SQL = f"""{EVIDENCE_SQL}, facts AS (SELECT page_id AS id, 'no_ads' AS criterion_id, {ABSENCE_SQL} AS verdict FROM evidence
  UNION ALL SELECT page_id, 'long_read', CASE WHEN outcome <> 'ok' THEN 'blocked' WHEN pages_read >= 2 THEN 'match' ELSE 'no_match' END FROM evidence WHERE page_id % 9 <> 0)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two criteria; one is missing for every ninth page."""
    found = _evidence(spark, sf_dir)
    first = found.select(F.col("page_id").alias("id"), F.lit("no_ads").alias("criterion_id"), _absence().alias("verdict"))
    second = found.filter("page_id % 9 <> 0").select("page_id", F.lit("long_read"), F.when(F.col("outcome") != "ok", "blocked").when(F.col("pages_read") >= 2, "match").otherwise("no_match"))
    return first.union(second)


@query("verdict_roll_up", f"""WITH {FACTS_SQL}, c AS (SELECT id, count(*) FILTER (verdict = 'no_match') AS n, count(*) FILTER (verdict = 'match') AS m, count(*) FILTER (verdict = 'blocked') AS b, count(*) FILTER (verdict = 'couldnt_tell') AS ct FROM facts GROUP BY id)
SELECT page_id AS id, CASE WHEN n > 0 THEN 'no_match' WHEN m >= 2 THEN 'match' WHEN b > 0 THEN 'blocked' WHEN ct > 0 THEN 'couldnt_tell' ELSE 'unread' END AS verdict FROM pages LEFT JOIN c ON id = page_id""")
def verdict_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.roll_up(_facts(spark, sf_dir), _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), 2)


@query("verdict_tallies", f"WITH {FACTS_SQL} SELECT criterion_id, verdict, count(*) AS n FROM facts GROUP BY criterion_id, verdict")
def verdict_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.tallies(_facts(spark, sf_dir))


@query("verdict_pivot", f"WITH {FACTS_SQL} SELECT criterion_id, count(*) FILTER (verdict = 'match') AS match, count(*) FILTER (verdict = 'no_match') AS no_match, count(*) FILTER (verdict IN ('couldnt_tell', 'blocked')) AS unsettled FROM facts GROUP BY criterion_id")
def verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settled share's counts, one row a criterion."""
    v = F.col("verdict")
    return _facts(spark, sf_dir).groupBy("criterion_id").agg(F.count_if(v == "match").alias("match"), F.count_if(v == "no_match").alias("no_match"), F.count_if(v.isin("couldnt_tell", "blocked")).alias("unsettled"))


@query("fit_labels", f"""WITH {EVIDENCE_SQL}, o AS (SELECT page_id AS id, true AS must, CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 3 <> 0 END AS passed FROM evidence UNION ALL SELECT page_id, false, CASE WHEN page_id % 4 = 0 THEN NULL ELSE positive END FROM evidence),
c AS (SELECT id, count(passed) AS settled, count(*) FILTER (must AND NOT passed) AS fm, count(*) FILTER (must AND passed) AS pm FROM o GROUP BY id)
SELECT page_id AS id, CASE WHEN pages_read = 0 THEN 'unreadable' WHEN fm > 0 THEN 'no' WHEN settled = 0 THEN 'unreadable' WHEN pm = 1 THEN 'strong' ELSE 'maybe' END AS fit FROM evidence JOIN c ON id = page_id""")
def fit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One must and one nice-to-have rule."""
    found = _evidence(spark, sf_dir)
    i = F.col("page_id")
    outcomes = found.select(i.alias("id"), F.lit(True).alias("must"), F.when(i % 4 != 0, i % 3 != 0).alias("passed")).union(found.select(i, F.lit(False), F.when(i % 4 != 0, F.col("positive"))))
    return judge.fit(outcomes, found.select(i.alias("id"), F.col("pages_read").alias("pages")), True, 2, 1)


JUDGED_SQL = """judged AS (SELECT d.lang, l.quality AS label, CASE WHEN d.n_chars < 200 THEN 'couldnt_tell' WHEN regexp_matches(d.text, '[#$%&*!]{2}') THEN 'no_match' ELSE 'match' END AS verdict FROM documents d JOIN labels l USING (doc_id))"""


@query("confusion_matrix", f"""WITH {JUDGED_SQL}, c AS (SELECT lang, count(*) FILTER (verdict = 'match' AND label = 1) AS tp, count(*) FILTER (verdict = 'match' AND label = 0) AS fp, count(*) FILTER (verdict = 'no_match' AND label = 1) AS fn,
  count(*) FILTER (verdict = 'no_match' AND label = 0) AS tn, count(*) FILTER (verdict = 'couldnt_tell') AS abstained, count(*) FILTER (verdict = 'couldnt_tell' AND label = 1) AS abstained_on_match FROM judged GROUP BY lang),
w AS (SELECT *, tp + fp AS n, tp / nullif(tp + fp, 0)::DOUBLE AS p FROM c)
SELECT lang, tp, fp, fn, tn, abstained, abstained_on_match, round(p, 6) AS precision, round(CASE WHEN n > 0 THEN greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) ELSE 0 END, 6)::DOUBLE AS precision_lo,
  round(CASE WHEN n > 0 THEN least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) ELSE 1 END, 6)::DOUBLE AS precision_hi, round(tp / nullif(tp + fn + abstained_on_match, 0)::DOUBLE, 6) AS recall_delivered FROM w""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of thumb for quality against the labels, by language."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    verdict = F.when(F.col("n_chars") < 200, "couldnt_tell").when(F.col("text").rlike("[#$%&*!]{2}"), "no_match").otherwise("match")
    return measure.confusion(docs.join(labels, "doc_id").select("lang", F.col("quality").alias("label"), verdict.alias("verdict")), "lang")


BEFORE_SQL = "reading AS (SELECT doc_id AS id, text AS html, lower(text) AS text, source AS signals FROM documents)"
LEVEL_SQL = "substr(sha256({}), 1, 16)"


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as they are, and changed in ways that follow from their ids."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("html"), F.lower("text").alias("text"), F.col("source").alias("signals"))
    i = F.col("id")
    text_now = F.when(i % 7 == 0, F.concat("text", F.lit(" 2026"))).otherwise(F.col("text"))
    after = docs.filter(i % 11 != 0).select("id", F.when(i % 2 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("html"), text_now.alias("text"), F.when(i % 13 == 0, F.concat("signals", F.lit("+chat"))).otherwise(F.col("signals")).alias("signals"))
    return docs, after


def _levels_sql(html: str, body: str, signals: str) -> str:
    plain = f"regexp_replace(trim(regexp_replace(lower({body}), '[ \\t\\n\\r]+', ' ', 'g')), '[0-9]+', '0', 'g')"
    return ", ".join(f"{LEVEL_SQL.format(x)} AS {n}" for n, x in (("raw", html), ("text", body), ("normalised", plain), ("signals", signals)))


@query("change_rates", f"""WITH b AS (SELECT doc_id AS id, {_levels_sql('text', 'lower(text)', 'source')} FROM documents),
a AS (SELECT doc_id AS id, {_levels_sql("CASE WHEN doc_id % 2 = 0 THEN text || ' ' ELSE text END", "CASE WHEN doc_id % 7 = 0 THEN lower(text) || ' 2026' ELSE lower(text) END", "CASE WHEN doc_id % 13 = 0 THEN source || '+chat' ELSE source END")} FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT count(*) AS shared, {', '.join(f"count(*) FILTER (a.{n} <> b.{n}) AS {n}" for n in change.LEVELS)} FROM a JOIN b USING (id))
{' UNION ALL '.join(f"SELECT '{n}' AS level, shared, {n} AS changed FROM c" for n in change.LEVELS)}""")
def change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _readings(spark, sf_dir)
    return change.change_rates(change.levels(before), change.levels(after))


@query("change_digest", """WITH b AS (SELECT page_id AS id, md5(url) AS signals, page_id % 3 = 0 AS matched, page_id % 4 = 0 AS blocked FROM pages WHERE page_id % 10 <> 0),
a AS (SELECT page_id AS id, md5(CASE WHEN page_id % 2 = 0 THEN url ELSE url || '!' END) AS signals, page_id % 5 = 0 AS matched FROM pages),
j AS (SELECT a.*, b.id IS NULL AS new, b.signals = a.signals AS same, b.matched AS m0, b.blocked AS b0 FROM a LEFT JOIN b ON a.id = b.id)
SELECT count(*) FILTER (new AND matched) AS new_matches, count(*) FILTER (NOT new AND NOT same AND NOT m0 AND matched AND NOT b0) AS changed_to_match, count(*) FILTER (NOT new AND NOT same AND NOT m0 AND matched AND b0) AS newly_unblocked,
  count(*) FILTER (NOT new AND NOT same AND m0 AND NOT matched) AS changed_to_no_match, count(*) FILTER (new OR NOT same) AS re_judged, count(*) FILTER (NOT new AND same) AS unchanged FROM j""")
def change_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    i = F.col("page_id")
    before = pages.filter(i % 10 != 0).select(i.alias("id"), F.md5("url").alias("signals"), (i % 3 == 0).alias("matched"), (i % 4 == 0).alias("blocked"))
    after = pages.select(i.alias("id"), F.md5(F.when(i % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("!")))).alias("signals"), (i % 5 == 0).alias("matched"))
    return change.digest(before, after)


@query("quotes_held", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) AS page, trim(regexp_replace(lower(substr(text, doc_id % 40 + 1, 5 + doc_id % 60)), '[ \t\n\r]+', ' ', 'g')) AS quote FROM documents)
SELECT length(quote) >= 12 AND contains(page, quote) AS held, count(*) AS n FROM f GROUP BY 1""")
def quotes_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes taken from documents: only those long enough count as proof."""
    docs = _table(spark, sf_dir, "documents")
    quote = F.substring("text", (F.col("doc_id") % 40 + 1).cast("int"), (5 + F.col("doc_id") % 60).cast("int"))
    return docs.select(text.quote_holds(quote, F.col("text")).alias("held")).groupBy("held").agg(F.count("*").alias("n"))


@query("sentences", r"""WITH s AS (SELECT lang, trim(unnest(regexp_split_to_array(text, '[.!?\n|]|•'))) AS s FROM documents) SELECT lang, count(*) AS n, sum(length(s))::BIGINT AS chars FROM s WHERE length(s) >= 12 GROUP BY lang""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _table(spark, sf_dir, "documents").select("lang", F.explode(text.sentences(F.col("text"))).alias("s"))
    return split.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("chars"))


@query("turn_prompts", """WITH t AS (SELECT conv_id, turn, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)
SELECT conv_id, turn, least(least(chars, 600), greatest(0, 1800 - coalesce(before, 0)))::BIGINT AS used, chars > 600 OR chars + coalesce(before, 0) > 1800 AS truncated FROM t""")
def turn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each text fits a prompt: so much of one text, so much of all before it."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = _table(spark, sf_dir, "conversations").withColumn("before", before)
    chars = F.length("text")
    used = F.least(F.least(chars, F.lit(600)), F.greatest(F.lit(0), 1800 - F.col("before")))
    return given.select("conv_id", "turn", used.cast("long").alias("used"), ((chars > 600) | (chars + F.col("before") > 1800)).alias("truncated"))


@query("reply_gate", r"""WITH t AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answered FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(stop|unsubscribe|remove me|not interested)') THEN 'stop' WHEN answered >= 3 THEN 'hold' WHEN regexp_matches(text, '[?]') THEN 'answer' ELSE 'wait' END AS decision FROM t WHERE role = 'user'""")
def reply_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each incoming message: a plain stop decides first, then how often was answered already."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = _table(spark, sf_dir, "conversations").withColumn("answered", F.count_if(F.col("role") == "assistant").over(before))
    stop = F.lower("text").rlike("(stop|unsubscribe|remove me|not interested)")
    decision = F.when(stop, "stop").when(F.col("answered") >= 3, "hold").when(F.contains("text", F.lit("?")), "answer").otherwise("wait")
    return turns.filter("role = 'user'").select("conv_id", "turn", decision.alias("decision"))


@query("sender_domains", rf"""WITH e AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{text.EMAIL}'))) AS email FROM documents) SELECT split_part(email, '@', 2) AS domain, count(DISTINCT email) AS addresses, count(DISTINCT doc_id) AS documents FROM e GROUP BY 1""")
def sender_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))
    return found.groupBy(F.substring_index("email", "@", -1).alias("domain")).agg(F.countDistinct("email").alias("addresses"), F.countDistinct("doc_id").alias("documents"))


LEADS = "(?:website|site|web design|designed|built|created|developed|powered) by"


@query("page_credits", rf"""WITH p AS (SELECT page_id, regexp_extract(lower(url), '://([^/?#]*)', 1) AS own, lower(html) || CASE page_id % 4 WHEN 0 THEN '<p>website by <a href="https://www.acme' || (page_id % 5) || '.net/x">acme</a></p>' WHEN 1 THEN '<a href="http://studio.biz">site by studio</a>' WHEN 2 THEN '<a href="https://plain.org">links</a>' ELSE '' END AS html FROM pages),
a AS (SELECT page_id, own, unnest(list_concat(regexp_extract_all(html, '{LEADS}\s*:?\s*<a[^>]+href="(https?://[^"]*)"', 1), regexp_extract_all(html, '<a[^>]+href="(https?://[^"]*)"[^>]*>[^<]*{LEADS}', 1))) AS link FROM p),
h AS (SELECT page_id, own, regexp_replace(regexp_extract(link, '://([^/?#]*)', 1), '^www\.', '') AS host FROM a)
SELECT host, count(DISTINCT page_id) AS pages FROM h WHERE array_to_string(string_split(host, '.')[-2:], '.') <> array_to_string(string_split(own, '.')[-2:], '.') GROUP BY host""")
def page_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who made a site, by the credit in its footer: other root domains beside or inside the words that say so."""
    k = F.col("page_id")
    footer = F.when(k % 4 == 0, F.concat(F.lit('<p>website by <a href="https://www.acme'), (k % 5).cast("string"), F.lit('.net/x">acme</a></p>'))).when(k % 4 == 1, '<a href="http://studio.biz">site by studio</a>').when(k % 4 == 2, '<a href="https://plain.org">links</a>').otherwise("")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lower("html"), footer).alias("html"))
    return detect.credits(pages).groupBy("host").agg(F.countDistinct("page_id").alias("pages"))

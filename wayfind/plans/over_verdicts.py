"""Queries over pages and places that settle criteria, and over what was settled: who may see it, and what it adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import detect, entitlement, evidence, resolve
from wayfind.plans.over_pages import EVIDENCE_SQL, FACTS_SQL, OUTCOME_SQL, READS_SQL, _evidence, _facts, _marks_sql, _reads, _table
from wayfind.plans.over_places import HOST_SQL
from wayfind.plans.registry import query
from wayfind.sources.places import PLACES_SQL, places_of

#: Criteria as a person wrote them, and the families whose marks the pages of the tests carry beside the usual ones.
CRITERIA = [("no_tracking", "absence", "runs no tracking pixel"), ("no_ads", "absence", "shows no advertising"), ("no_quote", "absence", "has no way to request a quote"), ("long_text", "presence", "says a lot")]
FAMILIES = (*evidence.FAMILIES, ("pixel", r"(?i)\btracking\b"), ("ads", r"(?i)\badvertising\b"))
CRITERIA_SQL = "criteria(criterion_id, type, family) AS (VALUES ('no_tracking', 'absence', 'pixel'), ('no_ads', 'absence', 'ads'), ('no_quote', 'absence', 'quote_form'), ('long_text', 'presence', NULL))"


def _criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRITERIA, "criterion_id string, type string, text string")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = detect.signals(_table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "id")
    return evidence.detector(_criteria(spark), signals, families=FAMILIES)


DETECTED_SQL = f"{CRITERIA_SQL}, marks AS ({_marks_sql()}), detected AS (SELECT page_id AS id, criterion_id, min(name) FILTER (vendor) AS source FROM marks JOIN criteria USING (family) WHERE type = 'absence' GROUP BY page_id, criterion_id HAVING count(*) FILTER (vendor) > 0)"


@query("detector_verdicts", f"WITH {DETECTED_SQL} SELECT id, criterion_id, 'no_match' AS verdict, source FROM detected")
def detector_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir)


BATCH_SQL = f"""{READS_SQL}, {DETECTED_SQL}, b AS (SELECT page_id AS id, {OUTCOME_SQL} AS site, (page_id % 5)::INTEGER AS pages, page_id % 6 = 0 AS whole_site, text FROM reads),
said AS (SELECT b.*, criterion_id, type, CASE WHEN page_id_mod = 0 THEN NULL WHEN page_id_mod = 1 THEN 'couldnt_tell' WHEN page_id_mod = 2 THEN 'no_match' ELSE 'match' END AS verdict, CASE WHEN id % 3 = 0 THEN 'words that no page has' ELSE substr(text, (id % 50 + 1)::INTEGER, 40) END AS quote FROM (SELECT *, id % 7 AS page_id_mod FROM b) b, criteria),
held AS (SELECT *, CASE WHEN verdict = 'couldnt_tell' OR (length(trim(regexp_replace(lower(quote), '[ \\t\\n\\r]+', ' ', 'g'))) >= 12 AND contains(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')), trim(regexp_replace(lower(quote), '[ \\t\\n\\r]+', ' ', 'g')))) THEN verdict ELSE 'couldnt_tell' END AS v FROM said)"""


@query("batch_verdicts", f"""WITH {BATCH_SQL} SELECT h.id, h.criterion_id,
  CASE WHEN site <> 'ok' OR pages = 0 THEN 'couldnt_tell' WHEN d.id IS NOT NULL THEN 'no_match' WHEN verdict IS NULL THEN 'couldnt_tell' WHEN type = 'absence' AND v = 'match' THEN CASE WHEN NOT whole_site AND pages < 2 THEN 'couldnt_tell' ELSE 'match' END ELSE v END AS verdict,
  CASE WHEN site <> 'ok' OR pages = 0 THEN 'absence_rule' WHEN d.id IS NOT NULL THEN 'detector' WHEN verdict IS NOT NULL AND type = 'absence' AND v = 'match' THEN 'absence_rule' ELSE 'model' END AS settled_by
FROM held h LEFT JOIN detected d ON d.id = h.id AND d.criterion_id = h.criterion_id""")
def batch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and a model's answers made of the pages: some without an answer, some with a quote that no page has."""
    reads = _reads(spark, sf_dir).select(F.col("page_id").alias("id"), text.emptiness(F.length("text"), F.col("scripts")).alias("outcome"), (F.col("page_id") % 5).cast("int").alias("pages"), (F.col("page_id") % 6 == 0).alias("whole_site"), "text")
    i = F.col("id") % 7
    said = F.when(i == 1, "couldnt_tell").when(i == 2, "no_match").otherwise("match")
    quote = F.when(F.col("id") % 3 == 0, "words that no page has").otherwise(F.substring("text", (F.col("id") % 50 + 1).cast("int"), F.lit(40)))
    model = reads.filter(i != 0).select("id", said.alias("verdict"), quote.alias("quote")).crossJoin(F.broadcast(_criteria(spark).select("criterion_id")))  # four rows
    return evidence.batch(reads, _criteria(spark), _detected(spark, sf_dir), model)


LIVE_SQL = """f AS (SELECT page_id AS id, page_id % 2 = 0 AS presence, CASE page_id % 9 WHEN 0 THEN 'js_shell' WHEN 1 THEN 'blocked' WHEN 2 THEN 'timeout' WHEN 3 THEN 'robots_blocked' ELSE 'ok' END AS outcome, page_id % 5 AS pages,
  contains(html, 'track(') AND page_id % 4 = 0 AS detected, page_id % 11 = 0 AS in_source, page_id % 22 = 0 AS hinted, CASE page_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'couldnt_tell' WHEN 2 THEN 'match' WHEN 3 THEN 'match' ELSE 'no_match' END AS said, page_id % 3 = 0 AS quoted, page_id % 4 AS targeted, page_id % 7 % 2 AS reached FROM pages)"""


@query("live_verdicts", f"""WITH {LIVE_SQL} SELECT id, CASE
  WHEN outcome = 'js_shell' AND detected THEN CASE WHEN presence THEN 'match' ELSE 'no_match' END
  WHEN in_source AND NOT detected AND NOT hinted AND pages > 0 AND outcome IN ('ok', 'js_shell') THEN CASE WHEN presence THEN 'no_match' ELSE 'match' END
  WHEN outcome <> 'ok' OR pages = 0 THEN CASE WHEN outcome IN ('blocked', 'robots_blocked') THEN 'blocked' ELSE 'couldnt_tell' END
  WHEN detected THEN CASE WHEN presence THEN 'match' ELSE 'no_match' END WHEN said IS NULL THEN 'needs_model' WHEN said = 'couldnt_tell' THEN 'couldnt_tell'
  WHEN presence = (said = 'match') THEN CASE WHEN quoted THEN said ELSE 'couldnt_tell' END WHEN targeted > 0 AND reached = 0 THEN 'couldnt_tell' ELSE said END AS verdict FROM f""")
def live_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    k = i % 9
    outcome = F.when(k == 0, "js_shell").when(k == 1, "blocked").when(k == 2, "timeout").when(k == 3, "robots_blocked").otherwise("ok")
    m = i % 13
    said = F.when(m == 1, "couldnt_tell").when(m.isin(2, 3), "match").when(m != 0, "no_match")
    detected = F.contains("html", F.lit("track(")) & (i % 4 == 0)
    verdict = evidence.live(i % 2 == 0, outcome, i % 5, detected, i % 11 == 0, i % 22 == 0, said, i % 3 == 0, i % 4, i % 7 % 2)
    return _table(spark, sf_dir, "pages").select(i.alias("id"), verdict.alias("verdict"))


@query("health_verdicts", """SELECT page_id AS id, CASE WHEN page_id % 5 IN (0, 1) OR page_id % 7 = 0 OR page_id % 8 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'no_match' ELSE 'match' END
  WHEN starts_with(url, 'https:') THEN CASE WHEN page_id % 2 = 0 THEN 'match' ELSE 'no_match' END WHEN page_id % 3 = 0 THEN 'blocked' ELSE 'couldnt_tell' END AS verdict FROM pages""")
def health_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    dns = F.when(i % 5 == 0, "nxdomain").when(i % 5 == 1, "no_address").otherwise("resolves")
    verdict = evidence.health(i % 2 == 0, dns, F.when(i % 7 == 0, "CERT_HAS_EXPIRED"), i % 8 == 0, F.startswith("url", F.lit("https:")), F.when(i % 3 == 0, "blocked").otherwise("timeout"))
    return _table(spark, sf_dir, "pages").select(i.alias("id"), verdict.alias("verdict"))


@query("export_verdicts", """WITH p AS (SELECT page_id AS id, page_id % 8 <> 0 AS read, CASE WHEN page_id % 3 = 0 THEN 'presence' ELSE 'absence' END AS type, CASE page_id % 10 WHEN 0 THEN 'blocked' WHEN 1 THEN 'timeout' WHEN 2 THEN 'probe_error' WHEN 3 THEN 'thin' ELSE 'ok' END AS outcome, page_id % 4 AS pages, contains(html, 'class="ad"') AND page_id % 5 = 0 AS signal, page_id % 6 <> 0 AS covered FROM pages)
SELECT id, CASE WHEN NOT read THEN 'unread' WHEN type <> 'absence' THEN 'needs_model' WHEN outcome = 'blocked' THEN 'blocked' WHEN outcome = 'timeout' THEN 'unread' WHEN outcome = 'thin' THEN 'couldnt_tell' WHEN signal THEN 'no_match'
  WHEN pages < 2 OR NOT covered THEN CASE WHEN outcome = 'probe_error' THEN 'unread' ELSE 'couldnt_tell' END ELSE 'match' END AS verdict FROM p""")
def export_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    k = i % 10
    outcome = F.when(k == 0, "blocked").when(k == 1, "timeout").when(k == 2, "probe_error").when(k == 3, "thin").otherwise("ok")
    signal = F.contains("html", F.lit('class="ad"')) & (i % 5 == 0)
    verdict = evidence.exported(i % 8 != 0, F.when(i % 3 == 0, "presence").otherwise("absence"), outcome, i % 4, signal, i % 6 != 0)
    return _table(spark, sf_dir, "pages").select(i.alias("id"), verdict.alias("verdict"))


@query("whole_sites", rf"""WITH {READS_SQL}, l AS (SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a[^>]+href="([^"]*)"', 1), lambda x: starts_with(x, '/') OR contains(x, regexp_extract(url, '://([^/?#]*)', 1))))) AS links FROM pages)
SELECT page_id AS id, links::INTEGER AS internal_links, {OUTCOME_SQL} = 'ok' AS readable, {OUTCOME_SQL} = 'ok' AND links = 0 AND page_id % 9 <> 0 AS whole_site FROM reads JOIN l USING (page_id)""")
def whole_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by whether they link to others of their host; every ninth had a page that failed to come."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    links = F.size(F.filter(text.links(F.col("html")), lambda x: F.startswith(x, F.lit("/")) | F.contains(x, host)))
    outcome = text.emptiness(F.length("text"), F.col("scripts"))
    found = _reads(spark, sf_dir).select(F.col("page_id").alias("id"), links.alias("internal_links"), outcome.alias("outcome"))
    return found.select("id", "internal_links", evidence.readable(F.col("outcome"), F.lit(1)).alias("readable"), evidence.whole_site(F.col("outcome"), F.lit(1), F.col("internal_links"), F.when(F.col("id") % 9 == 0, 1).otherwise(0)).alias("whole_site"))


@query("why_matched", f"""WITH {FACTS_SQL}, t AS (SELECT id, verdict, CASE criterion_id WHEN 'no_ads' THEN 1 ELSE 2 END AS ordinal, CASE criterion_id WHEN 'no_ads' THEN 'shows no ads' ELSE 'has a long site' END || CASE WHEN id % 3 = 0 THEN '' ELSE ' (page ' || id || ')' END AS part FROM facts)
SELECT id, string_agg(part, '; ' ORDER BY ordinal) AS why FROM t WHERE verdict = 'match' GROUP BY id""")
def why_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("criterion_id") == "no_ads"
    proof = F.when(F.col("id") % 3 != 0, F.concat(F.lit("page "), F.col("id").cast("string")))
    return evidence.why_matched(_facts(spark, sf_dir).select("id", "verdict", F.when(first, 1).otherwise(2).alias("ordinal"), F.when(first, "shows no ads").otherwise("has a long site").alias("text"), proof.alias("proof")))


@query("label_scores", f"""WITH {FACTS_SQL}, labels_long AS (SELECT doc_id AS id, c AS criterion_id, CASE WHEN quality = 1 THEN 'match' ELSE 'no_match' END AS label FROM labels, (VALUES ('no_ads'), ('long_read'), ('unknown')) t(c))
SELECT criterion_id, count(*) AS labelled, count(*) FILTER (verdict IS NULL) AS not_judged, count(*) FILTER (verdict = label) AS agreed, count(*) FILTER (verdict IN ('couldnt_tell', 'blocked')) AS abstained FROM labels_long LEFT JOIN facts USING (id, criterion_id) WHERE criterion_id <> 'unknown' GROUP BY criterion_id""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against verdicts: a missing verdict is counted as not judged, a label of an unknown criterion is left out."""
    names = spark.createDataFrame([("no_ads",), ("long_read",), ("unknown",)], "criterion_id string")
    known = spark.createDataFrame([("no_ads",), ("long_read",)], "criterion_id string")
    label = F.when(F.col("quality") == 1, "match").otherwise("no_match")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), label.alias("label")).crossJoin(F.broadcast(names))  # three rows
    joined = labels.join(known, "criterion_id").join(_facts(spark, sf_dir), ["id", "criterion_id"], "left")
    v = F.col("verdict")
    return joined.groupBy("criterion_id").agg(F.count("*").alias("labelled"), F.count_if(v.isNull()).alias("not_judged"), F.count_if(v == F.col("label")).alias("agreed"), F.count_if(v.isin("couldnt_tell", "blocked")).alias("abstained"))


RATED_SQL = f"{PLACES_SQL}, rated AS (SELECT *, CASE WHEN rating >= 3.5 THEN 'match' WHEN rating IS NULL THEN 'needs_model' WHEN ordinal % 9 = 0 THEN 'blocked' WHEN ordinal % 7 = 0 THEN 'couldnt_tell' ELSE 'no_match' END AS verdict FROM places)"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places judged by their rating."""
    i = F.col("ordinal")
    verdict = F.when(F.col("rating") >= 3.5, "match").when(F.col("rating").isNull(), "needs_model").when(i % 9 == 0, "blocked").when(i % 7 == 0, "couldnt_tell").otherwise("no_match")
    return places_of(spark, sf_dir).withColumn("verdict", verdict)


def _removed(rows: DataFrame) -> DataFrame:
    return rows.filter("ordinal % 15 = 0").select("id")


def _paid(rows: DataFrame) -> DataFrame:
    return rows.filter("ordinal % 4 <> 0").select("id")


@query("entitlement_refusals", f"WITH {RATED_SQL} SELECT id, CASE WHEN ordinal % 15 = 0 THEN 'suppressed' WHEN verdict <> 'match' THEN 'not_matched' WHEN ordinal % 4 = 0 THEN 'not_unlocked' END AS code FROM rated")
def entitlement_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)
    return entitlement.refusals(rated.select("id", "verdict"), _removed(rated), _paid(rated))


@query("refusal_summary", f"WITH {RATED_SQL}, r AS (SELECT CASE WHEN ordinal % 15 = 0 THEN 'suppressed' WHEN verdict <> 'match' THEN 'not_matched' WHEN ordinal % 4 = 0 THEN 'not_unlocked' END AS code FROM rated) SELECT code, count(*) AS n FROM r WHERE code IS NOT NULL GROUP BY code ORDER BY n DESC, code")
def refusal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)
    return entitlement.counted(entitlement.refusals(rated.select("id", "verdict"), _removed(rated), _paid(rated)), "code")


@query("non_match_summary", f"WITH {RATED_SQL} SELECT verdict, count(*) AS n FROM rated WHERE verdict <> 'match' GROUP BY verdict ORDER BY n DESC, verdict")
def non_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entitlement.counted(_rated(spark, sf_dir).filter("verdict <> 'match'"), "verdict")


@query("suppression_filter", f"WITH {RATED_SQL} SELECT id, cat FROM rated WHERE NOT EXISTS (SELECT 1 FROM rated s WHERE s.id = rated.id AND s.ordinal % 15 = 0)")
def suppression_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)
    return rated.join(_removed(rated), "id", "left_anti").select("id", "cat")


@query("visible_rows", f"""WITH {RATED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY town ORDER BY reviews DESC NULLS LAST, id) AS place FROM rated WHERE verdict = 'match'), s AS (SELECT *, place <= 3 OR ordinal % 4 = 1 AS seen FROM o)
SELECT town, place::INTEGER AS place, seen, CASE WHEN seen THEN id ELSE 'locked-' || (place - 1) END AS id, CASE WHEN seen THEN name END AS name, CASE WHEN seen THEN site END AS site, CASE WHEN seen THEN phone END AS phone FROM s""")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir).filter("verdict = 'match'")
    return entitlement.visible(rated, rated.filter("ordinal % 4 = 1"), "town", [F.desc_nulls_last("reviews"), F.col("id")])


@query("blind_rows", f"WITH {RATED_SQL}, b AS (SELECT CASE WHEN verdict = 'match' THEN 'strong' ELSE 'no' END AS fit, ordinal % 4 AS settled, ordinal % 4 % 3 AS passed, phone, site FROM rated) SELECT fit, round(passed / nullif(settled, 0)::DOUBLE, 6) AS strength, phone IS NOT NULL OR site IS NOT NULL AS reachable FROM b")
def blind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir).select(F.when(F.col("verdict") == "match", "strong").otherwise("no").alias("fit"), (F.col("ordinal") % 4).alias("settled"), (F.col("ordinal") % 4 % 3).alias("passed"), "phone", "site")
    return entitlement.blind(rows)


@query("matched_set", f"""WITH {RATED_SQL}, k AS (SELECT *, {HOST_SQL} AS site_key FROM rated), n AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY ordinal) AS rn FROM k) SELECT id, verdict FROM n WHERE (site_key IS NULL OR rn = 1) AND ordinal % 15 <> 0 AND verdict = 'match'""")
def matched_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing a business, those who asked to be left out gone, and of these the matches."""
    rated = _rated(spark, sf_dir)
    leads = resolve.work_list(rated, drop_chains=False).filter("status = 'kept'")
    return leads.join(_removed(rated), "id", "left_anti").filter("verdict = 'match'").select("id", "verdict")


@query("unsure_groups", """WITH r AS (SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'needs_model' WHEN 1 THEN 'match' WHEN 2 THEN 'blocked' ELSE 'couldnt_tell' END AS verdict, CASE page_id % 11 WHEN 0 THEN 'blocked' WHEN 1 THEN 'dead' WHEN 2 THEN 'timeout' WHEN 3 THEN 'thin' WHEN 4 THEN 'js_shell' WHEN 5 THEN 'probe_error' WHEN 6 THEN 'odd' ELSE 'ok' END AS outcome FROM pages),
g AS (SELECT id, CASE WHEN verdict = 'needs_model' THEN 'needs_model' WHEN outcome IN ('ok', 'odd') THEN 'thin' ELSE outcome END AS "group" FROM r WHERE verdict <> 'match'), n AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY id) AS k FROM g)
SELECT CASE "group" WHEN 'blocked' THEN 0 WHEN 'dead' THEN 1 WHEN 'timeout' THEN 2 WHEN 'js_shell' THEN 4 WHEN 'thin' THEN 6 WHEN 'needs_model' THEN 7 ELSE 8 END AS place, "group", "group" IN ('needs_model', 'probe_error') AS ours, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM n GROUP BY "group" """)
def unsure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    k, m = i % 4, i % 11
    verdict = F.when(k == 0, "needs_model").when(k == 1, "match").when(k == 2, "blocked").otherwise("couldnt_tell")
    outcome = F.when(m == 0, "blocked").when(m == 1, "dead").when(m == 2, "timeout").when(m == 3, "thin").when(m == 4, "js_shell").when(m == 5, "probe_error").when(m == 6, "odd").otherwise("ok")
    return entitlement.unsure_groups(_table(spark, sf_dir, "pages").select(i.alias("id"), i.alias("ordinal"), verdict.alias("verdict"), outcome.alias("outcome")))


WIDE_SQL = "count(*) FILTER (verdict = 'match') AS match, count(*) FILTER (verdict = 'no_match') AS no_match, count(*) FILTER (verdict = 'couldnt_tell') AS couldnt_tell, count(*) FILTER (verdict = 'blocked') AS blocked, count(*) FILTER (verdict = 'needs_model') AS needs_model, count(*) FILTER (verdict = 'unread') AS unread"
TALLY_SQL = f"{RATED_SQL}, t AS (SELECT town, cat, {WIDE_SQL} FROM rated GROUP BY town, cat)"


def _tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entitlement.tallies_wide(_rated(spark, sf_dir), "town", "cat")


@query("settled_shares", f"WITH {TALLY_SQL} SELECT town, cat, match + no_match + couldnt_tell + blocked + needs_model AS attempted, match + no_match AS settled, needs_model, unread AS not_attempted, round(coalesce(100.0 * (match + no_match) / nullif(match + no_match + couldnt_tell + blocked + needs_model, 0), 0), 1)::DOUBLE AS settled_pct FROM t")
def settled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entitlement.settled_shares(_tallies(spark, sf_dir), "town", "cat")


@query("saturation_set", f"WITH {TALLY_SQL} SELECT town, cat, match AS matches, match + no_match + couldnt_tell + blocked AS judged, match >= 20 AS published, CASE WHEN match >= 20 THEN NULL WHEN match = 0 AND needs_model > 0 THEN 'nothing judged' ELSE 'too few matches' END AS why FROM t")
def saturation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entitlement.saturation(_tallies(spark, sf_dir), "town", "cat")


@query("match_rates", f"WITH {TALLY_SQL}, r AS (SELECT match, match / (match + no_match + couldnt_tell + blocked)::DOUBLE AS rate FROM t WHERE match + no_match + couldnt_tell + blocked > 0) SELECT round(min(rate) FILTER (match > 0), 6) AS low, round(max(rate) FILTER (match > 0), 6) AS high, count(*) FILTER (match > 0) AS hits, count(*) FILTER (match = 0) AS zeroes FROM r")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entitlement.match_rates(_tallies(spark, sf_dir))


@query("template_library", f"""WITH {TALLY_SQL}, u AS (SELECT town, cat AS signal, CASE WHEN length(town) % 2 = 0 THEN 'absence' ELSE 'presence' END AS polarity, match AS m FROM t UNION ALL SELECT town, cat, CASE WHEN length(town) % 2 = 0 THEN 'presence' ELSE 'absence' END, no_match FROM t)
SELECT signal, polarity, sum(m)::BIGINT AS matches, count(*) FILTER (m > 0) AS markets, sum(m) >= 20 AS published FROM u GROUP BY signal, polarity""")
def template_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = _tallies(spark, sf_dir).withColumnsRenamed({"town": "market", "cat": "signal"})
    return entitlement.templates(tallies.withColumn("type", F.when(F.length("market") % 2 == 0, "absence").otherwise("presence")))


@query("best_markets", f"WITH {TALLY_SQL} SELECT town, cat, match AS fit FROM t WHERE match > 0 ORDER BY fit DESC, town, cat")
def best_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market with a match, the best first."""
    found = _tallies(spark, sf_dir).filter("match > 0").select("town", "cat", F.col("match").alias("fit"))
    return found.orderBy(F.desc("fit"), F.asc_nulls_last("town"), F.asc_nulls_last("cat"))


@query("unsure_split", """WITH o AS (SELECT page_id % 6 AS market, CASE page_id % 13 WHEN 0 THEN 'blocked' WHEN 1 THEN 'robots_blocked' WHEN 2 THEN 'social_only' WHEN 3 THEN 'dead' WHEN 4 THEN 'thin' WHEN 5 THEN 'js_shell' WHEN 6 THEN 'timeout' WHEN 7 THEN 'probe_error' ELSE 'ok' END AS outcome FROM pages),
c AS (SELECT market, count(*) FILTER (outcome NOT IN ('timeout', 'probe_error')) AS scored, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome IN ('blocked', 'robots_blocked')) AS blocked, count(*) FILTER (outcome IN ('social_only', 'dead')) AS no_site, count(*) FILTER (outcome IN ('thin', 'js_shell')) AS genuine FROM o GROUP BY market)
SELECT market, scored, round(100.0 * (scored - ok) / scored, 1)::DOUBLE AS not_ok_pct, round(100.0 * blocked / scored, 1)::DOUBLE AS blocked_pct, round(100.0 * no_site / scored, 1)::DOUBLE AS no_site_pct, round(coalesce(100.0 * genuine / nullif(scored - no_site, 0), 0), 1)::DOUBLE AS genuine_pct FROM c WHERE scored > 0""")
def unsure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why sites were not settled, by market: our own failures are no one's, and sites with nothing to read are answered."""
    i = F.col("page_id")
    outcome = F.lit("ok")
    for k, name in enumerate(("blocked", "robots_blocked", "social_only", "dead", "thin", "js_shell", "timeout", "probe_error")):
        outcome = F.when(i % 13 == k, name).otherwise(outcome)
    o = F.col("outcome")
    counted = _table(spark, sf_dir, "pages").select((i % 6).alias("market"), outcome.alias("outcome")).groupBy("market").agg(
        F.count_if(~o.isin(*evidence.OURS)).alias("scored"), F.count_if(o == "ok").alias("ok"), F.count_if(o.isin(*evidence.REFUSED)).alias("blocked"), F.count_if(o.isin("social_only", "dead")).alias("no_site"), F.count_if(o.isin("thin", "js_shell")).alias("genuine"),
    ).filter("scored > 0")
    percent = lambda part, whole: F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), 1)
    scored = F.col("scored")
    return counted.select("market", "scored", percent(scored - F.col("ok"), scored).alias("not_ok_pct"), percent(F.col("blocked"), scored).alias("blocked_pct"), percent(F.col("no_site"), scored).alias("no_site_pct"), percent(F.col("genuine"), scored - F.col("no_site")).alias("genuine_pct"))


@query("unit_economics", f"""WITH {FACTS_SQL}, cost AS (SELECT page_id AS id, page_id % 6 AS market, length(html) * 0.000001::DOUBLE AS usd FROM pages WHERE page_id % 8 <> 0),
v AS (SELECT id, count(*) FILTER (verdict IN ('match', 'no_match')) AS decided, count(*) FILTER (verdict = 'match') AS criterion, count(*) = count(*) FILTER (verdict = 'match') AS matched FROM facts GROUP BY id),
s AS (SELECT market, count(*) AS reads, sum(usd) AS spend, sum(decided)::BIGINT AS decided, sum(criterion)::BIGINT AS criterion, count(*) FILTER (matched) AS matched FROM cost JOIN v USING (id) GROUP BY market)
SELECT market, reads, decided, criterion, matched, round(spend, 6) AS spend, round(spend / reads, 9) AS per_read, round(spend / nullif(decided, 0), 9) AS per_decided, round(spend / nullif(criterion, 0), 9) AS per_criterion, round(spend / nullif(matched, 0), 9) AS per_match FROM s""")
def unit_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each market over what it bought: reads, decided criteria, matched criteria and matched businesses."""
    cost = _table(spark, sf_dir, "pages").filter("page_id % 8 <> 0").select(F.col("page_id").alias("id"), (F.col("page_id") % 6).alias("market"), (F.length("html") * F.lit(0.000001)).alias("usd"))
    v = F.col("verdict")
    of = _facts(spark, sf_dir).groupBy("id").agg(F.count_if(v.isin("match", "no_match")).alias("decided"), F.count_if(v == "match").alias("criterion"), (F.count("*") == F.count_if(v == "match")).alias("all_match"))
    summed = cost.join(of, "id").groupBy("market").agg(F.count("*").alias("reads"), F.sum("usd").alias("spend"), F.sum("decided").alias("decided"), F.sum("criterion").alias("criterion"), F.count_if("all_match").alias("matched"))
    per = lambda n: F.round(F.try_divide(F.col("spend"), F.col(n)), 9)
    return summed.select("market", "reads", "decided", "criterion", "matched", F.round("spend", 6).alias("spend"), per("reads").alias("per_read"), per("decided").alias("per_decided"), per("criterion").alias("per_criterion"), per("matched").alias("per_match"))

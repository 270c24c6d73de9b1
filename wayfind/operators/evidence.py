"""Verdicts of single criteria: from detectors, from a model whose quotes are held against the pages, and from what a site answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import folded, let
from wayfind.operators.judge import absence

# Which detector family bears on a criterion, by the criterion's words.
FAMILIES = (
    ("booking", r"(?i)\b(online booking|book online|appointment|booking (widget|system))\b"),
    ("quote_form", r"(?i)\b(quote|estimate|request a price)\b"),
    ("chat", r"(?i)\b(chat|live support|messenger)\b"),
)
REFUSED = ("blocked", "robots_blocked")
OURS = ("timeout", "probe_error")
#: A shorter quote proves nothing.
LEAST_QUOTE = 12


def family_of(text: Column, families=FAMILIES) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(family)) for family, pattern in families])


def readable(outcome: Column, pages: Column) -> Column:
    return (outcome == "ok") & (pages > 0)


def whole_site(outcome: Column, pages: Column, internal_links: Column, failures: Column) -> Column:
    """The home page is all there is, and nothing that was asked for failed to come."""
    return readable(outcome, pages) & (internal_links == 0) & (failures == 0)


def detector(criteria: DataFrame, signals: DataFrame, settle_on_generic: bool = False, families=FAMILIES) -> DataFrame:
    """id, criterion_id, verdict, source: absence criteria that a detected vendor disproves.

    Of criteria(criterion_id, type, text) and signals(id, family, name, vendor). What is not
    detected proves nothing, so only no_match is ever returned; a generic mark settles only
    where asked for.
    """
    able = criteria.filter("type = 'absence'").select("criterion_id", family_of(F.col("text"), families).alias("family")).filter("family is not null")
    found = signals.groupBy("id", "family").agg(F.min(F.when(F.col("vendor"), F.col("name"))).alias("source"), F.max(~F.col("vendor")).alias("generic"))
    settled = found.filter(F.col("source").isNotNull() | (F.col("generic") & F.lit(settle_on_generic)))
    return settled.join(able, "family").select("id", "criterion_id", F.lit("no_match").alias("verdict"), "source")


def batch(reads: DataFrame, criteria: DataFrame, detected: DataFrame, model: DataFrame) -> DataFrame:
    """id, criterion_id, verdict, settled_by: reads(id, outcome, pages, whole_site, text) against criteria.

    An unreadable site settles nothing; a detector settles first; a model's verdict counts
    only with a quote that stands on the pages; a model's absence match is judged by what
    was read; a criterion that the model(id, criterion_id, verdict, quote) left out is open.
    """
    narrow = criteria.select("criterion_id", "type")  # rows that a person wrote, so few that each site gets an array of its answers
    answers = model.groupBy("id").agg(F.collect_list(F.struct("criterion_id", "verdict", "quote")).alias("_answers"))
    held = lambda a, page: F.coalesce((a["verdict"] == "couldnt_tell") | ((F.length(folded(a["quote"])) >= LEAST_QUOTE) & F.contains(page, folded(a["quote"]))), F.lit(False))
    judged = let(folded(F.col("text")), lambda page: F.transform("_answers", lambda a: F.struct(a["criterion_id"].alias("criterion_id"), F.when(held(a, page), a["verdict"]).otherwise("couldnt_tell").alias("said"))))
    facts = reads.join(answers, "id", "left").select("id", "outcome", "pages", "whole_site", judged.alias("_judged"))  # the text stays here
    asked = facts.crossJoin(F.broadcast(narrow))
    settled = detected.select("id", "criterion_id", F.lit(True).alias("_detected"))
    mine = F.get(F.filter("_judged", lambda a: a["criterion_id"] == F.col("criterion_id")), F.lit(0))
    joined = asked.join(settled, ["id", "criterion_id"], "left").withColumn("_said", mine["said"])
    said = F.col("_said")
    no, pages = F.lit(False), F.col("pages")
    silent = absence(F.col("outcome"), no, no, F.col("whole_site"), pages, F.greatest(pages - 1, F.lit(0)), no, no)
    judged = (F.col("type") == "absence") & (said == "match")
    able, found = readable(F.col("outcome"), pages), F.coalesce("_detected", F.lit(False))
    verdict = F.when(~able, "couldnt_tell").when(found, "no_match").when(F.col("_said").isNull(), "couldnt_tell").when(judged, silent).otherwise(said)
    by = F.when(~able, "absence_rule").when(found, "detector").when(F.col("_said").isNotNull() & judged, "absence_rule").otherwise("model")
    return joined.select("id", "criterion_id", verdict.alias("verdict"), by.alias("settled_by"))


def health(presence: Column, dns: Column, tls: Column, no_https: Column, loaded: Column, outcome: Column) -> Column:
    """Whether a site is up and secure: broken or working only on positive evidence."""
    broken = dns.isin("nxdomain", "no_address") | tls.isNotNull() | no_https
    return (
        F.when(F.coalesce(broken, F.lit(False)), F.when(presence, "no_match").otherwise("match"))
        .when(loaded, F.when(presence, "match").otherwise("no_match"))
        .when(outcome.isin(*REFUSED), "blocked").otherwise("couldnt_tell")
    )


def live(presence: Column, outcome: Column, pages: Column, detected: Column, in_source: Column, hinted: Column, said: Column, quoted: Column, targeted: Column, reached: Column) -> Column:
    """A live read's verdict; said is null where no model ran.

    Detection proves presence alone. A signal that every page's source carries is absent
    where pages were read without it or a hint of it. An answer that something is there
    needs its quote on the pages; that it is not, pages reached where it would be.
    """
    there, missing = F.when(presence, "match").otherwise("no_match"), F.when(presence, "no_match").otherwise("match")
    asserts = presence == (said == "match")
    return (
        F.when((outcome == "js_shell") & detected, there)
        .when(in_source & ~detected & ~hinted & (pages > 0) & outcome.isin("ok", "js_shell"), missing)
        .when((outcome != "ok") | (pages == 0), F.when(outcome.isin(*REFUSED), "blocked").otherwise("couldnt_tell"))
        .when(detected, there).when(said.isNull(), "needs_model").when(~said.isin("match", "no_match"), "couldnt_tell")
        .when(asserts, F.when(quoted, said).otherwise("couldnt_tell"))
        .when((targeted > 0) & (reached == 0), "couldnt_tell").otherwise(said)
    )


def exported(read: Column, type_: Column, outcome: Column, pages: Column, signal: Column, covered: Column) -> Column:
    """The verdict that a market document carries, from a probe alone: without one nothing was read, and a presence needs a model."""
    no = F.lit(False)
    judged = absence(outcome, signal, F.lit(None).cast("boolean"), no, pages, F.greatest(pages - 1, F.lit(0)), no, covered)
    refused, ours = outcome.isin(*REFUSED), outcome.isin(*OURS)
    return F.when(~read, "unread").when(type_ != "absence", "needs_model").when((judged == "couldnt_tell") & refused, "blocked").when((judged == "couldnt_tell") & ours, "unread").otherwise(judged)


def why_matched(facts: DataFrame) -> DataFrame:
    """id, why: the matched criteria of facts(id, ordinal, text, verdict, proof) as one sentence part each, in order."""
    part = F.when(F.col("proof").isNotNull(), F.concat("text", F.lit(" ("), "proof", F.lit(")"))).otherwise(F.col("text"))
    rows = facts.filter("verdict = 'match'").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ordinal", part.alias("part")))).alias("parts"))
    return rows.select("id", F.array_join("parts.part", "; ").alias("why"))

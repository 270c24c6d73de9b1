"""Verdicts: absence, roll-up over criteria, and fit to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes that leave a site unread, and the pages that silence takes.
UNREADABLE = ("blocked", "robots", "timeout", "connect_error", "js_shell", "thin", "social", "no_site")
LEAST_PAGES = 2
#: Verdicts of several criteria, the one that decides first.
PRECEDENCE = ("blocked", "couldnt_tell", "needs_model", "unread")


def absence(outcome: Column, positive: Column, model_positive: Column, whole_site: Column, pages: Column, targeted: Column, abstained: Column, covered: Column) -> Column:
    """match only where pages enough were read and something able to notice found nothing."""
    return (
        F.when(outcome.isin(*UNREADABLE), "couldnt_tell")
        .when(positive | F.coalesce(model_positive, F.lit(False)), "no_match")
        .when(~whole_site & ((pages < LEAST_PAGES) | (targeted < 1)), "couldnt_tell")
        .when(whole_site & (pages < 1), "couldnt_tell")
        .when(abstained, "couldnt_tell")
        .when(~covered & model_positive.isNull(), "couldnt_tell")
        .otherwise("match")
    )


def roll_up(facts: DataFrame, businesses: DataFrame, criteria: int) -> DataFrame:
    """id, verdict: of facts(id, criterion_id, verdict) over a number of criteria; without criteria all match.

    A no_match decides; a match needs every criterion; a missing verdict is unread.
    """
    if not criteria:
        return businesses.select("id", F.lit("match").alias("verdict"))
    has = lambda v: F.count_if(F.col("verdict") == v)
    counted = facts.groupBy("id").agg(has("no_match").alias("no"), has("match").alias("yes"), *[has(v).alias(v) for v in PRECEDENCE])
    verdict = F.when(F.col("no") > 0, "no_match").when(F.col("yes") >= criteria, "match")
    for v in PRECEDENCE:
        verdict = verdict.when(F.col(v) > 0, v)
    return businesses.select("id").join(counted, "id", "left").select("id", verdict.otherwise("unread").alias("verdict"))


def tallies(facts: DataFrame) -> DataFrame:
    return facts.groupBy("criterion_id", "verdict").agg(F.count("*").alias("n"))


def fit(outcomes: DataFrame, subjects: DataFrame, reading_rules: bool, rules: int, musts: int) -> DataFrame:
    """id, fit: of outcomes(id, must, passed: null is unsettled) for subjects(id, pages).

    no: a must failed; unreadable: nothing read or nothing settled; strong: every must
    passed, or without musts all that was settled; maybe: the rest.
    """
    passed, must = F.col("passed"), F.col("must")
    counted = outcomes.groupBy("id").agg(
        F.count_if(passed.isNotNull()).alias("settled"), F.count_if(must & (passed == False)).alias("failed_musts"),  # noqa: E712
        F.count_if(must & passed).alias("passed_musts"), F.count_if(passed == False).alias("failed"),  # noqa: E712
    )
    joined = subjects.join(counted, "id", "left").fillna(0, ["settled", "failed_musts", "passed_musts", "failed"])
    read = F.col("pages") > 0
    verdict = F.when(~read & F.lit(reading_rules), "unreadable")
    if rules == 0:
        verdict = verdict.when(read, "strong").otherwise("unreadable")
    else:
        verdict = verdict.when(F.col("failed_musts") > 0, "no").when(F.col("settled") == 0, "unreadable")
        all_passed = (F.col("passed_musts") == musts) if musts else (F.col("failed") == 0)
        verdict = verdict.when(all_passed, "strong").otherwise("maybe")
    return joined.select("id", verdict.alias("fit"))


# The verdicts that a reader writes; any other is no verdict.
VERDICTS = ("match", "no_match", "couldnt_tell", "blocked", "needs_model", "unread")


def job_rows(sites: DataFrame) -> DataFrame:
    """sites(job_id, business_id, name, site, state, verdict, read_outcome, pages, proof) as businesses of a market named job:<job_id>.

    Only a site that is done has a read and a verdict; a verdict that is not known is
    unread, so that it is never taken for a match. An outcome that was not kept is ok.
    """
    done = F.coalesce(F.col("state") == "done", F.lit(False))
    verdict = F.when(done & F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("unread")
    read = F.when(done, F.struct(F.coalesce("read_outcome", F.lit("ok")).alias("outcome"), F.coalesce("pages", F.lit(0)).alias("pages")))
    proof = F.when(F.length("proof") > 0, F.col("proof"))
    return sites.select(F.concat(F.lit("job:"), F.col("job_id").cast("string")).alias("market"), F.col("business_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), "site", read.alias("read"), verdict.alias("verdict"), proof.alias("proof"))


def job_markets(rows: DataFrame) -> DataFrame:
    """market, businesses, read, proofs and one count a verdict of `job_rows`: worked out from the rows, not copied from a job's counters."""
    return rows.groupBy("market").agg(F.count("*").alias("businesses"), F.count("read").alias("read"), F.count("proof").alias("proofs"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])

"""Refunds, renewals, reads and upserts over an append-only ledger and a log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refunds(requests: DataFrame, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """request_id, refunded, reason, milli: requests(request_id, account_id, business_id) against entries(account_id, business_id, kind, milli, at).

    The refund is what the first charge took, whatever a band would cost now. Of requests
    for one business the first is granted and the later ones find it refunded.
    """
    key = ["account_id", "business_id"]
    charged = entries.filter("kind in ('match', 'no_website_unlock')").groupBy(*key).agg(F.min_by("milli", F.struct("at", "milli")).alias("charged"))
    before = entries.filter("kind = 'refund'").select(*key).distinct().withColumn("_before", F.lit(True))
    joined = requests.join(accounts.select("account_id").distinct().withColumn("_known", F.lit(True)), "account_id", "left").join(charged, key, "left").join(before, key, "left")
    again = F.row_number().over(Window.partitionBy(*key).orderBy("request_id")) > 1
    reason = (
        F.when(F.col("_known").isNull(), "No such account.").when(F.col("_before").isNotNull() | (again & F.col("charged").isNotNull()), "Already refunded.")
        .when(F.col("charged").isNull(), "Nothing was charged for this.")
    )
    return joined.withColumn("reason", reason).select("request_id", F.col("reason").isNull().alias("refunded"), "reason", F.when(F.col("reason").isNull(), -F.col("charged")).otherwise(0).cast("long").alias("milli"))


def renewals(balances: DataFrame) -> DataFrame:
    """account_id, carried, expired, granted of balances(account_id, milli, allowance): what is left carries up to one allowance."""
    left, cap = F.col("milli"), F.col("allowance")
    return balances.select("account_id", F.greatest(F.lit(0), F.least(left, cap)).alias("carried"), F.greatest(F.lit(0), left - cap).alias("expired"), cap.alias("granted"))


def spend_reads(asked: DataFrame) -> DataFrame:
    """request_id, allowed: asked(request_id, account_id, reads, allowance, at) in order, each as much as the period's allowance still holds.

    What is allowed so far is the lesser of what was asked so far and the allowance, so a
    running sum tells each share without a fold.
    """
    before = F.coalesce(F.sum("reads").over(Window.partitionBy("account_id").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return asked.withColumn("_b", before).select("request_id", (F.least(F.col("_b") + F.col("reads"), F.col("allowance")) - F.least("_b", "allowance")).cast("long").alias("allowed"))


def upserted_runs(runs: DataFrame, key: list[str]) -> DataFrame:
    """One row a key of runs(key..., at, run_id, matched, query): how often, when last, the latest count, and the latest query that is not null."""
    last = F.struct("at", "run_id")
    return runs.groupBy(*key).agg(F.count("*").alias("times"), F.max("at").alias("last_run_at"), F.max_by(F.greatest("matched", F.lit(0)), last).alias("matched"), F.max_by("query", F.when(F.col("query").isNotNull(), last)).alias("query"))


def first_claims(claims: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The claims with claimed: true for the first of each key, which alone may act."""
    return claims.withColumn("claimed", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def taken(sites: DataFrame, n: int) -> DataFrame:
    """job_sites with the next n pending ones of each job, in order, taken."""
    pending = F.col("state") == "pending"
    place = F.row_number().over(Window.partitionBy("job_id", "state").orderBy("ordinal"))
    return sites.withColumn("_p", place).withColumn("state", F.when(pending & (F.col("_p") <= n), "taken").otherwise(F.col("state"))).drop("_p")


def recorded(sites: DataFrame, results: DataFrame) -> DataFrame:
    """job_sites(job_id, ordinal, state, verdict, pages) after results(job_id, ordinal, verdict, pages) were written: nulls keep what was there."""
    new = results.select("job_id", "ordinal", F.col("verdict").alias("_v"), F.col("pages").alias("_p"), F.lit(True).alias("_done"))
    joined = sites.join(new, ["job_id", "ordinal"], "left")
    return joined.select("job_id", "ordinal", F.when(F.col("_done"), "done").otherwise(F.col("state")).alias("state"), F.coalesce("_v", "verdict").alias("verdict"), F.coalesce("_p", "pages").alias("pages"))


def appended(sites: DataFrame, more: DataFrame) -> DataFrame:
    """job_id, site, ordinal: sites(job_id, ordinal, site) and, after the last ordinal of each job, the listed more(job_id, sites) in their order."""
    last = sites.groupBy("job_id").agg(F.max("ordinal").alias("_last"))
    listed = more.select("job_id", F.posexplode("sites").alias("_i", "site")).join(last, "job_id", "left")
    return sites.select("job_id", "site", F.col("ordinal").cast("long")).union(listed.select("job_id", "site", (F.coalesce("_last", F.lit(0)) + F.col("_i") + 1).cast("long")))


def months_between(start: Column, end: Column) -> Column:
    """Whole calendar months: one less if the day of the month has not come yet."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def iso_week(day: Column) -> Column:
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))

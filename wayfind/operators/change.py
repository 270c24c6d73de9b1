"""What changed between two readings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.functions.stats import wilson
from wayfind.functions.text import digest16, folded

LEVELS = ("raw", "text", "normalised", "signals")


def levels(reads: DataFrame) -> DataFrame:
    """id and four hashes of reads(id, html, text, signals): each level forgives more."""
    plain = F.regexp_replace(folded(F.col("text")), "[0-9]+", "0")
    return reads.select("id", digest16(F.col("html")).alias("raw"), digest16(F.col("text")).alias("text"), digest16(plain).alias("normalised"), digest16(F.col("signals")).alias("signals"))


def change_rates(before: DataFrame, after: DataFrame) -> DataFrame:
    """level, shared, changed: over ids that both readings have."""
    pairs = before.alias("b").join(after.alias("a"), "id")
    changed = [F.count_if(F.col(f"b.{c}") != F.col(f"a.{c}")).alias(c) for c in LEVELS]
    one = pairs.agg(F.count("*").alias("shared"), *changed)
    return one.select("shared", F.stack(F.lit(len(LEVELS)), *[x for c in LEVELS for x in (F.lit(c), F.col(c))]).alias("level", "changed")).select("level", "shared", "changed")


def digest(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts: verdicts(id, signals, matched, blocked) now against then; equal signals are not judged again."""
    then = before.select("id", F.col("signals").alias("s0"), F.col("matched").alias("m0"), F.col("blocked").alias("b0"), F.lit(True).alias("was"))
    joined = after.join(then, "id", "left")
    new = F.col("was").isNull()
    same = ~new & F.col("signals").eqNullSafe(F.col("s0"))
    judged = ~new & ~same
    turned = judged & ~F.col("m0") & F.col("matched")
    return joined.agg(
        F.count_if(new & F.col("matched")).alias("new_matches"), F.count_if(turned & ~F.col("b0")).alias("changed_to_match"), F.count_if(turned & F.col("b0")).alias("newly_unblocked"),
        F.count_if(judged & F.col("m0") & ~F.col("matched")).alias("changed_to_no_match"), F.count_if(new | judged).alias("re_judged"), F.count_if(same).alias("unchanged"),
    )


# What changes on a page that has not changed, and what is put in its place, in this order.
SITE_NOISE = ((r"(?i)(?<![A-Za-z0-9_])[0-9]{1,2}:[0-9]{2}\s*(a\.?m\.?|p\.?m\.?)?", "TIME"), (r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "N"), (r"\s+", " "))


def rules_version(noise=SITE_NOISE) -> str:
    """A fingerprint of the rules: readings normalised by other rules cannot be compared on that level."""
    return hashlib.sha256(repr(noise).encode()).hexdigest()[:16]


def site_levels(pages: DataFrame, signals: DataFrame, noise=SITE_NOISE) -> DataFrame:
    """site, rules and four fingerprints over the site's pages(site, url, html, text) and its signals(site, family, name).

    A fingerprint is the sum of 60-bit hashes of the site's (url, content), or of its
    distinct signals, so that no site's pages meet in one task and their order is no
    matter. Null contents count as empty, pages without a site are left out; a site
    without signals has the sum 0.
    """
    plain = F.lower("text")
    for pattern, instead in noise:
        plain = F.regexp_replace(plain, pattern, instead)
    total = lambda *c: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(x, F.lit("")) for x in c]), 256), 1, 15), 16, 10).cast("decimal(20,0)"))
    read = pages.filter("site is not null").groupBy("site").agg(
        total(F.col("url"), F.col("html")).alias("raw"), total(F.col("url"), F.col("text")).alias("text"), total(F.col("url"), F.trim(plain)).alias("normalised")
    )
    marked = signals.select("site", "family", "name").distinct().groupBy("site").agg(total(F.col("family"), F.col("name")).alias("signals"))
    out = read.join(marked, "site", "left").select("site", *[F.coalesce(c, F.lit(0)).cast("string").alias(c) for c in LEVELS])
    return out.withColumn("rules", F.lit(rules_version(noise)))


def reread(before: DataFrame, after: DataFrame) -> DataFrame:
    """level, gone, new, shared, comparable, changed, rate, low, high: two readings of `site_levels` against each other.

    Rates are over sites that both readings have. The normalised level is compared only
    where both were made by the same rules: otherwise a change of the rules would be
    taken for one of the sites; changed, rate and bounds are then null.
    """
    names = {c: F.col(f"b.{c}") != F.col(f"a.{c}") for c in LEVELS}
    both = F.col("b.site").isNotNull() & F.col("a.site").isNotNull()
    one = before.alias("b").join(after.alias("a"), F.col("b.site") == F.col("a.site"), "full").agg(
        F.count_if(F.col("a.site").isNull()).alias("gone"), F.count_if(F.col("b.site").isNull()).alias("new"), F.count_if(both).alias("shared"),
        F.coalesce(F.min(F.when(both, F.col("b.rules") == F.col("a.rules"))), F.lit(True)).alias("same_rules"), *[F.count_if(both & d).alias(c) for c, d in names.items()],
    )
    listed = one.select("gone", "new", "shared", "same_rules", F.stack(F.lit(len(LEVELS)), *[x for c in LEVELS for x in (F.lit(c), F.col(c))]).alias("level", "n"))
    comparable = (F.col("level") != "normalised") | F.col("same_rules")
    low, high = wilson(F.col("n"), F.col("shared"))
    only = lambda c: F.when(comparable, c)
    return listed.select("level", "gone", "new", "shared", comparable.alias("comparable"), only(F.col("n")).alias("changed"), only(F.round(F.try_divide(F.col("n"), F.col("shared")), 4)).alias("rate"), only(F.round(low, 6)).alias("low"), only(F.round(high, 6)).alias("high"))

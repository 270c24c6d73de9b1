"""What may be shown or taken: suppressions, refusals, unlocked and locked rows, and summaries without identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREE_PREVIEW = 3
LEAST_MATCHES = 20
# What a site answered, in the order that the groups are listed, and whether the reason is ours.
UNSURE_GROUPS = (
    ("blocked", ("blocked", "robots_blocked"), False), ("dead", ("dead",), False), ("timeout", ("timeout",), False), ("http_error", ("http_error",), False), ("js_shell", ("js_shell",), False),
    ("social_only", ("social_only",), False), ("thin", ("ok", "thin"), False), ("needs_model", (), True), ("probe_error", ("probe_error",), True),
)
UNSURE = ("couldnt_tell", "blocked", "needs_model")


def refusals(verdicts: DataFrame, suppressed: DataFrame, unlocked: DataFrame) -> DataFrame:
    """id, code: why a row of verdicts(id, verdict) may not leave (null: it may); a suppression decides first, then the verdict."""
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    joined = verdicts.join(mark(suppressed, "_out"), "id", "left").join(mark(unlocked, "_paid"), "id", "left")
    code = F.when(F.col("_out").isNotNull(), "suppressed").when(F.col("verdict") != "match", "not_matched").when(F.col("_paid").isNull(), "not_unlocked")
    return joined.select("id", code.alias("code"))


def counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def visible(rows: DataFrame, unlocked: DataFrame, market: str, order: list, preview: int = FREE_PREVIEW) -> DataFrame:
    """rows(id, name, site, phone, ...) of each market in order: the first few and the unlocked in full, the others without what names them."""
    place = F.row_number().over(Window.partitionBy(market).orderBy(*order))
    joined = rows.withColumn("place", place).join(unlocked.select("id").distinct().withColumn("_paid", F.lit(True)), "id", "left")
    seen = (F.col("place") <= preview) | F.col("_paid").isNotNull()
    masked = [F.when(F.col("seen"), F.col(c)).alias(c) for c in ("name", "site", "phone")]
    return joined.withColumn("seen", seen).select(market, "place", "seen", F.when(F.col("seen"), F.col("id")).otherwise(F.concat(F.lit("locked-"), (F.col("place") - 1).cast("string"))).alias("id"), *masked)


def blind(judged: DataFrame) -> DataFrame:
    """What may be said of a row before anybody paid: fit, strength and reach, no identity."""
    share = F.try_divide(F.col("passed"), F.col("settled"))
    return judged.select("fit", F.round(share, 6).alias("strength"), (F.col("phone").isNotNull() | F.col("site").isNotNull()).alias("reachable"))


def unsure_group(verdict: Column, outcome: Column) -> Column:
    """The group of an unsure verdict, else null: needs_model by the verdict alone, all others by what the site answered."""
    by_outcome = F.coalesce(*[F.when(outcome.isin(*outcomes), F.lit(group)) for group, outcomes, _ in UNSURE_GROUPS if outcomes], F.lit("thin"))
    return F.when(verdict.isin(*UNSURE), F.when(verdict == "needs_model", "needs_model").otherwise(by_outcome))


def unsure_groups(rows: DataFrame, examples: int = 3) -> DataFrame:
    """place, group, ours, n, examples: rows(id, ordinal, verdict, outcome) that nothing settled, with the first few ids each."""
    grouped = rows.withColumn("group", unsure_group(F.col("verdict"), F.col("outcome"))).filter("group is not null")
    first = F.row_number().over(Window.partitionBy("group").orderBy("ordinal"))
    shown = grouped.withColumn("_n", first).groupBy("group").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_n") <= examples, F.struct("_n", "id")))).alias("_first"))
    place = F.coalesce(*[F.when(F.col("group") == g, F.lit(k)) for k, (g, _, _) in enumerate(UNSURE_GROUPS)])
    return shown.select(place.alias("place"), "group", F.col("group").isin(*[g for g, _, ours in UNSURE_GROUPS if ours]).alias("ours"), "n", F.array_join("_first.id", ",").alias("examples"))


def tallies_wide(facts: DataFrame, *by: str) -> DataFrame:
    """Counts of each verdict of facts(by..., verdict), one row a group."""
    kinds = ("match", "no_match", "couldnt_tell", "blocked", "needs_model", "unread")
    return facts.groupBy(*by).agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])


def settled_shares(tallies: DataFrame, *by: str) -> DataFrame:
    """How much of what was attempted was settled: by..., attempted, settled, settled_pct."""
    settled, attempted = F.col("match") + F.col("no_match"), F.col("match") + F.col("no_match") + F.col("couldnt_tell") + F.col("blocked") + F.col("needs_model")
    return tallies.select(*by, attempted.alias("attempted"), settled.alias("settled"), "needs_model", F.col("unread").alias("not_attempted"), F.round(F.coalesce(F.try_divide(100.0 * settled, attempted), F.lit(0.0)), 1).alias("settled_pct"))


def saturation(tallies: DataFrame, *by: str) -> DataFrame:
    """by..., matches, judged, published, why: groups with proven matches enough for a page, and why the others have none."""
    judged = F.col("match") + F.col("no_match") + F.col("couldnt_tell") + F.col("blocked")
    why = F.when(F.col("match") >= LEAST_MATCHES, F.lit(None)).when((F.col("match") == 0) & (F.col("needs_model") > 0), "nothing judged").otherwise("too few matches")
    return tallies.select(*by, F.col("match").alias("matches"), judged.alias("judged"), (F.col("match") >= LEAST_MATCHES).alias("published"), why.alias("why"))


def match_rates(tallies: DataFrame) -> DataFrame:
    """low, high, hits, zeroes: the spread of match rates over groups with something settled; those without a match stand apart."""
    settled = F.col("match") + F.col("no_match") + F.col("couldnt_tell") + F.col("blocked")
    rated = tallies.filter(settled > 0).withColumn("rate", F.col("match") / settled)
    hit = F.when(F.col("match") > 0, F.col("rate"))
    return rated.agg(F.round(F.min(hit), 6).alias("low"), F.round(F.max(hit), 6).alias("high"), F.count(hit).alias("hits"), F.count_if(F.col("match") == 0).alias("zeroes"))


def templates(tallies: DataFrame) -> DataFrame:
    """signal, polarity, matches, markets, published: a criterion's matches prove its own polarity and its no_matches the other."""
    both = tallies.select("market", "signal", F.explode(F.array(
        F.struct(F.col("type").alias("polarity"), F.col("match").alias("m")),
        F.struct(F.when(F.col("type") == "absence", "presence").otherwise("absence").alias("polarity"), F.col("no_match").alias("m")),
    )).alias("u")).select("market", "signal", "u.*")
    summed = both.groupBy("signal", "polarity").agg(F.sum("m").alias("matches"), F.count_if(F.col("m") > 0).alias("markets"))
    return summed.withColumn("published", F.col("matches") >= LEAST_MATCHES)

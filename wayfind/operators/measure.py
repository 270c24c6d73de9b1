"""Measuring: samples, projections, confusion, stop rules and ties by first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.stats import band_credits, half_up, wilson, wilson_corrected


def confusion(judged: DataFrame, by: str) -> DataFrame:
    """Counts and rates of judged(by, verdict, label): abstentions stand apart from wrong answers."""
    v, y = F.col("verdict"), F.col("label")
    counted = judged.groupBy(by).agg(
        F.count_if((v == "match") & (y == 1)).alias("tp"), F.count_if((v == "match") & (y == 0)).alias("fp"),
        F.count_if((v == "no_match") & (y == 1)).alias("fn"), F.count_if((v == "no_match") & (y == 0)).alias("tn"),
        F.count_if(v == "couldnt_tell").alias("abstained"), F.count_if((v == "couldnt_tell") & (y == 1)).alias("abstained_on_match"),
    )
    lo, hi = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fn") + F.col("abstained_on_match"), F.lit(0))
    precision = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    return counted.withColumns({"precision": F.round(precision, 6), "precision_lo": F.round(lo, 6), "precision_hi": F.round(hi, 6), "recall_delivered": F.round(recall, 6)})


def free_count(frame: DataFrame, by: str, sample: int = 25) -> DataFrame:
    """A projection of matches for each group of frame(by, id, matched), from a hash-drawn sample."""
    drawn = Window.partitionBy(by).orderBy(F.md5("id"), "id")
    picked = frame.withColumn("_n", F.row_number().over(drawn)).withColumn("_all", F.count("*").over(Window.partitionBy(by))).filter(F.col("_n") <= sample)
    counted = picked.groupBy(by).agg(F.max("_all").alias("frame"), F.count("*").alias("sampled"), F.count_if("matched").alias("matched"))
    lo, hi = wilson_corrected(F.col("matched"), F.col("sampled"))
    return counted.withColumns({"low": F.floor(lo * F.col("frame")).cast("long"), "high": F.ceil(hi * F.col("frame")).cast("long")})


def stop_rule(events: DataFrame, seeds: DataFrame) -> DataFrame:
    """sent and wanted: distinct addresses sent to and not bounced, and distinct that answered, seeds aside."""
    mine = events.withColumn("who", F.lower(F.trim("email"))).join(seeds.select(F.lower(F.trim("email")).alias("who")), "who", "left_anti")
    bounced = mine.filter("kind = 'bounced'").select("who").distinct()
    sent = mine.filter("kind = 'sent'").select("who").distinct().join(bounced, "who", "left_anti").agg(F.count("*").alias("sent"))
    wanted = mine.filter("kind = 'reply'").agg(F.countDistinct("who").alias("wanted"))
    return sent.crossJoin(wanted)  # one row each


def commonest(rows: DataFrame, by: str, value: str, ordinal: str) -> DataFrame:
    """Each group's most frequent value; of equal ones the first to appear."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"), F.min(ordinal).alias("_o"))
    return counted.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("less"), "_o", value)).alias("b")).select(by, F.col(f"b.{value}").alias(value), (-F.col("b.less")).alias("n"))


def strata_estimate(strata: DataFrame, by: str) -> DataFrame:
    """Matched over all places, each stratum scaled from its sampled cells to all: strata(by, cells, sampled, places, matched)."""
    scale = F.col("cells") / F.col("sampled")
    return strata.filter("sampled > 0").groupBy(by).agg((F.sum(F.col("matched") * scale) / F.nullif(F.sum(F.col("places") * scale), F.lit(0.0))).alias("estimate"))


def draw(rows: DataFrame, by: str, sizes: dict, id_: str = "id") -> DataFrame:
    """So many rows of each stratum, by a hash of the id."""
    order = Window.partitionBy(by).orderBy(F.md5(F.col(id_).cast("string")), id_)
    size = F.coalesce(*[F.when(F.col(by) == k, F.lit(n)) for k, n in sizes.items()], F.lit(0))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size).drop("_n")


# Dollars for a site that is read anew and for one that is known, and the seconds that a site takes.
COLD_READ, WARM_READ, WARN_ABOVE = 0.01, 0.002, 5000
SECONDS_A_PAGE, PAGES_A_SITE, SECONDS_BESIDES, AT_ONCE = 3.4, 1.5, 1.2, 12


def live_sites(checks: DataFrame) -> DataFrame:
    """checks(with_site, checked, dead) with exact and live: what was checked, carried to all; never 0 while some live."""
    share = 1 - F.col("dead") / F.col("checked")
    about = F.when(share > 0, F.greatest(F.lit(1), half_up(F.col("with_site") * share))).otherwise(0)
    exact = F.col("checked") >= F.col("with_site")
    live = F.when(exact, F.greatest(F.lit(0), F.col("with_site") - F.col("dead"))).otherwise(about)
    return checks.filter("checked > 0 and with_site > 0").withColumns({"exact": exact, "live": live.cast("long")})


def read_costs(asked: DataFrame) -> DataFrame:
    """What reading candidates costs, of asked(..., candidates, read), and how long it takes."""
    n, known = F.col("candidates"), F.col("read")
    unread = F.greatest(n - known, F.lit(0))
    return asked.withColumns({
        "unread": unread, "cold": F.round(unread * COLD_READ + known * WARM_READ, 6), "warm": F.round(n * WARM_READ, 6), "warm_share": F.round(F.coalesce(F.try_divide(known, n), F.lit(0.0)), 6),
        "over_budget": n > WARN_ABOVE, "seconds": F.round(n * (SECONDS_A_PAGE * PAGES_A_SITE + SECONDS_BESIDES) / AT_ONCE, 6),
    }).drop("candidates", "read")


def enriched(judged: DataFrame, filler: int) -> DataFrame:
    """id, kind, valid_for_recall: all hits of judged(id, hit) and so many others by hash; such a sample measures precision only."""
    others = judged.filter("not hit").orderBy(F.md5("id"), "id").limit(filler)
    return judged.filter("hit").select("id", F.lit("positive").alias("kind"), F.lit(False).alias("valid_for_recall")).union(others.select("id", F.lit("filler"), F.lit(False)))


def slug_parts(slugs: DataFrame, trades: DataFrame) -> DataFrame:
    """slug, trade, city, state of slugs like trade-in-city-st, by the known trades(trade), so that a city with "in" in its name does no harm."""
    heads = slugs.select("slug", F.substring_index("slug", "-in-", 1).alias("trade"))
    rest = F.substring("slug", F.length("trade") + 5, F.length("slug"))
    known = heads.join(trades, "trade").withColumn("rest", rest).filter(F.col("rest").rlike("^.+-[a-z]{2}$"))
    return known.select("slug", "trade", F.regexp_extract("rest", "^(.+)-([a-z]{2})$", 1).alias("city"), F.upper(F.regexp_extract("rest", "^(.+)-([a-z]{2})$", 2)).alias("state"))


def stop_verdict(reached: Column, wanted: Column, people: Column) -> Column:
    """working once anybody wanted it, stop when so many were reached and none did, testing before."""
    return F.when(wanted > 0, "working").when(reached >= people, "stop").otherwise("testing")


# Plans with their price and credits, and what a place, its details and its reviews cost.
PLANS = (("Starter", 29.0, 120), ("Growth", 79.0, 400), ("Agency", 199.0, 1000))
PLACE_COST, REVIEWS_COST = 0.0015, 0.002 + 0.0005 * 12


def margins(niches: DataFrame) -> DataFrame:
    """niche, plan, policy, margin of niches(niche, spend, reads, matched): reviews are bought for every read, or for matches alone."""
    cells = niches.filter("matched > 0").withColumn("plan", F.explode(F.array(*[F.struct(F.lit(n).alias("plan"), F.lit(p).alias("price"), F.lit(c).alias("credits")) for n, p, c in PLANS])))
    cells = cells.select("niche", "spend", "reads", "matched", "plan.*").withColumn("policy", F.explode(F.array(F.lit("every"), F.lit("match"))))
    revenue = F.col("price") / F.col("credits") * band_credits(F.col("matched") / F.col("reads"))
    every = F.col("policy") == "every"
    read = F.col("spend") / F.col("reads") + PLACE_COST + F.when(every, REVIEWS_COST).otherwise(0.0)
    cost = read * F.col("reads") / F.col("matched") + F.when(every, 0.0).otherwise(REVIEWS_COST)
    return cells.withColumn("margin", (revenue - cost) / revenue)


def gap_fill(runs: DataFrame, pools: DataFrame, per_place: float) -> DataFrame:
    """market, read_cost, per_match: the dearest of runs(market, per_read), and a match's cost in pools(market, places, missing, matched)."""
    dearest = runs.groupBy("market").agg(F.max("per_read").alias("read_cost"))
    whole = F.col("read_cost") + per_place * F.col("missing") / F.col("places")
    return pools.filter("matched > 0").join(dearest, "market").withColumn("per_match", whole * F.col("places") / F.col("matched"))


# The least precision and delivered recall of a release.
PRECISION, RECALL = 0.90, 0.60
ENRICHED = "enriched_on_engine_positives"


def scored(labels: DataFrame, verdicts: DataFrame, designs: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row a set and kind of criterion, and one a set over all kinds: what labels say of verdicts, as far as the set's design allows.

    labels(set, id, criterion_id, kind, label), verdicts(set, id, criterion_id, said),
    designs(set, sampling), sampled(set, id: positives when an enriched set was drawn).
    A business without any verdict counts once (not_judged, in the row of all kinds); a
    pair without one is "unread". Labels of wrong sites or that people could not settle,
    and verdicts that settle nothing, are counted apart. An abstention on a true match
    is a miss of delivered recall. A set drawn among the engine's positives cannot tell
    recall: its columns are null there, and kept is the share of the positives it was
    drawn from that still are positives (all verdicts match). A set without a design is
    a complete slice. Repeated labels count each, of repeated verdicts the least counts.
    """
    said = verdicts.groupBy("set", "id", "criterion_id").agg(F.min("said").alias("said")).groupBy("set", "id").agg(F.collect_list(F.struct("criterion_id", F.coalesce("said", F.lit("unread")).alias("said"))).alias("v"))  # a row a criterion
    asked = labels.groupBy("set", "id").agg(F.collect_list(F.struct("criterion_id", "kind", "label")).alias("l"))
    pair = lambda x: F.coalesce(F.get(F.filter("v", lambda y: y["criterion_id"] == x["criterion_id"]), F.lit(0))["said"], F.lit("unread"))
    outcome = lambda x: (
        F.when(x["label"] == "wrong_site", "wrong_site").when(~F.coalesce(x["label"].isin("match", "no_match"), F.lit(False)), "unsettled_label")
        .when(pair(x) == "couldnt_tell", F.when(x["label"] == "match", "abstained_on_match").otherwise("abstained")).when(~pair(x).isin("match", "no_match"), "unsettled_verdict")
        .otherwise(F.concat(F.when(pair(x) == x["label"], "t").otherwise("f"), F.when(pair(x) == "match", "p").otherwise("n")))
    )
    row = lambda kind, found: F.struct(kind.alias("kind"), found.alias("found"))
    each = asked.join(said, ["set", "id"], "left").select(
        "set",
        F.explode(F.when(F.col("v").isNull(), F.array(row(F.lit("all"), F.lit("not_judged")))).otherwise(F.flatten(F.transform("l", lambda x: F.array(row(x["kind"], outcome(x)), row(F.lit("all"), outcome(x))))))).alias("r"),
    )
    n = lambda *names: F.count_if(F.col("r.found").isin(*names))
    counted = each.groupBy("set", F.col("r.kind").alias("kind")).agg(
        F.count_if(F.col("r.found") != "not_judged").alias("pairs"), *[n(k).alias(k) for k in ("tp", "fp", "fn", "tn")], n("abstained", "abstained_on_match").alias("abstained"),
        *[n(k).alias(k) for k in ("abstained_on_match", "not_judged", "wrong_site", "unsettled_label", "unsettled_verdict")],
    )
    positive = said.filter(F.forall("v", lambda y: y["said"] == "match")).select("set", "id", F.lit(1).alias("still"))
    kept = sampled.distinct().join(positive, ["set", "id"], "left").groupBy("set").agg((F.count("still") / F.count("*")).alias("kept"))
    enriched = designs.filter(F.col("sampling") == ENRICHED).select("set", F.lit(True).alias("enriched")).distinct()
    known = counted.join(enriched, "set", "left").withColumn("enriched", F.coalesce("enriched", F.lit(False))).join(kept, "set", "left")

    def rated(name: str, whole: Column, target: float, shown: Column) -> dict:
        lo, hi = wilson(F.col("tp"), whole)
        word = F.when(lo >= target, "passes").when(hi < target, "fails").otherwise("undecided")
        shown = shown & (whole > 0)
        return {name: F.when(shown, F.round(F.col("tp") / whole, 6)), f"{name}_low": F.when(shown, F.round(lo, 6)), f"{name}_high": F.when(shown, F.round(hi, 6)), f"{name}_gate": F.when(shown, word)}

    found = F.col("tp") + F.col("fn")
    return known.withColumns({
        **rated("precision", F.col("tp") + F.col("fp"), PRECISION, F.lit(True)), **rated("recall", found + F.col("abstained_on_match"), RECALL, ~F.col("enriched")),
        "recall_decided": F.when(~F.col("enriched") & (found > 0), F.round(F.col("tp") / found, 6)), "kept": F.when(F.col("enriched"), F.round("kept", 6)),
    })

# Outcomes that measure the reader and not the site, and those of pages with something to read.
OURS, READ = ("timeout", "probe_error"), ("ok", "thin")


def market_summary(sites: DataFrame, marks: DataFrame, family: str, others: tuple[str, ...] = (), top: int = 10) -> DataFrame:
    """One row a market of sites(market, site, outcome, ordinal): outcomes, and how many sites show a family of signals, where and by which vendors.

    marks(site, family, name, vendor, home) are what was found on the sites' pages, home
    where it was on the first. Our own failures leave every rate of sites but are shown
    beside them. Signals are looked for on sites with something to read: found counts
    them, beyond those whose home page alone shows none. Vendors are a report of the
    `top` most common, as "name=sites", of equal ones that which a site of a lower
    ordinal shows first. Rates are percents of one digit, 0 without sites.
    """
    kinds = [family, *others]
    by_site = marks.filter(F.col("family").isin(kinds)).groupBy("site").agg(
        F.max((F.col("family") == family).cast("int")).alias("shows"), F.max(((F.col("family") == family) & F.col("home")).cast("int")).alias("at_home"),
        *[F.max((F.col("family") == f).cast("int")).alias(f"_{f}") for f in others],
    )
    known = sites.join(by_site, "site", "left").withColumns({"ours": F.col("outcome").isin(*OURS), "read": F.col("outcome").isin(*READ)})
    shows = F.col("read") & (F.coalesce("shows", F.lit(0)) == 1)
    one = known.groupBy("market").agg(
        F.count("*").alias("sampled"), F.count_if(~F.col("ours")).alias("scored"), F.count_if("ours").alias("excluded"), *[F.count_if(F.col("outcome") == k).alias(k) for k in OURS],
        F.count_if(F.col("outcome") == "ok").alias("judgeable"), F.count_if("read").alias("considered"), F.count_if(shows).alias("found"), F.count_if(shows & (F.col("at_home") == 0)).alias("beyond"),
        *[F.count_if(F.col("read") & (F.coalesce(f"_{f}", F.lit(0)) == 1)).alias(f"_{f}") for f in others],
    )
    # A vendor's sites are counted before they are ranked, so a market's window holds one row a vendor.
    named = marks.filter((F.col("family") == family) & F.col("vendor")).select("site", "name").distinct().join(known.filter("read").select("market", "site", "ordinal"), "site")
    counted = named.groupBy("market", "name").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "name")).alias("o"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("n"), "o"))).filter(F.col("rank") <= top)
    vendors = ranked.groupBy("market").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda v: F.concat_ws("=", v["name"], v["n"].cast("string"))).alias("vendors"))
    pct = lambda part, whole: F.coalesce(F.round(F.try_divide(100.0 * part, F.col(whole)), 1), F.lit(0.0))
    return one.join(vendors, "market", "left").select(
        "market", "sampled", "scored", "excluded", pct(F.col("excluded"), "sampled").alias("excluded_pct"), *OURS, pct(F.col("judgeable"), "scored").alias("judgeable_pct"), pct(F.col("scored") - F.col("judgeable"), "scored").alias("floor_pct"),
        "considered", "found", pct(F.col("found"), "considered").alias("found_pct"), "beyond", pct(F.col("beyond"), "considered").alias("beyond_pct"),
        *[pct(F.col(f"_{f}"), "considered").alias(f"{f}_pct") for f in others], F.coalesce("vendors", F.array().cast("array<string>")).alias("vendors"),
    )

"""Which trades an agency says it serves: sentences about its work that name a trade, a quote that proves it, and the trade to write about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import let

# The trades told apart, each with the words that name it, and whether it counts only where the site leads with it.
TRADES = (
    ("dental", r"dental|dentists?|dentistry|orthodont\w*", False),
    ("medspa", r"med ?spas?|medical spas?|aesthetic (?:clinics?|practices?)|medspas?", False),
    ("hvac", r"hvac|heating and (?:air|cooling)|air conditioning", False),
    ("plumbing", r"plumbers?|plumbing", False),
    ("roofing", r"roofers?|roofing", False),
    ("legal", r"law firms?|attorneys?(?![’']? fees)|lawyers?|legal practices?", False),
    ("chiro", r"chiropract\w*", False),
    ("vet", r"veterinar\w*|vet clinics?|animal hospitals?", False),
    ("realestate", r"real estate agents?|realtors?|real estate brokerages?", False),
    ("restaurant", r"restaurants?|restaurateurs?", True),
    ("landscaping", r"landscapers?|landscaping|landscape (?:design|contractors?|companies|company)|lawn care", False),
    ("electrical", r"electricians?|electrical contractors?", False),
    ("physio", r"physical therap\w+|physiotherap\w+", False),
    ("salon", r"hair salons?|beauty salons?|salons? and spas?", False),
)
# Words of a sentence about marketing work.
CUE = (
    r"marketing|market|seo|search|websites?|web design|ads|advertis\w*|leads?|clients?|brand\w*|grow\w*|campaigns?|patients|customers|social media|ppc|google|agency|digital|online|calls?|bookings?|reviews?"
)
# Named character references that are read, and what they stand for.
REFERENCES = ((r"&#8217;|&#039;|&#39;|&rsquo;|&lsquo;", "'"), (r"&#8220;|&#8221;|&ldquo;|&rdquo;|&quot;", '"'), (r"&#8211;|&#8212;|&ndash;|&mdash;", "-"), (r"&nbsp;|&#160;", " "))
#: A quote's length, what is kept on each side of the words that name the trade, and the shortest that is preferred.
LONGEST, AROUND, FAIR = 180, 80, 25
#: Mentions that make a trade strong, and how many trades a site may name before only one it leads with counts.
STRONG, GENERALIST = 3, 5


def word(pattern: str) -> str:
    """A pattern between edges of words, words being of ASCII letters, digits and underscores."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def decoded(text: Column) -> Column:
    """Named and numeric character references read; a number that no character has stays as it is."""
    out = reduce(lambda t, r: F.regexp_replace(t, *r), REFERENCES, text)

    def read(t: Column, pattern: str, number) -> Column:
        return let(t, lambda v: F.aggregate(F.array_distinct(F.regexp_extract_all(v, F.lit(pattern), F.lit(0))), v, lambda done, ref: F.replace(done, ref, F.coalesce(_character(number(ref)), ref))))

    out = read(out, r"&#[xX][0-9a-fA-F]{1,6};", lambda r: F.conv(F.regexp_extract(r, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long"))
    out = read(out, r"&#[0-9]{1,7};", lambda r: F.regexp_extract(r, "([0-9]+)", 1).cast("long"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _character(code: Column) -> Column:
    known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def sentences(text: Column, least: int = 12) -> Column:
    """Sentences as written: a mark before a blank ends one, and so does a new line, a bullet or a bar."""
    parts = F.split(decoded(text), r"(?<=[.!?])\s+|\s*[\n•|]+\s*")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) >= least)


def excerpt(sentence: Column, at: Column) -> Column:
    """The sentence, or the stretch around its at-th character (from 0), cut between words and marked as cut."""
    start, end = F.greatest(at - AROUND, F.lit(0)), F.least(at + AROUND, F.length(sentence))
    cut = F.substring(sentence, start + 1, end - start)
    cut = F.when(start > 0, F.concat(F.lit("…"), F.regexp_replace(cut, r"^\S*\s", ""))).otherwise(cut)
    cut = F.when(end < F.length(sentence), F.concat(F.regexp_replace(cut, r"\s\S*$", ""), F.lit("…"))).otherwise(cut)
    return F.when(F.length(sentence) <= LONGEST, sentence).otherwise(cut)


def served(pages: DataFrame, reads_like_prose) -> DataFrame:
    """id, niche, ordinal, mentions, leads, strong, quote of pages(id, ordinal, headline, text); a site has as many pages as it likes.

    mentions counts distinct sentences, case aside, that name the trade and speak of
    marketing work; leads holds where a headline of the site names it. A trade is left out
    where no prose sentence can be quoted, or where it must be led with and is not. Texts
    and headlines that are null or empty name nothing. Only sentences that pass one test
    for all trades are told apart, and what is shuffled is those sentences, never pages.
    """
    any_trade = word("|".join(p for _, p, _ in TRADES))
    held = lambda c: F.array_compact(F.array(*[F.when(c.rlike(word(p)), F.struct(F.lit(n).alias("ordinal"), F.lit(k).alias("niche"), F.regexp_instr(c, F.lit(word(p))).alias("at"))) for n, (k, p, _) in enumerate(TRADES)]))
    split = pages.select("id", F.col("ordinal").alias("page"), F.posexplode(F.filter(sentences(F.col("text")), lambda s: s.rlike(any_trade) & s.rlike(word(CUE)))).alias("n", "s"))
    named = split.select("id", "page", "n", "s", reads_like_prose(F.col("s")).alias("prose"), F.explode(held(F.col("s"))).alias("t"))
    # Equal sentences are one before anything is counted; the first of them stands for all.
    rank = F.struct((F.length("s") < FAIR).alias("short"), F.length("s").alias("length"), "page", "n", "s", F.col("t.at").alias("at"))
    each = named.groupBy("id", "t.niche", "t.ordinal", F.lower("s").alias("folded")).agg(F.min(F.when(F.col("prose"), rank)).alias("best"))
    counted = each.groupBy("id", "niche", "ordinal").agg(F.count("*").alias("mentions"), F.min("best").alias("best")).filter("best is not null")
    heads = pages.select("id", decoded(F.col("headline")).alias("h")).filter(F.col("h").rlike(any_trade)).select("id", F.explode(held(F.col("h"))["niche"]).alias("niche")).distinct().withColumn("leads", F.lit(True))
    led_only = [k for k, _, only in TRADES if only]
    out = counted.join(heads, ["id", "niche"], "left").withColumn("leads", F.coalesce("leads", F.lit(False))).filter(F.col("leads") | ~F.col("niche").isin(led_only))
    return out.select("id", "niche", "ordinal", "mentions", "leads", (F.col("leads") | (F.col("mentions") >= STRONG)).alias("strong"), excerpt(F.col("best.s"), F.col("best.at") - 1).alias("quote"))


def primary(found: DataFrame) -> DataFrame:
    """id, niche, quote: the strongest trade of `served`'s rows: led with, then most mentioned, then first in the catalogue.

    A site that names more than five trades and leads with none is a generalist and has no row.
    """
    order = F.struct((~F.col("leads")).alias("a"), (-F.col("mentions")).alias("b"), "ordinal", "niche", "quote")
    one = found.groupBy("id").agg(F.count("*").alias("trades"), F.min(F.when(F.col("strong"), order)).alias("best")).filter("best is not null")
    return one.filter((F.col("trades") <= GENERALIST) | ~F.col("best.a")).select("id", "best.niche", "best.quote")

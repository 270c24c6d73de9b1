"""URL filters: listed rules, and empirical-Bayes host reputation where none fits.

Labelled page outcomes (1 good, 0 bad) are counted by host. A beta-binomial prior goes
down the levels: the suffixes' rates are shrunk to the overall rate, each registered
domain's to its suffix's, each host's to its domain's. The strength of each prior
follows from how much the children's rates differ beyond chance (method of moments). A
host is blocked when the upper bound of its posterior rate is below the overall rate.

DataFrame functions only. Defined results: a null url, or one without "://", has an
empty host and path; a null page_id is kept and has no label; repeated rows are judged
alike, each of them an outcome if labelled; several labels of one id count as the least;
without labels nothing but the rules blocks; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.shrinkage import strength

#: Verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of two labels under which domains are registered; all others have one.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "github.io", "gov.uk", "net.au", "org.au", "org.uk")
Z = 1.645
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """A host's registered domain and its suffix, the port aside; an IPv4 address is a domain of its own without a suffix."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    address, two = bare.rlike(r"^[0-9.]+$"), F.substring_index(bare, ".", -2)
    long = two.isin(*suffixes)
    domain = F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(address, "").when(long, two).otherwise(F.substring_index(bare, ".", -1))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, rate, upper, floor: posterior mean and upper bound, and the overall rate, of hosts with labels."""
    outcome = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.min("quality").cast("long").alias("good"))
    hosts = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host")).join(outcome, "page_id")
        .groupBy("host").agg(F.sum("good").alias("k"), F.count("*").alias("n"))
        .withColumns(dict(zip(("domain", "suffix"), domain_and_suffix(F.col("host")), strict=True)))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    overall = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("floor"))
    s1, s2, s3 = (strength(x).withColumnRenamed("strength", f"s{i}") for i, x in ((1, suffixes), (2, domains), (3, hosts)))
    constants = overall.crossJoin(s1).crossJoin(s2).crossJoin(s3)  # one row each
    by_suffix = suffixes.crossJoin(F.broadcast(constants)).select("suffix", "floor", "s2", "s3", ((F.col("k") + F.col("s1") * F.col("floor")) / (F.col("n") + F.col("s1"))).alias("p_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "floor", "s3", ((F.col("k") + F.col("s2") * F.col("p_suffix")) / (F.col("n") + F.col("s2"))).alias("p_domain"))
    a, b = F.col("k") + F.col("s3") * F.col("p_domain"), F.col("n") - F.col("k") + F.col("s3") * (1 - F.col("p_domain"))
    rate = a / (a + b)
    return hosts.join(by_domain, "domain").select("host", "floor", rate.alias("rate"), (rate + Z * F.sqrt(rate * (1 - rate) / (a + b + 1))).alias("upper"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row a page."""
    known = reputations(pages, labels).filter("upper < floor").select(F.col("host").alias("_host"))
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    joined = parts.join(known, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))

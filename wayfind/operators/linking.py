"""Which links of a page are worth following: same-site addresses by the keywords in their path and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import let, visible_text

# Words that make a page worth reading, where a search names none.
KEYWORDS = (("services", 5), ("contact", 4), ("about", 2))
LINK = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)(?=</a>|<a\b|\z)"""


def parts_of(url: Column) -> Column:
    """scheme, host, path of an absolute address; query and fragment dropped."""
    at = lambda k: F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)", k)
    return F.struct(F.lower(at(1)).alias("scheme"), at(2).alias("host"), at(3).alias("path"))


def without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken."""
    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    ends = F.when(F.element_at(F.split(path, "/"), -1).isin(".", ".."), "/").otherwise("")
    plain = F.concat(F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"), ends)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), plain).otherwise(path)


def joined(base: Column, href: Column) -> Column:
    """scheme, host, path of a link as its page means it; base: parts_of the page's address."""
    def resolved(raw: Column) -> Column:
        own = parts_of(raw)
        bare = F.regexp_extract(raw, r"(?s)^([^?#]*)", 1)
        away = F.regexp_extract(bare, r"(?s)^//([^/]*)", 1)
        folder = F.regexp_replace(base["path"], "[^/]*$", "")
        path = (
            F.when(F.startswith(bare, F.lit("//")), F.regexp_replace(bare, "^//[^/]*", "")).when(F.startswith(bare, F.lit("/")), bare)
            .when(bare == "", base["path"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), bare))
        )
        near = F.struct(base["scheme"].alias("scheme"), F.when(away != "", away).otherwise(base["host"]).alias("host"), without_dots(path).alias("path"))
        return F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.struct(own["scheme"].alias("scheme"), own["host"].alias("host"), without_dots(own["path"]).alias("path"))).otherwise(near)

    return let(F.trim(href), resolved)


def ranked_links(pages: DataFrame, keywords: tuple[tuple[str, int], ...] = KEYWORDS, most: int = 6) -> DataFrame:
    """page_id, rank, link, score of pages(page_id, url, html): at most `most` links of the same host, the highest scores first, then the shortest, then the first.

    A link scores the weights of the keywords that its path or text holds; a page's
    address itself and links without a keyword are left out; a repeated link keeps its
    greatest score. Only links that score leave their page's row.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"^www\.", "")
    own = parts_of(F.trim("url"))
    raw = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("text"))
    held = pages.select("page_id", "url", own.alias("own"), raw.alias("raw"))

    def weighed(x: Column, i: Column) -> Column:
        def score(to: Column) -> Column:
            said = F.concat(F.lower(to["path"]), F.lit(" "), F.lower(visible_text(x["text"])))
            points = let(said, lambda words: sum((F.when(F.contains(words, F.lit(w)), weight).otherwise(0) for w, weight in keywords), F.lit(0)))
            link = F.concat(to["scheme"], F.lit("://"), to["host"], to["path"])
            able = to["scheme"].isin("http", "https") & (bare(to["host"]) == bare(F.col("own.host"))) & (F.rtrim(link, F.lit("/")) != F.rtrim(F.col("url"), F.lit("/")))
            return F.when(able, F.struct(link.alias("link"), points.alias("score"), i.alias("at")))

        return let(joined(F.col("own"), x["href"]), score)

    scored = held.select("page_id", F.filter(F.transform("raw", weighed), lambda x: x["score"] > 0).alias("found"))
    best = scored.select("page_id", F.explode("found").alias("x")).groupBy("page_id", "x.link").agg(F.max("x.score").alias("score"), F.min("x.at").alias("at"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.length("link").alias("length"), "at", "link")))  # one page's links
    return best.groupBy("page_id").agg(F.slice(order, 1, most).alias("top")).select("page_id", F.posexplode("top").alias("rank", "t")).select("page_id", (F.col("rank") + 1).alias("rank"), "t.link", (-F.col("t.less")).alias("score"))

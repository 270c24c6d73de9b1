"""Uploaded lists of websites, and delimited files out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions.text import host_of

# What headers call a column, and how a website looks.
HEADERS = {
    "site": r"(?i)^(website|web ?site|url|domain|site|homepage|web|company ?url|website ?url)$",
    "name": r"(?i)^(name|business|business ?name|company|company ?name|organi[sz]ation|account)$",
    "phone": r"(?i)^(phone|telephone|tel|phone ?number|mobile|contact ?number)$",
}
SITE_LIKE = r"(?i)^(https?://)?[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+)+(/|$|\?|#)"
MOST, HEADER_LINES = 5000, 5


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a quoted file as strings _c0, _c1 ..., with quoted line ends and doubled quotes."""
    return spark.read.csv(path, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def roles(header: list[str | None]) -> dict[str, int]:
    """Which column has which role, by the names in a header row."""
    import re

    return {role: i for role, pattern in HEADERS.items() for i, name in reversed(list(enumerate(header))) if name and re.match(pattern, name.strip())}


def map_upload(rows: DataFrame, site: Column, name: Column, phone: Column, line: Column, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows skipped with their reason): one row a site, the first line wins."""
    shaped = rows.select(line.cast("long").alias("line"), host_of(site).alias("site"), F.trim(name).alias("name"), F.trim(phone).alias("phone"))
    order = Window.partitionBy("site").orderBy("line")
    ranked = shaped.filter("site is not null").withColumn("_n", F.row_number().over(order))  # lines without a site are not gathered
    first = ranked.filter("_n = 1").drop("_n")
    kept = first.orderBy("line").limit(most)
    beyond = first.join(kept.select("line"), "line", "left_anti").select("line", "site", F.lit("beyond the limit").alias("reason"))
    repeated = ranked.filter("_n > 1").select("line", "site", F.lit("repeated website"))
    return kept, shaped.filter("site is null").select("line", "site", F.lit("no website").alias("reason")).union(repeated).union(beyond)


def write_delimited(rows: DataFrame, to: str) -> None:
    """Quoted where needed; one header row in each part file."""
    rows.write.mode("overwrite").csv(to, header=True, quote='"', escape='"', lineSep="\n", emptyValue="")


@dataclass
class Layout:
    """The line of the headers, and the column of each role; None: there is none."""

    header_line: int
    site: str | None
    name: str | None
    phone: str | None


def layout(rows: DataFrame, line: str) -> Layout | None:
    """Where the headers and the columns of rows are, whose other columns are strings; None without rows.

    The first of the first five lines with a website's header is the header line, else the
    first line is. A website column without a known header is the first of those with most
    websites below the headers, if at least half of the lines have one there. All columns
    are profiled in one aggregation, and only these few numbers reach the driver.
    """
    columns = [c for c in rows.columns if c != line]
    cell = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))
    top = rows.filter(F.exists(F.array(*[cell(c) for c in columns]), lambda v: v != "")).orderBy(line).limit(HEADER_LINES).collect()
    if not top:
        return None
    text = lambda r, c: (r[c] or "").strip()
    header = next((r for r in top if any(re.match(HEADERS["site"], text(r, c)) for c in columns)), top[0])
    role = {k: next((c for c in columns if re.match(pattern, text(header, c))), None) for k, pattern in HEADERS.items()}
    if role["site"] is None:
        below = rows.filter(F.col(line) > header[line])
        profile = below.agg(F.count("*").alias("_lines"), *[F.count_if(cell(c).rlike(SITE_LIKE)).alias(c) for c in columns]).first()
        best = max(columns, key=lambda c: profile[c])
        role["site"] = best if profile[best] >= max(1, profile["_lines"] * 0.5) else None
    return Layout(header[line], role["site"], role["name"], role["phone"])


def site_root(raw: Column) -> Column:
    """https:// and the host without www. of what looks like a website; else null."""
    host = F.regexp_extract(F.regexp_replace(F.lower(F.trim(raw)), "^https?://", ""), r"^([^/?#]*)", 1)
    return F.when(F.trim(raw).rlike(SITE_LIKE), F.concat(F.lit("https://"), F.regexp_replace(host, r"^www\.", "")))


def read_upload(rows: DataFrame, line: str, most: int = MOST) -> DataFrame:
    """line, site, name, phone, why of every line below the headers: why is null for lines taken.

    One line a website, the first; a line without one says what stood there. Lines beyond
    the limit are reported, not dropped. Empty lines are no lines.
    """
    found = layout(rows, line)
    if found is None:
        return rows.select(F.col(line).cast("long").alias("line"), *[F.lit(None).cast("string").alias(c) for c in ("site", "name", "phone", "why")]).limit(0)
    columns = [c for c in rows.columns if c != line]
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c else F.lit(None).cast("string")
    body = rows.filter(F.col(line) > found.header_line).filter(F.exists(F.array(*[F.coalesce(cell(c), F.lit("")) for c in columns]), lambda v: v != ""))
    shaped = body.select(F.col(line).cast("long").alias("line"), cell(found.site).alias("raw"), site_root(cell(found.site)).alias("site"), cell(found.name).alias("name"), cell(found.phone).alias("phone"))
    bad = F.when(F.col("raw").isNull(), "no website in this row").otherwise(F.concat(F.lit('"'), F.left("raw", F.lit(40)), F.lit('" is not a website we can open')))
    sited = shaped.filter("site is not null")
    first = sited.groupBy("site").agg(F.min("line").alias("first"))
    kept = first.select(F.col("first").alias("line")).orderBy("line").limit(most).agg(F.max("line").alias("last"))
    judged = sited.join(first, "site").crossJoin(F.broadcast(kept))  # one row
    why = F.when(F.col("line") != F.col("first"), "the same website as an earlier line").when(F.col("line") > F.col("last"), "beyond the limit")
    taken = judged.select("line", "site", "name", "phone", why.alias("why"))
    return taken.union(shaped.filter("site is null").select("line", "site", "name", "phone", bad.alias("why")))

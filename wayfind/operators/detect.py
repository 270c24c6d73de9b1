"""Technology signals: vendors whose marks a page's markup carries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BOOKS = r"[\w/.?=&-]*(book|appointment|schedule|portal)"
# Family, vendor and the marks in markup by which it is known.
CATALOGUE = (
    ("booking", "calendly", r"calendly\.com|calendly-badge|calendly\.init"), ("booking", "acuity", r"acuityscheduling\.com|squarespacescheduling\.com"),
    ("booking", "square", r"squareup\.com/appointments|square\.site/book"), ("booking", "vagaro", r"vagaro\.com|vagaro\.js"), ("booking", "zocdoc", r"zocdoc\.com|zd-plugin"),
    ("booking", "mindbody", r"mindbodyonline\.com|mindbody\.io|healcode|mb-widget"), ("booking", "jane", r"janeapp\.com"), ("booking", "boulevard", r"joinblvd\.com|blvd\.co/book|boulevard\.io"),
    ("booking", "booker", r"booker\.com|secure-booker\.com"), ("booking", "setmore", r"setmore\.com"), ("booking", "simplybook", r"simplybook\.(me|it)"), ("booking", "schedulicity", r"schedulicity\.com"),
    ("booking", "fresha", r"fresha\.com"), ("booking", "styleseat", r"styleseat\.com"), ("booking", "booksy", r"booksy\.com"), ("booking", "phorest", r"phorest\.com|phorest\.me"),
    ("booking", "dentrix", rf"dentrix(ascend)?\.com/{_BOOKS}"), ("booking", "nexhealth", r"nexhealth\.com"), ("booking", "localmed", r"localmed\.com"), ("booking", "flexbooker", r"flexbooker\.com"),
    ("booking", "appointy", r"appointy\.com"), ("booking", "housecallpro", r"hcp-booking|housecallpro\.com/book"), ("booking", "servicetitan", r"st-scheduler|servicetitan\.com/[\w/.?=&-]*(book|schedule)"),
    ("booking", "jobber", r"getjobber\.com|jobber\.com/online-booking"), ("booking", "opendental", rf"opendental\.com/{_BOOKS}"), ("booking", "tebra", rf"(tebra|kareo)\.com/{_BOOKS}"),
    ("booking", "athenahealth", rf"athenahealth\.com/{_BOOKS}"), ("booking", "healthiepatient", r"gethealthie\.com"), ("booking", "cliniko", r"cliniko\.com"), ("booking", "practicefusion", rf"practicefusion\.com/{_BOOKS}"),
    ("booking", "timely", r"gettimely\.com"), ("booking", "resurva", r"resurva\.com"), ("booking", "genbook", r"genbook\.com"), ("booking", "yocale", r"yocale\.com"),
    ("booking", "planmyappointment", r"planmyappointment\.com"), ("booking", "weave", r"getweave\.com/schedule"),
    ("booking", "vetstoria", r"vetstoria\.com"), ("booking", "petdesk", r"petdesk\.com"), ("booking", "evetpractice", r"evetpractice\.com"), ("booking", "ezyvet", rf"ezyvet\.com/{_BOOKS}"),
    ("booking", "shepherd_vet", r"shepherd\.vet|shepherdsoftware"), ("booking", "digitail", r"digitail\.(com|io)"), ("booking", "instinct_vet", r"instinct\.vet"), ("booking", "vetter", r"vettersoftware\.com"),
    ("booking", "idexx_neo", r"neo\.idexx\.com|idexxneo"), ("booking", "provet_cloud", r"provet\.cloud"), ("booking", "televet", r"televet\.com"), ("booking", "vitusvet", r"vitusvet\.com"),
    ("booking", "hippo_manager", r"hippomanager\.com"), ("booking", "covetrus", rf"covetrus\.com/{_BOOKS}"),
    ("booking", "curve_dental", rf"curve(dental|hero)\.com/{_BOOKS}"), ("booking", "denticon", rf"denticon\.com/{_BOOKS}"), ("booking", "eaglesoft", rf"eaglesoft{_BOOKS}"), ("booking", "adit", r"adit\.com"),
    ("booking", "yapi", r"yapiapp\.com"), ("booking", "simplifeye", r"simplifeye\.co"), ("booking", "flex_dental", r"flexdental(solutions)?\.com"),
    ("booking", "aesthetic_record", r"aestheticrecord\.com|myaestheticrecord\.com"), ("booking", "symplast", r"symplast\.com"), ("booking", "nextech", r"nextech\.com"), ("booking", "zenoti", r"zenoti\.com"),
    ("booking", "mangomint", r"mangomint\.com"), ("booking", "meevo", r"meevo\.com|millenniumsi\.com"), ("booking", "moxie", r"moxie\.xyz"),
    ("booking", "fieldedge", r"fieldedge\.com"), ("booking", "service_fusion", r"servicefusion\.com"), ("booking", "workiz", r"workiz\.com"), ("booking", "mhelpdesk", r"mhelpdesk\.com"),
    ("booking", "service_autopilot", r"serviceautopilot\.com"), ("booking", "thryv", r"thryv\.com"), ("booking", "scheduling_engine", r"schedulingengine\.com"), ("booking", "servicem8", r"servicem8\.com"),
    ("quote_form", "hubspot_forms", r"js\.hsforms\.net|hbspt\.forms"), ("quote_form", "gravity_forms", r"gform_wrapper|gravityforms"), ("quote_form", "contact_form_7", r"wpcf7|contact-form-7"), ("quote_form", "typeform", r"typeform\.com"),
    ("quote_form", "jotform", r"jotform\.com"), ("quote_form", "wufoo", r"wufoo\.com"), ("quote_form", "formstack", r"formstack\.com"), ("quote_form", "ninja_forms", r"ninja[-_]forms"), ("quote_form", "wpforms", r"wpforms"),
    ("quote_form", "formidable", r"frm_forms|formidableforms"), ("quote_form", "marketo", r"marketo\.com|mktoform"), ("quote_form", "pardot", r"pardot\.com|go\.pardot"),
    ("chat", "intercom", r"intercom\.io|intercomsettings"), ("chat", "drift", r"drift\.com|driftt\.com"), ("chat", "tawk", r"tawk\.to"), ("chat", "crisp", r"crisp\.chat"), ("chat", "zendesk_chat", r"zopim|zdassets\.com"),
    ("chat", "livechat", r"livechatinc\.com"), ("chat", "tidio", r"tidio\.co"), ("chat", "podium", r"podium\.com"), ("chat", "birdeye", r"birdeye\.com"), ("chat", "hubspot_chat", r"js\.usemessages\.com"),
    ("chat", "olark", r"olark\.com"), ("chat", "gorgias", r"gorgias\.chat"),
    ("cms", "wordpress", r'/wp-content/|/wp-includes/|name="generator" content="wordpress'), ("cms", "wix", r"wix\.com|wixstatic\.com|_wixcssstates"), ("cms", "squarespace", r"squarespace\.com|static1\.squarespace"),
    ("cms", "godaddy_website_builder", r"godaddysites\.com|img1\.wsimg\.com"), ("cms", "webflow", r"webflow\.com|wf-form"), ("cms", "duda", r"dudamobile\.com|duda_website"), ("cms", "shopify", r"cdn\.shopify\.com|shopify\.theme"),
    ("cms", "weebly", r"weebly\.com|editmysite\.com"), ("cms", "hubspot_cms", r"hs-sites\.com|hubspotusercontent"),
    ("pixel", "google_analytics", r"googletagmanager\.com|google-analytics\.com|gtag\("), ("pixel", "meta_pixel", r"connect\.facebook\.net|fbq\("), ("pixel", "google_ads", r"googleadservices\.com|gtag/js\?id=aw-"),
    ("pixel", "tiktok_pixel", r"analytics\.tiktok\.com"), ("pixel", "linkedin_insight", r"snap\.licdn\.com"), ("pixel", "inline", r"track\([0-9]+\)"),
)
#: Marks of a kind of offer that name no vendor.
GENERIC = (("quote_form", r">\s*(get|request)\s+an?\s+(free\s+)?(quote|estimate)\s*<"), ("booking", r">\s*(book|schedule)\s+(now|online|an?\s+appointment)\s*<"), ("any_form", r"<form[^>]*>"), ("ads", r'class="ad"'), ("menu", r"<nav>"))


#: A mark of GENERIC needs one of these words; of CATALOGUE, what `literals` finds in it.
GENERIC_WORDS = (("quote", "estimate"), ("book", "schedule"), ("<form",), ('class="ad"',), ("<nav>",))


def literals(mark: str) -> tuple[str, ...]:
    """For each alternative of a mark, its longest stretch of plain characters outside groups and classes, which any match holds."""
    out = []
    for part in _alternatives(mark):
        bare = re.sub(r"\[[^\]]*\][*+?]?|\\[a-z][*+?]?", "\0", part)
        while re.search(r"\([^()]*\)", bare):
            bare = re.sub(r"\([^()]*\)[*+?]?", "\0", bare)
        plain = re.sub(r"\\(.)", r"\1", re.sub(r"(?<!\\)(.[*?]|[.+])", "\0", bare))
        out.append(max(plain.split("\0"), key=len))
    return tuple(dict.fromkeys(out))


def _alternatives(mark: str) -> list[str]:
    """The mark split at its outermost bars."""
    parts, depth = [""], 0
    for at, c in enumerate(mark):
        if c in "()" and mark[at - 1 : at] != "\\":
            depth += 1 if c == "(" else -1
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _marks() -> list[tuple[str, str, bool, re.Pattern, tuple[str, ...]]]:
    """family, name, vendor, expression and words of every mark."""
    named = [(f, v, True, re.compile(mark, re.ASCII), literals(mark)) for f, v, mark in CATALOGUE]
    return named + [(f, "generic", False, re.compile(mark, re.ASCII), words) for (f, mark), words in zip(GENERIC, GENERIC_WORDS, strict=True)]


def signals(pages: DataFrame) -> DataFrame:
    """page_id, family, name, vendor (false: a generic mark): one row a mark found.

    One pass over the markup by an automaton of all marks' words tells which marks can be
    there; only their expressions then run. A null markup has no marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        marks, by_word = _marks(), {}
        for k, (*_, words) in enumerate(marks):
            for w in words:
                by_word.setdefault(w, []).append(k)
        automaton = ahocorasick.Automaton()
        for w, ks in by_word.items():
            automaton.add_word(w, ks)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, cell in enumerate(batch.column(1)):
                html = (cell.as_py() or "").lower()
                able = {k for _, ks in automaton.iter(html) for k in ks}
                held = [k for k in sorted(able) if marks[k][3].search(html)]
                rows += [i] * len(held)
                found += held
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array([marks[k][at] for k in found], kind) for at, kind in ((0, pa.string()), (1, pa.string()), (2, pa.bool_()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "family", "name", "vendor"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, family string, name string, vendor boolean"
    return pages.select("page_id", "html").mapInArrow(run, schema)


def site_signals(pages: DataFrame, found: DataFrame) -> DataFrame:
    """site, pages, vendors (map: family to its vendors, each once, in order), generic (families with a generic mark), pages_by_family.

    Of pages(page_id, site) and found(page_id, family, name, vendor). Marks are first
    summed by site, family and name, so the maps of a site are made of one row a mark,
    however many pages it has; a site without marks has empty maps.
    """
    marks = found.join(pages.select("page_id", "site"), "page_id").groupBy("site", "family", "name", "vendor").agg(F.count("*").alias("n"))
    by_family = marks.groupBy("site", "family").agg(
        F.array_sort(F.collect_set(F.when(F.col("vendor"), F.col("name")))).alias("names"), F.max(~F.col("vendor")).alias("generic"), F.max("n").alias("most")
    )
    maps = by_family.groupBy("site").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.size("names") > 0, F.struct("family", "names"))))).alias("vendors"),
        F.array_sort(F.collect_set(F.when(F.col("generic"), F.col("family")))).alias("generic"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "most")))).alias("pages_by_family"),
    )
    sites = pages.groupBy("site").agg(F.count("*").alias("pages"))
    empty = lambda name, kind: F.coalesce(name, F.expr(f"cast(map() as {kind})"))
    return sites.join(maps, "site", "left").select(
        "site", "pages", empty(F.col("vendors"), "map<string,array<string>>").alias("vendors"),
        F.coalesce("generic", F.array().cast("array<string>")).alias("generic"), empty(F.col("pages_by_family"), "map<string,bigint>").alias("pages_by_family"),
    )


def as_signals(sites: DataFrame) -> DataFrame:
    """id, family, name, vendor of site_signals' rows, as `evidence.detector` reads them."""
    named = sites.select("site", F.explode("vendors").alias("family", "names")).select(F.col("site").alias("id"), "family", F.explode("names").alias("name"), F.lit(True).alias("vendor"))
    return named.union(sites.select(F.col("site").alias("id"), F.explode("generic").alias("family"), F.lit("generic").alias("name"), F.lit(False).alias("vendor")))


#: Words before the name of whoever made a site.
CREDIT = "(?:website|site|web design|designed|built|created|developed|powered) by"


def credits(pages: DataFrame) -> DataFrame:
    """page_id, host: links of pages(page_id, url, html) to another root domain with a credit before or inside them."""
    href = r'<a[^>]+href="(https?://[^"]*)"'
    found = F.concat(F.regexp_extract_all("html", F.lit(rf"(?i){CREDIT}\s*:?\s*{href}"), F.lit(1)), F.regexp_extract_all("html", F.lit(rf"(?i){href}[^>]*>[^<]*{CREDIT}"), F.lit(1)))
    host = lambda c: F.regexp_replace(F.regexp_extract(F.lower(c), r"://([^/?#]*)", 1), r"^www\.", "")
    root = lambda c: F.substring_index(c, ".", -2)
    linked = pages.select("page_id", host(F.col("url")).alias("own"), F.explode(found).alias("link")).withColumn("host", host(F.col("link")))
    return linked.filter(root(F.col("host")) != root(F.col("own"))).select("page_id", "host")

"""People and phone numbers that pages print, told by what stands beside them, and the contacts of a site put together.

A match counts by its position: a role belongs to the name next to it, a phone number
needs a word like "call" in the sixty characters before it. Everything is column
expressions over one text; only what is found leaves the text behind and is then ranked
by site. Null texts hold nothing; a null listed phone confirms nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.text import let
from wayfind.operators.outreach import COMMON_WORDS, NOISE, ROLE_MAILBOX, SOCIAL

# First names, which tell no business, and words that no person's name holds.
GIVEN_NAMES = tuple(
    """aaron abigail adam alan albert alexander alexis alice amanda amber amy andrea andrew angela ann anna anthony arthur ashley austin barbara benjamin betty beverly
    billy bobby bradley brandon brenda brian brittany bruce bryan carl carol carolyn catherine charles cheryl christian christina christine christopher cynthia daniel
    danielle david deborah debra denise dennis diana diane donald donna doris dorothy douglas dylan edward elijah elizabeth emily emma eric ethan eugene evelyn frances
    frank gabriel gary george gerald gloria grace gregory hannah harold heather henry jack jacob jacqueline james jane janet janice jason jean jeffrey jennifer jeremy
    jerry jesse jessica joan joe john jonathan jordan jose joseph joshua joyce juan judith judy julia julie justin karen katherine kathleen kathryn kayla keith kelly
    kenneth kevin kimberly kyle larry laura lauren lawrence linda lisa logan lori madison margaret maria marie marilyn mark martha mary mason matthew megan melissa
    michael michelle nancy natalie nathan nicholas nicole noah olivia pamela patricia patrick paul peter philip rachel ralph randy raymond rebecca richard robert roger
    ronald rose roy russell ruth ryan samantha samuel sandra sara sarah scott sean sharon shirley sophia stephanie stephen steven susan teresa terry theresa thomas
    timothy tyler victoria vincent virginia walter wayne william willie zachary""".split()
)
NOT_A_NAME = tuple(
    """about all and appointment appointments avenue ave blog book call care careers center centre clinic company contact copyright cosmetic customer dental dentistry
    dds directions dr emergency family find first for free from get group heating help here home hours inc llc location locations map meet menu more new news now
    office our owner patient patients plumbing policy president privacy quote read request reserved reviews rights road roofing salon schedule service services smile
    spa staff street studio suite team terms testimonials the today welcome with your us we north south east west monday tuesday wednesday thursday friday saturday
    sunday january february march april may june july august september october november december founder ceo manager principal proprietor partner director cooling air
    electric fitness gym law firm medical health wellness auto repair construction""".split()
)
ROLE = (
    r"(?:co-?)?owner(?:\s*(?:&|and)\s*operator)?|proprietor|(?:co-?)?founder(?:\s*(?:&|and)\s*(?:ceo|president|owner))?|ceo|chief executive officer|president|principal"
    r"|managing (?:partner|director)|general manager|(?:office|practice) manager"
)
NAME_WORD = r"(?:Ma?c[A-Z][a-z]+|[A-Z]'[A-Z][a-z]+|[A-Z][a-z]+)(?:-[A-Z][a-z]+)?"
NAME = rf"(?:Dr\.?\s+)?{NAME_WORD}(?:\s+[A-Z]\.)?\s+{NAME_WORD}(?:\s+{NAME_WORD})?"
SUFFIX = r"(?:,?\s+(?:DDS|DMD|MD|DO|DC|DVM|CPA|PE|Esq\.?|Jr\.?|Sr\.?|II|III))?"
#: what the words on a side of the anchor must look like for a name to be found there: anchor, side, expression, whether a known first name is needed, and how it is said
PERSON_RULES = (
    ("role", "before", rf"(?i)({NAME}){SUFFIX}\s*[,–—|(-]\s*$", False, "printed beside their role"),
    ("role", "after", rf"(?i)^\s*[:–—-]\s*({NAME})", False, "printed after their role"),
    ("role", "before", rf"(?i)({NAME}){SUFFIX}\s+is\s+(?:the\s+|our\s+)?$", False, "named as the role"),
    ("by", "after", rf"(?i)^({NAME})", False, "named as founder or owner"),
    ("role", "before", rf"(?i)({NAME}){SUFFIX}\s+$", True, "printed beside their role"),
    ("credential", "before", rf"({NAME})\s*,?\s*$", False, "printed with their credential"),
)
FOUNDED_BY = r"(?i)\b(?:founded|owned(?:\s+and\s+operated)?|started)\s+by\s+"
#: credential, the role it stands for, whether the name must carry Dr.
CREDENTIALS = (
    (r"D\.?\s?D\.?\s?S\.?|D\.?\s?M\.?\s?D\.?", "Dentist", False), (r"D\.?V\.?M\.?", "Veterinarian", False), (r"C\.?P\.?A\.?", "CPA", False), (r"Esq\.?", "Attorney", False),
    (r"M\.?D\.?|D\.?O\.?", "Physician", True), (r"D\.?C\.?", "Chiropractor", True), (r"O\.?D\.?", "Optometrist", True),
)
UNNAMED_ROLE = "Founder or owner"
PEOPLE = 3
NAME_CHARS = 120  # a name lies this near to what tells it
PHONE = r"(?:\+1[ .\-]?)?\(?([0-9]{3})\)?[ .\-]?([0-9]{3})[ .\-]?([0-9]{4})"
CUE = r"(?i)(call|phone|tel|text|dial|reach us|contact)"
CUE_CHARS, SHORTEST = 60, 10  # how far before a number its cue may stand; characters of the shortest number
BAD_AREA = ("000", "111", "555", "123")
LISTED, CUED = "matches the phone on the business listing", "printed next to a word like call or phone"
CONTACT_PAGE = r"(?i)/contact|/get-in-touch|/reach"


def around_each(text: Column, pattern: str, chars: int, shortest: int) -> Column:
    """value, before, after: each match of a pattern, and the characters on either side of it, `chars` at most; a match has `shortest` at least.

    What lies between matches is cut at them, so only the stretches that can reach into
    a window are joined again: the work is linear in the text, however many matches.
    """
    cut = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    back = chars // shortest + 1

    def sides(held: Column, i: Column) -> tuple[Column, Column]:
        before = F.transform(F.sequence(F.greatest(i - back, F.lit(0)), i), lambda k: F.concat(F.get(held["between"], k), F.when(k < i, F.get(held["matches"], k)).otherwise("")))
        later = F.sequence(i + 1, F.least(i + 1 + back, F.size(held["matches"])))
        after = F.transform(later, lambda k: F.concat(F.when(k > i + 1, F.get(held["matches"], k - 1)).otherwise(""), F.get(held["between"], k)))
        return F.right(F.array_join(before, ""), F.lit(chars)), F.left(F.array_join(after, ""), F.lit(chars))

    def found(held: Column, m: Column, i: Column) -> Column:
        before, after = sides(held, i)
        return F.struct(m.alias("value"), before.alias("before"), after.alias("after"))

    return let(cut, lambda held: F.transform(held["matches"], lambda m, i: found(held, m, i)))


def phones_said(text: Column, known: Column) -> Column:
    """value, how: the numbers of a text that the listing or a word before them confirms, each once, in order."""
    digits = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))
    listed = digits(F.coalesce(known, F.lit("")))

    def judged(x: Column) -> Column:
        number, area = x["number"], F.left(x["number"], F.lit(3))
        cued = x["before"].rlike(CUE) & ((listed == "") | (area == F.left(listed, F.lit(3))))
        how = F.when((listed != "") & (number == listed), LISTED).when(cued, CUED)
        shown = F.concat(F.lit("("), area, F.lit(") "), F.substring(number, 4, 3), F.lit("-"), F.substring(number, 7, 4))
        return F.when(~area.isin(*BAD_AREA) & ~area.rlike("^[01]") & how.isNotNull(), F.struct(shown.alias("value"), how.alias("how")))

    numbers = F.transform(around_each(text, PHONE, CUE_CHARS, SHORTEST), lambda m: F.struct(digits(m["value"]).alias("number"), m["before"].alias("before")))
    return F.array_distinct(F.array_compact(F.transform(numbers, judged)))  # a number is always confirmed in the same way


def plausible(name: Column, needs_given: bool) -> Column:
    """Whether a run of capitalised words can be a person: two or three words, none of them a business word."""
    words = F.filter(F.split(F.regexp_replace(name, r"(?i)^Dr\.?\s+", ""), " "), lambda w: ~w.rlike(r"^[A-Z]\.$"))
    ok = F.size(words).between(2, 3) & ~F.exists(words, lambda w: F.lower(w).isin(*NOT_A_NAME, *COMMON_WORDS))
    return ok & (F.lower(F.get(words, F.lit(0))).isin(*GIVEN_NAMES) | name.rlike(r"^Dr\b")) if needs_given else ok


def nearest_name(raw: Column, role_is: str, needs_given: bool = False) -> Column:
    """Of the words matched as a name, the shortest run next to the role that is one as written; null: none."""
    words = F.split(F.trim(F.regexp_replace(raw, r"\s+", " ")), " ")
    n = F.size(words)

    def run(k: Column) -> Column:
        part = F.when(n < k, F.lit(None)).otherwise(F.array_join(F.slice(words, 1, k) if role_is == "before" else F.slice(words, n - k + 1, k), " "))
        if role_is == "after":
            part = F.when((k == n - 1) & F.get(words, F.lit(0)).rlike(r"^Dr\.?$"), F.concat(F.lit("Dr. "), part)).otherwise(part)
        return part

    runs = F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), run)
    return F.get(F.filter(runs, lambda r: F.coalesce(r.rlike(f"^{NAME}$") & plausible(r, needs_given), F.lit(False))), F.lit(0))


def plain_words(text: Column) -> Column:
    """The words that a text has in lower case, outside addresses."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![@./\w-])[a-z]+(?![\w@])"), F.lit(0)))


def used_as_word(name: Column, text: Column, plain: Column) -> Column:
    """Whether the text has a word of the name in lower case, outside addresses; a known first name may be. plain: plain_words of the text."""
    words = F.filter(F.split(F.regexp_replace(name, r"(?i)^Dr\.?\s+", ""), " "), lambda w: ~w.rlike(r"^[A-Z]\.$"))
    low = F.transform(F.filter(words, lambda w, i: ~((i == 0) & F.lower(w).isin(*GIVEN_NAMES))), lambda w: F.regexp_replace(F.lower(w), "[^a-z'-]", ""))
    compound = lambda w: F.rlike(text, F.concat(F.lit(r"(?<![@./\w-])"), w, F.lit(r"(?![\w@])")))
    return F.exists(low, lambda w: F.when(w.rlike("^[a-z]+$"), F.array_contains(plain, w)).otherwise(compound(w)))


def _ruled(hits: Column, k: int) -> Column:
    """rule, at, name, role, how of what one of PERSON_RULES finds beside its anchors; a null name is none."""
    anchor, side, pattern, loose, how = PERSON_RULES[k]

    def found(hit: Column, i: Column) -> Column:
        raw, said = F.regexp_extract(hit[side], pattern, 1), F.trim(F.regexp_replace(hit["value"], r"\s+", " "))
        name = F.when(raw != "", nearest_name(raw, "after" if side == "before" else "before", loose))
        if anchor == "credential":
            met = [(said.rlike(f"^(?:{c})$"), role, needs_dr) for c, role, needs_dr in CREDENTIALS]
            role = F.coalesce(*[F.when(m, F.lit(r)) for m, r, _ in met])
            name = F.when(~F.coalesce(*[F.when(m, F.lit(n)) for m, _, n in met]) | name.rlike(r"^Dr\b"), name)
        elif anchor == "role":
            tidy = F.regexp_replace(said, r"(?i)\bceo\b", "CEO")
            role = F.concat(F.upper(F.left(tidy, F.lit(1))), F.substring(tidy, F.lit(2), F.length(tidy)))
        else:
            role = F.lit(UNNAMED_ROLE)
        return F.struct(F.lit(k).alias("rule"), i.alias("at"), name.alias("name"), role.alias("role"), F.lit(how).alias("how"))

    return F.transform(hits[anchor], found)


def named_in(text: Column) -> Column:
    """rule, at, name, role, how of every name that a text prints beside a role or credential and never as plain words, in order."""
    anchors = F.struct(
        around_each(text, rf"(?i)\b(?:{ROLE})\b", NAME_CHARS, 3).alias("role"), around_each(text, FOUNDED_BY, NAME_CHARS, 9).alias("by"),
        around_each(text, rf"(?:{'|'.join(c for c, _, _ in CREDENTIALS)})(?![A-Za-z])", NAME_CHARS, 2).alias("credential"),
    )
    found = let(anchors, lambda hits: F.filter(F.concat(*[_ruled(hits, k) for k in range(len(PERSON_RULES))]), lambda x: x["name"].isNotNull() & x["role"].isNotNull()))
    unused = lambda names: let(plain_words(text), lambda plain: F.filter(names, lambda x: ~used_as_word(x["name"], text, plain)))
    return let(found, lambda names: F.when(F.size(names) > 0, unused(names)))


def people(pages: DataFrame, most: int = PEOPLE) -> DataFrame:
    """site, place, name, role, how, page_no: of pages(site, page_no, text), at most `most` people a site, in the order of pages, rules and positions.

    A name counts once; with a credential it counts as the same with or without Dr. Only
    the first rows of a site can decide this (each of the people already taken can hide
    three spellings of a name), so a site's names are ranked and cut to so many, which
    Spark does before the shuffle too, and then folded.
    """
    held = pages.select("site", "page_no", F.explode(named_in(F.col("text"))).alias("x"))
    place = F.struct("page_no", F.col("x.rule").alias("rule"), F.col("x.at").alias("at"))
    by_rule = F.col("x.rule") < len(PERSON_RULES) - 1  # not with a credential
    first = held.groupBy("site", F.lower("x.name").alias("exact"), by_rule.alias("by_rule")).agg(F.min_by("x", place).alias("x"), F.min(place).alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("place"))).filter(F.col("rank") <= 6 * most)
    rows = ranked.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "exact", "by_rule", "x"))).alias("rows"))  # 6 * most at most
    bare = lambda c: F.regexp_replace(c, r"^dr\.?\s+", "")

    def add(taken: Column, row: Column) -> Column:
        same = F.exists(taken, lambda t: F.when(row["by_rule"], t["exact"] == row["exact"]).otherwise(bare(t["exact"]) == bare(row["exact"])))
        return F.when(same | (F.size(taken) >= most), taken).otherwise(F.concat(taken, F.array(row)))

    kept = rows.select("site", F.posexplode(F.aggregate("rows", F.filter("rows", lambda _: F.lit(False)), add)).alias("place", "p"))
    return kept.select("site", "place", "p.x.name", "p.x.role", "p.x.how", F.col("p.place.page_no").alias("page_no"))


def phones(pages: DataFrame, listings: DataFrame) -> DataFrame:
    """site, value, how, page_no: the confirmed numbers of pages(site, page_no, text), each once a site, as its first page has it; listings(site, phone)."""
    said = pages.join(listings.groupBy("site").agg(F.min("phone").alias("phone")), "site", "left")
    rows = said.select("site", "page_no", F.explode(phones_said(F.col("text"), F.col("phone"))).alias("p"))
    first = rows.groupBy("site", "p.value").agg(F.min_by("p.how", "page_no").alias("how"), F.min("page_no").alias("page_no"))
    return first.select("site", "value", "how", "page_no")


def mailbox_forms(name: Column) -> Column:
    """The mailbox names that are plainly a person's: first, last, and both in the usual ways."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"(?i)^Dr\.?\s+", "")), " "), lambda w: ~w.rlike(r"^[a-z]\.$"))
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    initial = F.left(first, F.lit(1))
    forms = F.array(first, last, F.concat(first, F.lit("."), last), F.concat(first, last), F.concat(initial, last), F.concat(first, F.lit("_"), last), F.concat(initial, F.lit("."), last))
    return F.filter(forms, lambda f: F.length(f) >= 3)


def email_tier(email: Column, names: Column) -> Column:
    """role, person or other: by the mailbox, the people named on the site (an array of names), known first names and the form first.last."""
    local = F.regexp_replace(F.lower(F.substring_index(email, "@", 1)), "[0-9]+$", "")
    parts = F.split(local, "[._-]")
    named = F.coalesce(F.exists(names, lambda n: F.array_contains(mailbox_forms(n), local)), F.lit(False))
    given = F.get(parts, F.lit(0)).isin(*GIVEN_NAMES) & (F.size(parts) <= 2)
    return F.when(local.rlike(ROLE_MAILBOX), "role").when(named | given | local.rlike(r"^[a-z]{2,}[._][a-z]{2,}$"), "person").otherwise("other")


def emails(pages: DataFrame, named: DataFrame) -> DataFrame:
    """site, email, how, tier, place: addresses linked or printed on pages(site, page_no, text, links), each once a site, a person's before others and those before a desk's."""
    one = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
    mail = F.filter("links", lambda x: F.startswith(F.lower(x), F.lit("mailto:")))
    linked = F.filter(F.transform(mail, lambda x: F.trim(F.substring_index(F.substring(x, F.lit(8), F.length(x)), "?", 1))), lambda e: e.rlike(f"^{one}$"))
    printed = F.regexp_extract_all("text", F.lit(one), F.lit(0))
    as_found = lambda k: lambda e, i: F.struct(F.lit(k).alias("kind"), i.alias("at"), e.alias("email"))
    both = F.concat(*[F.transform(F.coalesce(found, F.array().cast("array<string>")), as_found(k)) for k, found in enumerate((linked, printed))])
    rows = pages.select("site", "page_no", F.explode(F.filter(both, lambda x: ~x["email"].rlike(NOISE))).alias("x"))
    place = F.struct("page_no", "x.kind", "x.at")
    first = rows.groupBy("site", F.lower("x.email").alias("key")).agg(F.min_by("x", place).alias("x"), F.min(place).alias("place"))
    people_of = named.groupBy("site").agg(F.collect_list("name").alias("names"))  # three a site
    tiered = first.join(people_of, "site", "left").withColumn("tier", email_tier(F.col("x.email"), F.col("names")))
    order = F.when(F.col("tier") == "person", 0).when(F.col("tier") == "other", 1).otherwise(2)
    how = F.when(F.col("x.kind") == 0, "linked as mailto:").otherwise("printed on the page")
    return tiered.select("site", F.col("x.email").alias("email"), how.alias("how"), "tier", F.struct(order.alias("tier"), "place").alias("place"))


def assembled(pages: DataFrame, listings: DataFrame) -> DataFrame:
    """One row a site of pages(site, page_no, url, text, links): best_email, its tier, n_emails, n_phones, best_phone, socials, contact_page, people (name and role, in order)."""
    named = people(pages)
    mail = emails(pages, named).groupBy("site").agg(F.min_by(F.struct("email", "tier"), "place").alias("m"), F.count("*").alias("n_emails"))
    called = phones(pages, listings)
    numbers = called.groupBy("site").agg(F.count("*").alias("n_phones"), F.min_by("value", F.struct((F.col("how") != LISTED).alias("other"), "page_no", "value")).alias("best_phone"))
    who = named.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("name", F.lit(", "), "role").alias("who")))), lambda x: x["who"]), "; ").alias("people"))  # three a site
    to = lambda host: F.exists("links", lambda x: F.contains(F.lower(x), F.lit(f"//{host}")) | F.contains(F.lower(x), F.lit(f".{host}")))
    hosts = [F.when(to(h), F.lit(h)) for h in SOCIAL]
    linked = pages.select("site", F.explode(F.array_compact(F.array(*hosts))).alias("host")).groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("host")), ",").alias("socials"))
    sites = pages.groupBy("site").agg(F.min_by("url", F.when(F.col("url").rlike(CONTACT_PAGE), F.col("page_no"))).alias("contact_page"))
    whole = sites.join(mail, "site", "left").join(numbers, "site", "left").join(who, "site", "left").join(linked, "site", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("site", F.col("m.email").alias("best_email"), F.col("m.tier").alias("tier"), zero("n_emails"), zero("n_phones"), "best_phone", "socials", "contact_page", "people")

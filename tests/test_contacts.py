"""People, phones and addresses on pages against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from wayfind.operators import contacts as c
from wayfind.operators import detect
from wayfind.plans import over_contacts

SCHEMA = "site string, page_no long, url string, text string, links array<string>"


def plain_people(pages):
    """The rules over whole texts with a backtracking engine: page by page, rule by rule, match by match."""
    suffix, name, role = c.SUFFIX, c.NAME, c.ROLE
    rules = [
        (rf"(?i)({name}){suffix}\s*[,–—|(-]\s*({role})\b", 1, 2, False), (rf"(?i)\b({role})\s*[:–—-]\s*({name})", 2, 1, False),
        (rf"(?i)({name}){suffix}\s+is\s+(?:the\s+|our\s+)?({role})\b", 1, 2, False), (rf"(?i)\b(?:founded|owned(?:\s+and\s+operated)?|started)\s+by\s+({name})", 1, 0, False),
        (rf"(?i)({name}){suffix}\s+({role})\b", 1, 2, True),
    ]
    titles = "|".join(x for x, _, _ in c.CREDENTIALS)

    def nearest(raw, side, loose):
        words = raw.split()
        for n in (2, 3, 4):
            if n > len(words):
                break
            part = words[:n] if side == "start" else words[-n:]
            text = ("Dr. " if side == "end" and words[0] in ("Dr", "Dr.") and n == len(words) - 1 else "") + " ".join(part)
            bare = [w for w in re.sub(r"(?i)^Dr\.?\s+", "", text).split(" ") if not re.fullmatch(r"[A-Z]\.", w)]
            if re.fullmatch(name, text) and len(bare) in (2, 3) and not any(w.lower() in c.NOT_A_NAME + c.COMMON_WORDS for w in bare) and (not loose or bare[0].lower() in c.GIVEN_NAMES or re.match(r"Dr\b", text)):
                return text
        return None

    def common(found, text):
        bare = [w for w in re.sub(r"(?i)^Dr\.?\s+", "", found).split(" ") if not re.fullmatch(r"[A-Z]\.", w)]
        return any(re.search(rf"(?<![@./\w-]){re.sub('[^a-z\'-]', '', w.lower())}(?![\w@])", text, re.ASCII) for i, w in enumerate(bare) if not (i == 0 and w.lower() in c.GIVEN_NAMES))

    out = []
    bare = lambda n: re.sub(r"^dr\.?\s+", "", n.lower())
    for page_no, text in pages:
        for pattern, n, r, loose in rules:
            for m in re.finditer(pattern, text or "", re.ASCII):
                who = nearest(m[n], "start" if n > r else "end", loose)
                if who and not common(who, text) and not any(x[0].lower() == who.lower() for x in out):
                    said = re.sub(r"(?i)\bceo\b", "CEO", " ".join(m[r].split())) if r else c.UNNAMED_ROLE
                    out.append((who, said[0].upper() + said[1:], page_no))
        for m in re.finditer(rf"({name})\s*,?\s*({titles})(?![A-Za-z])", text or "", re.ASCII):
            _, role_of, needs = next(x for x in c.CREDENTIALS if re.fullmatch(x[0], m[2].strip()))
            who = nearest(m[1], "end", False)
            if who and (not needs or re.match(r"Dr\b", who)) and not common(who, text) and not any(bare(x[0]) == bare(who) for x in out):
                out.append((who, role_of, page_no))
    return out[:3]


PAGES = [
    ("a", 1, "http://a/x", "Our team Maria Lopez, Owner. James O'Brien Call us. Dr. Ahmed Jaheen DDS. maria@a.com or a.b@example.com", ["mailto:info@a.com?subject=" + "x" * 2000, "https://www.facebook.com/a", "tel:1"]),
    ("a", 2, "http://a/contact", "Founder & ceo: Robert McDonald. Founded by Grace Hall. Susan Ferguson is our office manager. maria@a.com", []),
    ("b", 1, "http://b", "Consultation Experienced, CPA. we are experienced in consultation. Downtown Baltimore, MD. Owner: The Team.", None),
    ("b", 2, "http://b/2", "Ann Lee, DDS; Dr. Ann Lee, Owner; Dr. Ann Lee, DMD; Mary-Jane Smith-Jones Esq. Bob T. MacLeod – General Manager", None),
    ("c", 1, "http://c", "John Smith Owner, Xavier Poe Owner, William Shaw Jr., President, started by Karen Page and Dr Li Wu Chen, O.D.", None),
    ("d", 1, "http://d", None, None), ("d", 2, None, "", None),
]


def test_people_are_those_of_plain_rules(spark):
    got = c.people(spark.createDataFrame(PAGES, SCHEMA)).collect()
    for site in "abcd":
        want = plain_people([(n, t) for s, n, _, t, _ in PAGES if s == site])
        assert [(r.name, r.role, r.page_no) for r in sorted((r for r in got if r.site == site), key=lambda r: r.place)] == want
    long = spark.createDataFrame([("e", 1, "u", "x" * 50_000 + " Maria Lopez, Owner " + "y" * 50_000, None)], SCHEMA)
    assert [r.name for r in c.people(long).collect()] == ["Maria Lopez"]
    assert len(got) == 9 and c.people(spark.createDataFrame([], SCHEMA)).count() == 0


def test_people_of_documents(spark):
    pages = over_contacts.business_pages(spark, "/root/testdata/sf0.01").filter("length(text) < 1500")
    texts = {}
    for r in pages.collect():
        texts.setdefault(r.site, []).append((r.page_no, r.text))
    got = c.people(pages).collect()
    want = {s: plain_people(sorted(t)) for s, t in texts.items()}
    assert {s: [(r.name, r.role, r.page_no) for r in sorted((r for r in got if r.site == s), key=lambda r: r.place)] for s in want} == want and sum(map(len, want.values())) > 3


def plain_phones(text, known):
    listed, out = re.sub(r"\D", "", known or "")[-10:], []
    for m in re.finditer(c.PHONE, text):
        n = m[1] + m[2] + m[3]
        cued = re.search(c.CUE, text[max(0, m.start() - 60) : m.start()]) and (not listed or n[:3] == listed[:3])
        how = c.LISTED if listed and n == listed else c.CUED if cued else None
        if how and n[:3] not in c.BAD_AREA and n[0] not in "01" and (f"({n[:3]}) {n[3:6]}-{n[6:]}", how) not in out:
            out.append((f"({n[:3]}) {n[3:6]}-{n[6:]}", how))
    return out


@pytest.mark.parametrize("known", [None, "+1 602.555.0134", "480"])
def test_phones_need_a_cue_or_the_listing(spark, known):
    texts = ["Call (602) 555-0134, fax 602-555-9999 or 480 555 1212", "6025550134 6025550135 " * 30 + "tel", "call " + "." * 58 + "602-555-7777", "call " + "." * 61 + "602-555-7777", "call 000-555-1212 155-555-1212 123-555-1212 555-555-1212", "602-555-0134", "dial" + " 602-555-0000" * 20, ""]
    rows = spark.createDataFrame([(t, known) for t in [*texts, None]], "t string, k string").select("t", c.phones_said(F.col("t"), F.col("k")).alias("p")).collect()
    for r in rows:
        assert [(x.value, x.how) for x in r.p or []] == plain_phones(r.t or "", known)


def test_contacts_of_a_site(spark):
    listings = spark.createDataFrame([("a", "602 555 0134"), ("b", None)], "site string, phone string")
    got = {r.site: r for r in c.assembled(spark.createDataFrame(PAGES, SCHEMA), listings).collect()}
    a = got["a"]
    assert (a.best_email, a.tier, a.n_emails, a.socials, a.contact_page) == ("maria@a.com", "person", 2, "facebook.com", "http://a/contact")
    assert a.people == "Maria Lopez, Owner; Dr. Ahmed Jaheen, Dentist; Robert McDonald, Founder & CEO" and got["d"].n_emails == 0
    tiers = spark.createDataFrame([("jeremy@x.com",), ("rob.gerwing@x.com",), ("info2@x.com",), ("xq7@x.com",), ("gpoe@x.com",)], "e string").select(c.email_tier(F.col("e"), F.array(F.lit("Gus Poe"))).alias("t")).collect()
    assert [r.t for r in tiers] == ["person", "person", "role", "other", "person"]


def test_marks_need_their_words():
    for mark in [m for *_, m in detect.CATALOGUE]:
        assert all(len(w) >= 4 for w in detect.literals(mark)), mark
    assert detect.literals(r"(tebra|kareo)\.com/[\w/]*(book|portal)") == (".com/",) and detect.literals(r"a\.b|gtag\(x?y") == ("a.b", "gtag(")


def test_signals_of_a_site(spark):
    pages = spark.createDataFrame([(1, "s", "x calendly.com Vagaro.com <nav>"), (2, "s", "CALENDLY.com <form a>"), (3, "t", None), (4, "t", "athenahealth.com/x/book")], "page_id long, site string, html string")
    got = {r.site: r for r in detect.site_signals(pages.select("page_id", "site"), detect.signals(pages)).collect()}
    assert got["s"].vendors == {"booking": ["calendly", "vagaro"]} and got["s"].generic == ["any_form", "menu"] and got["s"].pages_by_family == {"booking": 2, "any_form": 1, "menu": 1}
    assert got["t"].pages == 2 and got["t"].vendors == {"booking": ["athenahealth"]} and got["t"].generic == []

"""Seeded shuffles, spread samples, link ranking, uploads told by content, greedy representatives, edit distances."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from wayfind.functions import text
from wayfind.operators import linking, resolve, samples, supply
from wayfind.sources import uploads


def plain_shuffle(items, seed):
    """The generator with unbounded integers, wrapped by hand, and the exchange from the last place down."""
    wrap, h = (1 << 32) - 1, 2166136261
    for c in seed:
        h = ((h ^ ord(c)) * 16777619) & wrap
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        h = (h + 0x6D2B79F5) & wrap
        t = ((h ^ (h >> 15)) * (1 | h)) & wrap
        t = (t ^ (t + ((t ^ (t >> 7)) * (61 | t)))) & wrap
        j = math.floor((t ^ (t >> 14)) / 4294967296 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def test_shuffles_repeat_bit_for_bit(spark):
    assert samples.seed_number("") == 2166136261 and samples.seed_number("a") == 0xE40C292C  # published values of the hash
    for seed, n in (("x", 0), ("x", 1), ("dental in Phoenix", 57), ("ü€", 1000)):
        assert samples.shuffle_order(seed, n).tolist() == plain_shuffle(range(n), seed)
    rows = [(g, i * 3) for g, n in (("a", 40), ("b", 1), (None, 7)) for i in range(n)]
    got = samples.shuffled(spark.createDataFrame(rows, "g string, i long").repartition(5), "g", "i", "s:").collect()
    for g in ("a", "b", None):
        mine = [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)]
        assert mine == plain_shuffle([i for h, i in rows if h == g], "s:" + (g or ""))


def plain_halves(n):
    if n <= 2:
        return list(range(n))
    out, todo = [0], [(0, n - 1)]
    while todo:
        nxt = []
        for lo, hi in todo:
            if hi - lo >= 2:
                out.append((lo + hi) // 2)
                nxt += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        todo = nxt
    return out + [i for i in range(n) if i not in set(out)]


def test_pools_are_walked_by_halves(spark):
    for n in (1, 2, 3, 4, 5, 17, 64, 100):
        got = spark.range(n).select("id", samples.halving_key(F.col("id"), F.lit(n)).alias("k")).orderBy("k").collect()
        assert [r.id for r in got] == plain_halves(n)


def test_spread_samples(spark):
    rng = np.random.default_rng(2)
    rows = [(p, f"r{i}", rng.choice(["Aspen Dental - South", "Aspen Dental, North", "Bee", "Cee LLC", "Dee", "...", "Ee", "Eff"]) + rng.choice(["", " (x)"]), rng.choice(["Ayr", "Bath", " ", "Cork"]), rng.choice(["", "a.com"])) for p in "pq" for i in range(60)]
    rows += [("few", "1", "One", None, None), ("none", "1", "...", "x", "y")]
    rows = [tuple(None if v is None else str(v) for v in r) for r in rows]
    got = samples.spread_sample(spark.createDataFrame(rows, "pool string, id string, name string, town string, site string"), "pool").collect()
    bare = lambda s: " ".join("".join(c if c.isalnum() else " " for c in __import__("re").split(r"[-–—,(|]", s.lower())[0]).replace("llc", " ").split())
    for pool in ("p", "q", "few", "none"):
        mine = sorted((r for r in rows if r[0] == pool), key=lambda r: (not r[4], r[2], r[1]))
        names, towns, first, rest = set(), set(), [], []
        for r in (mine[i] for i in plain_halves(len(mine))):
            if bare(r[2]) and bare(r[2]) not in names:
                names.add(bare(r[2]))
                town = (r[3] or "").strip()
                new = len(town) > 1 and town not in towns
                towns |= {town} if new else set()
                (first if new else rest).append(r[1])
        assert [r.id for r in sorted((r for r in got if r.pool == pool), key=lambda r: r["rank"])] == (first + rest)[:5]


def test_links_are_resolved_and_ranked(spark):
    html = """<a href="/About-us">x</a><a HREF='contact.html#form'>Write <b>SERVICES</b></a><a href="../services/?q">y<a href="//www.site.com/contact">z</a>
    <a href="https://other.com/contact">o</a><a href="mailto:contact@site.com">m</a><a href="?about">self</a><a href="/services/">again</a><a href="#contact">here</a>"""
    pages = spark.createDataFrame([(1, "https://site.com/a/b", html), (2, "https://site.com", "<a href='about'>x"), (3, None, html), (4, "https://site.com/", None)], "page_id long, url string, html string")
    got = [(r.page_id, r["rank"], r.link, r.score) for r in linking.ranked_links(pages).collect()]
    assert sorted(got) == [(1, 1, "https://site.com/a/contact.html", 9), (1, 2, "https://site.com/services/", 5), (1, 3, "https://www.site.com/contact", 4), (1, 4, "https://site.com/About-us", 2), (2, 1, "https://site.com/about", 2)]


def test_columns_are_told_by_content(spark):
    schema = "line long, a string, b string, c string"
    titled = [(1, "list of spring", None, None), (2, None, None, None), (3, " Company ", "PHONE", "Homepage"), (4, "Ann", "1", "acme.com/x"), (5, "Bob", None, "https://www.ACME.com"), (6, "Cy", "2", "none"), (7, "Di", "", None), (8, "Ed", "3", "b.org")]
    assert uploads.layout(spark.createDataFrame(titled, schema), "line") == uploads.Layout(3, "c", "a", "b")
    got = {r.line: (r.site, r.name, r.phone, r.why) for r in uploads.read_upload(spark.createDataFrame(titled, schema), "line", 1).collect()}
    assert got == {4: ("https://acme.com", "Ann", "1", None), 5: ("https://acme.com", "Bob", None, "the same website as an earlier line"), 6: (None, "Cy", "2", '"none" is not a website we can open'), 7: (None, "Di", None, "no website in this row"), 8: ("https://b.org", "Ed", "3", "beyond the limit")}
    plain = [(1, "x", "y", "z"), (2, "a.com", "see a.com", "b.org"), (3, "q", "t", "c.org"), (4, "d.net", None, "d.net")]
    assert uploads.layout(spark.createDataFrame(plain, schema), "line").site == "c"
    assert uploads.layout(spark.createDataFrame(plain[:1], schema), "line").site is None
    assert uploads.read_upload(spark.createDataFrame([], schema), "line").count() == 0


def test_representatives_are_those_of_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{h}{i}", int(o), f"http://{h}.com/x", float(lat), float(lon)) for h, lat0 in (("a", 0.0), ("b", 60.0)) for i, (o, lat, lon) in enumerate(zip(rng.permutation(120), lat0 + rng.uniform(0, 0.012, 120), 10 + rng.uniform(0, 0.02, 120), strict=True))]
    rows += [(f"c{i}", i, "c.com", 40.0 + i * 0.0012, 10.0) for i in range(30)] + [("d1", 1, "d.com", 1.0, 1.0), ("d2", 2, None, 1.0, 1.0), ("d3", 3, "d.com", None, 1.0), ("d1", 1, "d.com", 1.0, 1.0)]
    want = set()
    for host in "abcd":
        seen = []
        for i, _, _, lat, lon in sorted((r for r in rows if r[2] and r[2].replace("http://", "")[0] == host and r[3] is not None), key=lambda r: (r[1], r[0])):
            far = lambda p: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(lat - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - p[2]) / 2) ** 2)) > 200  # noqa: B023, E731
            if all(far(p) for p in seen):
                seen.append((i, lat, lon))
        want |= {(f"{host}.com", i) for i, _, _ in seen}
    got = resolve.representatives(spark.createDataFrame(rows, "id string, ordinal long, site string, lat double, lon double")).collect()
    assert {(r.host, r.id) for r in got} == want and len(got) == len(want) > 30


def test_edit_distances_and_suggestions(spark):
    def osa(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = np.random.default_rng(1)
    words = ["", "ca", "abc", "albequerque", "albuquerque", "pheonix", "phoenix", *["".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(40)]]
    pairs = [(a, b) for a in words for b in words[:25]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for cap in (1, 2):
        got = {(r.a, r.b): r.d for r in df.select("a", "b", text.edit_distance(F.col("a"), F.col("b"), cap).alias("d")).collect()}
        assert got == {(a, b): osa(a, b) if osa(a, b) <= cap else None for a, b in pairs}
    vocabulary = [(w, i) for i, w in enumerate(["albuquerque", "phoenix", "troy", "tracy", "cary", "gary", "sacramento"])]
    typed = ["albequerqe", "pheonix", "tryo", "cry", "sacremneto", "zzzzzzz", "phoenx"]
    got = {r.typed: (r.word, r.distance) for r in supply.suggestions(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame(vocabulary, "word string, n int")).collect()}
    assert got == {"albequerqe": ("albuquerque", 2), "pheonix": ("phoenix", 1), "tryo": ("troy", 1), "sacremneto": ("sacramento", 2), "phoenx": ("phoenix", 1)}

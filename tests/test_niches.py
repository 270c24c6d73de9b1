"""Trades served: references, quotes, sites that lead with a trade, generalists and odd rows."""

from pyspark.sql import functions as F

from wayfind.operators import niches, outreach


def rows(spark, pages):
    frame = spark.createDataFrame(pages, "id string, ordinal int, headline string, text string")
    return frame, {(r.id, r.niche): r for r in niches.served(frame, outreach.reads_like_prose).collect()}


def test_references_are_read(spark):
    one = spark.createDataFrame([("a&#8217;b&quot;c&mdash;d&nbsp;e&#x41;&#66;&#1114112;&#0;&amp;amp;", None)], "t string, n string")
    assert one.select(niches.decoded(F.col("t")), niches.decoded(F.col("n"))).first()[:] == ("a'b\"c-d eAB&#1114112;&#0;&amp;", None)


def test_fees_are_no_attorneys_and_restaurants_must_lead(spark):
    text = "We pay attorneys' fees for our marketing clients now. We bring restaurants more customers from search every week."
    _, got = rows(spark, [("a", 1, "", text), ("b", 1, "Restaurant marketing", text), ("c", 1, None, None), ("d", 1, "Dentists", "")])
    assert set(got) == {("b", "restaurant")}
    assert got["b", "restaurant"].leads and got["b", "restaurant"].strong and got["b", "restaurant"].mentions == 1


def test_mentions_are_distinct_sentences_over_pages(spark):
    menu, prose = "Dental Marketing | Dental SEO Services | Dental Ads Management", "we grow dental practices with search ads. We GROW dental practices with search ads."
    _, got = rows(spark, [("a", 1, "", menu), ("a", 2, "", prose), ("a", 3, "", prose)])
    assert (got["a", "dental"].mentions, got["a", "dental"].leads, got["a", "dental"].strong) == (4, False, True)
    assert got["a", "dental"].quote == "we grow dental practices with search ads."
    _, got = rows(spark, [("a", 1, "", menu)])  # a menu alone proves nothing
    assert not got


def test_long_sentences_are_cut_around_the_trade(spark):
    text = "we do the marketing " + "and more of it " * 20 + "for plumbers who want calls " + "and yet more of it " * 20
    _, got = rows(spark, [("a", 1, "", text)])
    quote = got["a", "plumbing"].quote
    assert quote[0] == quote[-1] == "…" and "plumbers" in quote and len(quote) <= 162 and quote[1:-1].split()[0] in {"and", "more", "of", "it"}


def test_generalists_have_no_primary_trade(spark):
    said = [f"we find more clients for {w} in your town every day." for w in ("dentists", "roofers", "plumbers", "lawyers", "realtors", "electricians")]
    six, five = " ".join(said), " ".join(said[:5])
    thrice = " ".join(f"we find more clients for dentists in town {k} every day." for k in "abc")
    frame, _ = rows(spark, [("many", 1, "", six + " " + thrice), ("led", 1, "Roofing leads", six), ("few", 1, "", five + " " + thrice), ("weak", 1, "", five)])
    found = niches.served(frame, outreach.reads_like_prose)
    assert {(r.id, r.niche) for r in niches.primary(found).collect()} == {("led", "roofing"), ("few", "dental")}
    assert niches.primary(niches.served(frame.limit(0), outreach.reads_like_prose)).count() == 0

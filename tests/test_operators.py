"""Operators against hand-made cases and plain loops."""

import datetime as dt
import math

from pyspark.sql import functions as F

from wayfind.functions import geo, stats, text
from wayfind.operators import accounts, judge, measure, resolve, supply
from wayfind.plans import over_accounts, over_places
from wayfind.sources import snapshot, uploads
from wayfind.sources.places import flatten, places_of

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_haversine_and_ring(spark):
    assert abs(one(spark, geo.haversine(F.lit(39.74), F.lit(-104.99), 33.45, -112.07)) - 585.6) < 1.5
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    got = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (1.0, 2.5)], "lat double, lon double").select(geo.in_ring(F.col("lat"), F.col("lon"), square).alias("x"))
    assert [r.x for r in got.collect()] == [True, False, False]
    assert len(geo.ring_of_circle(30, -90, 5)) == 97
    assert geo.within_any(F.lit(1), F.lit(1), [], 3) is not None


def test_text(spark):
    assert one(spark, text.host_of(F.lit("HTTPS://www.Example.com/a?b"))) == "example.com"
    assert one(spark, text.host_of(F.lit("localhost/x"))) is None
    assert one(spark, text.readable(F.lit("   "))) is False and one(spark, text.readable(F.lit(None).cast("string"))) is False
    assert one(spark, text.is_street_address(F.lit("1200 N. Main Street Suite 4"))) is True
    assert one(spark, text.is_street_address(F.lit("16 Park Dental Care"))) is False
    assert one(spark, text.bare_name(F.lit("Bright Smile, LLC - Downtown"))) == "bright smile"
    assert one(spark, text.similarity(F.lit("The Bright Dental Clinic"), F.lit("Bright Dental of Phoenix"))) == 1.0
    assert one(spark, text.similarity(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, text.visible_text(F.lit("<p>a<script>var t='</p>'</script> b</p>"))) == "a b"
    assert one(spark, text.emails(F.lit("Write A@b.com, a@B.com"))) == ["a@b.com"]
    assert one(spark, text.quote_holds(F.lit("open late\n every day"), F.lit("We are OPEN  late every day."))) is True
    assert one(spark, text.sentences(F.lit("Short. This one is long enough!"))) == ["This one is long enough"]


def test_intervals(spark):
    lo, hi = stats.wilson(F.lit(41), F.lit(41))
    assert abs(one(spark, lo) - 0.914) < 0.001 and one(spark, hi) == 1.0
    lo, hi = stats.wilson_corrected(F.lit(0), F.lit(25))
    assert one(spark, lo) == 0.0 and abs(one(spark, hi) - 0.166) < 0.001
    lo, hi = stats.wilson(F.lit(0), F.lit(0))
    assert (one(spark, lo), one(spark, hi)) == (0.0, 1.0)
    assert [one(spark, stats.band_credits(F.lit(x))) for x in (0.15, 0.149, 0.06, 0.0)] == [1, 4, 4, 5]


def test_rules_keep_the_unsettled(spark):
    pool = spark.createDataFrame([("a", 4.5), ("b", None), ("c", 2.0)], "name string, rating double")
    got = supply.apply_rules(pool, [("rating", F.col("rating") >= 4)]).collect()
    assert {r.name: r.first_fail for r in got} == {"a": None, "b": None, "c": "rating"}


def test_roll_up_and_fit(spark):
    facts = spark.createDataFrame([(1, "a", "match"), (1, "b", "match"), (2, "a", "match"), (2, "b", "no_match"), (3, "a", "blocked"), (3, "b", "couldnt_tell"), (4, "a", "match")], "id long, criterion_id string, verdict string")
    ids = spark.range(1, 6)
    got = {r.id: r.verdict for r in judge.roll_up(facts, ids, 2).collect()}
    assert got == {1: "match", 2: "no_match", 3: "blocked", 4: "unread", 5: "unread"}
    assert {r.verdict for r in judge.roll_up(facts, ids, 0).collect()} == {"match"}
    outcomes = spark.createDataFrame([(1, True, True), (2, True, None), (2, False, True), (3, True, False), (4, True, None)], "id long, must boolean, passed boolean")
    subjects = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 2), (5, 0)], "id long, pages int")
    assert {r.id: r.fit for r in judge.fit(outcomes, subjects, True, 2, 1).collect()} == {1: "strong", 2: "maybe", 3: "no", 4: "unreadable", 5: "unreadable"}
    assert {r.fit for r in judge.fit(outcomes.limit(0), subjects.filter("pages > 0"), True, 0, 0).collect()} == {"strong"}


def test_billing_groups_against_a_loop(spark):
    base = [(f"p{i}", f"n{i}", "http://one.example.com", None, None, 40.0 + (i * 7 % 13) * 0.0011, -100.0 + (i * 5 % 11) * 0.0013, i) for i in range(60)]
    base += [("x", "n", None, None, None, 40.0, -100.0, 99), ("y", "n", "two.example.com", None, None, 40.0, -100.0, 98)]
    got = resolve.billing_groups(spark.createDataFrame(base, "id string, name string, site string, phone string, addr string, lat double, lon double, ordinal long")).collect()

    def metres(a, b):
        h = math.sin(math.radians(b[5] - a[5]) / 2) ** 2 + math.cos(math.radians(a[5])) * math.cos(math.radians(b[5])) * math.sin(math.radians(b[6] - a[6]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    clusters = []
    for r in base[:60]:
        near = next((c for c in clusters if any(metres(o, r) <= 200 for o in c)), None)
        near.append(r) if near else clusters.append([r])
    want = {r[0]: f"one.example.com#{i}" if len(clusters) > 1 else "one.example.com" for i, c in enumerate(clusters) for r in c} | {"x": "id:x", "y": "two.example.com"}
    assert {r.id: r.group_key for r in got} == want


def test_charges_against_a_loop(spark):
    got = {r.request_id: (r.charged, r.reason, r.milli) for r in over_accounts.credit_charges(spark, SF).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    keys = {r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect() if r.c_custkey % 10}
    left, taken, want = {}, set(), {}
    for r in sorted(orders, key=lambda r: (r.o_orderdate, r.o_orderkey)):
        a, b, cost = r.o_custkey, r.o_orderkey % 7, r.o_orderkey % 5 + 1
        balance = left.setdefault(a, a % 20)
        if a not in keys:
            want[r.o_orderkey] = (False, "No such account.", 0)
        elif (a, b) in taken:
            want[r.o_orderkey] = (False, "Already unlocked by this workspace.", 0)
        elif a % 25 == 1:
            taken.add((a, b))
            want[r.o_orderkey] = (True, None, 0)
        elif balance < cost:
            want[r.o_orderkey] = (False, "Not enough credits left.", 0)
        else:
            left[a] -= cost
            taken.add((a, b))
            want[r.o_orderkey] = (True, None, cost)
    assert got == want


def test_refused_calls_leave_no_trace(spark):
    at = dt.datetime(2026, 1, 1)
    calls = [(i, 1, at + dt.timedelta(minutes=20 * i)) for i in range(8)]
    got = {r.call_id: r.admitted for r in accounts.rationed(spark.createDataFrame(calls, "call_id long, caller long, at timestamp"), 2, 5).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False}


def test_snapshot_round_trip(spark, tmp_path):
    places = places_of(spark, SF)
    snapshot.write(places, str(tmp_path))
    read = snapshot.read(spark, str(tmp_path), over_places.CITIES, over_places.MILES)
    near = lambda df: {r.id for r in df.filter(geo.within_any(F.col("lat"), F.col("lon"), over_places.CITIES, over_places.MILES)).collect()}
    assert near(read) == near(places)
    canaries = spark.createDataFrame([("c", 100), ("d", 0)], "canary string, n long")
    before = spark.createDataFrame([("c", 80)], "canary string, n long")
    failed = {(r.check, r.detail) for r in snapshot.gate(places, places.select("cat"), canaries, before).collect()}
    assert failed == {("canary", "c"), ("canary", "d")}


def test_nested_places(spark):
    nested = spark.sql("""SELECT 'a' AS id, named_struct('primary', 'N') AS names, named_struct('primary', 'dentist', 'hierarchy', array('x')) AS taxonomy, array() AS websites, array('1') AS phones,
      array(named_struct('freeform', 'f', 'locality', 'l', 'region', 'r')) AS addresses, named_struct('names', named_struct('primary', 'B')) AS brand, 'open' AS operating_status, 0.9D AS confidence,
      array(named_struct('dataset', 'm'), named_struct('dataset', 'm')) AS sources, named_struct('xmin', 1D, 'xmax', 3D, 'ymin', 4D, 'ymax', 4D) AS bbox""")
    row = flatten(nested).first()
    assert (row.site, row.phone, row.town, row.lon, row.lat, row.datasets) == (None, "1", "l", 2.0, 4.0, ["m"])


def test_upload(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Website,Name\nwww.a.com,"A ""x""\ny"\nhttp://a.com/z,B\n,C\n')
    rows = uploads.read_delimited(spark, str(tmp_path / "in.csv"))
    assert uploads.roles(["Website", "Name"]) == {"site": 0, "name": 1}
    body = rows.filter("_c1 <> 'Name'").withColumn("line", F.monotonically_increasing_id())
    kept, skipped = uploads.map_upload(body, F.col("_c0"), F.col("_c1"), F.lit(None).cast("string"), F.col("line"))
    assert [(r.site, r.name) for r in kept.collect()] == [("a.com", 'A "x"\ny')]
    assert {r.reason for r in skipped.collect()} == {"no website", "repeated website"}


def test_commonest_breaks_ties_by_first_seen(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("a", None, 0)], "k string, v string, o long")
    assert measure.commonest(rows, "k", "v", "o").collect()[0].v == "y"


def test_market_documents_are_written_by_market(spark, tmp_path):
    import json

    from wayfind.operators.supply import write_markets

    documents = over_places.market_documents(spark, SF)
    write_markets(documents, str(tmp_path / "markets"))
    back = spark.read.text(str(tmp_path / "markets")).collect()
    assert len(back) == places_of(spark, SF).count()
    read = [(r.market, json.loads(r.value)) for r in back]
    assert {(m, d["id"]) for m, d in read} == {(r.market, r.id) for r in documents.collect()}
    assert all(d["verdicts"][0]["criterion_id"] == "rated" for _, d in read)


def test_lines_beyond_the_limit_are_reported(spark):
    rows = spark.createDataFrame([(i, f"s{i}.com") for i in range(5)] + [(9, "s1.com"), (10, None)], "line long, site string")
    none = F.lit(None).cast("string")
    kept, skipped = uploads.map_upload(rows, F.col("site"), none, none, F.col("line"), most=3)
    assert [r.line for r in kept.orderBy("line").collect()] == [0, 1, 2]
    assert {(r.line, r.reason) for r in skipped.collect()} == {(3, "beyond the limit"), (4, "beyond the limit"), (9, "repeated website"), (10, "no website")}


def test_a_null_caller_is_one_caller(spark):
    calls = [(i, None, dt.datetime(2026, 1, 1, 0, i)) for i in range(4)]
    got = accounts.rationed(spark.createDataFrame(calls, "call_id long, caller long, at timestamp"), 2, 5).collect()
    assert sorted((r.call_id, r.admitted) for r in got) == [(0, True), (1, True), (2, False), (3, False)]


def test_the_curve_goes_from_neighbour_to_neighbour(spark):
    points = spark.range(256).select((F.col("id") % 16).alias("x"), F.expr("id div 16").alias("y"))
    at = points.select("x", "y", snapshot.hilbert(F.col("y") / 8 + 0.01, F.col("x") / 8 + 0.01, 4).alias("d")).orderBy("d").collect()
    assert [r.d for r in at] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(at, at[1:], strict=False))


def test_one_edit(spark):
    pairs = [("pheonix", "phoenix", 1), ("a", "a", 0), ("ab", "ba", 1), ("abc", "cba", None), ("", "a", 1), ("dallas", "dalas", 1), ("abcd", "badc", None)]
    got = spark.createDataFrame(pairs, "a string, b string, d int").select(text.edit_distance(F.col("a"), F.col("b"), 1).alias("x"), "d").collect()
    assert [r.x for r in got] == [r.d for r in got]

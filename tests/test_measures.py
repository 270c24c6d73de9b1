"""Scores under a design, sites read again, families, jobs as markets: small cases and odd rows."""

from wayfind.operators import accounts, change, judge, measure, supply


def frames(spark, labels, verdicts, designs=(), sampled=()):
    return [spark.createDataFrame(list(r), s) for r, s in (
        (labels, "set string, id int, criterion_id string, kind string, label string"), (verdicts, "set string, id int, criterion_id string, said string"), (designs, "set string, sampling string"), (sampled, "set string, id int"))]


def test_enriched_designs_refuse_recall_and_tell_drift(spark):
    labels = [(s, i, "a", "absence", label) for s in ("whole", "drawn") for i, label in enumerate(["match", "match", "no_match", "match", "wrong_site", None, "match", "match"])]
    said = ["match", "couldnt_tell", "match", "no_match", "match", "match", None]  # the eighth has no verdict at all
    verdicts = [(s, i, "a", v) for s in ("whole", "drawn") for i, v in enumerate(said)]
    got = {(r["set"], r.kind): r for r in measure.scored(*frames(spark, labels, verdicts, [("drawn", measure.ENRICHED)], [("drawn", 0), ("drawn", 1), ("drawn", 3), ("drawn", 2), ("drawn", 2)])).collect()}
    whole, drawn = got["whole", "absence"], got["drawn", "absence"]
    assert (whole.tp, whole.fp, whole.fn, whole.tn, whole.abstained_on_match, whole.wrong_site, whole.unsettled_label, whole.unsettled_verdict, whole.pairs) == (1, 1, 1, 0, 1, 1, 1, 1, 7)
    assert got["whole", "all"].not_judged == 1 and whole.not_judged == 0
    assert (whole.precision, whole.recall, whole.recall_decided, whole.kept) == (0.5, round(1 / 3, 6), 0.5, None)
    assert (drawn.precision, drawn.recall, drawn.recall_gate, drawn.recall_decided, drawn.kept) == (0.5, None, None, None, 0.5)


def test_scores_of_nothing(spark):
    assert measure.scored(*frames(spark, [], [])).count() == 0
    only = measure.scored(*frames(spark, [("s", 1, "a", "presence", "match")], [])).collect()
    assert [(r.kind, r.pairs, r.not_judged, r.precision, r.recall) for r in only] == [("all", 0, 1, None, None)]


PAGE, MARK = "site string, url string, html string, text string", "site string, family string, name string"


def levels(spark, pages, marks=(), **more):
    return change.site_levels(spark.createDataFrame(list(pages), PAGE), spark.createDataFrame(list(marks), MARK), **more)


def changed(before, after):
    return {r.level: r.changed for r in change.reread(before, after).collect()}


def test_levels_forgive_in_turn(spark):
    first = levels(spark, [("a", "u", "<p>", "Open 9:30 am, 1841 served"), ("a", "v", "<p>", "b"), (None, "w", "x", "x")], [("a", "chat", "x")])
    moved = levels(spark, [("a", "v", "<p>", "b"), ("a", "u", "<p>!", "open 10:15 p.m., 1902 served")], [("a", "chat", "x"), ("a", "chat", "x")])
    assert changed(first, moved) == {"raw": 1, "text": 1, "normalised": 0, "signals": 0}
    swapped = levels(spark, [("a", "v", "<p>", "Open 9:30 am, 1841 served"), ("a", "u", "<p>", "b")])  # the same texts at each other's address
    assert changed(first, swapped) == {"raw": 0, "text": 1, "normalised": 1, "signals": 1}


def test_other_rules_make_the_level_incomparable(spark):
    first, other = levels(spark, [("a", "u", None, "1")]), levels(spark, [("a", "u", "", "1"), ("b", "u", "", "")], noise=(("[0-9]", "D"),))
    got = {r.level: r for r in change.reread(first, other).collect()}
    assert (got["normalised"].comparable, got["normalised"].changed, got["normalised"].rate) == (False, None, None)
    assert (got["raw"].changed, got["raw"].shared, got["raw"].gone, got["raw"].new) == (0, 1, 0, 1)
    empty = {r.level: r for r in change.reread(first.limit(0), other.limit(0)).collect()}
    assert (empty["raw"].shared, empty["raw"].rate, empty["normalised"].comparable) == (0, None, True)


def test_a_path_ends_in_the_category_itself(spark):
    taxonomy = spark.createDataFrame([("health", ["health"]), ("dentist", ["health", "dentist"]), ("odd", ["odd", "dentist"]), ("bare", None), ("void", [])], "cat string, path array<string>")
    anchors = spark.createDataFrame([("health",), ("dentist",), ("dentist",), ("bare",), ("none",)], "anchor string")
    got = {(r.anchor, r.cat) for r in supply.families(taxonomy, anchors).collect()}
    assert got == {("health", "health"), ("health", "dentist"), ("dentist", "dentist"), ("bare", "bare")}
    places = spark.createDataFrame([("dentist",)] * 3 + [("health",), (None,)], "cat string")
    assert {(r.anchor, r.categories, r.places) for r in supply.family_counts(places, taxonomy, anchors).collect()} == {("health", 2, 4), ("dentist", 1, 3), ("bare", 1, 0), ("none", 0, 0)}


def test_rows_that_are_not_done_have_no_verdict(spark):
    schema = "job_id int, business_id string, name string, site string, state string, verdict string, read_outcome string, pages int, proof string"
    rows = spark.createDataFrame([(1, "a", None, "s", "done", "match", None, None, "p"), (1, "b", "n", "s", "reading", "match", "ok", 2, ""), (1, "c", "n", None, "done", "great", "thin", 1, None), (1, "d", "n", "s", None, None, None, None, None)], schema)
    got = {r.id: r for r in judge.job_rows(rows).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"a": "match", "b": "unread", "c": "unread", "d": "unread"}
    assert got["a"].read[:] == ("ok", 0) and got["a"].name == "" and got["b"].read is None and got["b"].proof is None
    one = judge.job_markets(judge.job_rows(rows)).first()
    assert (one.market, one.businesses, one.read, one.proofs, one.match, one.unread) == ("job:1", 4, 2, 1, 1, 3)


def test_markets_count_vendors_by_site(spark):
    sites = spark.createDataFrame([("m", f"s{i}", o, i) for i, o in enumerate(["ok", "thin", "ok", "timeout", "blocked", "probe_error"])] + [("void", "v", "timeout", 9)], "market string, site string, outcome string, ordinal int")
    marks = [("s0", "booking", "b", True, False), ("s0", "booking", "b", True, False), ("s0", "booking", "generic", False, False), ("s1", "booking", "a", True, True), ("s1", "booking", "c", True, True), ("s2", "booking", "c", True, False), ("s2", "chat", "x", True, True), ("s3", "booking", "a", True, True), ("gone", "booking", "z", True, True)]
    frame = spark.createDataFrame(marks, "site string, family string, name string, vendor boolean, home boolean")
    got = {r.market: r for r in measure.market_summary(sites, frame, "booking", ("chat",), top=2).collect()}
    m, v = got["m"], got["void"]
    assert (m.sampled, m.scored, m.excluded, m.excluded_pct, m.timeout, m.probe_error, m.judgeable_pct, m.floor_pct) == (6, 4, 2, 33.3, 1, 1, 50.0, 50.0)
    assert (m.considered, m.found, m.found_pct, m.beyond, m.beyond_pct, m.chat_pct, m.vendors) == (3, 3, 100.0, 2, 66.7, 33.3, ["c=2", "b=1"])
    assert (v.scored, v.judgeable_pct, v.considered, v.found_pct, v.vendors) == (0, 0.0, 0, 0.0, [])
    assert measure.market_summary(sites.limit(0), frame, "booking").count() == 0


def test_the_first_mark_since_the_last_unmark_holds(spark):
    log = [(1, "a", 1, True, "mail"), (1, "a", 2, True, "call"), (1, "b", 1, True, "mail"), (1, "b", 2, False, None), (1, "b", 3, True, " "), (1, "b", 4, True, "call"), (1, "c", 1, True, "mail"), (1, "c", 2, False, None), (2, "c", 5, False, None), (2, "a", 5, True, None)]
    frame = spark.createDataFrame(log, "account_id int, business_id string, at int, marked boolean, channel string")
    assert {tuple(r) for r in accounts.contacted(frame).collect()} == {(1, "a", 1, "mail"), (1, "b", 3, None), (2, "a", 5, None)}
    assert accounts.contacted(frame.limit(0)).count() == 0
    said = spark.createDataFrame([(1, "a", 1, None), (1, "a", 2, " "), (2, "a", 3, "other"), (3, "a", 4, "not_a_fit")], "account_id int, business_id string, at int, kind string")
    assert {tuple(r) for r in accounts.feedback(said).collect()} == {("a", "not_a_fit", 3, 2, 4), ("a", "other", 1, 1, 3)}

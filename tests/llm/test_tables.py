"""Vectors, urls and the whole pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind.llm import near_vectors, queries, url_filter
from wayfind.llm.components import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 70), (70, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 70: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_and_links_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, made = [], []
    for i in range(600):
        if i % 3 and made:
            x = made[rng.integers(0, len(made))] + rng.normal(0, rng.choice([0.02, 0.05, 0.08]), 64)
        else:
            x = rng.normal(size=64)
            x /= np.linalg.norm(x)
            made.append(x)
        rows.append((i, [float(np.float32(v)) for v in x], int(i % 2)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id")
    want = dict.fromkeys([r[0] for r in rows], 0)
    for label in (0, 1):
        ids = [r[0] for r in rows if r[2] == label]
        x = np.array([r[1] for r in rows if r[2] == label])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.93
        for i, n in zip(ids, near.sum(axis=1) - 1, strict=True):
            want[i] = int(n)
    assert all(got.n_links[i] <= n for i, n in want.items())
    assert got.n_links.sum() >= 0.9 * sum(want.values())
    assert (got.kept == (got.index == got.component_id)).all()


def test_components_overflow_and_labels(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(0, 0.11, 24)], "abc"[i % 3]) for i in range(240)]
    rows += [(900, [1e300, 0.0], "z"), (901, [1e300, 1e299], "z"), (902, [1e-300, 0.0], "z"), (903, [0.0, 1.0], "z")]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).toPandas().set_index("vec_id")
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for i, x, a in rows:
        for j, y, b in rows:
            if i < j and a == b and len(x) == len(y):
                u, v = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    low, high = sorted((find(i), find(j)))
                    parent[high] = low
    assert sum(links.values()) > 100 and got.n_links.to_dict() == links
    assert got.component_id.to_dict() == {i: find(i) for i in parent}


def test_recall_with_three_rotations(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 8))
    near = base[:600] + rng.normal(0, 0.2, (600, 8)) * np.linalg.norm(base[:600], axis=1, keepdims=True) / np.sqrt(8)
    x = np.concatenate([base, near])
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    assert np.log(len(x)) / np.log(16) > 2
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).agg({"n_links": "sum"}).first()[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert 0.9 <= got / ((x @ x.T >= 0.93).sum() - len(x)) <= 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [None, 1.0], 0), (9, [inf, 1.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    schema = "vec_id long, embedding array<float>, label int"
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()]
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_urls_match_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    names = ["page_id", "host", "path", "rule", "verdict"]
    plain = lambda df: sorted(map(str, df[names].astype(object).where(df[names].notna(), None).to_numpy().tolist()))
    assert plain(queries.QUERIES["op6_url_filter"](spark, SF).toPandas()) == plain(con.sql(queries.ORACLES["op6_url_filter"]).df())


def test_rules_and_odd_urls(spark):
    urls = ["http://A.Example.COM/en/71?x", "https://b.com/en/", "https://b.com/EN/", "http://com/en/1", "x://notcom/en/", "http://example.net/de/8", "http://w.example.net/de/7#q", "nothing", None, "http://h", "http://o.org/es/?a://b.com/en/"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)] + [(None, "http://c.com/en/x", "e"), (0, urls[0], "e")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()]
    want = [
        (0, "a.example.com", "/en/71", "example.com/en/7", "allow"), (0, "a.example.com", "/en/71", "example.com/en/7", "allow"), (1, "b.com", "/en/", "com/en/", "block"), (2, "b.com", "/EN/", None, "allow"), (3, "com", "/en/1", "com/en/", "block"),
        (4, "notcom", "/en/", None, "allow"), (5, "example.net", "/de/8", "example.net/de/8", "block"), (6, "w.example.net", "/de/7", "net/de/", "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "h", "", None, "allow"), (10, "o.org", "/es/", "org/es/", "block"), (None, "c.com", "/en/x", "com/en/", "block"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_domains_and_suffixes(spark):
    hosts = ["a.b.example.com:8080", "shop.name.co.uk", "10.0.0.1:80", "10.0.0.1", "x.github.io", "localhost", ""]
    domain, suffix = url_filter.domain_and_suffix(F.col("host"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select(domain, suffix).collect()]
    assert got == [("example.com", "com"), ("name.co.uk", "co.uk"), ("10.0.0.1", ""), ("10.0.0.1", ""), ("x.github.io", "github.io"), ("localhost", "localhost"), ("", "")]


def test_bad_hosts_are_blocked(spark):
    pages = [(i, f"http://{'bad' if i % 4 == 0 else 'h' + str(i % 40)}.site.info/x") for i in range(800)]
    labels = [(i, 0 if i % 4 == 0 else int(i % 11 != 0)) for i in range(800)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    assert set(got[got.host == "bad.site.info"].verdict) == {"block"}
    assert (got[got.host != "bad.site.info"].verdict == "allow").mean() > 0.9


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert 0 < docs.select("doc_id").distinct().count() < before
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all() and packed[packed.piece == 0].shape[0] == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_pipeline_matches_brute_force(spark):
    """Toxicity's verdicts are taken as given; groups, passages, copies and ids of all later stages are worked out plainly."""
    import zlib
    from collections import Counter

    import public_tokenizers
    from test_text_operators import brute_components
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from wayfind.llm import mixing, toxicity

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.judge(documents, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    rows = {r.doc_id: (r.text or "", r.source) for r in documents.collect() if r.doc_id not in toxic}
    groups = brute_components([(i, t) for i, (t, _) in rows.items()])
    rows = {i: v for i, v in rows.items() if groups[i][1] == i}
    seen, left = {}, {}
    for i in sorted(rows):
        words = rows[i][0].encode().split()
        covered = [False] * len(words)
        for at in range(len(words) - 19):
            if seen.setdefault(tuple(words[at : at + 20]), (i, at)) != (i, at):
                covered[at : at + 20] = [True] * 20
        kept = b" ".join(w for w, c in zip(words, covered, strict=True) if not c) if any(covered) else rows[i][0].encode()
        if kept or not any(covered):
            left[i] = (kept.decode(), rows[i][1])
    sizes = Counter()
    for t, s in left.values():
        sizes[s] += len(t.encode().split())
    goals = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sorted(sizes.items()), "source string, source_size long")).collect()}
    slow, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    draws = {r.doc_id: r.u for r in spark.createDataFrame([(i,) for i in left], "doc_id long").select("doc_id", mixing.uniform(F.col("doc_id"), "mix").alias("u")).collect()}
    for i, (t, s) in left.items():
        rate = min(goals[s] / sizes[s] if sizes[s] else 0.0, 3.0)
        copies = int(rate) + (draws[i] < rate - int(rate))
        ids = slow.encode(t, add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids) + 1, 1024)], strict=True)):
            want[i, k, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += copies
    got = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


def test_pipeline_of_odd_and_empty_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int, size int"
    text = "one two three four five six seven eight"
    odd = [(1, text, "en", "a", 39, 1, 2), (1, text, "en", "a", 39, 1, 2), (None, text, "en", None, 39, 1, 2), (2, None, None, "b", None, None, None), (3, "", "en", "b", 0, 1, 2), (4, "word " * 20_000, "en", None, 100_000, 1, 2)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).checkpoint()
            assert docs.columns == spark.createDataFrame([], schema).columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.filter("piece = 0").count() == docs.count()

"""Personal data, centroid clustering and importance resampling against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import ODD, SCHEMA

from wayfind.llm import centroids, importance, personal, queries

SF = "/root/testdata/sf0.001"
LONG = [(12, "9" * 60_000, "en", "a", 1, "x", 0, "t"), (13, "1.2.3" * 20_000 + "@" * 1_000 + "+" * 1_000, "en", "a", 1, "x", 0, "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD + LONG, SCHEMA)


def sql_rows(name, columns):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", ["op12_centroids", "op13_importance_resampling"])
def test_rows_match_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sql_rows(name, got.columns)


def plain_luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    """The patterns as they are stated, by a backtracking engine."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "1", "255", "256", "0007", "4111111111111111", "49927398716", "é", "%", "_", "\n", "user@mail.org", "+1 (743) 555-3824", "10.0.0.1"]), max_size=24))
def test_base_spans_are_the_patterns(parts):
    text = "".join(parts)
    assert personal.base_spans(text) == plain_base(text)


@given(st.integers(2, 6), st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_beliefs_on_trees_are_exact(n, seed):
    rng = np.random.default_rng(seed)
    model = personal.Model(np.zeros((1, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    unary = rng.normal(size=(n, 5))
    edges = [(int(rng.integers(0, i)), i, bool(rng.integers(0, 2))) for i in range(1, n)]
    want = np.zeros((n, 5))
    for y in itertools.product(range(5), repeat=n):
        weight = math.exp(sum(unary[i, y[i]] for i in range(n)) + sum((model.skip if s else model.chain)[y[a], y[b]] for a, b, s in edges))
        for i in range(n):
            want[i, y[i]] += weight
    pairs = lambda kind: personal._edges([(a, b) for a, b, s in edges if s == kind])
    got = personal.beliefs(unary, pairs(False), pairs(True), model, sweeps=60)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    return personal.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def added(text, model):
    base, every = next(personal.all_spans([text], model))
    assert set(base) <= set(every)
    return {(personal.KINDS[k], text[s:e]) for s, k, e in every if (s, k, e) not in base}


def test_distant_repeats_take_one_label(model):
    assert added("call +1 (743) 555-3824 now; later (743) 555-3824 or 743.555.3824, not 212-555-0000", model) == {("phone", "(743) 555-3824"), ("phone", "743.555.3824")}
    assert added("mail thwhhe.68@mail2.example.com; then thwhhe.68 said, section.12 says", model) == {("email", "thwhhe.68")}
    assert added("card 4994226020900891, printed 4994.2260.2090.0891, not 4994226020900892", model) == {("card", "4994.2260.2090.0891")}
    assert added("743.555.3824 and section.12 of 2020-01-01", model) == set()
    far = "x " * 20_000
    assert added(f"+1 (743) 555-3824 {far} 743.555.3824 {far} 743.555.3824", model) == {("phone", "743.555.3824")}


def test_personal_data_of_tables_and_odd_rows(spark, odd, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in personal.find(docs).collect():
        base = plain_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        listed = [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(",")) | {""}
    got = personal.find(odd, model).collect()
    assert len(got) == odd.count() and {r.doc_id: r.spans for r in got}[7] == ""
    assert personal.find(odd.limit(0)).count() == 0 and personal.fit(odd.filter("doc_id < 10")) is None


def test_redaction(spark, model):
    rows = [(1, "write to thw.68@mail2.example.com, or thw.68, from 10.0.0.1", 7), (2, None, 7), (None, "", 7), (1, "clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = personal.redact(docs, model)
    assert out.columns == docs.columns and sorted((str(r.text) for r in out.collect())) == ["", "None", "clean", "write to [EMAIL], or [EMAIL], from [IP]"]


def test_nearest_is_exact_and_compares_less():
    rng = np.random.default_rng(3)
    for spread in (1, 40, 1 << 24):
        c = rng.integers(-spread, spread + 1, (40, 64))
        x = np.concatenate([rng.integers(-spread, spread + 1, (500, 64)), c, c[:5] + 1])
        search = centroids.Search(c)
        number, best = search.nearest(x)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (best == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()
    levels = np.arange(40)[:, None] * 50 + rng.integers(-9, 9, (40, 64))
    search = centroids.Search(levels)
    search.nearest(np.repeat(levels, 30, axis=0) + rng.integers(-9, 9, (1200, 64)))
    assert search.compared < 2 * 1200  # of 40 * 1200
    ties = centroids.Search(np.array([[2, 0], [0, 2], [2, 0]]))
    assert ties.nearest(np.array([[1, 1], [3, 0], [0, 3]]))[0].tolist() == [0, 0, 1]


def test_odd_vectors(spark):
    nan, inf, v = float("nan"), float("inf"), [0.5] * 64
    rows = [(1, v, "x"), (1, v, "x"), (None, v, None), (2, [-0.001] * 64, "x"), (3, None, "x"), (4, [nan] + v[1:], "x"), (5, [None] + v[1:], "x"), (6, [inf] + v[1:], "x"), (7, v[1:], "x"), (8, [], "x"), (9, [3e38, -3e38] * 32, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    got = {(r.vec_id, r.distance) for r in centroids.cluster(df).collect()}
    assert got == {(1, 0), (None, 0), (2, 0), (9, 0)}
    two = centroids.cluster(df.filter("vec_id < 9"), clusters=2, rounds=3).collect()
    assert len(two) == 3 and {r.cluster_inertia for r in two} == {0}
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df.filter("vec_id = 3")).count() == 0
    far = centroids.cluster(df, clusters=1, rounds=1).collect()
    assert len(far) == 5 and all(r.inertia == sum(x.distance for x in far) for r in far)


def plain_resampling(docs, target, buckets=10_000, seed=2024, least=20, percent=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    of = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(of(w) for _, x in docs for w in low(x)), Counter(of(w) for x in target for w in low(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[of(w)] for w in low(x))
        rows.append((i, len(low(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return sorted([(*r, k + 1 if k < len(able) * percent // 100 else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least], key=str)


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([("One TWO word Ü 9",), (None,), ("",)], "text string")
    got = sorted(map(tuple, importance.resample(odd, target, least=1, percent=60).collect()), key=str)
    assert got == plain_resampling([(r[0], r[1]) for r in ODD + LONG], [r.text for r in target.collect()], least=1, percent=60)
    empty = importance.resample(odd.limit(0), target.limit(0))
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank"] and empty.count() == 0
    assert importance.resample(odd, target.limit(0)).filter("n_features = 0 and (weight != 0 or rank is not null)").count() == 0


def test_radix_order(spark):
    rng = np.random.default_rng(5)
    big = [(-(1 << 63)), (1 << 63) - 1, -1, 0, 1, None, None]
    rows = [(int(a), big[int(b)], i) for i, (a, b) in enumerate(zip(rng.integers(-3, 3, 3000), rng.integers(0, 7, 3000), strict=True))]
    got = importance.radix_ranked(spark.createDataFrame(rows, "a long, b long, i long").repartition(7), "b", "a").collect()
    assert sorted(r.place for r in got) == list(range(3000))
    assert [(r.b, r.a) for r in sorted(got, key=lambda r: r.place)] == [(b, a) for a, b, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    same = importance.radix_ranked(spark.range(50).selectExpr("1L as k"), "k").collect()
    assert sorted(r.place for r in same) == list(range(50)) and importance.radix_ranked(spark.range(0).selectExpr("id as k"), "k").count() == 0

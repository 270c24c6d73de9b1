"""Operators on texts against brute force, and the cases that their docstrings define."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfind.llm import license_scan, media, mixing, packing, quality, queries, shingle_join, substring_dedup, toxicity
from wayfind.llm import progressive_jpeg as jpeg
from wayfind.llm.textops import gram_hashes, text_slices, word_hashes, words_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bin long, token string"
ODD = [
    (5, "one two three four five six seven", "en", "a", 1, "x", 0, "t"), (6, "one two three four five six seven", "en", "a", 1, "x", 0, "t"), (6, "one two three four five six seven", "en", "a", 1, "x", 0, "t"),
    (None, "one two three four five six seven", "en", None, 1, "x", 0, "t"), (7, None, None, "b", None, None, None, None), (8, "", "en", "b", 0, "x", 0, "t"), (9, " \t\n", "en", "c", 3, "x", 0, "t"),
    (10, "word " * 30_000, "en", "b", 150_000, "x", 0, "t"), (11, "\u00a0é\u2003 <|endoftext|> ü", "fr", "c", 9, "x", 0, "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_kept(rows):
    seen, out = {}, {}
    for i, t in sorted(set(rows)):
        w = (t or "").encode().split()
        covered = [False] * len(w)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                covered[s : s + 20] = [True] * 20
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        out[i] = (len(w), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_words_and_grams():
    texts = ["a b  c", "", None, "c\ta b\u00a0b", "a b c"]
    (lo, hi, buf, offsets), = text_slices(pa.array(texts))
    words = words_of(buf, offsets)
    assert (lo, hi) == (0, 5) and words.counts.tolist() == [3, 0, 0, 3, 3]
    h = word_hashes(buf, words)
    assert h[0] == h[4] == h[6] and h[2] == h[3] == h[8] and h[1] == h[7] != h[5]
    g = gram_hashes(h, 3)
    assert g[0] == g[6] and len(set(g.tolist())) == len(g) - 1
    assert [s[:2] for s in text_slices(pa.array(["x" * 10] * 5), 20)] == [(0, 2), (2, 4), (4, 5)]


def test_components_match_brute_force(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(documents).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in documents.collect()])


def test_hard_sets(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(vocabulary, 90))
    passage = list(rng.choice(vocabulary, 40))
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # a crowd of near copies, more or less far from the first
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(1, 7)):
            words[at] = vocabulary[rng.integers(0, 40)]
        rows.append((i, " ".join(words[: 90 - rng.integers(0, 6)])))
    rows += [(200 + i, " ".join(list(rng.choice(vocabulary, 30)) + passage + list(rng.choice(vocabulary, 25)))) for i in range(60)]
    rows += [(300 + i, " ".join(f"s{j}" for j in range(i % 4, i % 4 + 5 + i % 9))) for i in range(60)]  # light sets
    rows += [(400 + i, " ".join(rng.choice(vocabulary[:12], rng.integers(1, 16)))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_boundary_follows_the_cost():
    assert shingle_join.light_boundary({100: 5}, 75) == 4
    assert shingle_join.light_boundary({12: 1, 200: 10**6}, 75) in shingle_join.BOUNDARIES


def test_joins_on_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(5, 3, 5), (6, 3, 5), (6, 3, 5), (None, 3, 5), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 11)], key=str)
    kept = shingle_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, None, 7, 8, 9, 10, 11], key=str)
    assert shingle_join.near_duplicates(odd.limit(0)).count() == 0


def test_repeats_match_brute_force(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_report(documents).collect()}
    assert got == brute_kept([(r.doc_id, r.text) for r in documents.collect()])


def test_repeats_within_and_across(spark):
    rng = np.random.default_rng(5)
    some = lambda n: [f"v{x}" for x in rng.integers(0, 60, n)]
    shared = some(33)
    rows = [(i, " ".join(some(rng.integers(0, 70)) + shared[rng.integers(0, 14) :] + some(rng.integers(0, 30)) + (shared if i % 3 else []))) for i in range(80)]
    rows += [(100, "a b " * 60), (101, "x " * 19), (102, "x " * 21), (103, "x " * 21)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_kept(rows)


def test_dedup_on_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_report(odd).collect()), key=str)
    assert got == sorted([(5, 7, 0), (6, 7, 0), (6, 7, 0), (None, 7, 0), (7, 0, 0), (8, 0, 0), (9, 0, 0), (10, 30000, 29999), (11, 3, 0)], key=str)
    rest = substring_dedup.dedup(odd)
    assert rest.columns == odd.columns and rest.count() == odd.count()
    long = rest.filter("doc_id = 10").first()
    assert long.text == "word" and long.n_chars == 4
    assert rest.filter("doc_id = 9").first().text == " \t\n"
    assert substring_dedup.dedup_report(odd.limit(0)).count() == 0


def test_mix_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    got = queries.QUERIES["op1_mixing"](spark, SF).select(*names).toPandas().sort_values("doc_id").round(6).to_numpy().tolist()
    assert got == con.sql(queries.ORACLES["op1_mixing"]).df()[names].sort_values("doc_id").round(6).to_numpy().tolist()


def test_targets_fill_up_to_the_limit(spark):
    def loop(sizes):
        names = sorted(sizes)
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        capped, target = set(), {}
        while True:
            left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
            free = [s for s in names if s not in capped]
            target = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            above = {s for s in free if target[s] > 3 * sizes[s]}
            if not above:
                return target
            capped |= above

    for sizes in ({"a": 1, "b": 10, "c": 100}, {"a": 5, "b": 0, "c": 7, "d": 900, "e": 2}, {"a": 3}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(loop(sizes))


def test_mix_never_deals_documents_by_source(spark, odd, monkeypatch):
    """Whether sources fit into one broadcast or take several, the same rows come, and no exchange carries texts."""
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    plain = sorted(map(str, mixing.plan_mix(odd).select(columns).collect()))
    for most in (mixing.BROADCAST_BYTES, 120):
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", most)
        assert sorted(map(str, mixing.plan_mix(odd).select(columns).collect())) == plain
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_mix_on_odd_rows(spark, odd):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == 9 and all(r.taken == r.copies * r["size"] and r.copies <= 3 for r in plan)
    assert len({r.copies for r in plan if r.doc_id == 6}) == 1
    mixed = mixing.mix(odd)
    assert mixed.count() == sum(r.copies for r in plan) and "text" in mixed.columns
    assert mixing.plan_mix(odd.limit(0)).count() == 0


def test_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(documents).collect()
    ids = {r.doc_id: slow.encode(r.text or "", add_special_tokens=False).ids + [2] for r in documents.collect()}
    bins = {}
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for at, size in sorted(pieces):
            assert at == end
            end += size
        assert end <= 1024
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r.length)
    assert all(sum(v) == len(ids[d]) and all(x == 1024 for x in v[1:]) and len(v) == -(-sum(v) // 1024) for d, v in by_doc.items())
    assert len(bins) <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_packing_merges_partitions_and_odd_rows(spark, odd):
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id % 37 as int) * 9)").alias("text")).repartition(40)
    rows = packing.pack(many).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) + 2
    got = packing.pack(odd).collect()
    assert sum(1 for r in got if r.piece == 0) == 9 and {(r.length) for r in got if r.doc_id in (7, 8)} == {1}
    assert packing.pack(odd.limit(0)).count() == 0
    where, place, fill = packing.best_fit(np.array([600, 600, 424, 400]), 1024)
    assert sorted(fill.tolist()) == [1000, 1024] and place.tolist() == [0, 0, 600, 600]


def test_packing_hands_on_every_item_of_bins_that_are_not_nearly_full(spark):
    for parts in (2, 3):  # the first partitions hold long pieces alone, the last short ones alone
        words = F.when(F.col("id") < 6000 * (parts - 1), 39).otherwise(23)
        docs = spark.range(0, 6000 * parts, 1, parts).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.repeat(F.lit(" word"), words - 1)).alias("text"))
        for merge in (packing.MERGE, 500):
            rows = packing.pack(docs, length=64, merge=merge).collect()
            bins = {}
            for r in rows:
                bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert len(rows) == docs.count() == len({r.doc_id for r in rows})
            assert all(at == sum(size for _, size in sorted(b)[:k]) and at + n <= 64 for b in bins.values() for k, (at, n) in enumerate(sorted(b)))
            assert len(bins) == sum(r.length == 40 for r in rows)


def test_packing_counts_like_items():
    rng = np.random.default_rng(1)
    for length in (10, 64, 1024):
        sizes = rng.integers(1, length + 1, 3000) if length > 10 else rng.integers(1, 4, 3000)
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
        plan, fill = packing.fit_counts(counts, length), {}
        for (size, at, first, each, place), end in zip(plan.tolist(), [*plan[1:, 1].tolist(), 0], strict=True):
            for k in range((end or counts[size]) - at):
                bin_, row = first + k // each, k % each
                assert fill.get(bin_, 0) == place + row * size
                fill[bin_] = fill.get(bin_, 0) + size
        assert sorted(fill.values()) == sorted(packing.best_fit(sizes, length)[2].tolist())


def test_coefficients_survive_the_file():
    rng = np.random.default_rng(0)
    wide, high = np.array([3, 1, 7]), np.array([2, 1, 5])
    n = int((wide * high).sum())
    blocks = [(rng.integers(-255, 256, (k, 64)) * (rng.random((k, 64)) < rng.random((k, 1)))).astype(np.int16) for k in (4 * n, n, n)]
    blocks[0][1] = 0
    blocks[0][2, 1:40] = 0
    read = jpeg.decode(jpeg.encode(blocks, wide, high, [b"x"] * 3))
    at = 0
    for i, image in enumerate(read):
        k = int(wide[i] * high[i])
        assert all((image.coefficients[c] == blocks[c][at * m : (at + k) * m]).all() for c, m in ((0, 4), (1, 1), (2, 1)))
        assert jpeg.rgb(image).shape == (16 * high[i], 16 * wide[i], 3)
        at += k


def test_inverse_transform():
    flat = np.zeros((1, 64), np.int16)
    flat[0, 0] = 80
    assert (jpeg.samples(flat, b"\1" * 64) == 138).all()
    flat[0, 1] = 40
    x = np.arange(8)
    want = np.floor(10 + 40 * np.sqrt(0.125) * 0.5 * np.cos((2 * x + 1) * np.pi / 16) + 0.5) + 128
    assert np.abs(jpeg.samples(flat, b"\1" * 64).reshape(8, 8)[0] - want).max() <= 1


def test_media_round_trip(spark, odd):
    rows = media.report(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 33}) == 1
    stored = media.media(odd)
    pixels = media.tensors(stored).filter("doc_id = 5").first()
    assert len(pixels.rgb) == pixels.height * pixels.width * 3
    assert media.report(odd.limit(0)).count() == 0


def test_toxicity(spark, odd, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    words = ["idle chat", "kind words", "plain talk"]
    rows = [(i, " ".join(words[(i + k) % 3] for k in range(20)) + (" vile slur vile" if i % 4 == 0 else ""), "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    truth = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    got = toxicity.judge(docs, truth).toPandas()
    held = got[got.held_out]
    assert len(got) == 400 and len(held) > 40 and ((held.doc_id % 4 == 0).astype(int) == held.predicted).all()
    assert toxicity.keep_clean(docs, truth).count() == 300
    model = toxicity.fit(docs, truth)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == 9 and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id in (7, 8, 9)}) == 1
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert {r.score for r in toxicity.judge(documents, labels.limit(0)).collect()} == {0.0}


def test_quality(spark, odd):
    rows = [(i, ("Good plain prose of some length here. " if i % 3 else "$$$ WIN!!! ### ") * (5 + i % 7), "en", f"s{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    truth = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    got = quality.classify(docs, truth, F.col("source"), F.concat_ws("/", "source", "lang")).toPandas()
    assert len(got) == 300 and (got.keep == (got.doc_id % 3 != 0)).all()
    assert quality.classify(odd, truth, F.col("source"), F.col("lang")).count() == 9
    assert {r.keep for r in quality.classify(odd, truth.limit(0), F.col("source"), F.col("lang")).collect()} <= {True, False}
    assert quality.classify(odd.limit(0), truth, F.col("source"), F.col("lang")).count() == 0


def test_quality_counts_every_label(spark):
    docs = spark.createDataFrame([(i, "plain prose", "en", f"s{i}") for i in range(40)], "doc_id long, text string, lang string, source string")
    truth = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    sites = quality.posteriors(docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path")), truth).collect()
    assert {r.host for r in sites} == {f"s{i}" for i in range(40)} and {round(r.overall, 9) for r in sites} == {0.5}
    got = {r.doc_id: r for r in quality.classify(docs, truth, F.col("source"), F.col("lang")).collect()}
    assert not any(r.held_out for r in got.values()) and all((r.site_rate > 0.5) == (i % 2 == 1) for i, r in got.items())
    measured = quality.classify(docs, truth, F.col("source"), F.col("lang"), hold_out=True).collect()
    held = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert held and {r.doc_id for r in measured if r.held_out} == held


def test_licences(spark):
    files = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.py", "code\ncode"), (3, "r/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "r/a/c/y.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code " * 300), (5, "q/z.py", "nothing"), (6, None, None), (7, "r/d/e.py", ""), (7, "r/d/e.py", ""), (8, "q/w.py", "licensed to thrill everyone at the weekend show"),
    ]
    rows = license_scan.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()
    got = {r.file_id: (r.license, r.via, r.source_dir) for r in rows}
    assert len(rows) == 9
    assert got == {1: ("MIT", "header", None), 2: ("Apache-2.0", "inherited", "r/a"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "header", None), 5: (None, "none", None), 6: (None, "none", None), 7: ("MIT", "inherited", "r"), 8: (None, "none", None)}
    assert license_scan.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_licences_of_whole_files_blocks_and_spdx_forms(spark):
    full = dict(license_scan.all_templates()[:9])
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    code = "import os\nfor name in os.listdir(home):\n    print(name)\n" * 40
    files = [(f"{name}/7", "Copyright (c) 2020 Some Body\n\n" + text, name) for name, text in full.items()]
    files += [(f"{name}/src/main.c", code, name) for name in full]
    files += [("own/a.py", gpl + code, "GPL-3.0"), ("own/b.py", "# SPDX-License-Identifier: MIT\n" + code, "MIT"), ("own/c.rs", "// SPDX-License-Identifier: Apache-2.0\r\n" + code, "Apache-2.0"), ("own/d.c", "/* SPDX-License-Identifier: GPL-2.0-only */\n" + code, "GPL-2.0")]
    files += [("own/e.py", "# " + full["MIT"].replace("\n", "\n# ") + "\n\n" + code, "MIT"), ("own/f.py", code, None), ("own/g.py", "# SPDX-License-Identifier: Zlib\n" + code, None), ("own/h.txt", "The weekend show is free and open to the public, who may use any seat.", None)]
    files += [("named/COPYING", gpl + "and so on, " * 400, "GPL-3.0"), ("named/x.py", code, "GPL-3.0")]
    rows = [(i, path, text) for i, (path, text, _) in enumerate(files)]
    got = {r.path: r.license for r in license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {path: name for path, _, name in files}


def test_token_groups_of_linked_sets():
    rng = np.random.default_rng(8)
    for k in range(1500):
        a = int(rng.integers(1, 14) if k % 3 == 0 else rng.integers(5, 300))
        b = int(rng.integers(-(-75 * a // 100), a * 100 // 75 + 1))
        common = -(-(a + b) * 75 // 175)
        if common > min(a, b):
            continue
        tokens = rng.permutation(np.unique(rng.integers(0, 2**63, 2 * (a + b) + 9).astype(np.uint64)))[: a + b - common]
        x, y = np.sort(tokens[:a]), np.sort(np.concatenate([tokens[:common], tokens[a:]]))
        (gx, may_x), (gy, may_y) = shingle_join.first_groups(x, 75), shingle_join.first_groups(y, 75)
        assert len(set(gx.tolist()) & set(gy.tolist())) > may_x + may_y
        for mine, theirs in ((x, y), (y, x)):  # and in one of the two dealings at least as many of all as a set must share
            whole = [set(np.concatenate([before, last]).tolist()) for before, last, _ in shingle_join.token_groups(theirs, 75)]
            assert any(len(set(np.concatenate([before, last]).tolist()) & set().union(*whole)) >= max(1, 0 if len(before) else len(last) - differ) for before, last, differ in shingle_join.token_groups(mine, 75))


def test_diffuse_groups(spark):
    rng = np.random.default_rng(21)
    vocabulary = [f"q{i}" for i in range(300)]
    rows = []
    for g in range(3):  # copies of a text that is not there itself, so that few link with any one of them
        base = list(rng.choice(vocabulary, 120))
        for i in range(45):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(2, 8)):
                words[at] = vocabulary[rng.integers(0, 300)]
            rows.append((1000 * g + i, " ".join(words[rng.integers(0, 4) : 120 - rng.integers(0, 12)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) > 3


def test_packing_pairs_what_two_partitions_hold(spark):
    docs = spark.range(0, 20_000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.repeat(F.lit(" word"), F.when(F.col("id") < 10_000, 600).otherwise(400))).alias("text"))
    rows = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(rows) == 10_000 and all(r.n <= 1024 for r in rows)


def test_clashing_columns_pass_through(spark):
    names = ["gone", "_gone", "doc", "_doc", "runs", "_runs", "size", "_copy", "copies", "of", "key", "_source"]
    text = "one two three four five six seven " * 6
    docs = spark.createDataFrame([(i, text, "en", "a", 1, *range(len(names))) for i in (1, 2)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for made in (mixing.mix(docs), substring_dedup.dedup(docs), shingle_join.keep_one(docs)):
        assert made.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in made.collect())


def test_toxicity_scores_match_a_plain_loop(spark, documents):
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    known = toxicity._function_table()
    some = documents.filter("n_chars < 1500").orderBy("doc_id").limit(25)
    got = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    for r in some.collect():
        rows, first = toxicity.features(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))
        words = [sum(model.table[i] for i in row) for row in rows]
        logit = model.base
        for w, (weights, bias) in enumerate(zip(model.filters, model.bias, strict=True)):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(words) - len(weights) + 1):
                    best = max(best, sum(float(words[at + i] @ weights[i][:, f]) for i in range(len(weights))) + float(bias[f]))
                logit += best * float(model.out[w * toxicity.FILTERS + f])
        votes = [sum(known[row[0]] == k + 1 for row in rows) for k in range(len(toxicity.LANGUAGES))]
        language = votes.index(max(votes)) if max(votes) else len(toxicity.LANGUAGES)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(logit - model.threshold[language]))), abs=1e-3)


def test_quality_matches_a_plain_loop(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(documents, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    good = {}
    for r in labels.collect():
        if r.quality in (0, 1) and r.doc_id is not None:
            good[r.doc_id] = min(r.quality, good.get(r.doc_id, 1))
    rows = [(r.doc_id, r.source, f"{r.source}/{r.lang}") for r in documents.collect()]

    def strength(groups):
        k, n = sum(a for a, _ in groups), sum(b for _, b in groups)
        rate, by_chance = k / n, len(groups) - 1
        below = n - sum(b * b for _, b in groups) / n - by_chance
        rho = 0.0001 if rate in (0, 1) or not below else (sum((a - b * rate) ** 2 / b for a, b in groups) / (rate * (1 - rate)) - by_chance) / below
        return 1 / min(0.5, max(0.0001, rho)) - 1

    count = lambda at: {x: (sum(good[d] for d, *p in rows if d in good and p[at] == x), sum(1 for d, *p in rows if d in good and p[at] == x)) for x in {p[at] for d, *p in rows if d in good}}
    hosts, paths = count(0), count(1)
    overall = (sum(k for k, _ in hosts.values()) + 1) / (sum(n for _, n in hosts.values()) + 2)
    s1, s2 = strength(list(hosts.values())), strength(list(paths.values()))
    for doc, host, path in rows:
        rate = (sum(good.values()) + 1) / (len(good) + 2)
        if host in hosts:
            rate = (hosts[host][0] + s1 * overall) / (hosts[host][1] + s1)
        if path in paths:
            rate = (paths[path][0] + s2 * rate) / (paths[path][1] + s2)
        assert got[doc].site_rate == pytest.approx(rate)
        assert got[doc].score == pytest.approx(1 / (1 + np.exp(-(got[doc].evidence + np.log(rate / (1 - rate))))))


def test_licences_match_a_plain_loop(spark):
    import math
    import re
    from collections import Counter

    templates = license_scan.all_templates()
    terms = lambda t: [x for x in re.findall("[a-z0-9]+", t.lower()) if x not in license_scan.STOP]
    counts = [(name, Counter(terms(t))) for name, t in templates]
    df = Counter(t for _, c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    unseen = math.log(1 + len(templates)) + 1
    weigh = lambda c: {t: n * idf.get(t, unseen) for t, n in c.items()}
    vectors = [(name, weigh(c)) for name, c in counts]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    norms = [norm(v) for _, v in vectors]

    def best(unit):
        v = weigh(Counter(terms(unit)))
        found = [(-round(sum(v[t] * w.get(t, 0) for t in v) / (norm(v) * n), 9), name) for (name, w), n in zip(vectors, norms, strict=True) if v]
        return min((f for f in found if -f[0] >= license_scan.LEAST_COSINE), default=None)

    def own(text):
        text = re.sub("\r\n?", "\n", text or "")
        blocks = re.split(license_scan.BETWEEN, re.sub(license_scan.COMMENT_ENDS, r"\1\n", text))
        units = [(False, text)] + [(True, u) for u in {*blocks, *text.split("\n")}]
        return min(((part, *b) for part, u in units if (b := best(u))), default=None)

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000")
    got = {r.file_id: (r.license, r.via) for r in license_scan.scan(docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string"), F.lit("x.txt")).alias("path"), "text")).collect()}
    want = {r.doc_id: own(r.text) for r in docs.collect()}
    assert {i for i, (_, via) in got.items() if via == "header"} == {i for i, w in want.items() if w}
    assert all(got[i][0] == w[2] for i, w in want.items() if w) and any(want.values())

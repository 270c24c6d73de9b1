"""Leases over a table and over a stream that is stopped and started again."""

import datetime

import pytest

from wayfind.streaming import leases

SCHEMA = "job_id long, request_id long, at timestamp, kind string, site string, n long"


def t(second):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=second)


REQUESTS = [
    (1, 1, 0, "add", "a", None), (1, 2, 0, "add", "b", None), (1, 3, 1, "add", "c", None), (1, 4, 1, "add", "a", None), (2, 5, 1, "add", "z", None),
    (1, 6, 5, "take", None, 2), (1, 7, 6, "done", "a", None), (1, 8, 6, "done", "a", None), (1, 9, 7, "release", "b", None), (1, 10, 8, "take", None, 9), (2, 11, 9, "take", None, 1),
    (1, 12, 100, "done", "c", None), (1, 13, 140, "take", None, 1), (3, 14, 150, "take", None, 5), (1, 15, 200, "done", "b", None), (4, 16, 400, "add", "late", None), (4, 17, 900, "add", "later", None),
]


def rows(lo, hi):
    return [(j, r, t(s), k, site, n) for j, r, s, k, site, n in REQUESTS if lo <= s < hi]


def story(df):
    return sorted((r.job_id, r.at, r.what, r.site, r.until is not None and (r.until - r.at).total_seconds(), r.request_id) for r in df.collect())


def test_table_tells_what_happened(spark):
    told = leases.table(spark.createDataFrame([*rows(0, 1000), (None, 99, t(1), "add", "x", None)], SCHEMA), t(600))
    mine = [(what, site) for j, _, what, site, _, _ in story(told) if j == 1]
    assert mine == [("added", "a"), ("added", "b"), ("added", "c"), ("taken", "a"), ("taken", "b"), ("done", "a"), ("released", "b"), ("taken", "b"), ("taken", "c"), ("done", "c"), ("stranded", "b"), ("taken", "b"), ("done", "b")]
    got = {r.job_id: (r.done, r.stranded, r.waiting, r.leased) for r in leases.outcomes(told).collect()}
    assert got == {1: (3, 1, 0, 0), 2: (0, 1, 1, 0), 4: (0, 0, 2, 0)}
    assert leases.table(spark.createDataFrame([], SCHEMA), t(1)).count() == 0


def test_stream_agrees_with_table_after_a_restart(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", leases.PROVIDER)
    try:
        for k, (lo, hi) in enumerate(((0, 7), (7, 120), (120, 1000))):
            spark.createDataFrame(rows(lo, hi), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = leases.stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()  # stopped, and started again from its checkpoint
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = story(spark.read.parquet(str(tmp_path / "out")))
    want = story(leases.table(spark.createDataFrame(rows(0, 1000), SCHEMA), t(600)))
    assert told == want and any(what == "stranded" and j == 2 for j, _, what, *_ in told)


@pytest.mark.parametrize("seconds,length", [(1, 10), (30, 30)])
def test_leases_have_a_least_length(spark, seconds, length):
    told = leases.table(spark.createDataFrame(rows(0, 6), SCHEMA), t(5), seconds)
    assert {s for *_, s, _ in story(told) if s} == {float(length)}

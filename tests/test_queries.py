"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from wayfind.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(repr([plain(v) for v in r]) for r in pdf[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_match_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_best_markets_are_whole_and_best_first(spark, tmp_path):
    """Against a plain loop, row by row: all markets with a match, also those whose town or trade is unknown, which come last among equals."""
    src = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS c_mktsegment) FROM read_parquet('{src}/customer.parquet')) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN n_nationkey % 8 > 0 THEN n_name END AS n_name) FROM read_parquet('{src}/nation.parquet')) TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    for t in ("customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    towns = dict(con.sql("SELECT n_nationkey, n_name FROM nation").fetchall())
    fits = {}
    for key, nation, segment in con.sql("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer").fetchall():
        if key % 11 and key * 37 % 50 >= 35:
            market = towns[nation], segment and segment.lower()
            fits[market] = fits.get(market, 0) + 1
    expected = sorted(((*m, n) for m, n in fits.items()), key=lambda r: (-r[2], r[0] is None, r[0] or "", r[1] is None, r[1] or ""))
    assert len(expected) > 100 and any(a[2] == b[2] and b[0] is None for a, b in zip(expected, expected[1:]))
    assert [tuple(r) for r in catalogue.QUERIES["best_markets"](spark, str(tmp_path)).collect()] == expected
    assert con.sql(catalogue.ORACLES["best_markets"]).fetchall() == expected


def test_area_members_on_the_lines_fall_as_in_sql(spark, tmp_path):
    """Towns whose places lie on the lines of their areas, beside one without a name, one on a single meridian and one at a single place."""
    con, src = duckdb.connect(), "/root/testdata/sf0.1"
    con.sql(f"CREATE VIEW c AS SELECT c.* REPLACE (c_custkey + 15000 * i AS c_custkey) FROM read_parquet('{src}/customer.parquet') c, range(5) r(i)")
    odd = "SELECT c.* REPLACE (600000 * i AS c_custkey, 3 AS c_nationkey) FROM (SELECT * FROM c LIMIT 1) c, range(3) r(i) UNION ALL SELECT c.* REPLACE (50000 * i AS c_custkey, 4 AS c_nationkey) FROM (SELECT * FROM c LIMIT 1) c, range(9) r(i)"
    con.sql(f"COPY (SELECT * FROM c WHERE c_nationkey IN (7, 18, 21) UNION ALL {odd}) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN n_nationkey <> 7 THEN n_name END AS n_name) FROM read_parquet('{src}/nation.parquet')) TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    for t in ("customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    expected = rows(con.sql(catalogue.ORACLES["area_members"]).df())
    assert len(expected[1]) == 3 and rows(catalogue.QUERIES["area_members"](spark, str(tmp_path)).toPandas()) == expected


def test_niche_mentions_read_words_as_sql_does(spark, tmp_path):
    """Accented letters beside words, capitals that lower() spells otherwise, other blanks, and documents that share an id."""
    texts = [
        (1, "Prix et the \u00e9on de la ville. The \u00e9of site at large. caf\u00e9the onto on the quai"), (2, "S\u0130TE of the city of it. of the \u0391\u03a3 s\u0130te and \u039f\u03a3 more"),
        (3, "free of all\u00a0\u2003. free of all x!free of all xy. \u3000free of all xyz\u3000"), (4, "the end of it all"), (4, "the end of it all|and the end of it all"), (4, "The end of it all. the end of it all"),
        (5, "and on the way \u0391\u03a3|and on the way \u03b1\u03c3|and on the way \u03b1\u03c2"), (9, "the list of names"), (9, "the list of names"), (6, None), (7, ""), (8, "on\u0301 the site_of and of_the and on"),
    ]
    con = duckdb.connect()
    con.register("t", pd.DataFrame(texts, columns=["doc_id", "text"]))
    con.sql(f"COPY (SELECT * FROM t) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    expected = rows(con.sql(catalogue.ORACLES["niche_mentions"]).df())
    assert len(expected[1]) > 10 and rows(catalogue.QUERIES["niche_mentions"](spark, str(tmp_path)).toPandas()) == expected


def test_stale_sites_count_parts_of_a_second(spark, tmp_path):
    """Leases taken within a second of the limit, on both sides of it and right at it, and rows without a time, type or id."""
    con = duckdb.connect()
    ages = [86_399_000_000, 86_399_999_999, 86_400_000_000, 86_400_000_001, 86_400_500_000, 86_400_999_999, 86_401_000_000, 0]
    for last in ("2024-01-30 23:59:25.261702", "2004-01-11 01:00:00.000001", "1969-12-31 23:59:59.75"):
        con.sql(
            f"""COPY (SELECT i // 2 * 2 AS event_id, TIMESTAMP '{last}' - to_microseconds(age) AS ts, 't' || i AS event_type FROM (SELECT unnest({ages}) AS age, unnest(range({len(ages)})) * 2 AS i)
            UNION ALL SELECT 2, NULL, 'x' UNION ALL SELECT NULL, TIMESTAMP '{last}', NULL) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
        )
        con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
        expected = rows(con.sql(catalogue.ORACLES["stale_sites"]).df())
        assert repr([None, 1, "done"]) in expected[1] and rows(catalogue.QUERIES["stale_sites"](spark, str(tmp_path)).toPandas()) == expected
        assert repr(["t8", 1, "pending"]) in expected[1] and repr(["t4", 1, "taken"]) in expected[1]

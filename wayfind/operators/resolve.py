"""Telling listings of one business apart from others, and keeping one of each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.geo import EARTH_METRES
from wayfind.functions.text import billing_key, host_of
from wayfind.sources.shared import cut

CHAIN_SITES = 5
SAME_PLACE_METRES = 200.0
#: Degrees of latitude that 200 m never exceed.
STEP_DEGREES = 0.0019
METRES_PER_DEGREE = EARTH_METRES * math.pi / 180


def work_list(rows: DataFrame, drop_chains: bool = True) -> DataFrame:
    """rows(id, site, ordinal) with status: kept, chain or duplicate; the first of each site is kept.

    Rows without a site that can be read as a host are kept, each by itself.
    """
    key = host_of(F.col("site"))
    keyed = rows.withColumn("site_key", key)
    own = Window.partitionBy("site_key")
    hosted = keyed.filter("site_key is not null")  # rows without a site share no key, so no window gathers them
    counted = hosted.withColumn("_n", F.count("*").over(own)).withColumn("_first", F.row_number().over(own.orderBy("ordinal")))
    status = F.when((F.col("_n") >= CHAIN_SITES) & F.lit(drop_chains), "chain").when(F.col("_first") > 1, "duplicate").otherwise("kept")
    return counted.withColumn("status", status).drop("_n", "_first").unionByName(keyed.filter("site_key is null").withColumn("status", F.lit("kept")))


def _metres(lat, lon, lat2, lon2):
    p = math.pi / 180
    h = np.sin((lat2 - lat) * p / 2) ** 2 + np.cos(lat * p) * np.cos(lat2 * p) * np.sin((lon2 - lon) * p / 2) ** 2
    return 2 * EARTH_METRES * np.arcsin(np.sqrt(h))


def _first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """In order: each row joins the first cluster that has a member near it, else begins one."""
    pdf = pdf.sort_values("ordinal", kind="stable")
    lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
    cluster = np.full(len(pdf), -1)
    made = 0
    for i in range(len(pdf)):
        near = np.flatnonzero(_metres(lat[i], lon[i], lat[:i], lon[:i]) <= SAME_PLACE_METRES)
        if len(near):
            cluster[i] = cluster[near].min()
        else:
            cluster[i], made = made, made + 1
    head = pdf.groupby(cluster)["ordinal"].transform("min")
    return pd.DataFrame({"id": pdf["id"], "head": head.to_numpy()})


def billing_groups(rows: DataFrame) -> DataFrame:
    """id, group_key, lead: rows(id, name, site, phone, addr, lat, lon, ordinal) of one host and place are one group.

    Clusters are order-dependent and never merge. Only rows of one host whose
    coordinates follow one another in small steps can meet, so each host is first cut
    into such islands by two windows; a group that goes to Python is one island.
    """
    keyed = rows.withColumn("key", billing_key(F.col("site"), F.col("id")))
    alone = keyed.filter(F.col("key").startswith("id:")).select("id", F.col("key").alias("group_key"), F.col("id").alias("lead"))
    hosted = keyed.filter(~F.col("key").startswith("id:"))
    by_lat = Window.partitionBy("key").orderBy("lat", "ordinal")
    step = F.coalesce(F.col("lat") - F.lag("lat").over(by_lat) > STEP_DEGREES, F.lit(False)).cast("int")
    banded = hosted.withColumn("_s", step).withColumn("band", F.sum("_s").over(by_lat.rowsBetween(Window.unboundedPreceding, 0)))
    by_lon = Window.partitionBy("key", "band").orderBy("lon", "ordinal")
    width = STEP_DEGREES / F.greatest(F.cos(F.radians(F.abs("lat") + STEP_DEGREES)), F.lit(0.01))
    step = F.coalesce(F.col("lon") - F.lag("lon").over(by_lon) > width, F.lit(False)).cast("int")
    islands = banded.withColumn("_s", step).withColumn("island", F.sum("_s").over(by_lon.rowsBetween(Window.unboundedPreceding, 0)))
    placed = islands.select("id", "key", "band", "island", "lat", "lon", "ordinal")
    heads = placed.groupBy("key", "band", "island").applyInPandas(lambda pdf: _first_fit(pdf), "id string, head long")
    clustered = hosted.join(heads, "id")
    numbers = clustered.select("key", "head").distinct()
    numbers = numbers.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("head")) - 1).withColumn("of", F.count("*").over(Window.partitionBy("key")))
    score = F.when(F.col("phone").isNotNull(), 1000).otherwise(0) + F.length(F.coalesce("addr", F.lit(""))) + F.length(F.coalesce("name", F.lit(""))) / 100
    lead = clustered.groupBy("key", "head").agg(F.min(F.struct((-score).alias("less"), "ordinal", "id")).alias("b")).select("key", "head", F.col("b.id").alias("lead"))
    named = numbers.join(lead, ["key", "head"]).withColumn("group_key", F.when(F.col("of") > 1, F.concat_ws("#", "key", F.col("no").cast("string"))).otherwise(F.col("key")))
    return clustered.join(named.select("key", "head", "group_key", "lead"), ["key", "head"]).select("id", "group_key", "lead").union(alone)


def shared_hosts(rows: DataFrame) -> DataFrame:
    """host, places: hosts with a row more than 200 m from the host's first row."""
    hosted = rows.withColumn("host", host_of(F.col("site"))).filter("host is not null")
    first = hosted.groupBy("host").agg(F.min_by(F.struct("lat", "lon"), "ordinal").alias("f"), F.count("*").alias("places"))
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    h = half(F.col("lat"), F.col("f.lat")) + F.cos(F.radians("lat")) * F.cos(F.radians("f.lat")) * half(F.col("lon"), F.col("f.lon"))
    far = hosted.join(first, "host").filter(2 * EARTH_METRES * F.asin(F.sqrt(h)) > SAME_PLACE_METRES)
    return far.select("host", "places").distinct()


def representatives(rows: DataFrame, metres: float = SAME_PLACE_METRES) -> DataFrame:
    """host, id: of each host's rows(id, ordinal, site, lat, lon), in order, those farther than so many metres from all representatives before them.

    A greedy choice in rounds: the first open row of a cell is chosen if no earlier open row
    lies within the distance; then all open rows near a chosen one are settled. Cells are
    narrow enough that rows of one are always near each other, so a round compares at most
    one row a cell with its neighbours, whatever a street holds. The first open row of all
    is chosen in each round, so rounds end; what is left is written to the shared folder
    each time. Rows without a host or coordinates have no part in it; places on both sides
    of the date line are not compared.
    """
    size = metres / METRES_PER_DEGREE / 1.5
    wide = F.greatest(F.cos(F.radians((F.col("cy") + 1) * size)), F.cos(F.radians(F.col("cy") * size))) * METRES_PER_DEGREE
    hosted = rows.select("id", "ordinal", host_of(F.col("site")).alias("host"), "lat", "lon").filter("host is not null and lat is not null and lon is not null")
    # a row of cells has one width, from its latitude; columns of the rows next to it are found by degrees
    placed = hosted.withColumn("cy", F.floor(F.col("lat") / size).cast("long")).withColumn("width", F.lit(metres / 1.5) / F.greatest(wide, F.lit(1.0))).withColumn("cx", F.floor(F.col("lon") / F.col("width")).cast("long"))
    open_ = cut(placed.select("host", "id", "ordinal", "lat", "lon", "cy", "cx", "width"))
    near = lambda a, b: great_circle_metres(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon")) <= metres
    chosen = None
    while not open_.isEmpty():
        leaders = open_.groupBy("host", "cy", "cx").agg(F.min_by(F.struct("id", "ordinal", "lat", "lon", "width"), F.struct("ordinal", "id")).alias("l")).select("host", "cy", "l.*")
        met = _reaching(leaders, metres, size).alias("a").join(open_.alias("b"), ["host", "cy", "cx"])
        earlier = F.struct("b.ordinal", "b.id") < F.struct("a.ordinal", "a.id")
        blocked = met.filter(earlier & near("a", "b")).select("host", F.col("a.id").alias("id"), F.col("a.ordinal").alias("ordinal")).distinct()
        new = cut(leaders.join(blocked, ["host", "id", "ordinal"], "left_anti"))
        covered = _reaching(new, metres, size).alias("a").join(open_.alias("b"), ["host", "cy", "cx"]).filter(near("a", "b")).select("host", F.col("b.id").alias("id"), F.col("b.ordinal").alias("ordinal")).distinct()
        open_ = cut(open_.join(covered, ["host", "id", "ordinal"], "left_anti"))
        picked = new.select("host", "id")
        chosen = picked if chosen is None else chosen.union(picked)
    return chosen if chosen is not None else placed.select("host", "id").limit(0)


def _reaching(rows: DataFrame, metres: float, size: float) -> DataFrame:
    """Each row once for every cell that can hold a row within the distance of it."""
    tall = 1.001 * metres / METRES_PER_DEGREE
    rows_of = F.sequence(F.floor((F.col("lat") - tall) / size).cast("long"), F.floor((F.col("lat") + tall) / size).cast("long"))
    spans = rows.drop("cy").withColumn("cy", F.explode(rows_of))
    wide = F.greatest(F.cos(F.radians((F.col("cy") + 1) * size)), F.cos(F.radians(F.col("cy") * size))) * METRES_PER_DEGREE
    width = F.lit(metres / 1.5) / F.greatest(wide, F.lit(1.0))
    reach = F.lit(1.02 * metres) / F.greatest(F.cos(F.radians(F.abs("lat") + 0.01)) * METRES_PER_DEGREE, F.lit(1.0))
    columns = F.sequence(F.floor((F.col("lon") - reach) / width).cast("long"), F.floor((F.col("lon") + reach) / width).cast("long"))
    return spans.withColumn("cx", F.explode(columns)).select("host", "id", "ordinal", "lat", "lon", "cy", "cx")


def great_circle_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(half(lat2, lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2, lon1)))


def claims(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, id, how: listings that a removal request names by domain, else by its phone's last ten digits."""
    digits = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))
    known = listings.select("id", host_of(F.col("site")).alias("host"), digits(F.col("phone")).alias("tel"))
    asked = requests.select("request_id", host_of(F.col("site")).alias("host"), digits(F.col("phone")).alias("tel"))
    by_host = asked.join(known.select("id", "host"), "host").select("request_id", "id", F.lit("domain").alias("how"))
    by_phone = asked.filter(F.length("tel") == 10).join(known.select("id", "tel"), "tel").select("request_id", "id", F.lit("phone").alias("how"))
    return by_host.union(by_phone.join(by_host.select("request_id", "id"), ["request_id", "id"], "left_anti"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key: an upsert as a read."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def merged(known: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row a key of both, which may lack each other's columns: of each column the latest value that is not null."""
    rows = known.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*key, at)]
    return rows.groupBy(*key).agg(F.max(at).alias(at), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in rest])

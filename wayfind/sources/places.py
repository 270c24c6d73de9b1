"""Places: the nested release layout, and places made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE_COLUMNS = ("id", "name", "cat", "site", "phone", "addr", "town", "lat", "lon", "ordinal")


def flatten(nested: DataFrame) -> DataFrame:
    """Flat places of the nested layout: first elements of arrays, middle of the box.

    Only the nested fields named here are read; missing array elements are null.
    """
    first = lambda c: F.get(F.col(c), F.lit(0))
    return nested.select(
        "id", F.col("names.primary").alias("name"), F.col("taxonomy.primary").alias("cat"), first("websites").alias("site"), first("phones").alias("phone"),
        first("addresses").getField("freeform").alias("addr"), first("addresses").getField("locality").alias("town"),
        first("addresses").getField("region").alias("state"), F.col("brand.names.primary").alias("brand"), F.col("operating_status").alias("status"), "confidence",
        F.array_distinct(F.transform("sources", lambda s: s.getField("dataset"))).alias("datasets"),
        ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("lat"), ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("lon"),
    )


def places_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place of each customer, with coordinates and sites that follow from its key."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("town"))
    k = F.col("c_custkey")
    site = F.when(k % 30 == 0, F.lit(None)).when(k % 31 == 0, F.lit("  ")).otherwise(F.concat(F.lit("https://www.site"), (k * 7 % 400).cast("string"), F.lit(".example.com/about")))
    return customer.join(nation, "c_nationkey").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("cat"), site.alias("site"),
        F.when(k % 7 != 0, F.concat(F.lit("303-555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.concat((k % 997).cast("string"), F.lit(" Main Street")).alias("addr"), "town",
        (25 + (k * 7919 % 24000) / 1000.0).alias("lat"), (-120 + (k * 104729 % 50000) / 1000.0).alias("lon"),
        F.when(k % 11 != 0, (k * 37 % 50) / 10.0).alias("rating"), F.when(k % 13 != 0, k * 13 % 200).alias("reviews"), k.alias("ordinal"),
    )


#: The same places in SQL, as the start of a query.
PLACES_SQL = """
places AS (
  SELECT 'c' || c_custkey AS id, c_name AS name, lower(c_mktsegment) AS cat,
    CASE WHEN c_custkey % 30 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN '  ' ELSE 'https://www.site' || (c_custkey * 7 % 400) || '.example.com/about' END AS site,
    CASE WHEN c_custkey % 7 <> 0 THEN '303-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone,
    (c_custkey % 997) || ' Main Street' AS addr, n_name AS town,
    25 + (c_custkey * 7919 % 24000) / 1000.0::DOUBLE AS lat, -120 + (c_custkey * 104729 % 50000) / 1000.0::DOUBLE AS lon,
    CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 37 % 50) / 10.0::DOUBLE END AS rating, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey * 13 % 200 END AS reviews, c_custkey AS ordinal
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)
"""

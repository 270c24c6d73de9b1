"""How strongly sparse groups are drawn to the level above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the correlation within a group, from which a prior's strength follows.
LEAST, MOST = 0.0001, 0.5


def strength(children: DataFrame) -> DataFrame:
    """One row: the prior's strength from children with k good outcomes of n, and parts of it."""
    total = children.agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("n")).alias("all_nn"), F.count("*").alias("groups"))
    rate = F.try_divide(F.col("all_k"), F.col("all_n"))
    joined = children.crossJoin(F.broadcast(total))  # one row on that side
    apart = F.col("k") - F.col("n") * rate
    one = joined.groupBy("all_k", "all_n", "all_nn", "groups").agg(F.sum(apart * apart / F.col("n")).alias("s"))
    by_chance = F.col("groups") - 1
    rho = F.try_divide(F.try_divide(F.col("s"), rate * (1 - rate)) - by_chance, F.col("all_n") - F.try_divide(F.col("all_nn"), F.col("all_n")) - by_chance)
    rho = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(rho, F.lit(LEAST))))
    return one.select((1 / rho - 1).alias("strength"))

"""Mixing sources to target weights.

DataFrame functions only. Sizes are summed by source, each source's target follows
from its weight under a repetition limit, and a document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy with the fraction as its probability.

Defined results: a null text has size 0 and an empty source is never repeated; a
null source is one source, ranked last; a null doc_id hashes as the empty string;
repeated rows share one fate; an empty table gives an empty result. `mix` returns all
columns as they came, whatever their names; `plan_mix` puts its own in place of columns
that carry a name from OUTPUTS.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
LIMIT = 3
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 48  # of the sources' table; a row's bytes besides its name
OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 48 bits of an md5 of the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target, from one row a source (source, source_size).

    The sources are a dimension (one row each), so their ranking and the running sums
    below run in one partition. With caps c = limit * size and weights w, raising one
    level for all sources fills them in the order of c / w; a source stays at its cap
    if, with all before it capped, its share of what remains would exceed the cap.
    """
    scale = math.lcm(*weights)
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    full = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * limit)
    everything = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("_cap") * F.expr(f"{scale} div _w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_w_all": F.sum("_w").over(everything),
        "_caps_before": F.coalesce(F.sum("_cap").over(order), F.lit(0)),
        "_w_before": F.coalesce(F.sum("_w").over(order), F.lit(0)),
    })
    capped = (F.col("_total") - F.col("_caps_before")) * F.col("_w") > F.col("_cap") * (F.col("_w_all") - F.col("_w_before"))
    full = full.withColumn("_capped", capped).withColumns({
        "_left": F.col("_total") - F.sum(F.when(capped, F.col("_cap")).otherwise(0)).over(everything),
        "_w_left": F.col("_w_all") - F.sum(F.when(capped, F.col("_w")).otherwise(0)).over(everything),
    })
    share = (F.col("_left") * F.col("_w")).cast("double") / F.nullif(F.col("_w_left"), F.lit(0)).cast("double")
    return full.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def plan_mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """The documents with size, source_size, target, copies and taken."""
    planned = _planned(docs, size, weights, limit, seed)
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in OUTPUTS]
    return planned.select(*own, *OUTPUTS)


def _planned(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """doc, a struct of a document's own columns, so that no name clashes, with OUTPUTS."""
    words = word_count(F.col("text")) if size is None else size.cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").alias("of"), F.col("doc_id").alias("key"), words.alias("size"))
    by_source = sized.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size"))
    joined = _with_targets(sized, cut(targets(cut(by_source), weights, limit)))
    rate = F.least(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)), F.lit(float(limit)))
    whole = F.floor(rate)
    extra = (uniform(F.col("key"), seed) < rate - whole).cast("long")
    return joined.withColumn("copies", (whole + extra).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def _with_targets(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """The rows with their source's target, joined where they lie: whole documents are never dealt by source, of which one may hold a third of them.

    The sources' bytes are summed first. One broadcast of BROADCAST_BYTES at most does for
    all but millions of sources; more are taken in blocks by hash, each a broadcast of
    that size and a scan of the documents whose sources fall into it.
    """
    bytes_ = goals.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + ROW_BYTES), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-2 * bytes_ // BROADCAST_BYTES)) if bytes_ > BROADCAST_BYTES else 1
    same = F.col("of").eqNullSafe(F.col("source"))
    if blocks == 1:
        return sized.join(F.broadcast(goals), same)
    in_block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(blocks)) == k
    parts = [sized.filter(in_block("of", k)).join(F.broadcast(goals.filter(in_block("source", k))), same) for k in range(blocks)]
    return reduce(DataFrame.union, parts)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as many times as planned, with its own columns."""
    planned = _planned(docs, **options).filter("copies > 0")
    return planned.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("doc.*")

"""Resampling documents towards the word distribution of a target corpus.

Words are hashed into buckets; a bucket's gain is a scaled log ratio of its share in
the target and in the corpus, and a document's weight sums the gains of its words. A
Gumbel term from a hash of doc_id is added, and the highest scores among long enough
documents are drawn, which samples without replacement in proportion to exp(weight /
1000). The gains, as many as buckets, are one literal array that each text is scored by.

Ranks come from a least-significant-digit radix sort over rows of numbers. Each pass is
a stable counting sort by one digit: rows lie in blocks of consecutive places, the rows
of a block and digit are counted, a prefix over digits and blocks gives each such group
its first destination, and the rank within the group the rest. The places after the last
pass are the order. A group never exceeds a block and blocks have one size, so no value
is hot; the counts of one digit, one row a block, are summed along the blocks. Every
pass is written to spark.checkpoint.dir: a lost executor costs one pass at most.

Defined results: a null or empty text has no words, weight 0, and is never drawn (unless
least is 0); a null doc_id is hashed as the empty string and comes after all others among
ties; repeated rows are ranked one after another; an empty table gives an empty result;
an empty target corpus is one without words. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import cut, shuffle_partitions

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, LEAST, PERCENT = 10_000, 2024, 20, 10
DIGIT_BITS = 12
BLOCK_ROWS = 1 << 20  # at most so many rows in a block, whose rows of one digit are sorted in one task
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bucket(word: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(word, "UTF-8")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often its words stand in all texts; one row a bucket that has any, summed within tasks before the shuffle."""
    return texts.select(F.explode(words(F.col("text"))).alias("word")).groupBy(bucket(F.col("word"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> Column:
    """The array of gains by bucket, as a literal: of `buckets` numbers, whatever the corpus."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # at most one row a bucket
    s_all, t_all = sum(r.s for r in rows), sum(r.t for r in rows)
    have = corpus.sparkSession.createDataFrame([(r.bucket, r.s, r.t) for r in rows] + [(-1, 0, 0)], "bucket int, s long, t long")
    top = (F.col("t") + 1).cast("double") * F.lit(float(s_all + buckets))
    bottom = (F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets))
    known = {r.bucket: r.gain for r in have.select("bucket", F.floor(F.lit(1000.0) * F.ln(top / bottom)).cast("long").alias("gain")).collect()}
    listed = ",".join(str(known.get(b, known[-1])) for b in range(buckets))
    return F.split(F.lit(listed), ",").cast("array<bigint>")


def scored(docs: DataFrame, gain: Column, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    weight = F.aggregate("w", F.lit(0).cast("long"), lambda total, w: total + F.get(gain, bucket(w, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return held.select("doc_id", F.size("w").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def _digits(name: str, low: int, high: int) -> list[tuple[str, int, int]]:
    """(column, first bit, bits) of the digits, lowest first, in which numbers from low to high can differ as unsigned 64 bits with the sign turned."""
    turn, mask = 1 << 63, (1 << 64) - 1
    bits = (((low & mask) ^ turn) ^ ((high & mask) ^ turn)).bit_length()
    passes = -(-bits // DIGIT_BITS)
    width = -(-bits // passes) if passes else 0
    return [(name, k * width, width) for k in range(passes)]


def radix_ranked(df: DataFrame, *keys: str) -> DataFrame:
    """The rows with `place`, from 0, in ascending order of the keys (longs, nulls last), the first key weighing most.

    df is written once; its other columns ride along, so it should hold numbers only.
    """
    spark = df.sparkSession
    rows = cut(df.withColumn("place", F.monotonically_increasing_id()))
    span = rows.agg(F.count("*").alias("n"), *[f(k).alias(f"{g}_{k}") for k in keys for g, f in (("low", F.min), ("high", F.max))], *[F.count(k).alias(f"have_{k}") for k in keys]).first()
    if not span.n:
        return rows
    block = max(1, min(BLOCK_ROWS, span.n // (8 * shuffle_partitions(spark))))
    digits = []
    for key in reversed(keys):
        if span[f"have_{key}"]:
            digits += _digits(key, span[f"low_{key}"], span[f"high_{key}"])
        if span[f"have_{key}"] < span.n:
            digits.append((key, -1, 1))  # nulls after all others
    for key, first_bit, bits in digits or [(keys[0], 0, 1)]:
        turned = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
        digit = F.col(key).isNull().cast("int") if first_bit < 0 else F.coalesce(F.shiftrightunsigned(turned, first_bit).bitwiseAND(F.lit((1 << bits) - 1)), F.lit(0)).cast("int")
        rows = cut(_counting_pass(rows, digit, block))
    return rows


def _counting_pass(rows: DataFrame, digit: Column, block: int) -> DataFrame:
    """The rows with their places in the stable order by the digit."""
    # The first places are partition number and row, not dense; a block then is a stretch of one partition.
    at = rows.select("*", F.expr(f"place div {block}L").alias("block"), digit.alias("digit"))
    counts = at.groupBy("block", "digit").agg(F.count("*").alias("n"))
    by_digit = counts.groupBy("digit").agg(F.sum("n").alias("n"))  # at most one row a digit value, so one task can hold them
    before = by_digit.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("smaller"))
    along = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
    starts = counts.withColumn("earlier", along).join(before, "digit").select("block", "digit", (F.col("smaller") + F.col("earlier")).alias("start"))
    within = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    placed = at.withColumn("within", within).join(starts, ["block", "digit"])
    return placed.select(*[c for c in rows.columns if c != "place"], (F.col("start") + F.col("within")).cast("long").alias("place"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; target holds the texts to be resembled."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    every = cut(scored(docs, gain, buckets, seed))
    able = F.col("n_features") >= least
    ordered = radix_ranked(every.filter(able).withColumn("below", -F.col("score")), "below", "doc_id")
    drawn = every.filter(able).count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ordered.select(*columns, rank.alias("rank")).union(every.filter(~able).select(*columns, F.lit(None).cast("long")))

"""Quality classifier: document evidence combined with host and path-level posteriors.

A logistic model in numpy reads the make-up of a whole text (shares of kinds of bytes,
word lengths, repeated words and lines). Labelled outcomes are counted by path and host
over all labelled rows; a host's rate is shrunk to the overall one, a path's to its
host's, with strengths that follow from how much the groups differ beyond chance. A
document's log-odds are the model's plus what its path's rate says beyond the overall.

The model alone is fitted on a bounded sample (ROWS of each class, texts up to LONGEST
characters); counts, posteriors, the overall rate and scores cover all rows. To measure
the result, classify(..., hold_out=True) leaves the labels of the rows with crc32(doc_id)
0 modulo 5 out of the model and the counts and marks those rows; it is off by default.

Defined results: a null text is scored as an empty one; null hosts and paths are groups
of their own; a null doc_id is scored and has no label; repeated rows count as often as
they stand; without labels of both classes the model says nothing and the overall rate
decides; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.shrinkage import strength
from wayfind.llm.textops import text_slices, word_hashes, words_of
from wayfind.llm.toxicity import bounded_sample, trained

ROWS = 3000
LONGEST = 20_000
#: Kinds of bytes whose shares in a text are features: the last is every other byte.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".,;:", "!?", "#$%&*@^~+=", "|<>{}[]\\/_`", "'\"()-")

_KIND = np.full(256, len(KINDS) + 1, np.int64)
_KIND[:128] = len(KINDS)
for _k, _bytes in enumerate(KINDS):
    _KIND[np.frombuffer(_bytes.encode(), np.uint8)] = _k
_NOT_LINE = np.zeros(256, dtype=bool)
_NOT_LINE[10] = True
FEATURES = len(KINDS) + 2 + 5


def make_up(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each text."""
    n, kinds = len(offsets) - 1, len(KINDS) + 2
    out = np.zeros((n, FEATURES))
    size = np.maximum(np.diff(offsets), 1)
    text = np.repeat(np.arange(n), np.diff(offsets))
    out[:, :kinds] = np.bincount(text * kinds + _KIND[buf], minlength=n * kinds).reshape(n, kinds) / size[:, None]
    for at, gap in ((kinds, None), (kinds + 3, _NOT_LINE)):
        parts = words_of(buf, offsets) if gap is None else words_of(buf, offsets, gap)
        hashes = word_hashes(buf, parts)
        whose = np.repeat(np.arange(n, dtype=np.uint64), parts.counts)
        pairs = np.unique(hashes ^ (whose * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        distinct = np.bincount(whose[pairs].astype(np.int64), minlength=n)
        out[:, at] = distinct / np.maximum(parts.counts, 1)
        out[:, at + 1] = np.log1p(parts.counts)
        if gap is None:
            out[:, at + 2] = np.log1p(np.diff(offsets) / np.maximum(parts.counts, 1))
    return out


def train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and intercept of a logistic model on standardised features and their squares."""
    x = np.concatenate([x, x**2], axis=1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    weight = np.zeros(z.shape[1])
    ridge = np.append(np.full(z.shape[1] - 1, 1.0), 0)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge + 1e-9)
        weight -= np.linalg.solve(curve, z.T @ (p - y) + ridge * weight)
    return mean, scale, weight[:-1], float(weight[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _usable(labels: DataFrame) -> DataFrame:
    good = labels.filter("doc_id is not null and quality in (0, 1)")
    return good.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("good"))


def learn(sample: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    y = sample.column("label").to_numpy().astype(np.int64)
    x = np.concatenate([make_up(buf, offsets) for _, _, buf, offsets in text_slices(sample.column("text").cast(pa.large_string()))])
    mean, scale, weight, base = train(x, y)
    # the sample is drawn by class: its log-odds are set back to even chances, the overall rate is added when scoring
    return mean, scale, weight, base - float(np.log(y.mean() / (1 - y.mean())))


def fit(docs: DataFrame, labels: DataFrame):
    """A model from a bounded sample of labelled rows, learnt in one task; None without both classes."""
    return trained(bounded_sample(docs, _usable(labels).withColumnRenamed("good", "label"), LONGEST, ROWS, "quality"), learn)


def evidence(docs: DataFrame, model, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and evidence: the model's log-odds at even chances."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "evidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, weight, base = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch.column(len(keep))):
                x = make_up(buf, offsets)
                points = ((np.concatenate([x, x**2], axis=1) - mean) / scale) @ weight + base
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(len(keep))], pa.array(points)], names=names)

    narrow = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kept}, evidence double")


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """host, path, path_rate, overall: of every path that has labelled rows."""
    counted = docs.select("doc_id", "host", "path").join(_usable(labels), "doc_id").groupBy("host", "path").agg(F.sum("good").alias("k"), F.count("*").alias("n"))
    hosts = counted.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    overall = hosts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("overall"))
    constants = overall.crossJoin(strength(hosts).withColumnRenamed("strength", "s1")).crossJoin(strength(counted).withColumnRenamed("strength", "s2"))  # one row each
    by_host = hosts.crossJoin(F.broadcast(constants)).select(F.col("host").alias("_host"), "overall", "s2", ((F.col("k") + F.col("s1") * F.col("overall")) / (F.col("n") + F.col("s1"))).alias("host_rate"))
    joined = counted.join(by_host, F.col("host").eqNullSafe(F.col("_host")))
    return joined.select("host", "path", "host_rate", "overall", ((F.col("k") + F.col("s2") * F.col("host_rate")) / (F.col("n") + F.col("s2"))).alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, hold_out: bool = False) -> DataFrame:
    """doc_id, held_out, evidence, site_rate, score, keep: one row a document."""
    held = held_out(F.col("doc_id")) if hold_out else F.lit(False)
    labels = labels.filter(~held)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    sites = posteriors(placed, labels)
    overall = _usable(labels).agg(((F.sum("good") + 1) / (F.count("*") + 2)).alias("rate")).select(F.coalesce("rate", F.lit(0.5)).alias("_overall"))
    by_path = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_rate", "overall")
    by_host = sites.groupBy(F.col("host").alias("_h2")).agg(F.min("host_rate").alias("host_rate"))
    scored = evidence(placed, fit(placed, labels), ("doc_id", "host", "path"))
    scored = scored.join(by_path, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    scored = scored.join(by_host, F.col("host").eqNullSafe(F.col("_h2")), "left").crossJoin(F.broadcast(overall))  # one row
    rate = F.coalesce("path_rate", "host_rate", "_overall")
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))
    return scored.select("doc_id", held.alias("held_out"), "evidence", rate.alias("site_rate"), score.alias("score"), (score >= 0.5).alias("keep"))

"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed rows for the word and for its beginnings of
several lengths (inflected forms of a word share those). Filters of several widths
slide over the embeddings, each keeps its largest response in the whole text, and a
linear layer gives a logit. The rows start from the smoothed association of each hash
with the label and are trained with Adagrad; with max pooling only the winning windows
carry gradients. Thresholds are calibrated by language, as told from the function words
of the text itself, so that a score of 0.5 is the threshold everywhere.

Only a bounded sample of labelled rows is used for training (ROWS of each class, drawn
among texts up to LONGEST characters), in one task; scoring reads every whole text.

Defined results: a null or empty text gets the score of no evidence; a null doc_id is
scored and not held out; repeated rows get equal rows; without labels of both classes
every score is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.textops import _BYTE_CODE, _INV, _MULT, LOWER, _power, mix, text_slices, words_of

#: Labelled rows of each class that training uses at most, and the longest of their texts in characters.
ROWS = 2500
LONGEST = 20_000
#: One labelled row in so many is kept to calibrate thresholds.
CALIBRATION = 4
BUCKETS = 1 << 15
BEGINNINGS = (4, 6, 8, 10)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 32
#: Common function words, by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the of and to is that in it for with was on are this be by",
    "de": "der die das und den von zu mit sich des ist im dem nicht ein eine auf für",
    "fr": "le les des et un une du dans pour est au qui sur par avec",
    "es": "el los las y del que con para su por una se al como",
}
LANGUAGES = tuple(FUNCTION_WORDS)

_U = np.uint64
_LETTER_GAP = np.ones(256, dtype=bool)
_LETTER_GAP[128:] = False
_LETTER_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the embedding rows of the word and of its beginnings; each text's first word."""
    low = np.take(LOWER, buf)
    words = words_of(low, offsets, _LETTER_GAP)
    codes = np.take(_BYTE_CODE, low)
    codes *= _power(int(_MULT), len(low))[: len(low)]
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(codes, out=total[1:])
    back = _power(int(_INV), len(low))[words.start]
    rows = np.empty((len(words.start), 1 + len(BEGINNINGS)), np.int32)
    for k, length in enumerate((None, *BEGINNINGS)):
        end = words.end if length is None else np.minimum(words.start + length, words.end)
        part = mix((total[end] - total[words.start]) * back + _U(k))
        rows[:, k] = (part & _U(BUCKETS - 1)).astype(np.int32) + k * BUCKETS
    return rows, words.first


def _function_table() -> np.ndarray:
    """Per bucket of whole words, 1 + the language whose function word falls there, else 0."""
    out = np.zeros(BUCKETS, np.int8)
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        raw = listed.encode()
        rows, _ = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out[rows[:, 0]] = k + 1
    return out


def languages(rows: np.ndarray, first: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Per text the language most of whose function words occur, or len(LANGUAGES) if none does."""
    k = len(LANGUAGES) + 1
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.bincount(text * k + known[rows[:, 0]], minlength=(len(first) - 1) * k).reshape(-1, k)[:, 1:]
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(LANGUAGES))


@dataclass
class Model:
    table: np.ndarray  # embedding rows
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    threshold: np.ndarray  # per language, and for texts of none

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text each filter's largest response (0 at least), and the word where it begins (-1: none)."""
        n, texts = len(rows), len(first) - 1
        best = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(best.shape, -1, np.int64)
        if not n:
            return best, at
        x = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x = x + self.table[rows[:, k]]
        size = np.diff(first)
        for w, (weights, bias) in enumerate(zip(self.filters, self.bias, strict=True)):
            width = len(weights)
            fit = np.flatnonzero(size >= width)
            if not len(fit):
                continue
            y = x[: n - width + 1] @ weights[0]
            for i in range(1, width):
                y += x[i : n - width + 1 + i] @ weights[i]
            y += bias
            begin, end = first[:-1][fit], first[1:][fit] - width + 1
            edges = np.stack([begin, end], axis=1).ravel()
            edges = edges if edges[-1] < len(y) else edges[:-1]
            top = np.maximum.reduceat(y, edges, axis=0)[::2]
            best[fit, w * FILTERS : (w + 1) * FILTERS] = np.maximum(top, 0)
            if self.tracking:
                for t, a, b, m in zip(fit, begin, end, top, strict=True):
                    at[t, w * FILTERS : (w + 1) * FILTERS] = np.where(m > 0, a + y[a:b].argmax(axis=0), -1)
        return best, at

    tracking: bool = False

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first)[0] @ self.out + self.base


def _association(rows: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Per hash, how surely texts of label 1 hold it more often than others (a z value)."""
    counts = np.full((2, (1 + len(BEGINNINGS)) * BUCKETS), 0.5)
    for of, lo, hi in zip(label, first[:-1], first[1:], strict=True):
        counts[1 - of][np.unique(rows[lo:hi])] += 1
    share = np.log(counts[0] / ((label == 1).sum() + 1)) - np.log(counts[1] / ((label == 0).sum() + 1))
    return share / np.sqrt(1 / counts[0] + 1 / counts[1])


def train(rows: np.ndarray, first: np.ndarray, label: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, ((1 + len(BEGINNINGS)) * BUCKETS, DIM)).astype(np.float32)
    table[:, 0] += (0.25 * np.clip(_association(rows, first, label), -4, 8)).astype(np.float32)
    filters, bias = [], []
    for width in WIDTHS:
        w = rng.normal(0, 0.1, (width, DIM, FILTERS)).astype(np.float32)
        w[:, 0, :] += 0.5 / width
        filters.append(w)
        bias.append(np.full(FILTERS, -0.6, np.float32))
    model = Model(table, filters, bias, np.full(len(WIDTHS) * FILTERS, 0.2, np.float32), -1.0, np.zeros(len(LANGUAGES) + 1), tracking=True)
    squares = {"table": np.full(len(table), 1e-2, np.float32), "out": np.full_like(model.out, 1e-2), "base": 1e-2}
    squares |= {f"f{i}": np.full_like(f, 1e-2) for i, f in enumerate(filters)} | {f"b{i}": np.full_like(b, 1e-2) for i, b in enumerate(bias)}
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
    rate = 0.05
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            index = np.concatenate([np.arange(first[t], first[t + 1]) for t in part])
            sub, begin = rows[index], np.concatenate([[0], np.cumsum(first[part + 1] - first[part])])
            hidden, at = model.pooled(sub, begin)
            p = 1 / (1 + np.exp(-(hidden @ model.out + model.base)))
            slope = ((p - label[part]) * weight[part] / len(part)).astype(np.float32)
            d_out, d_base = hidden.T @ slope + 1e-4 * model.out, float(slope.sum())
            d_hidden = slope[:, None] * model.out * (at >= 0)
            moved_rows, moved_by = [], []
            for w, width in enumerate(WIDTHS):
                cut = slice(w * FILTERS, (w + 1) * FILTERS)
                text, f = np.nonzero(d_hidden[:, cut])
                g, where = d_hidden[:, cut][text, f], at[:, cut][text, f]
                d_filter = 1e-4 * model.filters[w]
                for i in range(width):
                    hit = sub[where + i]
                    x = model.table[hit].sum(axis=1)
                    np.add.at(d_filter[i].T, f, g[:, None] * x)
                    moved_rows.append(hit.ravel())
                    moved_by.append(np.repeat(g[:, None] * model.filters[w][i][:, f].T, hit.shape[1], axis=0))
                squares[f"f{w}"] += d_filter**2
                model.filters[w] -= rate * d_filter / np.sqrt(squares[f"f{w}"])
                d_bias = np.bincount(f, g, FILTERS).astype(np.float32)
                squares[f"b{w}"] += d_bias**2
                model.bias[w] -= rate * d_bias / np.sqrt(squares[f"b{w}"])
            squares["out"] += d_out**2
            model.out -= rate * d_out / np.sqrt(squares["out"])
            squares["base"] += d_base**2
            model.base -= rate * d_base / np.sqrt(squares["base"])
            touched, inverse = np.unique(np.concatenate(moved_rows), return_inverse=True)
            if len(touched):
                change = np.zeros((len(touched), DIM), np.float32)
                np.add.at(change, inverse, np.concatenate(moved_by))
                squares["table"][touched] += (change**2).mean(axis=1)
                model.table[touched] -= rate * change / np.sqrt(squares["table"][touched])[:, None]
    model.tracking = False
    return model


def best_threshold(logit: np.ndarray, label: np.ndarray) -> float:
    """The middle of the widest best cut: the fewest wrong, both classes weighing alike."""
    order = np.argsort(logit)
    z, y = logit[order], label[order]
    ones, zeros = max(y.sum(), 1), max((1 - y).sum(), 1)
    missed = np.concatenate([[0], np.cumsum(y)]) / ones
    false = np.concatenate([[(1 - y).sum()], (1 - y).sum() - np.cumsum(1 - y)]) / zeros
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    wrong = missed + false
    gap = np.minimum(edges[1:] - edges[:-1], 4)
    k = np.lexsort((-gap, np.round(wrong, 9)))[0]
    return float((edges[k] + edges[k + 1]) / 2)


def calibrate(model: Model, rows: np.ndarray, first: np.ndarray, label: np.ndarray, known: np.ndarray) -> None:
    """A threshold for all texts, and one for each language, drawn to it while its rows of label 1 are few."""
    logit = np.concatenate([model.logits(rows[a:b], np.array([0, b - a])) for a, b in zip(first[:-1], first[1:], strict=True)])
    of = languages(rows, first, known)
    overall = best_threshold(logit, label)
    model.threshold[:] = overall
    for k in range(len(LANGUAGES)):
        mine = of == k
        ones = int(label[mine].sum())
        if ones and (label[mine] == 0).any():
            own = best_threshold(logit[mine], label[mine])
            model.threshold[k] = (ones * own + 10 * overall) / (ones + 10)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bounded_sample(docs: DataFrame, labelled: DataFrame, longest: int, rows: int, seed: str) -> DataFrame:
    """doc_id, label, text: by hash, at most so many rows of each label (0 and 1) among labelled(doc_id, label) with a text that is no longer."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= longest)
    able = labelled.join(texts.select("doc_id").distinct(), "doc_id")
    picked = None
    for of in (0, 1):
        some = able.filter(F.col("label") == of).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
        picked = some if picked is None else picked.union(some)
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # 2 * rows at most


def trained(sample: DataFrame, learn):
    """What learn(rows sorted by doc_id: doc_id, label, text) returns, worked out in a task; None without both labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and len(set(rows.column("label").to_pylist())) == 2:
            model = learn(rows.sort_by("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.select("doc_id", "label", "text").repartition(1).mapInArrow(run, "model binary").first()
    return None if found is None else pickle.loads(found[0])


def learn(sample: pa.Table) -> Model:
    texts = sample.column("text").cast(pa.large_string())
    parts = [features(buf, offsets) for _, _, buf, offsets in text_slices(texts, 200_000)]
    rows = np.concatenate([r for r, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    del parts
    label = sample.column("label").to_numpy().astype(np.int64)
    known = _function_table()
    held = (mix(sample.column("doc_id").to_numpy().view(np.uint64)) % _U(CALIBRATION)) == 0

    def part(mask):
        pick = np.flatnonzero(mask)
        index = np.concatenate([np.arange(first[t], first[t + 1]) for t in pick]) if len(pick) else np.zeros(0, np.int64)
        return rows[index], np.concatenate([[0], np.cumsum(np.diff(first)[pick])]), label[pick]

    if len(set(label[~held])) < 2 or len(set(label[held])) < 2:
        held = np.zeros(len(label), bool)
    model = train(*part(~held))
    calibrate(model, *part(held if held.any() else ~held), known)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model learnt, in one task, from labelled rows that are not held out; None without both classes."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("label")).filter("doc_id is not null and label in (0, 1)")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    return trained(bounded_sample(docs, usable, LONGEST, ROWS, "toxicity"), learn)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score: one row a document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return narrow.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, _function_table()
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch.column(1), 200_000):
                rows, first = features(buf, offsets)
                logit = own.logits(rows, first) - own.threshold[languages(rows, first, known)]
                points = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(points.astype(np.float64))], names=["doc_id", "score"])

    return narrow.mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not judged toxic, with all their columns."""
    model = fit(docs, labels)
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, _function_table()
        for batch in batches:
            clean = []
            for _, _, buf, offsets in text_slices(batch.column(at), 200_000):
                rows, first = features(buf, offsets)
                clean.append(own.logits(rows, first) < own.threshold[languages(rows, first, known)])
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(run, docs.schema)

"""Substring dedup over a de Bruijn graph of word k-mers.

Every window of k = 20 words of one document is an edge between its first and last 19
words. Edges are dealt to partitions in the short paths that a document walks through
one minimizer (the window's least hash of 8 words, leftmost), as is done to compact such
graphs on disk. Equal windows have equal minimizers, so all occurrences of an edge meet
where its minimizer is dealt. There, sorted by source coordinates (doc_id, start), an
edge whose words occur at an earlier coordinate is repeated. Repeated edges that follow
one another in a document compact into paths, which a join by doc_id brings to the
texts; each word on a repeated path goes. The 19-word nodes are not built as rows and
their degrees not counted: whether the next edge follows is told by coordinates.

Equal paths within a task's share of the texts are told before the shuffle: only the
earliest is dealt by its minimizer, the others are known to be repeated and are spread
evenly, so a passage in a third of all documents costs its partition one row a task.

An edge is known by 120 bits: 64 of its minimizer's hash and EDGE_BYTES bytes of its own.

Defined results: a null text has no words; a text with fewer than 20 words keeps all;
a row with a null doc_id has no coordinate, so it is neither a source nor changed;
rows with one doc_id are repeats of one document and get one result each; an empty
table gives an empty result; extra columns are ignored by `dedup_report` and passed
through by `dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import fresh, packed_texts, shuffle_partitions, unpacked
from wayfind.llm.textops import gram_hashes, mix, signed, text_slices, word_hashes, words_of

WINDOW = 20
MINIMIZER = 8
#: Windows that a task gathers before it tells equal paths apart.
GATHER = 1_000_000

#: Bytes of an edge's hash that are dealt, beside the hash of its minimizer.
EDGE_BYTES = 7

_U = np.uint64


def paths_of(buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW, small: int = MINIMIZER):
    """Per path of windows with one minimizer: minimizer, text, first window, windows; and all windows' hashes, first index of each path's in them."""
    words = words_of(buf, offsets)
    hashes = word_hashes(buf, words)
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.view(np.uint64), none, none, none, none.view(np.uint64), none
    text_of = np.repeat(np.arange(len(offsets) - 1), words.counts)
    edges = gram_hashes(hashes, window)
    inside = text_of[: n - window + 1] == text_of[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return none.view(np.uint64), none, none, none, none.view(np.uint64), none
    grams = gram_hashes(hashes, small)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - small + 1).argmin(axis=1)
    where = at + least[at]
    text = text_of[at]
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return grams[where[first]], text[first], at[first] - words.first[text[first]], count, edges[at], first


def _take_runs(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of values[first : first + count]."""
    ends = np.cumsum(count)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)
    return values[index]


def _binary(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Runs of hashes, EDGE_BYTES of each, as one binary each."""
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * EDGE_BYTES
    low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES])
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(low.tobytes())])


def _hashes(column: pa.Array) -> np.ndarray:
    """The values of all runs of such a column."""
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1]
    low = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, EDGE_BYTES)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :EDGE_BYTES] = low
    return out.view("<u8").ravel().astype(np.uint64)


#: place is 64 times a path's first window, plus its number of windows.
DEALT = "minimizer long, doc_id long, place long, edges binary"


def _deal(window: int, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def tell():
            minimizer, doc, start, count, edges = (np.concatenate([h[i] for h in held]) for i in range(5))
            first = np.cumsum(count) - count
            content = mix(edges[first] + mix(edges[first + count - 1]) + count.astype(np.uint64))
            order = np.lexsort((start, doc, content, minimizer))
            a, b = order[1:], order[:-1]
            equal = np.zeros(len(order), bool)
            equal[1:] = (minimizer[a] == minimizer[b]) & (content[a] == content[b])
            lead = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
            later = np.zeros(len(order), bool)
            later[order] = equal & ((doc[order] != doc[lead]) | (start[order] != start[lead]))
            dealt = np.sort(order[~equal])
            told = np.flatnonzero(later)
            for rows, known in ((dealt, False), (told, True)):
                if not len(rows):
                    continue
                if known:
                    key, binary = mix(doc[rows].astype(np.uint64) * _U(31) + start[rows].astype(np.uint64)), pa.nulls(len(rows), pa.binary())
                else:
                    key, binary = minimizer[rows], _binary(_take_runs(edges, first[rows], count[rows]), count[rows])
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(doc[rows]), pa.array(start[rows] * 64 + count[rows]), binary], names=["minimizer", "doc_id", "place", "edges"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in text_slices(batch.column(1)):
                minimizer, text, start, count, edges, _ = paths_of(buf, offsets, window, small)
                if len(minimizer):
                    held.append((minimizer, ids[lo:hi][text], start, count, edges))
                    size += len(edges)
                if size >= GATHER:
                    yield from tell()
                    held, size = [], 0
        if held:
            yield from tell()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of paths sorted by minimizer and coordinates: windows that occurred earlier."""
    names = ["doc_id", "start", "n"]
    # of the minimizer that the last batch ended with: its windows so far and their first coordinates
    kept_m, kept_w, kept_doc, kept_at = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        minimizer, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        start, count = place >> 6, place & 63
        edges = batch.column(3)
        known = edges.is_null().to_numpy(zero_copy_only=False)
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(start[known].astype(np.int32)), pa.array(count[known].astype(np.int32))], names=names)
            rest = np.flatnonzero(~known)
            if not len(rest):
                continue
            minimizer, doc, start, count, edges = minimizer[rest], doc[rest], start[rest], count[rest], edges.take(pa.array(rest))
        flat = _hashes(edges)
        met = np.zeros(len(minimizer), bool)
        same = minimizer[1:] == minimizer[:-1]
        met[1:] |= same
        met[:-1] |= same
        met |= minimizer == minimizer[-1]  # the next batch may go on with it
        if kept_m is not None:
            met |= minimizer == kept_m
        rows = np.flatnonzero(met)
        first = np.cumsum(count) - count
        c = count[rows].astype(np.int64)
        w_edge = _take_runs(flat, first[rows], c)
        w_m, w_doc = np.repeat(minimizer[rows], c), np.repeat(doc[rows], c)
        w_at = np.arange(len(w_edge)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[rows].astype(np.int64), c)
        before = 0
        if kept_m is not None and len(kept_w) and minimizer[0] == kept_m:
            before = len(kept_w)
            w_edge, w_m = np.concatenate([kept_w, w_edge]), np.concatenate([np.full(before, kept_m), w_m])
            w_doc, w_at = np.concatenate([kept_doc, w_doc]), np.concatenate([kept_at, w_at])
        # coordinates ascend within a minimizer but for windows within a path that begins earlier, so they are sorted too
        order = np.lexsort((w_at, w_doc, w_edge, w_m))
        a, b = order[1:], order[:-1]
        equal = np.zeros(len(order), bool)
        equal[1:] = (w_edge[a] == w_edge[b]) & (w_m[a] == w_m[b])
        lead = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
        again = np.zeros(len(order), bool)
        again[order] = equal & ((w_doc[order] != w_doc[lead]) | (w_at[order] != w_at[lead]))
        last = minimizer[-1]
        leads = order[~equal]
        leads = leads[w_m[leads] == last]
        kept_m, kept_w, kept_doc, kept_at = last, w_edge[leads], w_doc[leads], w_at[leads]
        hit = np.flatnonzero(again[before:]) + before
        if len(hit):
            run = np.ones(len(hit), bool)
            run[1:] = (w_doc[hit][1:] != w_doc[hit][:-1]) | (w_at[hit][1:] != w_at[hit][:-1] + 1)
            head = np.flatnonzero(run)
            yield pa.RecordBatch.from_arrays([pa.array(w_doc[hit][head]), pa.array(w_at[hit][head].astype(np.int32)), pa.array(np.diff(np.append(head, len(hit))).astype(np.int32))], names=names)


def repeated_runs(docs: DataFrame, window: int = WINDOW, small: int = MINIMIZER) -> DataFrame:
    """doc_id, start, n: runs of windows (by their first word) whose words occur earlier."""
    if not 0 < window - small < 63:
        raise ValueError("a path holds fewer than 64 windows")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    dealt = given.mapInArrow(_deal(window, small), DEALT)
    return (
        dealt.repartition(shuffle_partitions(docs.sparkSession), "minimizer").sortWithinPartitions("minimizer", "doc_id", "place")
        .mapInArrow(_repeated, "doc_id long, start int, n int")
    )


def kept_words(text: bytes, runs, window: int) -> tuple[list[bytes], int]:
    """The words that no repeated window covers, and how many there were."""
    words = text.split()
    if not runs:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        change[run["start"]] += 1
        change[min(run["start"] + run["n"] + window - 1, len(words))] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return list(compress(words, keep.tolist())), len(words)


def _runs_by_document(docs: DataFrame, window: int, doc: str, runs: str) -> DataFrame:
    return repeated_runs(docs, window).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("start", "n")).alias(runs))


def dedup_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for packed, runs in zip(batch.column(1), batch.column(2), strict=True):
                kept, n = kept_words(unpacked(packed), runs.as_py(), window)
                n_words.append(n)
                n_removed.append(n - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = _runs_by_document(narrow, window, "_doc", "_runs")
    packed = packed_texts(narrow)
    return packed.join(runs, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "packed", "_runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated words: changed texts have their kept words joined by a space.

    A document of which no word is left goes; n_chars, if there, follows the new text.
    """

    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, runs = batch.columns[:-1], batch.columns[-1]
            texts, keep, size = columns[at].to_pylist(), np.ones(batch.num_rows, bool), None
            changed = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            if chars is not None:
                size = columns[chars].to_pylist()
            for i in changed.tolist():
                texts[i] = b" ".join(kept_words(texts[i].encode(), runs[i].as_py(), window)[0]).decode()
                keep[i] = bool(texts[i])
                if size is not None:
                    size[i] = len(texts[i])
            if len(changed):
                columns[at] = pa.array(texts, columns[at].type)
                if size is not None:
                    columns[chars] = pa.array(size, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    doc, runs = fresh(docs, "doc", "runs")
    joined = docs.join(_runs_by_document(docs, window, doc, runs), F.col("doc_id").cast("long") == F.col(doc), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], runs).mapInArrow(run, docs.schema)

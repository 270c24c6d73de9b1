"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: each partition tokenises its documents and packs the
pieces best-fit into bins of its own. Nearly full bins are emitted. The underfull ones
go on as items, each as long as it is full, and are packed best-fit again in a tree of
groups of partitions, round by round; those that become nearly full are emitted. A group
of more than MERGE items is split by hash into subgroups of about that many; what they
leave meets in later rounds. The bins that the top of the tree leaves underfull, however
many, are opened, and their pieces packed by one best fit over all of them: the fit is
reckoned on counts by length, and each piece finds its bin by its number among those of
its length.

Ids are those of the public byte-level vocabulary (rank file of the same vocabulary,
whose library is three times as fast; a test holds the two equal). A document longer
than a sequence is cut so that its first piece takes the remainder. Jobs run while the
plan is built (each `cut`).

Defined results: a null or empty text is one piece with the end id alone; a null
doc_id stays null; repeated rows are packed each by itself; an empty table gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import cut

LENGTH = 1024
END_ID = 2
SPECIAL = {"<|endoftext|>": 50256}
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bins with at most so many free places count as nearly full.
SLACK = 8
#: Partitions that meet in one group, in each round.
FAN_IN = 16
#: Pieces that a partition gathers before it packs them.
BUFFER = 200_000
#: Bins that one merge packs as items; a group of more is split.
MERGE = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long, bin long, place long, open boolean"


def encoder(path: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


class Bins:
    """Open bins by free places; the smallest that still fits is found in a bit mask."""

    def __init__(self, length: int):
        self.length, self.mask, self.open, self.fill = length, 0, [[] for _ in range(length + 1)], []

    def put(self, size: int) -> tuple[int, int]:
        """(bin, place in it)."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self.open[free].pop()
            if not self.open[free]:
                self.mask &= ~(1 << free)
        else:
            free, number = self.length, len(self.fill)
            self.fill.append(0)
        place = self.fill[number]
        self.fill[number] += size
        left = free - size
        if left:
            self.open[left].append(number)
            self.mask |= 1 << left
        return number, place


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and place, and each bin's fill."""
    bins, where, place = Bins(length), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        where[i], place[i] = bins.put(int(sizes[i]))
    return where, place, np.asarray(bins.fill, np.int64)


def underfull(fill: np.ndarray, length: int) -> np.ndarray:
    """Whether each bin is not nearly full."""
    return fill < length - SLACK


def fit_counts(counts: dict[int, int], length: int) -> np.ndarray:
    """Best fit, largest first, of so many items of each length: rows of (length, number of the first item, first bin, items a bin, place of the first)."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # ranges of equal bins: first, how many
    rows, bins = [], 0
    for size in sorted(counts, reverse=True):
        done, room = 0, size
        while done < counts[size]:
            while room < length and not free[room]:
                room += 1
            each = room // size
            if free[room]:
                first, many = free[room].pop()
            else:
                first, many = bins, -(-(counts[size] - done) // each)
                bins += many
            here = min(many * each, counts[size] - done)
            rows.append((size, done, first, each, length - room))
            done += here
            full, part = divmod(here, each)
            for start, n, left in ((first, full, room - each * size), (first + full, int(part > 0), room - part * size), (first + full + (part > 0), many - full - (part > 0), room)):
                if n and left:
                    free[left].append((start, n))
    return np.array(rows, np.int64).reshape(-1, 5)


def _tokenise_and_pack(path: str | None, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        special = re.compile("|".join(map(re.escape, SPECIAL)))
        base = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        bins = items = 0

        def flush():
            nonlocal held, bins, items
            doc, piece, start, size, crc = zip(*held, strict=True)
            sizes = np.asarray(size, np.int64)
            where, place, fill = best_fit(sizes, length)
            out = pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(base + items + np.arange(len(sizes))), pa.array(base + bins + where), pa.array(place), pa.array(underfull(fill, length)[where])],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )
            held, bins, items = [], bins + len(fill), items + len(sizes)
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py() or ""
                ids = np.append(encode.encode_to_numpy(text, allowed_special="all" if special.search(text) else set(), disallowed_special=()), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % length + 1
                edges = [0, *range(first, len(ids) + 1, length)]
                held.extend((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
                if len(held) >= BUFFER:
                    yield flush()
        if held:
            yield flush()

    return run


def _merge(length: int):
    """One group's round: each underfull bin's new bin (named by one of those in it), its place there, and that bin's fill."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        items = pdf["bin"].to_numpy()
        where, place, fill = best_fit(pdf["fill"].to_numpy(), length)
        name = np.empty(len(fill), np.int64)
        name[where[::-1]] = items[::-1]
        return pd.DataFrame({"bin": items, "into": name[where], "at": place, "fill": fill[where]})

    return run


def _number(length: int):
    """Each item's partition and its number there among the items of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            order = np.argsort(sizes, kind="stable")
            counts = np.bincount(sizes, minlength=length + 1)
            number = np.empty(len(sizes), np.int64)
            number[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(sizes), part)), pa.array(number)], names=["item", "length", "part", "number"])

    return run


def _settle(items: DataFrame, length: int, base: int) -> DataFrame:
    """item, own_bin, own_place: best fit over all items at once, into bins from base on."""
    numbered = cut(items.mapInArrow(_number(length), "item long, length long, part long, number long"))
    counts = cut(numbered.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    plan = fit_counts({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, length)  # one row a length
    shared = items.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = -plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            sizes, number = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            _, first_item, first_bin, each, place = plan[np.searchsorted(keys, -sizes << 48 | number, side="right") - 1].T
            nth, row = np.divmod(number - first_item, each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base + first_bin + nth), pa.array(place + row * sizes)], names=["item", "own_bin", "own_place"])

    placed = numbered.join(cut(before), ["length", "part"]).select("item", "length", (F.col("number") + F.col("before")).alias("number"))
    return cut(placed.mapInArrow(run, "item long, own_bin long, own_place long"))


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, merge: int = MERGE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    ids = F.col("doc_id").cast("long")
    local = cut(docs.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokenise_and_pack(vocabulary, length), PIECES))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = local.filter("not open").select(*own, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    last = local.agg(F.max(F.shiftright("bin", 32))).first()[0]
    if last is None:
        return done
    loose = local.filter("open")
    # first: each underfull local bin; root: the bin that it is in now, at: its place there
    bins = cut(loose.groupBy(F.col("bin").alias("first")).agg(F.sum("length").alias("fill")).select("first", F.col("first").alias("root"), F.lit(0).cast("long").alias("at"), "fill"))
    closed, span = None, 1
    while closed is None or span <= last:
        span *= FAN_IN
        grouped = bins.groupBy(F.col("root").alias("bin")).agg(F.first("fill").alias("fill")).withColumn("group", F.expr(f"shiftright(bin, 32) div {span}"))
        split = grouped.groupBy("group").agg(F.ceil(F.count("*") / merge).alias("split"))
        salted = grouped.join(split, "group").withColumn("salt", F.pmod(F.xxhash64(F.lit(span), "bin"), F.col("split")))
        merged = salted.select("bin", "fill", "group", "salt").groupBy("group", "salt").applyInPandas(_merge(length), "bin long, into long, at long, fill long")
        moved = bins.drop("fill").join(merged.withColumnRenamed("at", "shift"), F.col("root") == F.col("bin"))
        bins = cut(moved.select("first", F.col("into").alias("root"), (F.col("at") + F.col("shift")).alias("at"), "fill"))
        full = bins.filter(F.col("fill") >= length - SLACK)
        closed = full if closed is None else closed.union(full)
        bins = bins.filter(F.col("fill") < length - SLACK)
    emitted = loose.join(closed.drop("fill"), F.col("bin") == F.col("first")).select(*own, F.col("root").alias("sequence_id"), (F.col("at") + F.col("place")).alias("offset"))
    rest = cut(loose.join(bins.select("first"), F.col("bin") == F.col("first"), "left_semi").select(*own, "item"))
    settled = _settle(rest.select("item", "length"), length, last + 1 << 32)
    settled = rest.join(settled, "item").select(*own, F.col("own_bin").alias("sequence_id"), F.col("own_place").alias("offset"))
    return done.union(emitted).union(settled)

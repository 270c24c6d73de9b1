"""N-gram Jaccard join: a size-aware heavy-light join on word shingles.

Two sets of a and b shingles link when 100 * common >= percent * united, which is
(100 + percent) * common >= percent * (a + b). Sets are told apart by size:

* light sets (up to a boundary that a cost count over the size histogram chooses)
  enumerate their subsets of every size that a partner can require; sets that share
  such a subset link, so the smallest set of each subset is a star's centre;
* heavy sets are found by scanning inverted lists twice. First lists of single tokens:
  each set enters those of its first tokens, so many that any partner must share a known
  number of them, and sets with less company than that go. Then, for the sets that are
  left, lists of token groups (see `group_keys`): tokens are dealt into so many groups
  that two linked sets have a group in common that is not empty and equal as a whole,
  which sets that merely share a passage seldom have. Each list is compared, by exact
  overlap, with one centre, and only what this leaves in several components is compared
  further: with a second centre, then pair by pair (see `_across`), which is exact.

Equal sets are one class from the start and are never expanded into pairs. Only
connectivity between classes is sought, so members of one component are not compared.
A task tells the company that it meets itself, so a token in a third of all sets sends
two rows a task to its list. Several jobs run while the plan is built (each `cut`).

Defined results: a null or wordless text has an empty set, no link and itself as its
component; a null doc_id takes the component of its equal sets, else null; repeated
rows each get the same row, and rows that share a doc_id are one node; an empty table
gives an empty result; extra columns, whatever their names, are ignored by
`near_duplicates` and passed through by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import cut, fresh, packed_texts, release, shuffle_partitions, unpacked
from wayfind.llm.components import components
from wayfind.llm.textops import LOWER, gram_hashes, mix, signed, text_slices, word_hashes, words_of

SHINGLE = 5
PERCENT = 75
#: Boundaries between light and heavy sets among which the cost count chooses (a set of five has six subsets of four or more).
BOUNDARIES = range(4, 17)
#: What scanning and checking one entry of an inverted list costs, in subsets.
SCAN_COST = 8
#: Beyond the tokens of which a partner must share one, this share of a set enters the lists too.
MORE = 0.1
#: Tokens a group of the largest sets that are dealt alike; smaller groups are dealt where these do not suffice.
GROUP = 2.5
#: The share of its size in lists of token groups that a set may leave.
SPARE = 0.05
#: Entries that a task gathers before it tells company, and classes that it remembers.
GATHER = 1_000_000

_U = np.uint64


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    low = np.take(LOWER, buf)
    words = words_of(low, offsets)
    hashes = word_hashes(low, words)
    grams = gram_hashes(hashes, shingle)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set's tokens."""
    a, b = mix(tokens).sum(dtype=np.uint64), mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _keys(shingle: int):
    """Per document its set's size and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(buf, offsets, shingle)
                keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
                yield _batch("doc_id n cid cid2", batch.column(0).slice(lo, hi - lo), np.array([len(s) for s in sets], np.int32), keys[:, 0], keys[:, 1])

    return run


def least_overlap(n: int, percent: int) -> int:
    """The fewest tokens that a set of n shares with any partner."""
    return -(-percent * n // 100)


def shared_entries(n: int) -> int:
    """The list entries that two sets of n or more share at least, if they link."""
    return int(n * MORE) + 1


def entries_of(n: int, percent: int) -> int:
    """The tokens of a set of n that enter the lists."""
    return min(n, n - least_overlap(n, percent) + shared_entries(n))


def subset_keys(tokens: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(key, size) of the subsets that a partner may require."""
    mixed = mix(tokens)
    return [
        (int(mix(mixed[list(pick)].sum(dtype=np.uint64, keepdims=True) + _U(size)).view(np.int64)[0]), size)
        for size in range(least_overlap(len(tokens), percent), len(tokens) + 1)
        for pick in combinations(range(len(tokens)), size)
    ]


def light_boundary(histogram: dict[int, int], percent: int) -> int:
    """The boundary with the least cost: subsets of the light against list entries of the heavy."""

    def cost(x: int) -> int:
        top = x * 100 // percent
        subsets = sum(c * sum(comb(n, k) for k in range(least_overlap(n, percent), n + 1)) for n, c in histogram.items() if n <= top)
        return subsets + SCAN_COST * sum(c * entries_of(n, percent) for n, c in histogram.items() if n > x)

    return min(BOUNDARIES, key=lambda x: (cost(x), x))


#: Rows of the first scan by size: n > 0, an entry of a heavy set (a its class; b 1 if its company is told
#: already); below 0, a light set's subset of -size tokens (a its n, b its class); LINK, two linked light
#: classes; TOLD, company that a task has told (a the class, b 2**32 times its size plus the number of entries).
ROWS = "token size a b"
TOLD, LINK = 0, -(1 << 20)


def _tell_heavy(token: np.ndarray, cid: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of distinct classes: those alone in their list are dealt, the others counted, and two of each list dealt."""
    order = np.argsort(token, kind="stable")
    same = token[order[1:]] == token[order[:-1]]
    after, before = np.append(same, False), np.append(False, same)
    second = before & ~np.append(False, before[:-1])
    company = np.empty(len(order), bool)
    company[order] = after | before
    dealt = np.sort(order[~(after | before) | ~before | second])  # class by class, which compresses better
    yield _batch(ROWS, token[dealt], n[dealt], cid[dealt], company[dealt].astype(np.int64))
    if company.any():
        told, at, count = np.unique(cid[company], return_index=True, return_counts=True)
        yield _batch(ROWS, told, np.full(len(told), TOLD, np.int32), told, (n[company][at].astype(np.int64) << 32) + count)


def _tell_light(token: np.ndarray, cid: np.ndarray, n: np.ndarray, size: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Subsets: sets that link with the smallest owner do so at once, the owner and all others are dealt."""
    order = np.lexsort((cid, n, token))
    token, cid, n, size = token[order], cid[order], n[order], size[order]
    first = np.append(True, token[1:] != token[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
    linked = ~first & (size * (100 + percent) >= (n + n[lead]) * percent)
    yield _batch(ROWS, token[~linked], -size[~linked], n[~linked].astype(np.int64), cid[~linked])
    linked &= cid != cid[lead]
    if linked.any():
        yield _batch(ROWS, cid[linked], np.full(int(linked.sum()), LINK, np.int32), cid[lead][linked], cid[linked])


def _entries(shingle: int, percent: int, boundary: int):
    """Each class's list entries and subsets, once a task (or so)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        heavy: list[tuple] = []
        light: list[tuple] = []
        held = 0

        def tell():
            if heavy:
                yield from _tell_heavy(*map(np.concatenate, zip(*heavy, strict=True)))
            if light:
                yield from _tell_light(*map(np.concatenate, zip(*light, strict=True)), percent)

        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column(0)):
                for s in shingle_sets(buf, offsets, shingle):
                    n = len(s)
                    if not n or (key := set_key(s)[0]) in met:
                        continue
                    met.add(key)
                    if n <= boundary * 100 // percent:
                        found = subset_keys(s, percent)
                        light.append((np.array([k for k, _ in found], np.int64), np.full(len(found), key, np.int64), np.full(len(found), n, np.int32), np.array([c for _, c in found], np.int32)))
                        held += len(found)
                    if n > boundary:
                        p = entries_of(n, percent)
                        heavy.append((signed(s[:p] >> _U(16)), np.full(p, key, np.int64), np.full(p, n, np.int32)))  # 48 bits will do: equal ones of unequal tokens only tell too much company
                        held += p
                if held >= GATHER:
                    yield from tell()
                    heavy, light, held = [], [], 0
                    if len(met) >= GATHER:
                        met = set()
        yield from tell()

    return run


def _scan(percent: int):
    """Of rows sorted by all their columns: cid, n, entries with company; and links of light classes (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "cid n entries a b"
        last = None  # of heavy entries: the last one (token, n, class, told), and whether its list has another class
        owner = None  # of subsets: the last token and its owner's size and class

        def counted(cid, n, entries):
            none = pa.nulls(len(cid), pa.int64())
            return _batch(names, cid, n, entries, none, none)

        def links(a, b):
            none = pa.nulls(len(a), pa.int64())
            return _batch(names, none, pa.nulls(len(a), pa.int32()), none, a, b)

        def summed(cid, n):
            own, at, count = np.unique(cid, return_index=True, return_counts=True)
            return counted(own, n[at], count.astype(np.int64))

        for batch in batches:
            token, size, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            told = size == TOLD
            if told.any():
                yield counted(a[told], (b[told] >> 32).astype(np.int32), b[told] & 0xFFFFFFFF)
            done = size == LINK
            if done.any():
                yield links(a[done], b[done])
            mine = (size < 0) & ~done
            if mine.any():
                t, c, n, cid = token[mine], -size[mine].astype(np.int64), a[mine], b[mine]
                first = np.append(True, t[1:] != t[:-1])
                lead = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
                n0, cid0 = n[lead], cid[lead]
                if owner is not None and owner[0] == t[0]:
                    n0[lead == 0], cid0[lead == 0] = owner[1:]
                owner = (t[-1], n0[-1], cid0[-1])
                linked = (c * (100 + percent) >= (n + n0) * percent) & (cid != cid0)
                if linked.any():
                    yield links(cid0[linked], cid[linked])
            mine = size > 0
            if mine.any():
                columns, before = [token[mine], size[mine], a[mine], b[mine]], False
                if last is not None:
                    columns = [np.concatenate([h, c]) for h, c in zip(last[0], columns, strict=True)]
                    before = last[1]
                t, n, cid, known = columns
                new = np.append(True, (t[1:] != t[:-1]) | (cid[1:] != cid[:-1]) | (n[1:] != n[:-1]))
                t, n, cid, known = t[new], n[new], cid[new], known[new]
                same = t[1:] == t[:-1]
                company = np.append(same, False) | np.append(False, same)
                company[0] |= before
                last = ([t[-1:], n[-1:], cid[-1:], known[-1:]], bool(company[-1]))
                company[-1] = False
                company &= known == 0
                if company.any():
                    yield summed(cid[company], n[company])
        if last is not None and last[1] and not last[0][3][0]:
            yield summed(last[0][2], last[0][1])

    return run


def token_groups(tokens: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Keys of the token groups of a set, by which it meets any partner, once for partners of its own class of sizes or the next, once for the class before.

    Sizes fall into classes so that partners are of one or of adjacent classes, and each
    two adjacent classes deal tokens by hash into the same number m of groups. Linked sets
    differ in at most D = (a + b) * (100 - percent) / (100 + percent) tokens, so at most D
    of the groups differ. A set that fills f > D groups has f - D of them in common with
    any partner, and one of any D + 1: the first in an order by falling size will do.
    A set that fills too few is dealt again into twice as many groups, and so on; of a pair,
    both are as long as neither fills enough. Returned are the keys from such dealings,
    those of the last one in order, and D.
    """
    n = len(tokens)
    low = [1]
    while low[-1] <= n:
        low.append(low[-1] * 100 // percent + 1)
    own = len(low) - 2
    hashed = mix(tokens ^ _U(0x2545F4914F6CDD1D))
    out = []
    for k in (own, own - 1) if own else (own,):
        end = low[k + 1] * 100 // percent + 1  # of the sizes of both classes
        partner = min(end - 1, n * 100 // percent) if k == own else low[own] - 1
        differ = (n + partner) * (100 - percent) // (100 + percent)
        m, before = max(1, int(end / GROUP)), []
        while True:
            group = (hashed >> _U(33)) % _U(m)
            order = np.argsort(group, kind="stable")
            filled, at = np.unique(group[order], return_index=True)
            salt = mix(np.array([m * 64 + k], np.uint64))
            keys = mix(np.add.reduceat(hashed[order], at) + mix(filled + salt))
            if len(keys) > differ:
                break
            before.append(keys)
            m *= 2
        size = np.diff(np.append(at, n))
        out.append((np.concatenate(before) if before else keys[:0], keys[np.lexsort((keys, -size))], differ))
    return out


def _token_sets(shingle: int):
    """Of rows (id, cid, rank, packed text): each id's set, if it is that of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([unpacked(v) for v in batch.column(3)], pa.large_binary())
            for lo, hi, buf, offsets in text_slices(raw):
                sets = shingle_sets(buf, offsets, shingle)
                keys = np.array([set_key(s)[0] for s in sets], np.int64)
                right = np.flatnonzero(keys == batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                if not len(right):
                    continue
                sets, at = [sets[i] for i in right.tolist()], pa.array(right + lo)
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(signed(np.concatenate(sets))))
                yield _batch("id n rank tokens", batch.column(0).take(at), np.diff(edges), batch.column(2).take(at), lists)

    return run


def _listed(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    flat, edges = batch.column(column).values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column(column).offsets.to_numpy()
    return (flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _whole_groups(percent: int):
    """Of rows (id, tokens): every token group as key, id and tag: twice the groups in common with any partner, plus which classes it is for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, tags = [], [], []
            for key, tokens in zip(batch.column(0).to_pylist(), _listed(batch, 1), strict=True):
                for slot, (before, last, differ) in enumerate(token_groups(tokens, percent)):
                    keys += [before, last]
                    ids.append(np.full(len(before) + len(last), key, np.int64))
                    tags.append(np.full(len(before) + len(last), 2 * (0 if len(before) else len(last) - differ) + slot, np.int32))
            if keys:
                yield _batch("key id tag", signed(np.concatenate(keys)), np.concatenate(ids), np.concatenate(tags))

    return run


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and id: id, tag and how many of them share their key with another id."""
    last, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if last is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(last, columns, strict=True)]
        key, ids, tag = columns
        same = key[1:] == key[:-1]
        other = same & (ids[1:] != ids[:-1])
        company = np.append(other, False) | np.append(False, other)
        company[0] |= before
        last, before = [c[-1:] for c in columns], bool(company[-1])
        company[-1] = False
        if company.any():
            pairs, count = np.unique(np.stack([ids[company], tag[company].astype(np.int64)], axis=1), axis=0, return_counts=True)
            yield _batch("id tag shared", pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), count.astype(np.int64))
    if last is not None and before:
        yield _batch("id tag shared", last[1], last[2], np.ones(1, np.int64))


def spare_lists(n: int) -> int:
    """The lists of token groups that a set of n may leave: linked sets share twice as many, and one more."""
    return int(n * SPARE)


def first_groups(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys of so many token groups that any partner shares more of them than both sets may leave, and how many this one may.

    A set that has too few groups for that gives all it has and leaves none.
    """
    keys, n = [], len(tokens)
    spare, more = spare_lists(least_overlap(n, percent)), 1 + 2 * spare_lists(n)
    for before, last, differ in token_groups(tokens, percent):
        if len(before) or len(last) < differ + more:
            keys += [before, last]
            spare = 0
        else:
            keys.append(last[: differ + more])
    return np.concatenate(keys), spare


def _first_groups(percent: int):
    """Of rows (tokens, rank, id, ...): key, spare and all columns but the tokens, for the first groups of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first_groups(t, percent) for t in _listed(batch, 0)]
            if found:
                many = [len(keys) for keys, _ in found]
                row = pa.array(np.repeat(np.arange(len(found)), many))
                keys, spare = np.concatenate([keys for keys, _ in found]), np.repeat(np.array([x for _, x in found], np.int32), many)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(spare), *[c.take(row) for c in batch.columns[1:]]], names=["key", "spare", *batch.schema.names[1:]])

    return run


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, rank and id: each list's first id with each other one, how many lists that other one may leave, and in how many the two meet."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, spare, _, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        first = np.append(True, key[1:] != key[:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        centre = ids[lead]
        if last is not None and last[0] == key[0]:
            centre[lead == 0] = last[1]
        last = (key[-1], centre[-1])
        other = centre != ids
        if other.any():
            pairs, count = np.unique(np.stack([centre[other], ids[other], spare[other].astype(np.int64)], axis=1), axis=0, return_counts=True)
            yield _batch("centre id spare lists", pairs[:, 0].copy(), pairs[:, 1].copy(), pairs[:, 2].astype(np.int32), count.astype(np.int64))


def _unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, rank and id, with components: (centre, id) of each list in which others than the centre are of several components.

    A list that begins or ends a batch may go on beyond it and counts as such.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, _, _, ids, component = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        centre = ids[start]
        if last is not None and last[0] == key[0]:
            centre[0] = last[1]
        last = (key[-1], centre[-1])
        own = np.repeat(centre, size)
        other = ids != own
        big = np.iinfo(np.int64)
        apart = np.minimum.reduceat(np.where(other, component, big.max), start) < np.maximum.reduceat(np.where(other, component, big.min), start)
        apart[[0, -1]] = True
        wanted = other & np.repeat(apart, size)
        if wanted.any():
            pairs = np.unique(np.stack([own[wanted], ids[wanted]], axis=1), axis=0)
            yield _batch("centre id", pairs[:, 0].copy(), pairs[:, 1].copy())


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """centre, id, id's size n, its tokens outside the centre, how many are inside (common), and whether the two link."""
    left = sets.select(F.col("id").alias("centre"), F.col("n").alias("centre_n"), F.col("tokens").alias("tc"))
    joined = left.join(pairs.hint("merge"), "centre").join(sets.hint("merge"), "id")
    counted = joined.select("centre", "id", "centre_n", "n", F.array_except("tokens", "tc").alias("outside")).withColumn("common", F.col("n") - F.size("outside"))
    linked = F.col("common") * (100 + percent) >= (F.col("n") + F.col("centre_n")) * percent
    return counted.select("centre", "id", "n", "common", linked.alias("linked"), "outside")


def _links(met: DataFrame) -> DataFrame:
    return met.filter("linked").select(F.col("centre").alias("a"), F.col("id").alias("b"))


def _across(met: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """centre, id: pairs of members of one centre that the components keep apart and that may yet link.

    Members x and y with bx and by tokens of the centre have at most min(bx, by) + s
    tokens in common, s of them outside the centre. Without any such token they can link
    only if min(bx, by) alone suffices, which bounds y's size; these meet in a list of the
    centre and the size. All others share tokens outside the centre, and either needs a
    known number of them: the smaller one at least what a partner of its own size asks for,
    the larger what its smallest partner does. With the tokens in one order (those that few
    members have first), they share one of so many first tokens, and meet in its list.
    """
    full = 100 + percent
    placed = found.select(F.col("node").alias("id"), "component")
    member = met.join(placed, "id", "left").withColumn("component", F.coalesce("component", "id"))
    middle = placed.select(F.col("id").alias("centre"), F.col("component").alias("middle"))
    member = member.join(middle, "centre", "left").withColumn("out", F.col("component") != F.coalesce("middle", "centre"))
    groups = member.groupBy("centre").agg(F.count("*").alias("members"), F.count_if("out").alias("outsiders"), F.min("n").alias("least")).filter("members > 1 and outsiders > 0")
    member = cut(member.join(groups.select("centre", "least"), "centre").drop("middle", "linked"))
    facts = ["centre", "id", "component", "out", "n", "common"]

    def side(rows: DataFrame, of: str, *more: str) -> DataFrame:
        return rows.select("centre", "at", F.col("id").alias(of), *[F.col(c).alias(f"{of}_{c}") for c in (*facts[2:], *more)])

    apart = F.col("x_component") != F.col("y_component")
    inside = F.least("x_common", "y_common")
    both = F.col("x_n") + F.col("y_n")
    pair = F.least("x", "y").alias("centre"), F.greatest("x", "y").alias("id")
    # by size
    low = F.greatest(F.ceil(F.col("n") * percent / 100).cast("int"), F.col("least"))
    high = F.floor(F.col("common") * full / percent).cast("int") - F.col("n")
    ranged = member.filter("out").select(*facts, F.explode(F.when(low <= high, F.sequence(low, high))).alias("at"))
    by_size = side(ranged, "x").join(side(member.withColumn("at", F.col("n")), "y"), ["centre", "at"]).filter(apart & (inside * full >= both * percent)).select(*pair)
    # by tokens outside the centre
    tokens = member.select(*facts, F.size("outside").alias("all"), F.explode("outside").alias("at"))
    shared = tokens.withColumn("members", F.count("*").over(Window.partitionBy("centre", "at"))).filter("members > 1")
    own = Window.partitionBy("centre", "id", "n", "common")
    place = F.col("all") - F.count("*").over(own) + F.row_number().over(own.orderBy("members", "at"))
    spare = lambda least: F.col("all") - F.greatest(least - F.col("common"), F.lit(1)) + 1
    as_larger = spare(F.ceil(F.col("n") * percent / 100).cast("int"))
    as_smaller = spare(F.ceil(F.col("n") * 2 * percent / full).cast("int"))
    first = shared.select(*facts, "at", "all", place.alias("place"), as_larger.alias("larger"), as_smaller.alias("smaller")).filter("place <= larger").withColumn("behind", F.col("all") - F.col("place"))
    # where two meet first, they have this token outside the centre and no more than stand behind it
    outside = 1 + F.least("x_behind", "y_behind")
    met_there = side(first.filter("place <= smaller"), "x", "behind").join(side(first, "y", "behind"), ["centre", "at"])
    by_token = met_there.filter(apart & (F.col("x_out") | F.col("y_out")) & (F.col("x_n") <= F.col("y_n")) & ((inside + outside) * full >= both * percent)).select(*pair)
    return by_size.union(by_token).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document."""
    parts = shuffle_partitions(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents = cut(given.mapInArrow(_keys(shingle), "doc_id long, n int, cid long, cid2 long"))
    classes = cut(documents.filter("n > 0").groupBy("cid", "n", "cid2").agg(F.min("doc_id").alias("rep")))
    histogram = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= max(BOUNDARIES) * 100 // percent).groupBy("n").count().collect()}
    boundary = light_boundary(histogram, percent)
    dealt = given.select("text").mapInArrow(_entries(shingle, percent, boundary), "token long, size int, a long, b long")
    scanned = dealt.repartition(parts, "token").sortWithinPartitions("token", "size", "a", "b").mapInArrow(_scan(percent), "cid long, n int, entries long, a long, b long")
    scanned = cut(scanned)
    release(docs.sparkSession)
    reps = classes.filter("rep is not null").select("cid", "n", "rep")
    nodes = reps.select("cid", "rep")
    light = scanned.filter("a is not null").select("a", "b").distinct()
    light = light.join(nodes.select(F.col("cid").alias("a"), F.col("rep").alias("ra")), "a").join(nodes.select(F.col("cid").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    # heavy sets with company enough; their rank is the share of entries that have none, in thousandths
    least = F.floor(F.ceil(F.col("n") * percent / 100) * MORE) + 1
    entered = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + F.floor(F.col("n") * MORE) + 1)
    enough = scanned.filter("cid is not null").groupBy("cid", "n").agg(F.sum("entries").alias("entries")).filter(F.col("entries") >= least)
    rank = F.floor(1000 - F.least(F.col("entries") / entered, F.lit(1.0)) * 1000).cast("int")
    wanted = cut(enough.join(reps, ["cid", "n"]).select(F.col("rep").alias("id"), "cid", rank.alias("rank")))
    texts = wanted.hint("merge").join(packed_texts(given).withColumnRenamed("doc_id", "id"), "id").groupBy("id", "cid", "rank", F.xxhash64("packed")).agg(F.first("packed").alias("packed"))
    sets = cut(texts.select("id", "cid", "rank", "packed").mapInArrow(_token_sets(shingle), "id long, n int, rank int, tokens array<long>"))
    release(docs.sparkSession)
    groups = sets.select("id", "tokens").mapInArrow(_whole_groups(percent), "key long, id long, tag int")
    shared = groups.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(_company, "id long, tag int, shared long")
    able = cut(shared.groupBy("id", "tag").agg(F.sum("shared").alias("shared")).filter("shared >= tag div 2").select("id").distinct())
    sets = cut(sets.join(able.hint("merge"), "id", "left_semi"))
    release(docs.sparkSession)
    groups = sets.select("tokens", "rank", "id").mapInArrow(_first_groups(percent), "key long, spare int, rank int, id long")
    pairs = groups.repartition(parts, "key").sortWithinPartitions("key", "rank", "id").mapInArrow(_centred, "centre long, id long, spare int, lists long")
    pairs = pairs.groupBy("centre", "id").agg(F.min("spare").alias("spare"), F.sum("lists").alias("lists"))
    rarest = Window.partitionBy("id").orderBy("lists", "centre").rowsBetween(Window.unboundedPreceding, 0)
    pairs = cut(pairs.withColumn("left", F.sum("lists").over(rarest)).filter("left > spare").select("centre", "id"))
    release(docs.sparkSession)
    met = cut(_overlaps(pairs, sets, percent))
    release(docs.sparkSession)
    found = components(_links(met).union(light))
    placed = sets.join(found.hint("merge"), F.col("id") == F.col("node"), "left").select("tokens", "rank", "id", F.coalesce("component", "id").alias("component"))
    groups = placed.mapInArrow(_first_groups(percent), "key long, spare int, rank int, id long, component long")
    unsettled = groups.repartition(parts, "key").sortWithinPartitions("key", "rank", "id").mapInArrow(_unsettled, "centre long, id long").distinct()
    more = cut(_across(met.join(unsettled.hint("merge"), ["centre", "id"], "left_semi"), found, percent))
    release(docs.sparkSession)
    more = cut(_links(_overlaps(more, sets, percent)))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("cid", "n", "cid2", F.coalesce("component", "rep").alias("component_id"))
    joined = documents.alias("d").join(of_class.alias("c"), ["cid", "n", "cid2"], "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, one of each component: that with the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows with a null doc_id stay.
    """
    key, = fresh(docs, "gone")
    judged = cut(near_duplicates(docs, shingle, percent).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id")))
    gone = judged.filter("doc_id <> component_id").select(F.col("doc_id").alias(key))
    kept = docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left_anti")
    if judged.filter("rows > 1").isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
